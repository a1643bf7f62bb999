"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this family splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file of ranks; loaded once per Python worker.

    A machine without the file takes the copy that ``share`` sent along.
    """
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def share(spark: SparkSession, path: str = VOCABULARY) -> str:
    """Sends a vocabulary file to every machine of the application; further calls do nothing."""
    spark.sparkContext.addFile(path)
    return path


def count(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a text; strings of special tokens are ordinary text."""
    return len(encoding(path).encode_ordinary(text))


def token_count(column: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text column; null for null, 0 for an empty text."""

    @F.pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        e = encoding(path)
        return texts.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int64")

    return run(column)
