"""Embedding providers behind one interface: a text column in, a vector of length one out."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embed:
    """Signed word hashing with a fixed dimension; needs no model and gives the same vector everywhere.

    A stand-in for tests and dry runs: near words are not near in it.
    """

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            words = pd.Series(t.lower().split(), dtype=object)
            if len(words):
                h = pd.util.hash_array(words.to_numpy(), categorize=False)
                np.add.at(out[i], (h % dim).astype(int), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0))
        return out

    return embed


def http_embedder(url: str, model: str, attempts: int = 3, pause: float = 1.0, timeout: float = 300.0, dim: int | None = None) -> Embed:
    """A server that takes ``{"model", "input"}`` at ``/api/embed``, or one text at a time at ``/api/embeddings``; retries with growing pauses.

    With ``dim``, vectors of another dimension are an error.
    """

    def post(path: str, body: dict) -> dict:
        request = urllib.request.Request(url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        for k in range(attempts):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError:
                raise
            except OSError:
                if k == attempts - 1:
                    raise
                time.sleep(pause * 4**k)
        raise RuntimeError("no attempt allowed")

    def embed(texts: list[str]) -> np.ndarray:
        try:
            vectors = post("/api/embed", {"model": model, "input": texts})["embeddings"]
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
            vectors = [post("/api/embeddings", {"model": model, "prompt": t})["embedding"] for t in texts]
        if len(vectors) != len(texts):
            raise ValueError("as many vectors as texts are wanted")
        if dim is not None and any(len(v) != dim for v in vectors):
            raise ValueError(f"vectors of {dim} numbers are wanted")
        return np.array(vectors, float)

    return embed


def model_embedder(model: str, batch: int = 96, most_tokens: int = 2048) -> Embed:
    """A sentence-transformers model, loaded once per Python worker on its first batch; needs that library on the executors."""
    held: dict[str, object] = {}

    def embed(texts: list[str]) -> np.ndarray:
        if "model" not in held:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError("the provider 'model' needs the library sentence-transformers") from e
            held["model"] = SentenceTransformer(model, trust_remote_code=True)
            held["model"].max_seq_length = min(most_tokens, held["model"].max_seq_length or most_tokens)
        return np.asarray(held["model"].encode(texts, batch_size=batch, show_progress_bar=False), float)

    return embed


PROVIDERS: dict[str, Callable[..., Embed]] = {"hashing": hashing_embedder, "http": http_embedder, "model": model_embedder}


def provider(name: str, **options: object) -> Embed:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[name](**options)


def embed_halving(embed: Embed, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """Vector or error of each text: a batch that fails is halved, down to single texts."""
    try:
        vectors = np.asarray(embed(texts), float)
        norms = np.linalg.norm(vectors, axis=1)
        return [((v / n).tolist(), None) if np.isfinite(n) and n > 0 else (None, "vector without direction") for v, n in zip(vectors, norms)]
    except Exception as e:  # a provider may fail in any way
        if len(texts) == 1:
            return [(None, str(e)[:200])]
        half = len(texts) // 2
        return embed_halving(embed, texts[:half]) + embed_halving(embed, texts[half:])


def embedded(df: DataFrame, id_column: str, text_column: str, embed: Embed, prefix: str = DOCUMENT_PREFIX, batch: int = BATCH) -> DataFrame:
    """``(id, embedding, error)``: rows go through the provider in batches inside the tasks; null texts have an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = iter(zip(frame["id"], frame["text"]))
            out = []
            while part := list(islice(rows, batch)):
                known = [(i, t) for i, t in part if t is not None]
                out += [(i, None, "no text") for i, t in part if t is None]
                if known:
                    out += [(i, v, e) for (i, _), (v, e) in zip(known, embed_halving(embed, [prefix + t for _, t in known]))]
            yield pd.DataFrame(out, columns=["id", "embedding", "error"])

    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(run, "id string, embedding array<double>, error string")
