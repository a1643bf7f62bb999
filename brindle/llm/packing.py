"""Filling containers of fixed capacity with documents of varying length."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.tokens import VOCABULARY, share, token_count
from brindle.sources.tables import cut, spread

CAPACITY = 2048
SHARD_ITEMS = 20_000


class _Gaps:
    """Open containers by free space, for best-fit look-ups."""

    def __init__(self, capacity: int) -> None:
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces: list[int] = []

    def add(self, space: int, container: int) -> None:
        if not self.by_space[space]:
            insort(self.spaces, space)
        self.by_space[space].append(container)

    def take(self, size: int) -> tuple[int, int] | None:
        """The container with the least space that still holds ``size``."""
        at = bisect_left(self.spaces, size)
        if at == len(self.spaces):
            return None
        space = self.spaces[at]
        container = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces.pop(at)
        return space, container


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item (sizes of at most ``capacity``).

    Large-item matching: of items above a third of the capacity at most two fit together,
    so each, from the largest down, is matched with the largest unmatched one that fits
    beside it, or stays alone. The smaller items then go, from the largest down, into the
    open container with the least space that holds them, or open a new one.
    """
    order = np.argsort(-sizes, kind="stable")
    container = np.full(len(sizes), -1, np.int64)
    large = [int(i) for i in order if 3 * sizes[i] > capacity]
    small = [int(i) for i in order if 3 * sizes[i] <= capacity]
    gaps, n = _Gaps(capacity), 0
    waiting = sorted((int(sizes[i]), k) for k, i in enumerate(large))
    gone = [False] * len(large)
    for k, i in enumerate(large):
        if gone[k]:
            continue
        gone[k] = True
        waiting.pop(bisect_left(waiting, (int(sizes[i]), k)))
        container[i], space = n, capacity - int(sizes[i])
        at = bisect_left(waiting, (space + 1, -1)) - 1
        if at >= 0:
            size, mate = waiting.pop(at)
            gone[mate] = True
            container[large[mate]] = n
            space -= size
        gaps.add(space, n)
        n += 1
    for i in small:
        size = int(sizes[i])
        fit = gaps.take(size)
        if fit is None:
            fit = (capacity, n)
            n += 1
        container[i] = fit[1]
        gaps.add(fit[0] - size, fit[1])
    return container


def sized_items(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, piece_no, item_tokens, token_from)``: one row per document, or per full container and rest of a longer one."""
    sized = (
        spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), "doc_id")
        .select("doc_id", token_count(F.col("text"), vocabulary).alias("tokens"))
        .groupBy("doc_id")
        .agg(F.max("tokens").alias("tokens"))
    )
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0))
    pieces = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece_no"))
    start = F.col("piece_no") * F.lit(capacity).cast("bigint")
    return pieces.select("doc_id", "piece_no", F.least(F.lit(capacity), F.col("tokens") - start).cast("bigint").alias("item_tokens"), start.alias("token_from"))


def fill_containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``(container_id, doc_id, piece_no, token_from, item_tokens)``: every document in one container.

    Only a document longer than ``capacity`` is cut, into full containers and one rest. Items are dealt
    into shards of about ``shard_items`` by a hash of their id and each shard is packed on its own, so the work is linear
    and each shard leaves at most one badly filled container. Null texts are
    left out; an empty text is an item of size 0; repeated rows of a document count once.
    """
    share(documents.sparkSession, vocabulary)
    items = cut(sized_items(documents, capacity, vocabulary))
    shards = max(1, math.ceil(items.count() / shard_items))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece_no"], ignore_index=True)
        group["container_id"] = group["shard"] * 2**32 + pack(group["item_tokens"].to_numpy(), capacity)
        return group[["container_id", "doc_id", "piece_no", "token_from", "item_tokens"]]

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(fill, "container_id bigint, doc_id bigint, piece_no int, token_from bigint, item_tokens bigint")


def container_fill(filled: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(containers, items, tokens, fill)`` of a packing: fill is the share of all capacity that is used."""
    per = filled.groupBy("container_id").agg(F.count("*").alias("n"), F.sum("item_tokens").alias("t"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.round(F.sum("t") / (F.count("*") * capacity), 4).alias("fill"),
    )
