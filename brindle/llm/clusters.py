"""Similarity clusters of records: distributed k-means with parallel oversampled seeding."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import cut, spread

DIM = 64
TEXT_DIM = 256
TEXT_COSINE = 0.5
WEIGHT_BUCKETS = 1 << 18
_WORD = re.compile(r"[^\W\d_][\w'’-]+")
COSINE = 0.78
CELL_ROWS = 4000
CENTRES = 1024
SAMPLE_A_CENTRE = 32
DEAL_ROWS = 65_536
BLOCK_ROWS = 3000
SEED_ROUNDS = 3
LLOYD_ROUNDS = 2
PAIR_ROWS = 32768
SPREAD_ROWS = 4096
_UNIT = "id string, vec array<float>"
_CELL = _UNIT + ", cell long, block long"


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column as one float32 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def vector_column(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows, dtype=np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, rows.shape[1], dtype=np.int32)), flat)


def draws(ids: pd.Series | pa.Array, salt: int) -> np.ndarray:
    """A number in (0, 1) per id, the same in every run, on every machine and in any order of rows."""
    values = ids.to_pandas() if not isinstance(ids, pd.Series) else ids
    h = pd.util.hash_array(values.to_numpy(dtype=object), hash_key=f"{salt:016d}", categorize=False)
    return (h.astype(np.float64) + 0.5) / 2.0**64


def unit_vectors(df: DataFrame, id_column: str, vector_column_name: str, dim: int = DIM) -> DataFrame:
    """``(id, vec)``: one vector of length one per id.

    Null ids, null vectors, vectors of another dimension and those without a direction (zero or
    not finite) are left out. Repeated ids count once.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(vector_column_name).alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    )

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), vector_column(x[good] / norm[good, None])], names=["id", "vec"])

    return rows.groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(normalise, _UNIT)


class _Words:
    """Hashes of the words of texts: a place among ``WEIGHT_BUCKETS``, a place in the vector and a sign."""

    def __init__(self, dim: int) -> None:
        self.dim, self.memo = dim, {}

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        codes = list(map(self.memo.get, words))
        if None in codes:
            for w in set(words):
                if w not in self.memo:
                    h = zlib.crc32(w.encode()), zlib.crc32(w.encode(), 77)
                    self.memo[w] = h[0] % WEIGHT_BUCKETS | h[1] % self.dim << 20 | (h[1] >> 30 & 1) << 40
            codes = list(map(self.memo.get, words))
            if len(self.memo) > 500_000:
                self.memo.clear()
        return np.array(codes, np.int64)


def hashed_vectors(df: DataFrame, id_column: str, text_column: str, dim: int = TEXT_DIM) -> DataFrame:
    """``(id, vec)``: hashed weighted features of a text.

    Every word falls into one of ``dim`` buckets with a sign, both from its hash, and adds
    (1 + ln tf) * ln(N / df). N counts the rows with a text and df those with the word, over the whole table; df is
    kept by a second hash into 2^18 places, which bounds what is counted and sent to the tasks.
    Null and wordless texts have no vector and are left out; repeated ids count once.
    """
    texts = spread(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"), "id")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, n = _Words(dim), np.zeros(WEIGHT_BUCKETS, np.int64), 0
        for batch in batches:
            seen = [np.unique(words.of(t) & 0xFFFFF) for t in batch.column(1).to_pylist()]
            n += len(seen)
            total += np.bincount(np.concatenate(seen) if seen else np.zeros(0, np.int64), minlength=WEIGHT_BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["place", "n"])

    counted = texts.mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most 2^18 + 1 rows
    place, n = counted.column("place").to_numpy(), counted.column("n").to_numpy()
    weight = np.zeros(WEIGHT_BUCKETS, np.float32)
    weight[place[place >= 0]] = np.log(np.maximum(1.0, n[place < 0].sum() / n[place >= 0]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(dim)
        for batch in batches:
            out = np.zeros((batch.num_rows, dim))
            for i, t in enumerate(batch.column(1).to_pylist()):
                code, tf = np.unique(words.of(t), return_counts=True)
                np.add.at(out[i], code >> 20 & 0xFFFFF, (1 + np.log(tf)) * weight[code & 0xFFFFF] * np.where(code >> 40, 1.0, -1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), vector_column(out)], names=["id", "vec"])

    return unit_vectors(texts.mapInArrow(vectors, _UNIT), "id", "vec", dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and cosine of each row's nearest centre, in blocks."""
    index, best = np.zeros(len(x), np.int64), np.full(len(x), -2.0, np.float32)
    for a in range(0, len(x), 4096):
        for b in range(0, len(centres), 4096):
            s = x[a : a + 4096] @ centres[b : b + 4096].T
            i = s.argmax(1)
            v = s[np.arange(len(s)), i]
            better = v > best[a : a + 4096]
            best[a : a + 4096][better], index[a : a + 4096][better] = v[better], i[better] + b
    return index, best


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _weighted_seeds(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k-means++ over the weighted candidates, then Lloyd steps over them; they number a few times k."""
    rng = np.random.default_rng(7)
    chosen = [int(weights.argmax())]
    cost = np.maximum(1 - points @ points[chosen[0]], 0)
    while len(chosen) < k and (mass := cost * weights).sum() > 1e-9:
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        cost = np.minimum(cost, np.maximum(1 - points @ points[chosen[-1]], 0))
    centres = points[chosen]
    for _ in range(5):
        near, _ = _nearest(points, centres)
        sums = np.zeros((len(centres), points.shape[1]))
        np.add.at(sums, near, points * weights[:, None])
        alive = np.linalg.norm(sums, axis=1) > 0
        centres = _unit(sums[alive])
    return centres


def seed_centres(vectors: DataFrame, k: int, dim: int = DIM, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """k-means|| seeding over all rows: a few rounds, each drawing 2k rows by their cost in one pass.

    Each task keys its rows by u^(1/cost) and keeps its 2k largest keys; the 2k largest of
    all are an exact weighted sample. Only those candidates (2k per round) and their weights reach the driver.
    """
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(1).toArrow()
    candidates = matrix(first.column("vec"), dim)
    for r in range(rounds):
        centres = candidates

        def sample(batches: Iterator[pa.RecordBatch], r: int = r, centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(1), dim)
                cost = np.maximum(1 - _nearest(x, centres)[1], 1e-9)
                key = np.log(draws(batch.column(0), r)) / cost
                top = np.argsort(-key)[: 2 * k]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(top)), vector_column(x[top]), pa.array(key[top])], names=["id", "vec", "key"])

        drawn = vectors.mapInArrow(sample, _UNIT + ", key double").orderBy(F.desc("key"), "id").limit(2 * k).toArrow()
        candidates = np.vstack([candidates, matrix(drawn.column("vec"), dim)])
    counts, _ = _sums(vectors, candidates, dim)
    return _weighted_seeds(candidates, np.maximum(counts, 1e-3), k)


def _sums(vectors: DataFrame, centres: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and vector sum of each centre; summed inside the tasks, then over the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centres), dim)), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = matrix(batch.column(1), dim)
            near, _ = _nearest(x, centres)
            order = np.argsort(near, kind="stable")
            there, at = np.unique(near[order], return_index=True)
            if len(there):
                total[there] += np.add.reduceat(x[order].astype(np.float64), at, axis=0)
            count += np.bincount(near, minlength=len(centres))
        used = np.flatnonzero(count)
        flat = pa.array(total[used].ravel())
        sums = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * dim + 1, dim, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], names=["cell", "n", "total"])

    parts = vectors.mapInArrow(partial, "cell long, n long, total array<double>")
    summed = parts.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"d{i}") for i in range(dim)]).toPandas()
    count, total = np.zeros(len(centres)), np.zeros((len(centres), dim))
    cells = summed["cell"].to_numpy(dtype=np.int64)
    count[cells], total[cells] = summed["n"], summed[[f"d{i}" for i in range(dim)]]
    return count, total


def kmeans(vectors: DataFrame, k: int, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Centres and sizes of a spherical k-means over all rows."""
    centres = seed_centres(vectors, k, dim)
    for _ in range(LLOYD_ROUNDS):
        count, total = _sums(vectors, centres, dim)
        centres = _unit(total[count > 0])
    return centres, _sums(vectors, centres, dim)[0]


def _leaders(ids: pd.Series, x: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of one block as k-means seeds: no two have this cosine, and each row has it with at least one.

    Each round draws up to 256 of the rows that no seed is near to, by cost, and keeps those
    that are not near an earlier draw.
    """
    best, seeds, r = np.full(len(x), -1.0, np.float32), np.zeros(0, np.int64), 0
    open_rows = np.arange(len(x))
    while len(open_rows):
        key = np.log(draws(ids.iloc[open_rows], 100 + r)) / np.maximum(1 - best[open_rows], 1e-9)
        drawn = open_rows[np.argsort(-key, kind="stable")[:256]]
        s = np.zeros((len(drawn), len(drawn)), bool)
        s[near_pairs(x[drawn], x[drawn], cosine)] = True
        keep: list[int] = []
        blocked = np.zeros(len(drawn), bool)
        for i in range(len(drawn)):
            if not blocked[i]:
                keep.append(i)
                blocked |= s[i]
        new = drawn[keep]
        done = np.zeros(len(x), bool)
        done[drawn] = True
        done[open_rows[near_pairs(x[open_rows], x[new], cosine)[0]]] = True
        open_rows = open_rows[~done[open_rows]]
        if len(open_rows):
            best[open_rows] = np.maximum(best[open_rows], (x[open_rows] @ x[new].T).max(1))
        seeds, r = np.append(seeds, new), r + 1
    return seeds


def _fine_clusters(x: np.ndarray, seeds: np.ndarray, cosine: float) -> np.ndarray:
    """Cluster number of each row of one block: Lloyd steps from the seeds, and clusters with near centres become one."""
    centres = x[seeds]
    for _ in range(2):
        near, _ = _nearest(x, centres)
        sums = np.zeros(centres.shape)
        np.add.at(sums, near, x)
        used = np.unique(near)
        centres = _unit(sums[used])
    near, _ = _nearest(x, centres)
    return link(centres, cosine)[near]


def _near_tiles(x: np.ndarray, y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of all pairs of a row of ``x`` and one of ``y`` of at least this cosine, by tiles; those at the edge are decided in double precision."""
    for a in range(0, len(x), 2048):
        for b in range(0, len(y), 2048):
            s = x[a : a + 2048] @ y[b : b + 2048].T
            i, j = np.nonzero(s >= cosine - 1e-5)
            edge = np.flatnonzero(s[i, j] < cosine + 1e-5)
            exact = np.einsum("ij,ij->i", x[a + i[edge]].astype(np.float64), y[b + j[edge]].astype(np.float64))
            far = edge[exact < cosine]
            yield np.delete(i, far) + a, np.delete(j, far) + b


def near_pairs(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of a row of ``x`` and one of ``y`` of at least this cosine."""
    tiles = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_near_tiles(x, y, cosine)]
    return np.concatenate([t[0] for t in tiles]), np.concatenate([t[1] for t in tiles])


def all_near(x: np.ndarray, y: np.ndarray, cosine: float) -> bool:
    """Whether every row of ``x`` has at least this cosine with every row of ``y``."""
    for a in range(0, len(x), 2048):
        for b in range(0, len(y), 2048):
            s = x[a : a + 2048] @ y[b : b + 2048].T
            if s.min() < cosine - 1e-5:
                return False
            i, j = np.nonzero(s < cosine + 1e-5)
            if (np.einsum("ij,ij->i", x[a + i].astype(np.float64), y[b + j].astype(np.float64)) < cosine).any():
                return False
    return True


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link(centres: np.ndarray, cosine: float) -> np.ndarray:
    """Smallest index of each centre's component, centres of at least this cosine being linked."""
    return components(len(centres), *near_pairs(centres, centres, cosine))


def _blocks(n: int) -> int:
    """Blocks of at most about ``PAIR_ROWS`` rows; up to four smaller ones, so that the pairs of blocks keep some cores busy."""
    return max(math.ceil(n / PAIR_ROWS), min(4, math.ceil(n / SPREAD_ROWS)), 1)


_MEMBER = "id string, vec array<float>, part string, n long, lead array<float>"


def _stitch(parts: DataFrame, cosine: float, dim: int) -> DataFrame:
    """``(part, cluster)`` for the partial clusters that belong with others.

    The ``lead`` vectors of all partial clusters are compared with each other: they are cut into blocks by a
    hash, and every pair of blocks is one group. The links then spread by the smallest key until none changes.
    """
    blocks = _blocks(parts.count())

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        x, own = matrix(group.column("lead"), dim), group.column("own").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        i, j = near_pairs(x[a], x[b], cosine)
        label = components(len(x), a[i], b[j])
        size = np.bincount(label, minlength=len(label))
        take = pa.array(np.flatnonzero(size[label] > 1))
        keys = group.column("part").combine_chunks()
        return pa.table({"part": keys.take(take), "meeting": pa.array([f"{low}:{high}:{k}" for k in keys.take(pa.array(label)).take(take).to_pylist()], pa.string())})

    dealt = parts.select("part", "lead", F.pmod(F.xxhash64("part"), F.lit(blocks)).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    pairs = dealt.select("part", "lead", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    edges = cut(pairs.groupBy("low", "high").applyInArrow(meet, "part string, meeting string"))
    labels = edges.groupBy("part").agg(F.min("part").alias("cluster"))
    while True:
        at = edges.join(labels, "part").groupBy("meeting").agg(F.min("cluster").alias("cluster"))
        new = cut(edges.join(at, "meeting").groupBy("part").agg(F.min("cluster").alias("cluster")))
        changed = new.alias("n").join(labels.alias("o"), "part").where("n.cluster <> o.cluster").limit(1).count()
        labels = new
        if not changed:
            return labels


def _cells(vectors: DataFrame, n: int, dim: int, most_centres: int) -> DataFrame:
    """``(id, vec, cell, block)``: k-means cells of about ``CELL_ROWS`` of the ``n`` rows, each in blocks of about ``BLOCK_ROWS`` by a hash of the id.

    At most ``most_centres`` centres are found over all rows, which bounds the work of the driver and what goes to each task. Where that leaves
    larger cells, each is parted again on the executors into at most as many, by k-means on about ``SAMPLE_A_CENTRE`` of its rows a centre (chosen by a hash of the id);
    its rows are dealt over groups of about ``DEAL_ROWS`` to find their nearest centre. Cells only say which
    rows are compared first: what a cell parts is joined again later, so the sample changes no result.
    """
    centres, sizes = kmeans(vectors, max(1, min(most_centres, math.ceil(n / CELL_ROWS))), dim)
    blocks = np.maximum(1, np.ceil(sizes / BLOCK_ROWS)).astype(np.int64)
    parts = np.clip(np.ceil(sizes / CELL_ROWS), 1, most_centres).astype(np.int64)
    deals = np.maximum(1, np.ceil(sizes / DEAL_ROWS)).astype(np.int64)
    two_levels = n > most_centres * CELL_ROWS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, _ = _nearest(matrix(batch.column(1), dim), centres)
            block = (draws(batch.column(0), 9) * (deals if two_levels else blocks)[near]).astype(np.int64) if batch.num_rows else near
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), pa.array(block)], names=["id", "vec", "cell", "block"])

    placed = vectors.mapInArrow(place, _CELL)
    if not two_levels:
        return placed
    placed = cut(placed)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            share = np.minimum(1.0, SAMPLE_A_CENTRE * parts[cell] / np.maximum(1, sizes[cell]))
            yield batch.filter(pa.array(draws(batch.column(0), 21) < share if batch.num_rows else np.zeros(0, bool)))

    def part(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        cell = group.column("cell")[0].as_py()
        x = matrix(group.column("vec"), dim)
        inner = _weighted_seeds(x, np.ones(len(x)), min(len(x), int(parts[cell])))
        deal = np.repeat(np.arange(deals[cell]), len(inner))
        return pa.table({"id": pa.nulls(len(deal), pa.string()), "vec": vector_column(np.tile(inner, (int(deals[cell]), 1))), "cell": pa.array(np.full(len(deal), cell)), "block": pa.array(deal)})

    def assign(group: pa.Table) -> pa.Table:
        centre = group.column("id").is_null()
        rows, inner = group.filter(pc.invert(centre)), matrix(group.filter(centre).column("vec"), dim)
        near = _nearest(matrix(rows.column("vec"), dim), inner)[0] if len(inner) else np.zeros(len(rows), np.int64)
        cell = rows.column("cell").to_numpy() * (1 << 32) + near
        return pa.table({"id": rows.column("id"), "vec": rows.column("vec"), "cell": pa.array(cell), "block": pa.array(np.zeros(len(rows), np.int64))})

    inner = placed.mapInArrow(sample, _CELL).groupBy("cell").applyInArrow(part, _CELL)
    finer = cut(placed.unionByName(inner).groupBy("cell", "block").applyInArrow(assign, _CELL)).drop("block")
    counts = finer.groupBy("cell").agg(F.count("*").alias("n"))
    place_in = F.pmod(F.xxhash64("id", F.lit(9)), F.ceil(F.col("n") / BLOCK_ROWS))
    return finer.join(counts, "cell").select("id", "vec", "cell", place_in.alias("block"))


def cluster_members(vectors: DataFrame, cosine: float = COSINE, dim: int = DIM, centroids: bool = False, most_centres: int = CENTRES) -> DataFrame:
    """``(id, cluster, similarity, part, size)``: each row's cluster, its cosine with the centroid, and the cluster's size.

    ``cluster`` is the smallest id in it; the row of that id has the ``centroid``.

    Coarse cells come from k-means over all rows (about ``CELL_ROWS`` rows a cell, in two levels for many rows). A cell's rows are
    spread over blocks of about ``BLOCK_ROWS`` by a hash of the id, so a cluster that holds
    a third of all rows is worked on by many tasks; each block finds its parts by
    k-means, and only their sums, sizes and leads meet again in ``_stitch``.

    A part is what is nearest to one seed, a row itself, and parts are joined whose seeds have the cosine. A group whose
    members all have it with each other and less with every other row is therefore found whole and
    alone: it has one seed in each block, no other row is nearer to that seed than to its own, and no other seed is
    near. With ``centroids``, for clusters that need not be so tight, Lloyd steps follow and centroids are joined.
    """
    vectors = cut(vectors)
    n = vectors.count()
    if n == 0:
        return vectors.selectExpr("id", "id AS cluster", "id AS part", "1L AS size", "vec", "1D AS similarity", "vec AS centroid")
    placed = _cells(vectors, n, dim, most_centres)

    def fine(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x, ids = matrix(group.column("vec"), dim), group.column("id").to_pandas()
        seeds = _leaders(ids, x, cosine)
        label = _fine_clusters(x, seeds, cosine) if centroids else _nearest(x, x[seeds])[0]
        first = pd.Series(np.arange(len(x))).groupby(label).min()
        part = ids.to_numpy()[first.loc[label].to_numpy()]
        sums = np.zeros((len(x), dim))
        np.add.at(sums, label, x)
        used, count = np.unique(label, return_counts=True)
        lead = _unit(sums[used]) if centroids else x[seeds[used]]
        ends = pa.table({"id": pa.nulls(len(used), pa.string()), "vec": vector_column(sums[used]), "part": pa.array(ids.to_numpy()[first.loc[used].to_numpy()], pa.string()), "n": pa.array(count), "lead": vector_column(lead)})
        rows = pa.table({"id": group.column("id"), "vec": vector_column(x), "part": pa.array(part, pa.string()), "n": pa.nulls(len(x), pa.int64()), "lead": pa.nulls(len(x), pa.list_(pa.float32()))})
        return pa.concat_tables([rows, ends])

    both = cut(placed.groupBy("cell", "block").applyInArrow(fine, _MEMBER))
    parts, rows = both.where("id IS NULL").drop("id"), both.where("id IS NOT NULL").drop("n", "lead")
    named = parts.join(_stitch(parts, cosine, dim), "part", "left").withColumn("cluster", F.coalesce("cluster", "part"))
    whole = named.groupBy("cluster").agg(F.sum("n").alias("size"), *[F.sum(F.col("vec")[i].cast("double")).alias(f"d{i}") for i in range(dim)])
    centroid = F.array(*[F.col(f"d{i}") for i in range(dim)])
    described = named.select("part", "cluster").join(whole.select("cluster", "size", centroid.cast("array<float>").alias("centroid")), "cluster")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = matrix(batch.column("vec"), dim), _unit(matrix(batch.column("centroid"), dim))
            first = batch.column("id").to_numpy(zero_copy_only=False) == batch.column("cluster").to_numpy(zero_copy_only=False)
            once = vector_column(c).take(pa.array(np.arange(len(c)), mask=~first))
            out = [batch.column(k) for k in ("id", "cluster", "part", "size")]
            yield pa.RecordBatch.from_arrays([*out, batch.column("vec"), pa.array(np.einsum("ij,ij->i", x, c).astype(np.float64)), once], names=["id", "cluster", "part", "size", "vec", "similarity", "centroid"])

    joined = rows.join(described, "part").select("id", "vec", "part", "cluster", "size", "centroid")
    return joined.mapInArrow(compare, "id string, cluster string, part string, size long, vec array<float>, similarity double, centroid array<float>")


def _touched(rows: DataFrame, large: DataFrame, candidates: DataFrame, cosine: float, dim: int) -> DataFrame:
    """``(cluster)`` of the candidates that any other row has this cosine with a member of.

    By the triangle inequality such a row's angle to the centroid is at most the allowed one plus the cluster's widest.
    All rows are compared with all centroids, block against block; the rows within that angle are
    compared with the members, again in blocks.
    """
    limit = math.acos(cosine)
    balls = cut(large.where("id = cluster").join(candidates, "cluster").select("cluster", F.col("centroid").alias("vec"), F.cos(F.least(F.lit(math.pi), F.col("widest") + limit)).alias("reach")))
    across, down = _blocks(rows.count()), max(1, math.ceil(balls.count() / PAIR_ROWS))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        ball = pc.is_null(group.column("id"))
        row, ball = group.filter(pc.invert(ball)), group.filter(ball)
        x, c, reach = matrix(row.column("vec"), dim), matrix(ball.column("vec"), dim), ball.column("reach").to_numpy().astype(np.float32) - np.float32(1e-5)
        own, cluster = row.column("cluster").to_numpy(), ball.column("cluster").to_numpy()
        for a in range(0, len(x), 2048):
            for b in range(0, len(c), 2048):
                s = x[a : a + 2048] @ c[b : b + 2048].T
                i, j = np.nonzero(s >= reach[b : b + 2048])
                other = own[i + a] != cluster[j + b]
                i, j = i[other], j[other]
                for k in range(0, len(i), 100_000):
                    r, q = i[k : k + 100_000], j[k : k + 100_000]
                    angle = np.arccos(np.clip(s[r, q].astype(np.float64), -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(cluster[q + b], pa.string()), pa.array(row.column("id").to_numpy()[r + a], pa.string()), vector_column(x[r + a]), pa.array(angle)], names=["cluster", "id", "vec", "angle"])

    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = rows.select("id", "cluster", "vec", F.lit(None).cast("double").alias("reach"), F.pmod(F.xxhash64("id"), F.lit(across)).cast("int").alias("low"), places(down).alias("high"))
    sides = sides.unionByName(balls.select(F.lit(None).cast("string").alias("id"), "cluster", "vec", "reach", F.pmod(F.xxhash64("cluster"), F.lit(down)).cast("int").alias("high"), places(across).alias("low")))
    asks = cut(sides.groupBy("low", "high").applyInArrow(suspects, "cluster string, id string, vec array<float>, angle double"))
    asked = asks.groupBy("cluster").agg(F.count("*").alias("asks"), F.min("angle").alias("nearest"))
    member = large.join(asked, "cluster").where(F.col("angle") >= F.col("nearest") - limit - 1e-4).select("cluster", "id", "vec", "size", "asks")
    asking = asks.join(large.where("id = cluster").select("cluster", "size").join(asked, "cluster"), "cluster").select("cluster", "id", "vec", "size", "asks")
    blocks = lambda n: F.ceil(F.col(n) / PAIR_ROWS)
    place = lambda n: F.pmod(F.xxhash64("id"), blocks(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    met = asking.select("cluster", "vec", F.lit(True).alias("asks"), place("asks").alias("low"), each("size").alias("high"))
    met = met.unionByName(member.select("cluster", "vec", F.lit(False).alias("asks"), place("size").alias("high"), each("asks").alias("low")))

    def touch(group: pa.Table) -> pa.Table:
        x, asks = matrix(group.column("vec"), dim), group.column("asks").to_numpy()
        hit = any(len(i) for i, _ in _near_tiles(x[asks], x[~asks], cosine))
        return pa.table({"cluster": pa.array([group.column("cluster")[0].as_py()] if hit else [], pa.string())})

    return met.groupBy("cluster", "low", "high").applyInArrow(touch, "cluster string").distinct()


def _block_pairs(rows: DataFrame) -> DataFrame:
    """``(cluster, id, vec, own, low, high)``: the rows of a cluster in blocks of about ``PAIR_ROWS`` by a hash of the id, each row once in every pair of its block with one of the cluster's."""
    blocks = F.ceil(F.col("size") / PAIR_ROWS)
    dealt = rows.select("cluster", "id", "vec", F.pmod(F.xxhash64("id"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    return dealt.select("cluster", "id", "vec", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def tight_clusters(members: DataFrame, cosine: float = COSINE, least: int = 5, dim: int = DIM) -> DataFrame:
    """``(cluster_key, record_id)`` of the clusters whose members all have this cosine with each other and less with every other row.

    Two members whose angles to the centroid add up to no more than the allowed angle are near
    enough by the triangle inequality, so only the outer members (whose angle plus the cluster's largest exceeds it)
    are compared pairwise, each pair of blocks as one group. Members that all have the cosine with each other have it with the
    centroid, so a cluster with one that has not is dropped before.
    """
    rows = cut(members)
    large = rows.where(F.col("size") >= least).withColumn("angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "similarity"))))
    spread = large.groupBy("cluster").agg(F.max("angle").alias("widest"), F.min("id").alias("cluster_key")).where(F.col("widest") <= math.acos(cosine) + 1e-3)
    limit = math.acos(cosine)
    outer = large.join(spread, "cluster").where(F.col("angle") + F.col("widest") > limit - 1e-6).select("cluster", "id", "vec", "size")

    def loose(group: pa.Table) -> pa.Table:
        x, own = matrix(group.column("vec"), dim), group.column("own").to_numpy()
        x, y = x[own == group.column("low")[0].as_py()], x[own == group.column("high")[0].as_py()]
        bad = not all_near(x, y, cosine)
        return pa.table({"cluster": pa.array([group.column("cluster")[0].as_py()] if bad else [], pa.string())})

    bad = _block_pairs(outer).groupBy("cluster", "low", "high").applyInArrow(loose, "cluster string").distinct()
    whole = cut(spread.join(bad, "cluster", "left_anti"))
    good = whole.join(_touched(rows, large, whole, cosine, dim), "cluster", "left_anti")
    return large.join(good, "cluster").select("cluster_key", F.col("id").alias("record_id"))


def describe_clusters(members: DataFrame, least: int = 5, typical: int = 3) -> DataFrame:
    """``(cluster_key, size, typical_ids)``: the members nearest the centroid, found per partial cluster and then per cluster."""
    near = F.struct((-F.round("similarity", 6)).alias("far"), "id")
    per_part = members.where(F.col("size") >= least).groupBy("cluster", "part", "size").agg(F.min("id").alias("key"), F.slice(F.array_sort(F.collect_list(near)), 1, typical).alias("top"))
    return per_part.groupBy("cluster", "size").agg(F.min("key").alias("cluster_key"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, typical).alias("top")).select(
        "cluster_key", "size", F.transform("top", lambda t: t["id"]).alias("typical_ids")
    )
