from __future__ import annotations

import numpy as np

from brindle.llm import clusters as C


def groups(rng, sizes, dim=64):
    rows = []
    for g, n in enumerate(sizes):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for k in range(n):
            v = centre + rng.normal(size=dim) * 0.02
            rows.append((f"g{g:03d}-{k:04d}", (v * rng.uniform(0.5, 3)).tolist()))
    return rows


def test_equals_brute_force_with_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(C, "CELL_ROWS", 120)
    monkeypatch.setattr(C, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(2)
    rows = groups(rng, [400, 5, 4, 30, 6, 1, 1, 2, 9] + [5] * 40 + [1] * 150)
    odd = [("nul", None), (None, [1.0] * 64), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0])]
    df = spark.createDataFrame(rows + odd + rows[:7], "id string, embedding array<float>").repartition(4)
    got = {tuple(r) for r in C.tight_clusters(C.cluster_members(C.unit_vectors(df, "id", "embedding"))).collect()}
    want = {(f"g{g:03d}-0000", i) for i, _ in rows for g in [int(i[1:4])] if sum(j.startswith(i[:5]) for j, _ in rows) >= 5}
    assert got == want
    monkeypatch.setattr(C, "DEAL_ROWS", 100)
    monkeypatch.setattr(C, "SAMPLE_A_CENTRE", 8)
    two_levels = C.cluster_members(C.unit_vectors(df, "id", "embedding"), most_centres=2)
    assert {tuple(r) for r in C.tight_clusters(two_levels).collect()} == want
    described = {r["cluster_key"]: r for r in C.describe_clusters(C.cluster_members(C.unit_vectors(df, "id", "embedding"))).collect()}
    assert described["g000-0000"]["size"] == 400 and len(described["g001-0000"]["typical_ids"]) == 3


def test_a_chain_is_no_cluster(spark):
    step = 0.5  # neighbours are near enough, the ends are not
    rows = [(f"c{k}", [float(np.cos(k * step)), float(np.sin(k * step))] + [0.0] * 62) for k in range(6)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert C.tight_clusters(C.cluster_members(C.unit_vectors(df, "id", "embedding"))).count() == 0


def test_empty_and_text_vectors(spark):
    empty = spark.createDataFrame([], "id string, embedding array<float>")
    assert C.tight_clusters(C.cluster_members(C.unit_vectors(empty, "id", "embedding"))).count() == 0
    texts = spark.createDataFrame([("a", "red chart breaks"), ("b", "red chart breaks"), ("c", "blue export waits"), ("d", None), ("e", "!")], "id string, text string")
    got = {r["id"]: np.array(r["vec"]) for r in C.hashed_vectors(texts, "id", "text").collect()}
    assert set(got) == {"a", "b", "c"} and np.isclose(got["a"] @ got["b"], 1) and got["a"] @ got["c"] < 0.5


def found(df):
    return {tuple(r) for r in C.tight_clusters(C.cluster_members(C.unit_vectors(df, "id", "embedding"))).collect()}


def test_parts_meet_however_far_their_cells_are(spark, monkeypatch):
    axis = np.eye(64)
    ends = [axis[0], 0.8 * axis[0] + 0.6 * axis[1]]
    cells = np.array([e + 0.1 * axis[k] for e in ends for k in (2, 3, 4)])  # three cells at each end of one cluster
    cells /= np.linalg.norm(cells, axis=1, keepdims=True)
    monkeypatch.setattr(C, "kmeans", lambda vectors, k, dim: (cells.astype(np.float32), np.full(6, 5.0)))
    rows = [(f"r{k}", (ends[k // 5] + 1e-3 * axis[10 + k]).tolist()) for k in range(10)]
    assert found(spark.createDataFrame(rows, "id string, embedding array<float>")) == {("r0", f"r{k}") for k in range(10)}


def spokes(centre, cosine, n, axes):
    """Rows of this cosine with each other, around ``centre``, each with its own axis."""
    return [np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * np.eye(64)[a] for a in list(axes)[:n]]


def test_clusters_nearer_than_their_centroids_stay_apart(spark):
    axis = np.eye(64)
    across = 0.875  # 0.80 inside and 0.70 across
    two = spokes(axis[0], 0.8, 5, range(10, 20)) + spokes(across * axis[0] + np.sqrt(1 - across**2) * axis[1], 0.8, 5, range(20, 30))
    six = spokes(axis[2], 0.8, 5, range(30, 40))
    rest = sum(six) * 0.72 / (six[0] @ sum(six))  # 0.72 to every member
    six.append(rest + np.sqrt(1 - rest @ rest) * axis[40])
    x = np.array(two + six)
    s = x @ x.T
    assert s[0, 1] > 0.78 and 0.69 < s[0, 5] < 0.71 and np.allclose(s[15, 10:15], 0.72)
    rows = [(f"r{k:02d}", v.tolist()) for k, v in enumerate(x)]
    want = {(f"r{k // 5 * 5:02d}", f"r{k:02d}") for k in range(15)}
    assert found(spark.createDataFrame(rows, "id string, embedding array<float>")) == want


def test_an_outsider_near_one_member_undoes_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIR_ROWS", 3)
    axis = np.eye(64)
    rows = []
    for g, near in enumerate((0.79, 0.77)):
        five = np.array(spokes(axis[g], 0.85, 5, range(10 + 10 * g, 20 + 10 * g)))
        beside = np.linalg.pinv(five) @ np.array([near] + [0.6] * 4)  # that cosine to one member, 0.60 to the others
        outsider = beside + np.sqrt(1 - beside @ beside) * axis[40 + g]
        assert np.allclose(five @ outsider, [near] + [0.6] * 4)
        rows += [(f"g{g}-{k}", v.tolist()) for k, v in enumerate([*five, outsider])]
    assert found(spark.createDataFrame(rows, "id string, embedding array<float>")) == {("g1-0", f"g1-{k}") for k in range(5)}


def test_outer_members_are_compared_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(C, "PAIR_ROWS", 5)
    axis = np.eye(64)
    wide = spokes(axis[0], 0.8, 30, range(10, 40))  # all are outer
    loose = spokes(axis[1], 0.8, 30, range(10, 40))
    loose[29] = loose[29] * 0.77 + np.sqrt(1 - 0.77**2) * axis[50]  # under 0.78 with some member
    rows = [(f"{g}{k:02d}", v.tolist()) for g, x in (("a", wide), ("b", loose)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert {r for r in found(df) if r[0] == "a00"} == {("a00", f"a{k:02d}") for k in range(30)}
    outer = df.selectExpr("'a' AS cluster", "id", "embedding AS vec", "30L AS size").where("id < 'b'")
    met = [r["ids"] for r in C._block_pairs(outer).groupBy("low", "high").agg(C.F.collect_list("id").alias("ids")).collect()]
    assert max(map(len, met)) < 25 and {(i, j) for ids in met for i in ids for j in ids} == {(i[0], j[0]) for i in rows[:30] for j in rows[:30]}
