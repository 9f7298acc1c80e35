import numpy as np
from pyspark.sql import functions as F

from clausewright.llm import neighbours, queries


def brute(ids, vectors, query, k=10):
    at = np.flatnonzero(ids == query)[0]
    d = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
    keep = ids != query
    order = np.lexsort((ids[keep], d[keep]))[:k]
    return ids[keep][order], d[keep][order]


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op5_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    asked = [i for i in ids if i % 100 == 0]
    assert sorted(got) == sorted(asked)
    hits = 0
    for q in asked:
        found = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        exact, _ = brute(ids, vectors, q)
        hits += len(set(exact) & {r.vec_id for r in found})
        at = {i: v for i, v in zip(ids, vectors, strict=True)}
        for r in found:
            assert abs(r.score - np.sqrt(((at[q] - at[r.vec_id]) ** 2).sum())) < 1e-12
    assert hits >= 0.9 * 10 * len(asked)


SMALL = {"cell_rows": 60, "block_rows": 40, "query_rows": 4}


def test_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 16))
    vectors[50:60] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score double")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 50 == 0, **SMALL).collect()
    stored = vectors.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 700, 50):
        exact, d = brute(np.arange(700), stored, q)
        mine = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        hits += len(set(exact) & set(mine))
    assert hits >= 0.95 * 140
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == list(range(50, 60))


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [5.0, 5.0]), (8, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 2 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in got if r.query_id == 0} == {(0, 1), (0, 8)}
    assert {r.query_id for r in got} == {0, 8}
    lengths = spark.createDataFrame([*rows, (20, [1.0]), (21, [2.0, 1.0, 0.0]), (22, [2.0, 1.0, 1.0])], "vec_id long, embedding array<float>")
    found = neighbours.nearest_neighbours(lengths, F.col("vec_id") >= 20, cell_rows=1).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(20, 7), (21, 22), (22, 21)}
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_repeated_queries_are_one(spark):
    line = [(i, [float(i), 1.0]) for i in range(1, 60)]
    df = spark.createDataFrame([(0, [0.0, 1.0])] * 2 + [(100, [1.5, 1.0]), (100, [40.25, 1.0])] + line, "vec_id long, embedding array<float>")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0, cell_rows=10, block_rows=8).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0][:10] == [1, 100, *range(2, 10)]
    mine = sorted((min(abs(x - 1.5), abs(x - 40.25)), i) for i, (x, _) in [*line, (0, (0.0, 1.0)), (0, (0.0, 1.0))])[:10]
    assert [(r.score, r.vec_id) for r in got if r.query_id == 100] == mine


def test_clusters_are_searched_apart(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24)) * 20
    vectors = np.repeat(centres, 100, axis=0) + rng.normal(size=(3000, 24))
    vectors[1000:1900] = vectors[1000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    asks = F.col("vec_id") % 50 == 0
    got = {}
    for r in neighbours.nearest_neighbours(df, asks, cell_rows=100, block_rows=200, query_rows=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 50):
        exact, d = brute(np.arange(3000), vectors, q)
        mine = [i for _, i, _ in sorted(got[q])]
        hits += len(set(exact) & set(mine))
        if 1000 <= q < 1900:
            assert mine == [i for i in range(1000, 1011) if i != q][:10]
    assert hits >= 0.95 * 600


def test_cells_bounds_rule_cells_out():
    rng = np.random.default_rng(6)
    size = 24
    centres = rng.normal(size=(10, size)) * 20
    cells = [c + rng.normal(size=(50, size)) for c in centres]
    plan = neighbours._Plan({(size, i): 50 for i in range(10)}, 100)
    at = neighbours.lines(size)
    plan.bound([(size, i, j, (v @ at)[:, j].min(), (v @ at)[:, j].max()) for i, v in enumerate(cells) for j in range(neighbours.PROJECTIONS)])
    queries_ = np.array([v[0] for v in cells])
    met = plan.met(size, queries_ @ at, np.full(10, 8.0))
    assert met.diagonal().all() and met.sum() <= 20
    for i, q in enumerate(queries_):
        for j, v in enumerate(cells):
            inside = (np.abs(v @ at - q @ at) <= 8.0).sum(axis=1)
            assert met[i, j] or inside.max() < neighbours.COLLISIONS
