import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq

from vacantia.llm import topk
from vacantia.llm.topk import exact_top_k


def brute(rows, k=10, every=100):
    """By whole numbers without a limit; scores beyond 64 bits count as the nearest 64-bit number."""
    seen = [(i, [math.floor(1024 * Fraction(c)) for c in map(float, v)]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    seen.sort()
    width = max((len(x) for _, x in seen), default=0)
    kind = np.int64 if all(sum(c * c for c in x) < 2**62 for _, x in seen) else object
    ids, x = np.array([i for i, _ in seen], np.int64), np.array([v + [0] * (width - len(v)) for _, v in seen], kind).reshape(len(seen), width)
    out = []
    for a, i in enumerate(ids):
        if i % every == 0:
            s = [min(max(int(c), -(1 << 63)), (1 << 63) - 1) for c in x @ x[a]]
            order = [b for b in sorted(range(len(ids)), key=lambda b: (-s[b], ids[b])) if b != a][:k]
            out += [(int(i), r + 1, int(ids[b]), s[b]) for r, b in enumerate(order)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_table(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    assert got(exact_top_k(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "id % 100 = 0", block=7, tile=500)) == brute(zip(t.vec_id.tolist(), t.embedding, strict=True))


def test_edges(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=8).astype(np.float32).tolist()) for i in range(500)] + [(1000 + i, [0.5] * 8) for i in range(30)] + [(100, [float("nan")] * 8), (201, None), (202, [None] * 8), (None, [1.0] * 8), (203, []), (204, [1.0]), (5, [0.25] * 8), (600, [float("inf")]), (700, [2.0] * 9)]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as score", "3 as rank")
    assert got(exact_top_k(df, "id % 100 = 0")) == brute(rows)
    again = df.union(df.where("vec_id in (0, 100, 5, 1003)")).union(df.where("vec_id in (0, 7)"))
    same = rows + [r for r in rows if r[0] in (0, 100, 5, 1003)] + [r for r in rows if r[0] in (0, 7)]
    assert got(exact_top_k(again, "id % 100 = 0", block=2, tile=16)) == brute(same)
    few = df.where("vec_id in (0, 1, 2)")
    assert got(exact_top_k(few, "id % 100 = 0")) == brute([r for r in rows if r[0] in (0, 1, 2)])
    assert exact_top_k(df.limit(0), "id % 100 = 0").count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0]), (200, [1.0, 1.0]), (200, [0.0, 3.0]), (200, [0.0, 3.0])]
    assert got(exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 100 = 0", k=3)) == brute(rows, 3)


def test_large_components(spark):
    rows = [(k, [c * 2.0**20, 1.0]) for k, c in ((0, 1), (1, 1.5), (2, -1), (3, 1023), (4, 2.0**30), (100, 1000))]
    assert got(exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 100 = 0")) == brute(rows)


def test_vectors_whose_scores_need_more_than_64_bits(spark):
    rnd = np.random.default_rng(4)
    rows = [(k, rnd.normal(size=6).tolist()) for k in range(120)] + [(200, [2.2e6, 0.0]), (201, [1.0, 0.0]), (300, [3e38, -1.0, 2.0]), (301, [-3e38]), (302, [2.1e6, 5.0]), (303, [2.2e6, 0.0]), (303, [2.2e6, 0.0]), (400, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(exact_top_k(df, "id % 100 = 0", k=5, block=3, tile=40)) == brute(rows, 5)
    assert (201, 1024 * 1024 * 2_200_000) in [r[2:] for r in got(exact_top_k(df, "id = 200", k=200))]


def test_neither_blocks_nor_parts_of_the_sample_pass_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 50)
    rnd = np.random.default_rng(6)
    rows = [(k, rnd.normal(size=6).tolist()) for k in range(3000)]
    df = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 100 = 0", block=10, tile=100)
    assert got(df) == brute(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    sent = topk.few(spark.createDataFrame([(k, bytes(8)) for k, _ in rows], "id long, v binary"), len(rows)).count()
    assert 50 <= sent < 400
