import random
import re

import numpy as np
import pyarrow.parquet as pq

from vacantia.llm import mixing as m
from vacantia.llm.shared import Scratch


def test_targets():
    t = m.targets([("b", 100), ("a", 10), (None, 1000), ("c", 100)])
    assert t["a"] == 20 and t["b"] <= 200 and abs(sum(t.values()) - 1815) < 1e-6
    assert m.targets([]) == {} and m.targets([("x", 0)]) == {"x": 0}


def brute_targets(size):
    """Weights by code point, null last; what is over a source's limit goes to the others by weight, one round after the other."""
    order = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, got, full = 1.5 * sum(size.values()), dict.fromkeys(size, 0.0), set()
    while left > 1e-9 and len(full) < len(size):
        each = left / sum(weight[s] for s in size if s not in full)
        for s in size:
            if s not in full:
                got[s] += each * weight[s]
        left = 0.0
        for s in size:
            if got[s] > 2 * size[s]:
                left += got[s] - 2 * size[s]
                got[s] = 2.0 * size[s]
                full.add(s)
    return got


def test_targets_of_many_sources(spark):
    rnd = random.Random(4)
    for size in ({f"s{k}": rnd.randrange(1, 2000) ** 2 for k in range(3000)} | {None: 7, "": 3, "é": 5, "\U0001f600": 9, "\uffee": 2}, {"a": 5}, {"a": 0, None: 0}, {"a": 1, "b": 1000}):
        df = spark.createDataFrame(list(size.items()), "source string, source_size long")
        got = {r.source: r.target for r in m.source_targets(df, Scratch(spark)).collect()}
        want = brute_targets(size)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(want[s], 1) for s in want)
        assert all(abs(v - want[s]) < 1e-6 * max(want[s], 1) for s, v in m.targets(list(size.items())).items())
    assert m.source_targets(df.limit(0), Scratch(spark)).count() == 0


def test_ties(spark):
    """Equal sizes leave the choice to the hash of the row: the same on any partitioning."""
    rows = [(i % 300, "a" if i % 2 else "b", "w w w") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(map(tuple, m.mix_report(df).collect()))
    assert got == sorted(map(tuple, m.mix_report(df.repartition(5)).collect()))


def test_equal_rows_are_decided_one_by_one(spark):
    """What the mix takes comes near the target also where one row, or rows without ids, make up a source."""
    near = lambda rows: {r.target: sum(x.taken for x in rows if x.target == r.target) for r in rows}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, text string")
    alike = m.mix_report(frame([(1, "a", "w w w")] * 100 + [(2, "b", "w")] * 3)).collect()
    assert len(alike) == 103 and all(abs(t - got) <= 3 for t, got in near(alike).items())
    assert {r.taken for r in alike if r.doc_id == 1} <= {3, 6} and len({r.taken for r in alike if r.doc_id == 1}) == 2
    nameless = m.mix_report(frame([(None, "a", "x y z")] * 120 + [(None, "a", "q r s")] * 80)).collect()
    assert len(nameless) == 200 and all(abs(t - got) <= 3 for t, got in near(nameless).items())
    df = frame([(1, "a", "w w w")] * 100 + [(1, "a", "v v v")] * 7 + [(1, "a", "u v w")])
    full = m.mixed(df)
    assert full.count() * 3 == sum(r.taken for r in m.mix_report(df).collect()) and full.where("text = 'w w w'").count() > 100


def test_flight_keeps_totals():
    rnd = np.random.default_rng(0)
    size, p = rnd.integers(0, 500, 3000).astype(float), np.full(3000, 0.37)
    q = m.flight(p, size, rnd.random(3000))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-4 and abs((q * size).sum() - (p * size).sum()) < 1e-1
    r = m.landing(q, size)
    assert set(np.unique(r)) <= {0.0, 1.0}
    # Each unit is taken as often as its probability says.
    many = np.mean([m.landing(m.flight(np.full(40, 0.3), np.arange(40.0), rnd.random(40)), np.arange(40.0)) for _ in range(3000)], axis=0)
    assert abs(many - 0.3).max() < 0.08


def test_table(spark):
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in m.mix_report(df).collect()}
    assert got == {r.doc_id: r for r in m.mix_report(df.repartition(7)).collect()}
    d["size"] = d.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert {k: r["size"] for k, r in got.items()} == dict(zip(d.doc_id, d["size"], strict=True))
    target = brute_targets(d.groupby("source")["size"].sum().to_dict())
    assert any(abs(t - 2 * s) > 1 for t, s in ((target[k], v) for k, v in d.groupby("source")["size"].sum().items()))
    for source, f in d.groupby("source"):
        taken = sum(got[i].taken for i in f.doc_id)
        assert all(abs(got[i].target - target[source]) < 1e-6 and got[i].source_size == f["size"].sum() for i in f.doc_id)
        assert abs(taken - target[source]) <= f["size"].max()
        assert all(got[i].taken <= 2 * got[i]["size"] for i in f.doc_id)


def test_edges_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET", 16)
    rows = [(i, "hot", "w " * (1 + i % 37)) for i in range(2000)] + [(5000 + i, f"s{i % 3}", "w " * (10 + i % 3)) for i in range(60)] + [(1, None, "a b"), (1, None, "a b"), (None, "hot", None), (7000, "s0", ""), (7001, None, "x " * 100_000), (7002, "zero", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as id", "2 as size", "3 as p", "4 as bucket", "5 as mix_id", "6 as _mix_copies", "7 as units")
    got = m.mix_report(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, round(r.target, 6)), [0, 0])
        t[0] += r.taken
        t[1] = max(t[1], r["size"])
        assert r.taken <= 2 * r["size"]
    assert all(abs(t[0] - target) <= 2 * t[1] for (_, target), t in by.items())
    full = m.mixed(df)
    assert full.columns == df.columns and full.selectExpr("sum(size(split(trim(text), ' ')))").count() == 1
    assert full.where("source = 'hot' and text is not null").count() >= 2000
    assert m.mix_report(df.limit(0)).count() == 0 and m.mixed(df.limit(0)).count() == 0
