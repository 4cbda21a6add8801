import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vacantia.llm import quality, registered, toxicity
from vacantia.llm.labelled import held_out, isotonic, training_sample
from vacantia.llm.words import SPACED, buffers, word_hashes

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("report", "label", "least"), [(toxicity.toxicity_report, "toxic", 0.85), (quality.quality_report, "quality", 0.95)])
def test_held_out_accuracy(spark, report, label, least):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    x = report(d, labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(x.doc_id, x.held_out, strict=True))
    x = x[x.held_out]
    s, y = x.score.to_numpy(), x[label].to_numpy()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert ((s >= 0) & (s <= 1)).all() and auc >= least


@pytest.mark.parametrize("report", [toxicity.toxicity_report, quality.quality_report])
def test_edges(spark, report):
    rows = [(i, "you idiot scum" if i % 2 else "good day to you", 14) for i in range(200)] + [(1000, None, None), (1001, "", 0), (1002, "z" * 300_000, 5), (1003, "word " * 200_000, -1), (None, "idiot", 3), (7, "you idiot scum", 14)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 as y", "2 as known_id", "'a' as score")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] + [(3, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = report(d, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert report(d.limit(0), labels).count() == 0
    assert report(d, labels.limit(0)).count() == len(rows)
    low = {r.doc_id: r.score for r in got}
    assert low[1] > 0.7 > 0.3 > low[2]


def test_without_toxic_keeps_columns(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(d, labels)
    bad = {r.doc_id for r in toxicity.scores(d, m).where("score >= 0.7").collect()}
    kept = toxicity.without_toxic(d, m)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in d.collect()} - bad and bad


@pytest.mark.parametrize("frequent", [0, 9, 40])
def test_index_is_exact(frequent):
    rnd = np.random.default_rng(3)
    x = rnd.random((700, 40)) * (rnd.random((700, 40)) < 0.15)
    x = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)
    row, term = np.nonzero(x)
    index = toxicity.Index(row, term, x[row, term], 40, rnd.integers(0, 2, 700).astype(float), np.ones(700), frequent)
    mine = row < 90
    cosine, who = index.nearest(row[mine], term[mine], x[row, term][mine], 90, 7)
    want = -np.sort(-(x[:90] @ x.T), axis=1)[:, :7]
    assert np.allclose(np.where(want > 0, want, 0), np.maximum(cosine, 0), atol=1e-5)
    assert (who[:, 0] >= 0).any()
    back = np.argsort(index.place)  # number in the index -> row
    assert np.allclose((x[:90, None] * x[back[np.maximum(who, 0)]]).sum(axis=2)[who >= 0], cosine[who >= 0], atol=1e-5)


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_toxicity_query_against_brute_force(spark):
    """All cosines of all documents with all examples, in plain Python."""
    d, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas(), spark.read.parquet("/root/testdata/sf0.001/labels.parquet").toPandas()
    got = {r.doc_id: r.score for r in registered.op8_toxicity(spark, "/root/testdata/sf0.001").collect()}
    counts = {i: Counter(_words(t)) for i, t in zip(d.doc_id, d.text, strict=True)}
    df = Counter(w for c in counts.values() for w in c)
    known = {i: int(t) for i, t in zip(labels.doc_id, labels.toxic, strict=True) if t in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1 and i in counts}
    n, n1 = len(known), sum(known.values())
    in_, toxic = Counter(w for i in known for w in counts[i]), Counter(w for i, y in known.items() if y for w in counts[i])
    factor = {w: (math.log((1 + len(d)) / (1 + df[w])) + 1e-3) * abs(toxic[w] * n - in_[w] * n1) / math.sqrt(max(in_[w] * (n - in_[w]) * (n - n1) * n1, 1e-9)) for w in in_}

    def vector(c):
        v = {w: (1 + math.log(k)) * factor[w] for w, k in c.items() if w in factor}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    vectors = {i: vector(c) for i, c in counts.items()}

    def vote(i, leave):
        near = sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in known if j != leave), reverse=True)[:15]
        total = sum(s * s for s, _ in near if s > 0)
        return (sum(s * s * known[j] for s, j in near if s > 0) / total if total > 1e-12 else -1.0), near

    own = {i: vote(i, i)[0] for i in known}
    ends, values = isotonic(np.array(list(own.values())), np.array([float(known[i]) for i in own]), np.ones(n))
    clear = 0
    for i in counts:
        v, near = vote(i, None)
        if len(near) < 15 or near[-1][0] > 0:
            at = np.searchsorted(ends, [v - 1e-4, v + 1e-4])
            low, high = values[np.minimum(at, len(values) - 1)]
            assert low - 1e-6 <= got[i] <= high + 1e-6
            clear += low == high
    assert clear > 0.5 * len(counts)


def test_rare_words_count(spark):
    """A word in a few of many toxic examples marks a text that has nothing else of them."""
    rnd = random.Random(5)
    plain = [" ".join(rnd.choices([f"w{k}" for k in range(400)], k=20)) for _ in range(900)]
    texts = [f"{p} {'zork' if k % 100 == 0 else 'vile'}" if k % 2 == 0 else p for k, p in enumerate(plain)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(5000, plain[1] + " zork"), (5001, plain[3])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(900)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_report(d, labels).where("doc_id >= 5000").collect()}
    assert got[5000] > got[5001]


def test_ties_and_repeats(spark):
    rows = [(i, "you idiot" if i % 2 else "good day", 9) for i in range(60)]
    d = spark.createDataFrame(rows + rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for report in (toxicity.toxicity_report, quality.quality_report):
        got = report(d, labels).collect()
        assert len(got) == 120 and len({(r.doc_id % 2, r.score) for r in got}) == 2


def test_sum_of_squares_identity():
    m = quality.FactorisationMachine(6, 3)
    m.v, m.w = np.random.default_rng(0).normal(size=(6, 3)), np.arange(6.0)
    col, value = np.array([0, 2, 5]), np.array([1.0, -2.0, 0.5])
    pairs = sum(m.v[a] @ m.v[b] * x * y for i, (a, x) in enumerate(zip(col, value, strict=True)) for b, y in list(zip(col, value, strict=True))[i + 1 :])
    assert np.isclose(m.raw(np.zeros(3, int), col, value, 1)[0], (m.w[col] * value).sum() + pairs)


def test_quality_query_against_all_pairs(spark):
    """The query's scores from the definition: every pair of inputs, one document at a time."""
    sf = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(d, labels)
    m, got = model.machine, {r.doc_id: r.score for r in registered.op5_quality(spark, sf).collect()}
    texts = d.select("doc_id", "text", "n_chars").collect()
    assert len(got) == len(texts)
    for r in texts[:40]:
        data, offsets = buffers(pa.array([r.text or ""]))
        row, bucket, value, stats = quality.features(data, offsets, np.array([float(r.n_chars or 0)]))
        words = {int(b) for b in word_hashes(data, offsets, SPACED)[0] & np.uint64(quality.BUCKETS - 1)}
        assert set(bucket.tolist()) == words and np.allclose(value, 1 / math.sqrt(max(len(words), 1)))
        x = dict(zip(bucket.tolist(), value.tolist(), strict=True)) | {quality.BUCKETS + k: float(v) for k, v in enumerate(np.clip((stats[0] - model.mean) / model.scale, -5, 5))}
        z = float(m.w0[0]) + sum(m.w[i] * v for i, v in x.items())
        z += sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for i in x for j in x if i < j)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-6


def test_sample_and_isotonic(spark):
    d = spark.createDataFrame([(i, "t", 1) for i in range(500)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 0, int(i % 10 == 0)) for i in range(500)], "doc_id long, quality int, toxic int")
    rows, weight = training_sample(d, labels, "toxic", 60)
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert sum(n.values()) <= 60 and n[1] == 30 and weight[1] < 1 < weight[0]
    assert d.where(held_out(d.doc_id)).count() == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(500))
    again = spark.createDataFrame([(i, "t", 1) for i in range(500) for _ in range(1 if i % 10 else 7)], "doc_id long, text string, n_chars long")
    assert 0 < training_sample(again, labels, "toxic", 60)[0].count() <= 60  # rows count, not ids
    ends, values = isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(values) > 0).all() and values[0] == 0 and values[-1] == 1 and len(ends) == 3
