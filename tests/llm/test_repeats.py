import collections
import hashlib
import random

import pyarrow.parquet as pq

from vacantia.llm import repeats
from vacantia.llm.repeats import COVER, V, repeated_spans


def brute(docs, length=200):
    count = collections.Counter()
    raw = [(t or "").encode() for _, t in docs]
    for b in raw:
        for i in range(len(b) - length + 1):
            count[hashlib.md5(b[i : i + length]).digest()] += 1
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[hashlib.md5(b[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((-1 if d is None else d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_cover():
    assert len({(a - b) % V for a in COVER for b in COVER}) == V


def test_table(spark):
    d = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas()
    want = brute(list(zip(d.doc_id.tolist(), d.text, strict=True)))
    assert got(repeated_spans(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) == want and sum(w[2] for w in want) > 1000


def test_edges(spark):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    p200, p199, p250 = "x" + text(150) + "é" * 20 + "0123456789", text(180), text(260)
    p200 = p200.encode()[:200].decode("utf-8", "ignore").ljust(200, "q")[:200]
    docs = [(1, None), (2, ""), (3, text(150)), (4, text(300) + p250 + text(50)), (5, p250), (6, text(77) + p250[:230] + text(400)), (7, "z" * 1000), (8, "ab" * 99 + "c"), (9, p199), (10, p199), (11, "k" + p199 + "m"), (12, text(500)), (None, text(90) + p200 + text(13)), (13, p200 + text(200)), (12, "tail")]
    docs += [(20, docs[11][1]), (21, "m" * 200), (22, text(3000)), (23, "n" * 201)]
    docs += [(30 + k, text(k * 7) + p250 + text(40)) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'c' as cls", "2 as bucket")
    assert got(repeated_spans(df)) == brute(docs)
    assert got(repeated_spans(df.limit(0))) == []


def test_stretches_in_many_chunks(spark, monkeypatch, few_partitions):
    """Long repeats settle whole stretches; their parts elsewhere find the copy that speaks for them, in whatever chunk it is."""
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    long = [text(n) for n in (250, 330, 420, 700, 2500)]
    docs = []
    for k in range(160):
        p = long[k % 5]
        a = rnd.randrange(0, len(p) - 190)
        part = p if k % 3 else p[a : a + rnd.randrange(190, 520)]
        docs.append((k, text(rnd.randrange(0, 400)) + part + text(rnd.randrange(0, 300)) + (part if k % 17 == 0 else "")))
    docs += [(200, "q" * 1500), (201, "xyz" * 300 + text(50)), (202, long[4]), (203, long[4]), (204, text(60) + long[4][300:520])]
    monkeypatch.setattr(repeats, "CHUNK", 4000)
    monkeypatch.setattr(repeats, "FILE", 30000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(repeated_spans(df)) == brute(docs)


def test_verdicts_by_chunk(spark, monkeypatch):
    """Verdicts are rows of chunks and buckets, not of texts and buckets: a passage in all texts is named twice a chunk at most."""
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, made = text(320), []
    docs = [(k, text(60) + passage + text(60)) for k in range(3000)]
    write = repeats.Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name.startswith("masks"):
            made.append(out.count())
        return out

    monkeypatch.setattr(repeats.Scratch, "write", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r.n_removed >= 320 for r in repeated_spans(df).collect())
    assert made and max(made) <= 2 * 1024
