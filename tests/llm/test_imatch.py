import hashlib
import math
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from vacantia.llm import imatch

pytestmark = pytest.mark.usefixtures("few_partitions")
DOCS = "doc_id long, text string, unit string, start int"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hash_text(s):
    return signed(xxhash.xxh64(s.encode(), seed=42).intdigest())


def hash_numbers(*parts):
    """xxhash64 of long (8 bytes) and int (4 bytes) values, each seeded by the last; the first seed is 42."""
    seed = 42
    for value, size in parts:
        seed = xxhash.xxh64((value % (1 << (8 * size))).to_bytes(size, "little"), seed=seed).intdigest()
    return signed(seed)


def terms(text):
    return {hash_text(w) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w}


def band(texts):
    slots, n = {}, {}
    for t in texts:
        for s in {h % (1 << imatch.SLOTS) for h in terms(t)}:
            slots[s] = slots.get(s, 0) + 1
    return {s for s, n in slots.items() if imatch.BAND[0] <= math.log(len(texts) / n) <= imatch.BAND[1]}


def fingerprint(text, lexicon):
    t = terms(text)
    t = {h for h in t if h % (1 << imatch.SLOTS) in lexicon} or t or {hash_text(text)}
    level, out = (len(t) - 1).bit_length(), []
    for at in range(level, level + imatch.LEVELS):
        found = {}
        for r in range(max(1, imatch.SUBSETS >> at)):
            for h in t:
                s = (r << at) + hash_numbers((h, 8), (r, 4)) % (1 << at)
                if s < imatch.SUBSETS:
                    found.setdefault(s, []).append((s << 56) | (h % (1 << 56)))
        hashes = {}
        for s, entries in found.items():
            x = None
            for e in sorted(entries):
                x = hash_numbers((e, 8)) if x is None else hash_numbers((x, 8), (e, 8))
            hashes[s] = x % (1 << imatch.BITS)
        out.append(hashes)
    return level, out


def as_text(fp):
    return ":".join([str(fp[0]), *("".join(f"{(s << imatch.BITS) | x:08x}" for s, x in sorted(h.items())) for h in fp[1])])


def likeness(a, b):
    level = max(a[0], b[0])
    if a == b:
        return 1.0
    if min(a[0], b[0]) + imatch.LEVELS <= level:
        return 0.0
    x, y = (f[1][level - f[0]] for f in (a, b))
    return sum(x[s] == y.get(s) for s in x) / len({*x, *y})


def invented(seed, n=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgÄé日") for _ in range(r.randint(3, 8))) for _ in range(2500)]
    return [r.choice([" ", "\n", ", "]).join(vocabulary[int(2500 * r.random() ** 2)] for _ in range(int(1.5 ** r.randint(1, 16)))) for _ in range(n)]


def test_against_brute_force(spark):
    texts = invented(1)
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "..."), (503, "."), (504, "x"), (505, texts[3]), (506, texts[3] + " more"), (7, "another text of one id"), (None, "no id"), (None, None), (508, "é" * 5000)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS).repartition(6)
    got = imatch.likeness_report(docs).collect()
    lexicon = band([t or "" for _, t in rows])
    unit = lambda i, t: hashlib.md5(f"{'-' if i is None else i}:{t}".encode()).digest()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), unit(*x)))
    want = []
    for (i, t), (j, after) in zip(order, order[1:] + order[:1], strict=True):
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, other, following = (fingerprint(x, lexicon) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, following), j))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert [tuple(r) for r in sorted(map(tuple, got), key=key)] == sorted(want, key=key)
    assert sum(w[5] for w in want) / len(want) > 0.3 and sum(w[6] for w in want) / len(want) < 0.1


def test_repeated_rows_and_single_rows(spark):
    frame = lambda rows: spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS)
    assert imatch.likeness_report(frame([])).count() == 0
    one = imatch.likeness_report(frame([(4, "some words here")])).first()
    assert (one.near_next, one.next_doc_id, one.edited_sha256) == (1.0, 4, hashlib.sha256(b"some wordssome ").hexdigest())
    got = imatch.likeness_report(frame([(1, "abc def"), (1, "abc def"), (1, "abc def"), (2, "something else")])).collect()
    assert sorted((r.doc_id, r.next_doc_id) for r in got) == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_own_lexicon_and_equal_texts(spark):
    texts = invented(2, 60)
    docs = spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts + texts)], DOCS)
    bits = imatch.lexicon(docs.where("doc_id < 60"))
    got = imatch.fingerprints(docs, bits).groupBy("text").agg(F.countDistinct("fingerprint").alias("n")).agg(F.max("n")).first()[0]
    assert got == 1
