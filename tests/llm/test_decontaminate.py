import hashlib
import random
import re

import pandas as pd
import pyarrow.parquet as pq

from vacantia.llm import decontaminate
from vacantia.llm.decontaminate import contamination_report, find_matches, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(None if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    items |= x
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items - {None})).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_against_brute_force_on_table(spark):
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    b = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pandas()
    got = rows(contamination_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")))
    assert got == brute(zip(d.doc_id, d.text, strict=True), zip(b.item_id, b.text, strict=True))
    assert sum(x[4] for x in got.values()) > 5


def test_edges(spark):
    base = " ".join(f"w{i % 7}x{i}" for i in range(40))
    bench = [(1, base), (2, "Tiny"), (3, ""), (4, None), (None, base), (5, "é à ü"), (1, "again " + base), (6, "a a a a a a a a a a a a a a a a")]
    docs = [(1, base.upper()), (2, None), (3, ""), (4, "x tiny-y tiny"), (5, base[:60]), (6, "é, à! ü É"), (7, "a " * 50), (7, "b"), (None, "tiny"), (8, "q" * 3_000_000 + " tiny"), (9, "z " * 200_000 + base)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as matches", "2 as item_id")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (1 << 20, 10):
        got = find_matches(d, b, block_words=block).selectExpr("doc_id", "n_words", "aggregate(hits, 0, (a,h)->a+h.end-h.start) n_hit", "size(array_distinct(transform(matches, m->m.item_id))) n").collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n) for r in got) == sorted((k or 0, *brute([(0, t)], bench)[0][:3]) for k, t in docs)
    named = d.selectExpr("doc_id", "text", "1 as hits", "2 as n_words", "'m' as matches", "3 as id")
    assert remove_contaminated(named, b).columns == named.columns
    kept = {r.doc_id for r in remove_contaminated(named, b).collect()}
    assert kept == {2, 3, 5, 7, 9}
    assert contamination_report(d.limit(0), b).count() == 0
    assert contamination_report(d, b.limit(0)).where("contaminated").count() == 0


def test_items_without_an_id(spark):
    text = " ".join(f"k{i}" for i in range(30))
    docs, bench = [(1, text), (2, "a b " + text[:80]), (3, "none")], [(None, text), (None, "b"), (7, text)]
    for b in (bench, bench[:2]):
        assert rows(contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string"))) == brute(docs, b)


def test_many_blocks_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    bench = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(9)]
    docs = [(k, f"x y {bench[k][1]} z {bench[(k + 4) % 9][1][:60]}") for k in range(9)] + [(20, "x y z")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert rows(decontaminate.find_matches(d, b, block_words=20).transform(lambda f: decontaminate.digest(f))) == brute(docs, bench)
    assert {r.doc_id for r in remove_contaminated(d, b, block_words=20).collect()} == {20}


def test_locations(spark):
    text = " ".join(f"k{i}" for i in range(30))
    d = spark.createDataFrame(pd.DataFrame({"doc_id": [1], "text": ["pre fix " + " ".join(text.split()[5:25]) + " end"]}))
    b = spark.createDataFrame(pd.DataFrame({"item_id": [9], "text": [text]}))
    assert [tuple(m) for m in find_matches(d, b).first().matches] == [("9", 5, 2, 20)]


def test_fragments_that_leave_an_item_and_go_on_in_its_words(spark):
    item = [f"t{i}" for i in range(13)]
    broken = " ".join(item[:3] + ["t8"])
    rng = random.Random(5)
    mixed = [" ".join(w for _ in range(12) for k in [rng.randrange(13)] for w in (item if rng.random() < 0.2 else item[k : k + rng.randrange(1, 9)])) for _ in range(300)]
    for texts in ([broken, " ".join(item)], [broken] * 3 + [" ".join(item)], [broken] * 10 + [" ".join(item)], mixed):
        docs, bench = list(enumerate(texts)), [(1, " ".join(item)), (2, "t3 t1 t2"), (3, "t5"), (4, " ".join(item[::-1] + item))]
        for b in (bench[:1], bench):
            got = rows(contamination_report(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(b, "item_id long, text string")))
            assert got == brute(docs, b)


def longest(text, item):
    """Longest common run of words of at least 13 (or the whole of a shorter item): (item word, text word, words)."""
    a, b, best = words(item), words(text), None
    need = min(13, len(a))
    for j in range(len(b)):
        for i in range(len(a)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= need and (best is None or n > best[2]):
                best = (i, j, n)
    return best


def test_longest_matches_with_each_item(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 7)
    rng = random.Random(3)
    items = [" ".join(rng.choice("abc") if k % 2 else f"w{rng.randrange(9)}" for _ in range(rng.choice([3, 14, 20, 30]))) for k in range(12)] + ["z " * 20, "z " * 13]
    docs = [(k, " ".join(" ".join(rng.choice(items).split()[rng.randrange(3) :]) + rng.choice(["", " mid"]) for _ in range(4))) for k in range(40)] + [(99, "z " * 60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    # On the driver, so that the small pieces hold.
    block = next(decontaminate.test_blocks(bench, 13, "item_id", "text", 1 << 20))
    data = "".join(t for _, t in docs).encode()
    ends = [0]
    for _, t in docs:
        ends.append(ends[-1] + len(t.encode()))
    import numpy as np

    hashes, first = decontaminate.word_hashes(np.frombuffer(data, np.uint8), np.array(ends), decontaminate.ALNUM)
    best, _ = decontaminate.shard_matches(hashes, first, block)
    got = {(docs[r][0], int(block.ids[i])): (a, b, n) for r, i, a, b, n in zip(*(x.tolist() for x in best), strict=True)}
    want = {(d, k): m for d, t in docs for k, item in enumerate(items) if (m := longest(t, item))}
    assert {k: m[2] for k, m in got.items()} == {k: m[2] for k, m in want.items()}
    assert {k: (m[1], m[0]) for k, m in got.items()} == {k: (m[1], m[0]) for k, m in want.items()}
    assert {(r.doc_id, int(m.item_id)): (m.item_word, m.doc_word, m.n_words) for r in find_matches(df, bench).collect() for m in r.matches} == want
    assert rows(contamination_report(df, bench)) == brute(docs, list(enumerate(items)))


def test_repetitive_texts_take_little_memory(spark):
    import tracemalloc

    import numpy as np

    shared = " ".join(f"s{k}" for k in range(13))
    bench = [(0, "a " * 1000)] + [(k, f"{shared} tail{k}") for k in range(1, 3001)]
    block = next(decontaminate.test_blocks(spark.createDataFrame(bench, "item_id long, text string"), 13, "item_id", "text", 1 << 20))
    for text in ("a " * 20_000, (shared + " x ") * 800):
        data = np.frombuffer(text.encode(), np.uint8)
        tracemalloc.start()
        n, matches, hits = decontaminate.row_matches(data, np.array([0, len(data)]), [type("B", (), {"value": block})])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400e6
        assert len(matches[0]) == (1 if text[0] == "a" else 3000) and max(m[3] for m in matches[0]) == (1000 if text[0] == "a" else 13)
        assert sum(b - a for a, b in hits[0]) == (20_000 if text[0] == "a" else 800 * 13)
