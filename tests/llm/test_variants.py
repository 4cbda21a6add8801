import random
import re
import zlib
from collections import Counter

import pytest

from vacantia.llm import variants

pytestmark = pytest.mark.usefixtures("few_partitions")
DOCS = "doc_id long, text string, word string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows):
    out, low = Counter(), str.maketrans(variants.UPPER, variants.LOWER)
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(words):
    out = {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = others[0] if others and words[others[0]] >= 2 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def same(got, words):
    rows = got.collect()
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(rows) == len(words)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == brute(words)


def test_report_against_brute_force(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("abàÿn") for _ in range(r.randint(4, 9))) for _ in range(60)]
    rows = []
    for k in range(400):
        words = [w if r.random() < 0.8 else w[: (p := r.randrange(len(w)))] + r.choice(["", "a", "b" + w[p], "É"]) + w[p + 1 :] for w in (r.choice(stems[: 1 + int(60 * r.random() ** 2)]) for _ in range(30))]
        rows.append((k if k % 50 else None, r.choice([" ", "-", "1"]).join(w.title() if r.random() < 0.2 else w for w in words)))
    rows += [(1, None), (2, ""), (3, "12 34"), rows[7], rows[7], (9, "x" * 3000 + " " + "x" * 3001), (9, "x" * 3000 + "." + "x" * 3000 + "." + "x" * 3001 + "." + "x" * 3001)]
    words = brute_words(rows)
    assert len(words) > 150 and len({len(w) for w in words}) > 6 and "x" * 3000 in words
    same(variants.variants_report(spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS).repartition(7)), words)


@pytest.mark.parametrize("tile", [16, 40, 4096])
def test_large_sets_are_cut_into_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(variants, "TILE", tile)
    r = random.Random(tile)
    words = {"aa" + "".join(r.choice("abc") for _ in range(r.randint(3, 5))): r.choice([3, 3, 6, 7, 12, 30]) for _ in range(300)}
    words |= {w[::-1] + "ss": n for w, n in list(words.items())[:100]}
    same(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")), words)


def test_chains_ties_and_other_alphabets(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbc": 200, "слово": 3, "слова": 9, "слову": 9, "aaaaaz": 3, "eeeee": 5, "eeee": 90, "日本語日本": 4}
    same(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")), words)
    assert variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert variants.variants_report(spark.createDataFrame([], DOCS)).count() == 0
