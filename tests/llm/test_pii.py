import hashlib
import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import regex

from vacantia.llm.pii import find_personal_data, personal_data_report, sanitize

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(t):
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], t or "") if valid(kind, m[0])]
    said = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))
    return (*[sum(x[3] == k for x in found) for k in PLAIN], hashlib.sha256(said.encode()).hexdigest())


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in personal_data_report(df).collect())


def test_table(spark):
    d = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas()
    want = sorted((i, brute(t)) for i, t in zip(d.doc_id.tolist(), d.text, strict=True))
    assert got(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) == want and sum(sum(w[:4]) for _, w in want) > 20


def test_edges(spark):
    texts = [None, "", "a@b.c", "a@b.c_d@e.f.g x@y", "é😀 a@b.c 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (234) 567-8901 +12 + +1..2 +99999999999999999999", "9" * 50_000, "a." * 100_000 + "@x.y", "x@" + "y." * 50_000 + "z", "1 " * 20_000, " ".join(f"u{i}@h{i}.org" for i in range(700)), "+1234567890" * 50, "1.1.1.1" * 30, "a@b.c@d.e"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[4]), (None, texts[2]), (2, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'k' as base", "2 as spans", "3 as t")
    assert got(df) == sorted((-1 if i is None else i, brute(t)) for i, t in rows)
    assert got(df.limit(0)) == []


def test_revealing_terms(spark):
    filler = [(100 + i, f"common words fill this line number with nothing of note {i}") for i in range(60)]
    rows = [(1, "The witness Zanzibari wrote from zed@mail.org about common matters"), (2, "Again Zanzibari said common things to zed@mail.org yesterday"), (3, "zed@mail.org")] + filler
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.doc_id: [(rows[k][1][x.s : x.e], x.v) for x in r.spans if x.k == 4] for r in find_personal_data(df).collect() for k in [next(j for j, y in enumerate(rows) if y[0] == r.doc_id)]}
    assert ("Zanzibari", "remove") in terms[1] and ("Zanzibari", "remove") in terms[2] and not any("common" in t for t, _ in terms[1]) and not terms[3] and not any(terms[i] for i, _ in filler)
    clean = {r.doc_id: r.text for r in sanitize(df).collect()}
    assert "[EMAIL]" in clean[1] and not any("anzibari" in clean[i] for i in (1, 2)) and clean[100] == rows[3][1]
    # Far from any entity, too.
    far = df.union(spark.createDataFrame([(4, "Zanzibari far from any address, then zanzibari again")], df.schema))
    assert {r.doc_id: r.text for r in sanitize(far).collect()}[4] == "[NAME] far from any address, then [TERM] again"
    # One passage and its copies are no evidence.
    assert not any(x.k == 4 for r in find_personal_data(spark.createDataFrame([(i, rows[0][1]) for i in range(20)] + filler, "doc_id long, text string")).collect() for x in r.spans)


WORD = regex.compile(r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+")


def brute_terms(docs, context=80, support=2, low=0.8, high=0.95):
    """Spans of the revealing terms of each (id, text), by the definition."""
    seen, entity_n, places, total = {}, Counter(), Counter(), 1
    bases = [[(m.start(), m.end(), kind, m[0]) for kind in PLAIN for m in re.finditer(PLAIN[kind], t or "") if valid(kind, m[0])] for _, t in docs]
    for (_, t), base in zip(docs, bases, strict=True):
        words = [m[0].lower() for m in WORD.finditer(t or "")]
        places.update(words)
        total += len(words)
        for s, e, kind, v in base:
            entity = (kind, v.lower() if kind == "email" else v if kind == "ip" else re.sub("[^0-9]", "", v))
            entity_n[entity] += 1
            at = max(s - context, 0)
            left, right = t[at:s], t[e : e + context]
            found = [(m.start() + at, m.end() + at, m[0]) for m in WORD.finditer(left) if m.start() > 0 or at == 0]
            found += [(m.start() + e, m.end() + e, m[0]) for m in WORD.finditer(right) if m.end() < len(right) or e + len(right) >= len(t)]
            for a, b, w in found:
                if not any(x < b and a < y for x, y, _, _ in base):
                    seen.setdefault((w.lower(), entity), Counter())[left, right] += 1
    best = {}
    for (w, entity), c in seen.items():
        if len(c) >= support:
            n, content = sum(c.values()), -math.log2(entity_n[entity] / total)
            best[w] = max(best.get(w, -9), (math.log2(min(n / max(places[w], n), 1)) + content) / content)
    verdict = {w: "remove" if r >= high else "generalise" for w, r in best.items() if r >= low}
    return [sorted((m.start(), m.end(), verdict[m[0].lower()]) for m in WORD.finditer(t or "") if m[0].lower() in verdict and not any(x < m.end() and m.start() < y for x, y, _, _ in base)) for (_, t), base in zip(docs, bases, strict=True)]


def test_terms_against_brute_force(spark):
    rnd = random.Random(8)
    people = [(f"p{k}@mail{k}.org", f"Person{k}", f"Street{k // 2}") for k in range(12)]
    common = [f"word{k}" for k in range(60)]
    docs = []
    for i in range(240):
        mail, name, street = rnd.choice(people)
        w = rnd.choices(common, k=rnd.randrange(5, 60))
        for x, often in ((mail, 0.8), (name, 0.7), (street, 0.5), (rnd.choice(people)[1], 0.1), ("+44 20 7946 0958", 0.2)):
            if rnd.random() < often:
                w.insert(rnd.randrange(len(w)), x if "@" not in x else f"{x} Case{x[1:3]}")
        docs.append((i, " ".join(w)))
    docs += [(5, docs[5][1]), (300, None), (301, ""), (None, docs[7][1]), (302, "Person1 " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as said")
    want = sorted((-1 if i is None else i, x) for (i, _), x in zip(docs, brute_terms(docs), strict=True))
    got = sorted((-1 if r.doc_id is None else r.doc_id, [(x.s, x.e, x.v) for x in r.spans if x.k == 4]) for r in find_personal_data(df).collect())
    assert got == want and {v for _, x in want for *_, v in x} == {"remove", "generalise"}
    clean = sanitize(df)
    assert clean.columns == df.columns and clean.count() == len(docs) and sanitize(df.limit(0)).count() == 0
    assert any("[NAME]" in (r.text or "") or "[CODE]" in (r.text or "") for r in clean.collect())
