import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from vacantia.llm import language, registered
from vacantia.llm.language import fit_text, identify, text_log_likelihood
from vacantia.llm.words import buffers

SF = "/root/testdata/sf0.01"


def test_accuracy(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    got = identify(pages, docs).toPandas()
    assert len(got) == pages.count() and (got.lang == got.declared).mean() > 0.95
    assert got.probability.between(0, 1 + 1e-9).all()
    # Text alone, on documents that were not learnt from.
    names, model = fit_text(docs.where("doc_id % 3 <> 0"))
    rest = docs.where("doc_id % 3 = 0 and n_chars > 100").toPandas()
    said = np.array(names)[text_log_likelihood(*buffers(pa.array(rest.text)), model).argmax(axis=1)]
    assert (said == rest.lang).mean() > 0.9


def test_host_prior_and_declaration(spark):
    docs = spark.createDataFrame([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), (None, "de"), ("", "en"), ("x", None)], "text string, lang string")
    pages = [(i, f"https://a.one.de/{i}", "<html><p>der hund und die katze</p>") for i in range(30)] + [(i, f"https://b.two.com/{i}", "<html lang='en'><p>the cat and the dog</p>") for i in range(30, 60)]
    pages += [(100, "https://a.one.de/x", "<html></html>"), (101, "https://new.two.com/x", ""), (102, None, None), (103, "not a url", "<script>der hund"), (104, "https://z.org/", "<html lang=en>12"), (None, "https://b.two.com/1", "<p>" + "the dog " * 100_000), (1, "https://a.one.de/1", "<p>der hund")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as id", "'q' as lang", "2 as post")
    got = {r.page_id: r for r in identify(df, docs).collect()}
    assert got[100].lang == "de" and got[101].lang == "en" and got[104].lang == "en" and got[None].lang == "en"
    assert got[102].host is None and got[103].declared is None and identify(df, docs).count() == len(pages)
    assert identify(df.limit(0), docs).count() == 0 and {r.lang for r in identify(df, docs.limit(0)).collect()} == {None}


def test_query_against_brute_force(spark):
    """The fusion in plain Python; the trigram model is the module's own (test_accuracy holds it to labels)."""
    sf = "/root/testdata/sf0.001"
    names, model = fit_text(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: r for r in registered.op4_language(spark, sf).collect()}
    k, rows = range(len(names)), []
    for i, url, html in pages:
        data, offsets = buffers(pa.array([language._MARKUP.sub(" ", html or "")]))
        log = text_log_likelihood(data, offsets, model)[0]
        w = [math.exp(x - max(log)) for x in log]
        host = m[1] if (m := re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", (url or "").lower())) else None
        labels = host.split(".") if host else []
        said = m[1].lower() if (m := language._DECLARED.search(html or "")) else None
        rows.append((i, log, [x / sum(w) for x in w], said, labels[-1] if labels else None, ".".join(labels[-2:]) if len(labels) > 1 else None, host))
    mass = [defaultdict(lambda: [0.0] * len(names)) for _ in range(4)]
    for _, _, post, *groups in rows:
        for m, g in zip(mass, groups, strict=True):
            m[g] = [a + b for a, b in zip(m[g], post, strict=True)]
    whole = [sum(r[2][x] for r in rows) + 0.5 for x in k]
    prior = [x / sum(whole) for x in whole]
    smooth = lambda own, post, wider: [(max(own[x] - post[x], 0) + 5 * wider[x]) / (sum(max(own[y] - post[y], 0) for y in k) + 5) for x in k]
    for i, log, post, said, suffix, domain, host in rows:
        wide = smooth(mass[2][domain], post, prior) if domain else prior
        near = smooth(mass[3][host], post, wide) if host else wide
        like = lambda m, v: [math.log((m[v][x] + 0.5) / (whole[x] + 0.5 * len(m))) for x in k]
        score = [a + math.log(b) + c + d for a, b, c, d in zip(log, near, like(mass[0], said), like(mass[1], suffix), strict=True)]
        p = 1 / sum(math.exp(x - max(score)) for x in score)
        assert abs(got[i].probability - p) < 1e-6 and (p < 0.6 or got[i].lang == names[score.index(max(score))])


def test_ties_and_repeats(spark):
    docs = spark.createDataFrame([("same words here", x) for x in ("nl", "af")], "text string, lang string")
    pages = spark.createDataFrame([(1, "https://a.org/", "same words")] * 3 + [(2, "https://a.org/", "<p>same words")], "page_id long, url string, html string")
    got = identify(pages, docs).collect()
    assert len(got) == 4 and {r.lang for r in got} == {"af"} and len({r.probability for r in got if r.page_id == 1}) == 1


def test_any_number_of_languages(spark, monkeypatch):
    words = [f"w{k}a w{k}b w{k}c w{k}d " * 4 for k in range(30)]
    docs = spark.createDataFrame([(w, f"l{k:02}") for k, w in enumerate(words)], "text string, lang string")
    pages = spark.createDataFrame([(k, f"https://h{k}.org/", w) for k, w in enumerate(words)], "page_id long, url string, html string")
    want = {r.page_id: (r.lang, round(r.probability, 9)) for r in identify(pages, docs).collect()}
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 7)
    assert {r.page_id: (r.lang, round(r.probability, 9)) for r in identify(pages, docs).collect()} == want
    assert Counter(x for x, _ in want.values()) == Counter(f"l{k:02}" for k in range(30))
