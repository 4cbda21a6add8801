"""Language of web pages by fusing evidence with Bayes' rule.

log P(l | page) = log prior of the page's host + text log-likelihood + log P(declared language | l) + log P(address suffix | l) + const.

- Text: naive Bayes on hashed byte trigrams, counted over all labelled documents by grouped aggregation. Trigrams overlap and so are not
  independent; the log-likelihood of a text is scaled to at most EVIDENCE trigrams.
- Declared language and address suffix (the last label of the host): likelihoods from the pages' text posteriors, summed by group.
- Host prior: the posterior mass of the host's other pages, smoothed towards that of its registered domain, which is smoothed towards the
  whole table. A page's own mass is left out, so that a page doesn't vote for itself.

Null or empty pages have only a prior; a page without a host has the whole table's. Without labelled documents the language is null. Repeated rows are
judged alike. Languages are those of the labelled documents, however many: LANGUAGES_AT_ONCE of them are scored in one pass over the pages. Ties go to
the language whose name comes first.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch, join_groups
from vacantia.llm.words import buffers, mix, slices

BUCKETS = 1 << 14
EVIDENCE = 200
#: Pages' worth of belief in the wider group, and of each unseen value.
STRENGTH, UNSEEN = 5.0, 0.5
LANGUAGES_AT_ONCE = 200

_MARKUP = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>?|&[a-z#0-9]{1,10};")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})")
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the byte trigrams inside each text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data]
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:-2] == row[2:]
    return row[:-2][inside], (mix(code[inside].astype(np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def fit_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log P(bucket | language), from all documents with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 20):
                names = rows.column(1).to_pylist()
                known = sorted(set(names))
                of = np.array([known.index(x) for x in names])
                row, bucket = trigrams(data, offsets)
                each = np.bincount(of[row] * BUCKETS + bucket, minlength=len(known) * BUCKETS).reshape(-1, BUCKETS)
                for k, x in enumerate(known):
                    total[x] = total[x] + each[k] if x in total else each[k]
        for x, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    # One row for each language and bucket.
    found = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket = found["lang"].combine_chunks().dictionary_encode(), found["bucket"].to_numpy()
    found_names = lang.dictionary.to_pylist()
    names = sorted(found_names)
    place = np.array([names.index(x) for x in found_names], np.int64)
    n = np.zeros((len(names), BUCKETS))
    n[place[lang.indices.to_numpy()], bucket] = found["n"].to_numpy()
    return names, np.log((n + 0.5) / (n + 0.5).sum(axis=1, keepdims=True))


def text_log_likelihood(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """A row of log-likelihoods for each text."""
    row, bucket = trigrams(data, offsets)
    n = len(offsets) - 1
    out = np.stack([np.bincount(row, m[bucket], n) for m in model], axis=1) if len(model) else np.zeros((n, 0))
    return out * np.minimum(1.0, EVIDENCE / np.maximum(np.bincount(row, minlength=n), 1))[:, None]


def _host(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, lang, probability, text_lang, declared, suffix, host of each page."""
    scratch = Scratch(pages.sparkSession)
    names, model = fit_text(docs)

    def read_block(model: np.ndarray, first: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, _, _ in slices(batch, "html", 1 << 20):
                    html = [h or "" for h in rows.column(2).to_pylist()]
                    data, offsets = buffers(pa.array([_MARKUP.sub(" ", h) for h in html], pa.string()))
                    log = text_log_likelihood(data, offsets, model).tolist()
                    if first:
                        declared = pa.array([m[1].lower() if (m := _DECLARED.search(h)) else None for h in html], pa.string())
                    else:
                        declared, log = rows.column(3), [a + b for a, b in zip(rows.column(4).to_pylist(), log, strict=True)]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:3], declared, pa.array(log, pa.list_(pa.float64()))], names=["id", "url", "html", "declared", "log"])

        return run

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = source.schema["id"].dataType.simpleString()
    if not names:
        host = _host(F.col("url"))
        return source.select(F.col("id").alias(id_col), F.expr("cast(null as string)").alias("lang"), F.expr("cast(null as double)").alias("probability"), F.expr("cast(null as string)").alias("text_lang"), F.expr("cast(null as string)").alias("declared"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), host.alias("host"))
    top = F.array_max("log")
    weight = F.transform("log", lambda x: F.exp(x - top))
    total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
    read = source
    for at in range(0, len(names), LANGUAGES_AT_ONCE):
        read = read.mapInArrow(read_block(model[at : at + LANGUAGES_AT_ONCE], at == 0), f"id {kind}, url string, html string, declared string, log array<double>")
        if at + LANGUAGES_AT_ONCE < len(names):
            read = scratch.write(read, f"languages{at}")
    read = read.select("id", "declared", "log", F.transform(weight, lambda x: x / total).alias("post"), _host(F.col("url")).alias("host"))
    read = read.select("*", F.nullif(F.regexp_extract("host", r"([^.]+)$", 1), F.lit("")).alias("suffix"), F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"))
    base = scratch.write(read, "pages")

    k = range(len(names))
    sums = F.array(*[F.sum(F.col("post")[i]) for i in k]).alias("mass")
    add = F.array(*[F.sum(F.col("mass")[i]) for i in k]).alias("mass")
    hosts = scratch.write(base.groupBy("host", "domain").agg(sums, F.count("*").alias("pages")), "hosts")
    domains = hosts.groupBy("domain").agg(add, F.sum("pages").alias("domain_pages"))
    all_mass = hosts.agg(add).first()[0]
    whole = np.array([x or 0.0 for x in (all_mass or [0.0] * len(names))]) + UNSEEN
    prior = F.array(*[F.lit(float(x)) for x in whole / whole.sum()])

    def group(column: str) -> DataFrame:
        """log P(value | language) of the column's values."""
        mass = scratch.write(base.groupBy(column).agg(sums, F.count("*").alias(f"{column}_pages")), column)
        n = mass.count()
        logs = F.array(*[F.log((F.col("mass")[i] + UNSEEN) / F.lit(float(whole[i] - UNSEEN + UNSEEN * (n + 1)))) for i in k])
        return mass.select(column, logs.alias(f"{column}_log"), f"{column}_pages")

    def smoothed(mass: Column, wider: Column) -> Column:
        sum_ = F.aggregate(mass, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(mass, wider, lambda m, w: (m + STRENGTH * w) / (sum_ + STRENGTH))

    less = lambda mass: F.zip_with(mass, F.col("post"), lambda m, p: F.greatest(m - p, F.lit(0.0)))
    # A page without a host belongs to no group.
    joined = join_groups(base, hosts.select("host", F.when(F.col("host").isNotNull(), F.col("mass")).alias("host_mass"), "pages"), "host", "pages")
    joined = join_groups(joined, domains.select("domain", F.when(F.col("domain").isNotNull(), F.col("mass")).alias("domain_mass"), "domain_pages"), "domain", "domain_pages")
    for column in ("declared", "suffix"):
        joined = join_groups(joined, group(column), column, f"{column}_pages")
    by_domain = F.when(F.col("domain_mass").isNull(), prior).otherwise(smoothed(less(F.col("domain_mass")), prior))
    joined = joined.withColumn("by_domain", by_domain).withColumn("prior", F.when(F.col("host_mass").isNull(), F.col("by_domain")).otherwise(smoothed(less(F.col("host_mass")), F.col("by_domain"))))
    score = F.array(*[F.col("log")[i] + F.log(F.col("prior")[i]) + F.col("declared_log")[i] + F.col("suffix_log")[i] for i in k])
    scored = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    pick = lambda c: F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(c, F.array_max(c)).cast("int"))
    return scored.select(F.col("id").alias(id_col), pick(F.col("score")).alias("lang"), (1 / F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)).alias("probability"), pick(F.col("post")).alias("text_lang"), "declared", "suffix", "host")
