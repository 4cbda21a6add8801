"""Personal data: pattern spans, and terms that reveal them, by information theory. DataFrame functions only.

1. Base spans: e-mail and IP addresses, card and phone numbers, leftmost and non-overlapping in each kind.
2. Each distinct value is a protected entity e. Terms (words of three letters or more) in a window of `context` code points around its places co-occur with it. Over the
   whole corpus, P(e|t) is the share of t's places that lie near e, and the information of e is IC(e) = -log2 P(e), with P(e) e's share of all term places.
   Term t reveals e as far as PMI(e;t) = log2 P(e|t) / P(e) approaches IC(e). A term that reveals any entity by `generalise` x IC(e) or more is generalised,
   by `remove` x IC(e) or more removed, at every place of the corpus, near the entity or not.
3. A term counts only with `support` different contexts of e: one passage and its copies are no evidence. So an entity with a single context has no revealing term.

A generalised term is replaced by the kind of word it is: NAME with a capital letter in front, CODE with a digit in it, else TERM. Counts cover all documents. Candidate
terms go to the scans by broadcast if there are at most BROADCAST_TERMS of them, else by a shuffle join. Hot entities and terms are summed before each shuffle.
Positions count code points; ends are exclusive. Null texts are empty; rows with equal id and text get equal spans, and so do terms with equal counts (a tie with
a threshold reaches it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch, own_names

# The kinds in order, and their patterns. Possessive forms and the look-behinds match what the plain patterns match, without repeated work on long runs.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_VALUE = rf"^{_PART}(?:\.{_PART}){{3}}$"
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+"

#: Code points on each side of a span that count as its context.
CONTEXT = 80
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
BROADCAST_TERMS = 100_000
_CHUNK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(a: Column) -> Column:
    """Running sums, from 0."""
    return F.aggregate(a, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def _running(lengths: Column) -> Column:
    """Sum of the elements before each; in chunks, so that long arrays don't cost their square."""

    def over(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _CHUNK).cast("int")), lambda k: _sums(F.slice(a, k * _CHUNK + 1, F.lit(_CHUNK))))
        return _let(chunks, joined)

    def joined(chunks: Column) -> Column:
        before = _sums(F.transform(chunks, lambda c: F.element_at(c, -1)))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x + b)))

    return _let(lengths, over)


def _placed(text: Column, pattern: str, matches: Column) -> Column:
    """(s, e, v) of the matches: what lies between them has known lengths too."""

    def place(pieces: Column) -> Column:
        begun = F.arrays_zip(pieces.alias("x"), _running(F.transform(pieces, lambda x: x["p"] + x["m"])).alias("b"))
        return F.transform(begun, lambda z: F.struct((z["b"] + z["x"]["p"]).alias("s"), (z["b"] + z["x"]["p"] + z["x"]["m"]).alias("e"), z["x"]["v"].alias("v")))

    def some(m: Column) -> Column:
        pieces = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda p, v: F.struct(F.length(p).alias("p"), F.length(v).alias("m"), v.alias("v")))
        return F.when(F.size(m) > 0, _let(pieces, place)).otherwise(F.array().cast("array<struct<s:int,e:int,v:string>>"))

    return _let(matches, some)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    backwards = F.reverse(_digits(v))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    n = F.length(_digits(v))
    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(IP_VALUE),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
_SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (id, text) with `base`: array of (s, k, e, v), by start and kind; k is the kind's number."""
    text = F.col("text")
    found = docs.select("id", F.coalesce(text, F.lit("")).alias("text"))
    near = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    for kind, pattern in PATTERNS.items():
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = found.withColumn(kind, F.when(near[kind], every).otherwise(F.array().cast("array<string>")) if kind in near else every)

    def spans(k: int, kind: str) -> Column:
        valid = F.filter(_placed(text, PATTERNS[kind], F.col(kind)), lambda x: _VALID[kind](x["v"]))
        numbered = F.transform(valid, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(F.exists(kind, _VALID[kind]), numbered).otherwise(F.array().cast(_SPAN))

    arrays = [spans(k, kind) for k, kind in enumerate(PATTERNS)]
    return found.select("id", "text", F.array_sort(F.concat(*[a.cast(_SPAN) for a in arrays])).alias("base"))


def _contexts(text: Column, base: Column, context: int) -> Column:
    """For each base span: its entity, a fingerprint of its context, and the terms there that lie outside all base spans."""

    def terms(part: Column, shift: Column, at_start: Column, at_end: Column, others: Column) -> Column:
        def inside(p: Column) -> Column:
            whole = F.filter(_placed(p, TERM, F.regexp_extract_all(p, F.lit(TERM), F.lit(0))), lambda x: ((x["s"] > 0) | at_start) & ((x["e"] < F.length(p)) | at_end))
            return F.transform(whole, lambda x: F.struct((x["s"] + shift).alias("s"), (x["e"] + shift).alias("e"), F.lower(x["v"]).alias("t")))

        return F.filter(_let(part, inside), lambda x: ~F.exists(others, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

    def one(b: Column) -> Column:
        from_ = F.greatest(b["s"] - context, F.lit(0))
        left, right = F.substring(text, from_ + 1, b["s"] - from_), F.substring(text, b["e"] + 1, F.lit(context))
        value = F.when(b["k"] == 0, F.lower(b["v"])).when(b["k"] == 1, b["v"]).otherwise(_digits(b["v"]))
        close = F.filter(base, lambda o: (o["s"] < b["e"] + context) & (o["e"] > b["s"] - context))
        inside = _let(close, lambda o: F.concat(terms(left, from_, from_ == 0, F.lit(True), o), terms(right, b["e"], F.lit(True), b["e"] + F.length(right) >= F.length(text), o)))
        return F.struct(F.concat_ws(":", b["k"], value).alias("entity"), F.xxhash64(left, right).alias("context"), inside.alias("terms"))

    return F.when(F.size(base) > 0, F.transform(base, one)).otherwise(F.array().cast("array<struct<entity:string,context:bigint,terms:array<struct<s:int,e:int,t:string>>>>"))


def revealing_terms(near: DataFrame, entities: DataFrame, source: DataFrame, total: float, scratch: Scratch, support: int, generalise: float, remove: float) -> DataFrame:
    """(t, v): terms that reveal an entity, with the stronger of their verdicts. near: entity, context, t for each place; entities: entity, entity_places."""
    together = near.groupBy("t", "entity", "context").agg(F.count("*").alias("n")).groupBy("t", "entity").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).where(F.col("contexts") >= support)
    together = scratch.write(together, "together")
    candidates = together.select("t").distinct()
    many = candidates.count()
    words = source.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("w"))
    own = F.broadcast(candidates) if many <= BROADCAST_TERMS else candidates
    places = words.join(own, F.col("w") == F.col("t")).groupBy("t").agg(F.count("*").alias("places")) if many else candidates.withColumn("places", F.lit(0).cast("long"))
    share = F.least(F.col("n") / F.greatest("places", "n"), F.lit(1.0))
    content = -F.log2(F.col("entity_places") / total)
    revealed = together.join(places, "t").join(entities, "entity").select("t", ((F.log2(share) + content) / content).alias("revealed")).groupBy("t").agg(F.max("revealed").alias("revealed"))
    return scratch.write(revealed.where(F.col("revealed") >= generalise).select("t", F.when(F.col("revealed") >= remove, "remove").otherwise("generalise").alias("v")), "revealing")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, context: int = CONTEXT) -> DataFrame:
    """id_col, text_key, spans: array of (s, k, e, v), by start and kind (KINDS), for every row.

    v is the value, for a term "generalise" or "remove". text_key (a hash of the text) with the id tells rows apart.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = base_spans(source).select("id", F.xxhash64("text").alias("text_key"), "base", _contexts(F.col("text"), F.col("base"), context).alias("contexts"), F.regexp_count("text", F.lit(TERM)).alias("n_terms"))
    base = scratch.write(scanned, "base")
    contexts = base.where("size(base) > 0").select(F.explode("contexts").alias("c")).select("c.*")
    entities = contexts.groupBy("entity").agg(F.count("*").alias("entity_places"))
    near = contexts.select("entity", "context", F.explode("terms.t").alias("t"))
    total = float(base.agg(F.sum("n_terms")).first()[0] or 0) + 1.0
    revealing = revealing_terms(near, entities, source, total, scratch, support, generalise, remove)
    many = revealing.count()
    base = base.select("id", "text_key", "base")
    if not many:
        return base.select(F.col("id").alias(id_col), "text_key", F.col("base").alias("spans"))
    own = F.broadcast(revealing) if many <= BROADCAST_TERMS else revealing
    # First which words of which texts, as numbers; then the places of these words, in these texts alone.
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    keyed = source.select("id", F.xxhash64("text").alias("text_key"), "text")
    hit = keyed.select("id", "text_key", F.posexplode(words).alias("no", "w")).select("id", "text_key", "no", F.lower("w").alias("w")).join(own, F.col("w") == F.col("t"))
    hit = hit.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("no", "v")).alias("said"))
    found = keyed.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("_id", "_key", "said", _placed(F.col("text"), TERM, words).alias("placed"))
    span = lambda x: F.struct(F.get("placed", x["no"])["s"].alias("s"), F.lit(4).alias("k"), F.get("placed", x["no"])["e"].alias("e"), x["v"].alias("v"))
    more = found.select("_id", "_key", F.transform("said", span).cast(_SPAN).alias("more")).groupBy("_id", "_key").agg(F.any_value("more").alias("more"))
    joined = base.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    apart = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return joined.select(F.col("id").alias(id_col), "text_key", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart))).alias("spans"))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the text's spans replaced: [KIND] for base spans, [NAME], [CODE] or [TERM] for generalised terms, nothing for removed ones. All columns stay."""
    id_, key, spans = own_names(docs, "span_id", "span_key", "spans")
    found = find_personal_data(docs, id_col, text_col, **options).where("size(spans) > 0").select(F.col(id_col).alias(id_), F.col("text_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([id_, key])
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(a: Column, x: Column) -> Column:
        word = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        kind = F.when(word.rlike("[0-9]"), "[CODE]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        said = F.when(x["k"] < 4, F.get(names, x["k"])).when(x["v"] == "remove", "").otherwise(kind)
        more = F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), said)
        return F.when(x["s"] >= a["at"], F.struct(more.alias("out"), x["e"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at")))

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    joined = docs.join(found, docs[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key)), "left")
    return joined.select(*[F.when(F.col(spans).isNull(), docs[c]).otherwise(done).alias(c) if c == text_col else docs[c] for c in docs.columns])


def _equals(k: int) -> Callable[[Column], Column]:
    return lambda x: x == k


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Digest of find_personal_data for each document."""
    base = F.filter("spans", lambda x: x["k"] < 4)
    counts = [F.size(F.filter(F.transform("spans", lambda x: x["k"]), _equals(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return find_personal_data(docs).select("doc_id", *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))
