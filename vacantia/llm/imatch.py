"""I-Match fingerprints of documents, in DataFrame functions alone.

The lexicon is the terms whose inverse document frequency lies in a band: not the frequent ones, which tell nothing, and not the rare ones, which any typing error makes.
A fingerprint holds hashes of a document's lexicon terms, each restricted to one of SUBSETS random subsets of the lexicon: its distinct terms in that subset, sorted, hashed
as one. One changed term changes only the hashes of its subsets. For a document with t terms the subsets hold one in 2^k lexicon terms, 2^k being the least power of 2 not
below t, so that a subset finds about one of its terms whatever its length. A fingerprint also has the hashes for k + 1 and k + 2, so that documents of unlike length share a level.
Likeness is the share of equal hashes among the subsets that have a term of either document, at the finer level of the two; it is 1 for equal fingerprints and 0 where no level is
shared (one document then has less than a quarter of the other's terms).

Document frequencies are counted for 2^20 slots of term hashes, terms of a slot together, over all rows. So the lexicon is a bitmap of a fixed size, 128 KB, whatever the corpus; a rare term
passes for a lexicon term if it shares a slot with one. Rare terms lift no slot into the band: some rare terms a document spread over 2^20 slots stay far below the band's lower end.

Null texts are empty. A text without lexicon terms is known by all its terms, one without terms by itself. Equal texts have equal fingerprints, whatever their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch

#: What separates terms in lower-cased texts: ASCII other than letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Band of inverse document frequencies, as natural logarithms of documents a document with the term: in a tenth to a two-thousandth of all documents.
BAND = (2.3, 7.6)
SLOTS = 20
SUBSETS = 64
#: Levels that a fingerprint holds, from its own to finer ones.
LEVELS = 3
#: Bits of a subset's hash.
BITS = 24


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << SLOTS) - 1))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> Column:
    """Bitmap of the slots whose inverse document frequency lies in the band, as a constant array of 64-bit words."""
    slots = docs.select(F.explode(F.array_distinct(F.transform(words(F.col(text_col)), lambda w: _slot(F.xxhash64(w))))).alias("slot"))
    idf = F.log(F.lit(float(docs.count())) / F.col("n"))
    within = slots.groupBy("slot").agg(F.count("*").alias("n")).where(idf.between(*band))
    rows = within.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("word")).collect()  # 2^14 rows at most
    found = {r["at"]: r["word"] for r in rows}
    return F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(1 << (SLOTS - 6)))), ",").cast("array<bigint>")


def _tokens(terms: Column, level: Column) -> Column:
    """Hashes of the subsets at a level that have terms: SUBSETS numbers at most, each a subset's number before BITS bits of its hash."""
    rounds = F.greatest(F.lit(1), F.lit(float(SUBSETS)) / F.pow(F.lit(2.0), level)).cast("int")
    cells = F.pow(F.lit(2.0), level).cast("long")

    def dealt(r: Column) -> Column:
        def term(h: Column) -> Column:
            # The subset's number above the term's hash, so that sorting brings a subset's terms together; -1 for the subsets that aren't kept.
            subset = r.cast("long") * cells + F.xxhash64(h, r).bitwiseAND(cells - 1)
            return F.when(subset < SUBSETS, F.shiftleft(subset, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))).otherwise(F.lit(-1).cast("long"))

        return F.filter(F.transform(terms, term), lambda e: e >= 0)

    entries = F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), rounds - 1), dealt)))
    closed = lambda a: F.when(a["subset"] < 0, a["out"]).otherwise(F.concat(a["out"], F.array(F.shiftleft(a["subset"], BITS).bitwiseOR(a["hash"].bitwiseAND(F.lit((1 << BITS) - 1))))))

    def step(a: Column, e: Column) -> Column:
        subset = F.shiftright(e, 56)
        same = F.struct(a["subset"].alias("subset"), F.xxhash64(a["hash"], e).alias("hash"), a["out"].alias("out"))
        return F.when(subset == a["subset"], same).otherwise(F.struct(subset.alias("subset"), F.xxhash64(e).alias("hash"), closed(a).alias("out")))

    start = F.struct(F.lit(-1).cast("long").alias("subset"), F.lit(0).cast("long").alias("hash"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(entries, start, step, closed)


def with_fingerprint(df: DataFrame, text: str, name: str, bits: Column) -> DataFrame:
    """df with the fingerprint of a text column: struct(level, hashes), hashes at LEVELS levels."""
    all_, kept, level = f"{name}_all", f"{name}_kept", f"{name}_level"
    within = lambda h: F.getbit(F.get(bits, F.shiftright(_slot(h), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    every = F.transform(F.array_distinct(words(F.col(text))), lambda w: F.xxhash64(w))
    out = df.withColumn(all_, every).withColumn(kept, F.filter(all_, within))
    terms = F.when(F.size(kept) > 0, F.col(kept)).when(F.size(all_) > 0, F.col(all_)).otherwise(F.array(F.xxhash64(F.col(text))))
    out = out.withColumn(kept, terms).drop(all_)
    out = out.withColumn(level, F.when(F.size(kept) < 2, F.lit(0)).otherwise(F.length(F.bin(F.size(kept) - 1))))
    return out.withColumn(name, F.struct(F.col(level).alias("level"), F.array(*[_tokens(F.col(kept), F.col(level) + k) for k in range(LEVELS)]).alias("hashes"))).drop(kept, level)


def as_text(fp: str) -> Column:
    """A fingerprint as its level and the hashes of each level after colons, eight hexadecimal digits a subset."""
    digits = lambda c: F.array_join(F.transform(c, lambda t: F.lpad(F.lower(F.hex(t)), 8, "0")), "")
    return F.concat(F.col(f"{fp}.level").cast("string"), F.lit(":"), F.array_join(F.transform(f"{fp}.hashes", digits), ":"))


def likeness(a: str, b: str) -> Column:
    """0 to 1 for two columns of fingerprints."""
    level = F.greatest(F.col(f"{a}.level"), F.col(f"{b}.level"))
    at = lambda x: F.get(F.col(f"{x}.hashes"), level - F.col(f"{x}.level"))
    subsets = lambda x: F.transform(at(x), lambda t: F.shiftright(t, BITS))
    share = F.size(F.array_intersect(at(a), at(b))) / F.size(F.array_union(subsets(a), subsets(b)))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce(F.when(at(a).isNotNull() & at(b).isNotNull(), share), F.lit(0.0)))


def fingerprints(docs: DataFrame, bits: Column | None = None, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with their fingerprint as text in a column `name`; bits: a lexicon, by default that of docs."""
    made = with_fingerprint(docs.withColumn("_imatch", F.coalesce(text_col, F.lit(""))), "_imatch", "_imatch_fp", lexicon(docs, text_col) if bits is None else bits)
    return made.withColumn(name, as_text("_imatch_fp")).drop("_imatch", "_imatch_fp")


def ring(units: DataFrame, scratch: Scratch) -> DataFrame:
    """(unit, rows, before, before_chars): each unit's predecessor by descending id (nulls last, then by unit), the first's being the last. units: unit, id, n_chars, rows."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("id"), F.col("unit")]
    ranged = units.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = scratch.write(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ordered")
    offsets, total = [], 0
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        offsets.append((r["part"], total))
        total += r["count"]
    starts = F.broadcast(units.sparkSession.createDataFrame(offsets, "part int, start long"))
    placed = ordered.join(starts, "part").withColumn("at", F.col("start") + F.col("at"))
    before = placed.select(((F.col("at") + 1) % max(total, 1)).alias("at"), F.col("unit").alias("before"), F.col("n_chars").alias("before_chars"))
    return scratch.write(placed.select("at", "unit", "rows").join(before, "at").drop("at"), "ring")


def likeness_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last third is the start of the next document's text, and of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id. The next document is that of the next smaller id, the largest after the smallest. Rows
    without an id come last; rows of one id go by a hash of id and text. Of rows that agree in both, each but one has a row like itself as the next.
    """
    scratch = Scratch(docs.sparkSession)
    bits = lexicon(docs, text_col, band)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("unit", F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")))))
    units = scratch.write(base.groupBy("unit", "id").agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("rows")), "units")
    # Whole texts move once, by unit; the starts that others need move once more.
    one = with_fingerprint(base, "text", "fp", bits).dropDuplicates(["unit"]).join(ring(units, scratch), "unit")
    starts = one.select(F.col("before").alias("unit"), F.expr("substring(text, 1, cast(floor(before_chars / 3) as int))").alias("start"), F.col("fp").alias("next_fp"), F.col("id").alias("next_doc_id"))
    x = one.select("unit", "id", "text", "fp", "rows").join(starts, "unit")
    x = x.withColumn("copy", F.explode(F.expr("sequence(1L, rows)"))).withColumn("n_chars", F.length("text").cast("long"))
    own = F.col("copy") > 1
    kept, taken = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.expr("substring(text, 1, cast(floor(n_chars / 3) as int))")
    x = x.withColumns({"edited": F.concat(kept, F.when(own, taken).otherwise(F.col("start"))), "next_fp": F.when(own, F.col("fp")).otherwise(F.col("next_fp")), "next_doc_id": F.when(own, F.col("id")).otherwise(F.col("next_doc_id"))})
    x = with_fingerprint(x.select("id", "n_chars", "edited", "fp", "next_fp", "next_doc_id"), "edited", "edited_fp", bits)
    return x.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "next_doc_id")
