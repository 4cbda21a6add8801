"""Mixing sources to target weights with balanced samples (the cube method).

A source whose target is r times its size is taken floor(r) times whole; of the rest, each document has an inclusion probability of
r - floor(r). The cube method moves these probabilities along vectors of the null space of the balancing constraints (the number of
documents and their sizes) until all but a few are 0 or 1, so that both totals of the sample stay at their expected values. It runs in
rounds: each source is cut into buckets, every bucket walks its flight, and the few documents still undecided in the buckets
meet in the next, smaller round. The last few of a source are settled by the landing: the choice nearest to its target.

Rows that agree in all their columns are one unit: of m such rows with probability p, the whole part of m * p is taken and the rest is the probability of one more. All
other rows, whatever they share, are decided one by one. Null texts have size 0; a null source is a source of its own. All choices come from hashes of the rows, so that reruns agree; ties
between equal choices go to the one that leaves more out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch, join_groups, own_names

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Units of a bucket of the flight.
BUCKET = 8192


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source, from its size: shares by repeating weights, none above `most` times its size, what is over shared anew by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    size, out, left, open_ = dict(sizes), {}, total * sum(n for _, n in sizes), [s for s, _ in order]
    while open_:
        every = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / every > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / every for s in open_}
        out |= {s: most * size[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def source_targets(sources: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """`targets` for any number of sources: adds target to (source, source_size). Places come from a range-partitioned sort, the water level from a few sums."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    absent = F.col("source").isNull()
    # UTF-8 strings sort by code point.
    ordered = sources.withColumn("absent", absent).repartitionByRange(n, "absent", "source").sortWithinPartitions("absent", "source")
    ordered = scratch.write(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")).drop("absent"), "ordered")
    before, offsets = 0, [F.lit(-1), F.lit(0).cast("long")]
    for r in ordered.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        offsets += [F.lit(r["part"]), F.lit(before).cast("long")]
        before += r["count"]
    place = F.create_map(*offsets)[F.col("part")] + F.col("at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    x = scratch.write(ordered.select(*sources.columns, weight.alias("weight")), "weighed")
    everything = total * float(x.agg(F.sum("source_size")).first()[0] or 0)
    # A source is full if its share of what is left lies above its limit; what is over is shared anew until no more become full.
    known = -1
    limit = F.col("source_size") * F.lit(float(most))
    first = x.agg(F.sum("weight")).first()[0] or 0.0
    level = everything / first if first else 0.0
    while True:
        full = F.col("weight") * level > limit
        r = x.agg(F.count_if(full).alias("n"), F.sum(F.when(full, limit)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r.n == known or not r.open:
            break
        known, level = r.n, (everything - (r.taken or 0.0)) / r.open
    return x.withColumn("target", F.least(F.col("weight") * level, limit)).drop("weight")


def flight(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Move probabilities until at most two are inside (0, 1), keeping sum(p) and sum(p * size); u: a random number for each unit."""
    p = p.astype(float).tolist()
    size, inside, eps = size.astype(float).tolist(), [], 1e-9
    draw = iter(u.tolist())
    for k in range(len(p)):
        if eps < p[k] < 1 - eps:
            inside.append(k)
        if len(inside) < 3:
            continue
        i, j, m = inside
        a, b, c = size[j] - size[m], size[m] - size[i], size[i] - size[j]  # orthogonal to (1, 1, 1) and to the sizes
        if not (a or b or c):
            a, b, c = 1.0, -1.0, 0.0
        up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in ((i, a), (j, b), (m, c)) if v)
        down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in ((i, a), (j, b), (m, c)) if v)
        step = up if next(draw) * (up + down) < down else -down
        for x, v in ((i, a), (j, b), (m, c)):
            p[x] += step * v
            if p[x] < eps or p[x] > 1 - eps:
                p[x] = float(round(p[x]))
        inside = [x for x in inside if 0 < p[x] < 1]
    return np.array([round(x) if x < eps or x > 1 - eps else x for x in p])


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the last few: the choice whose size, then number, is nearest to what is expected."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    want, many = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(float(np.dot(x, size[open_])) - want), abs(sum(x) - many), x))
    p = p.copy()
    p[open_] = best
    return p


def _walk(last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["mark", "size"], kind="stable").reset_index(drop=True)
        size = f["size"].to_numpy(float)
        u = ((f.mark.to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float)) / 2.0**53
        p = flight(f.p.to_numpy(float), size, u)
        return f.assign(p=landing(p, size) if last else p)

    return walk


def row_hash(docs: DataFrame) -> Column:
    """Hash of a row's columns, but for those of types that have no hash."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))])


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: id, source, size (words), same (hash of the row), rows (so many equal ones), source_size, target (its source's), copies. Of equal rows, those taken once more are a row of their own here."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(docs).alias("same"))
    units = scratch.write(sized.groupBy("id", "source", "size", "same").agg(F.count("*").alias("rows")), "units")
    found = scratch.write(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units")), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = scratch.write(source_targets(found, scratch, weights, total, most).select("source", "source_size", "target", rate.alias("rate"), F.ceil(F.col("units") / BUCKET).alias("buckets"), "units"), "targets")
    mark = F.xxhash64("id", "same", F.lit("mix"))
    ready = join_groups(units, per_source, "source", "units")
    many = F.col("rows") * (F.col("rate") - F.floor("rate"))
    ready = ready.select("id", "source", "size", "same", "rows", "source_size", "target", F.floor("rate").cast("int").alias("whole"), F.floor(many).cast("long").alias("sure"), (many - F.floor(many)).alias("p"), F.pmod(mark, "buckets").alias("bucket"), F.xxhash64("id", "same", F.lit("draw")).alias("mark"))
    open_, done, k = ready, [], 0
    most_units = per_source.agg(F.max("units")).first()[0] or 0
    while True:
        last = most_units <= BUCKET

        walked = scratch.write(open_.groupBy("source", "bucket").applyInPandas(_walk(last), open_.schema), f"round{k}")
        done.append(walked.where("p = 0 or p = 1"))
        if last:
            break
        # Each bucket leaves two units at most.
        most_units = 2 * -(-most_units // BUCKET)
        parts, k = -(-most_units // BUCKET), k + 1
        open_ = walked.where("p > 0 and p < 1").withColumn("bucket", F.pmod(F.xxhash64("bucket"), F.lit(parts).cast("long"))).withColumn("mark", F.xxhash64("mark"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    more = F.col("sure") + F.col("p").cast("long")
    parts = F.filter(F.array(F.struct(more.alias("rows"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("rows") - more).alias("rows"), F.col("whole").alias("copies"))), lambda x: x["rows"] > 0)
    return out.select("id", "source", "size", "same", "source_size", "target", F.inline(parts)).select("id", "source", "size", "same", "rows", "source_size", "target", "copies")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row for each row of documents: what the mix takes of it."""
    taken = mix(docs).withColumn("one", F.explode(F.expr("sequence(1L, rows)")))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them, all their columns, each as many times as it is taken."""
    same, taken_as, times, one = own_names(docs, "mix_same", "mix_row", "mix_times", "mix_one")
    taken = mix(docs, weights, total, most, id_col, text_col, source_col).where("copies > 0").select(F.col("same").alias(taken_as), (F.col("rows") * F.col("copies")).alias(times))
    # Equal rows move as one, which is then given as often as all of them are taken.
    each = docs.withColumn(same, row_hash(docs)).dropDuplicates([same]).join(taken, F.col(same) == F.col(taken_as))
    return each.withColumn(one, F.explode(F.expr(f"sequence(1L, `{times}`)"))).select(*docs.columns)
