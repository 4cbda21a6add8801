"""Exact top-k inner product search by pivot-table elimination.

A table holds each candidate's distances to many pivots. For a query, the largest difference between its own and a candidate's pivot
distances bounds their distance from below (triangle inequality), and with both lengths the inner product from above. Candidates are
evaluated in the order of their bounds until the k-th best score lies above all that remain; so results are exact.

Queries are a stated set. Candidates lie packed in tiles, queries packed in blocks; each tile meets each block once, in a product of the two written
tables. Each meeting sends at most k rows a query on.

Rows that agree in id and vector are one candidate with a number of copies, each of which counts; other rows that share an id are candidates and
queries of their own. Only a row itself is no candidate of its own query.

A component x counts as floor(1024 * x). Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Shorter vectors are filled with zeros. Ties
go to the smaller id. Vectors whose squared length is 2**62 or more (wide ones) lie in tiles and blocks of their own and are scored in Python's whole numbers; scores beyond
64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch

#: Rows from which pivots and first thresholds are taken, and pivots.
SAMPLE, PIVOTS = 2048, 48
#: Queries of a block, candidates of a tile.
QUERY_BLOCK, TILE = 2048, 8192
MOST_SQUARED = 2.0**62
#: Bytes of a wide vector: its numbers as text, filled up to a length that no vector of 64-bit numbers has.
WIDE = "length(v) % 8 = 1"
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Candidates evaluated between two looks at the bound.
STEP = 64


def whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) as (id, 64-bit integers)."""
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is not None and v is not None and None not in v:
                with np.errstate(over="ignore"):
                    x = np.floor(1024 * np.array(v, np.float64))
                    length = (x * x).sum()
                if np.isfinite(np.array(v, np.float64)).all():
                    ids.append(i)
                    vectors.append(x.astype("<i8").tobytes() if length < MOST_SQUARED else wide(v))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["id", "v"])


def wide(v: list[float]) -> bytes:
    text = " ".join(str(math.floor(1024 * Fraction(c))) for c in v)
    return text.ljust(len(text) + (1 - len(text)) % 8).encode()


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """64-bit numbers, or Python's where a vector is wide."""
    if any(len(v) % 8 for v in vectors):
        out = np.zeros((len(vectors), width), object)
        for row, v in zip(out, vectors, strict=True):
            x = [int(c) for c in v.split()] if len(v) % 8 else np.frombuffer(v, "<i8").tolist()
            row[: len(x)] = x
        return out
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        x = np.frombuffer(v, "<i8")
        row[: len(x)] = x
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the sample's vector farthest from those chosen."""
    if not len(sample):
        return sample
    picked = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(picked) < min(n, len(sample)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]


class Block:
    """Some queries with their pivot distances and a score that their k-th best reaches at least."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, pivots: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int):
        self.ids, self.copies, self.x = ids, copies, x
        self.to_pivots, self.norm = distances(x, pivots), (x.astype(float) ** 2).sum(axis=1)
        self.least = np.full(len(ids), -np.inf, object)
        for q in range(len(ids) if x.dtype != object else 0):
            own = sample[sample_ids != ids[q]] @ x[q]
            if len(own) >= k:
                self.least[q] = int(np.partition(own, len(own) - k)[len(own) - k])


def search(block: Block, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, to_pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidates, copies, scores) of up to k different candidates each that can be among the best."""
    norm = (x.astype(float) ** 2).sum(axis=1)
    for q in range(len(block.ids)):
        apart = np.abs(to_pivots - block.to_pivots[q]).max(axis=1) if to_pivots.shape[1] else np.zeros(len(x))
        both = norm + block.norm[q]
        most = (both - apart * apart) / 2 + 1e-9 * both + 1e-6
        most[~np.isfinite(most)] = np.inf  # beyond what bounds can tell: evaluated
        least, others = block.least[q], copies
        own = np.flatnonzero(ids == block.ids[q])
        own = own[(x[own] == block.x[q]).all(axis=1)]
        if len(own):  # one of the copies is the query itself
            others = copies.copy()
            others[own] -= 1
        open_ = np.flatnonzero((most >= least) & (others > 0))
        open_ = open_[np.argsort(-most[open_], kind="stable")]
        got, scores = open_[:0], np.zeros(0, np.int64)
        for at in range(0, len(open_), STEP):
            if most[open_[at]] < least:
                break
            step = x[open_[at : at + STEP]] @ block.x[q]
            if step.dtype == object:
                step = np.array([min(max(c, LEAST), MOST) for c in step], np.int64)
            got, scores = np.append(got, open_[at : at + STEP]), np.append(scores, step)
            top = best(scores, ids[got], k)
            got, scores = got[top], scores[top]
            if len(got) == k:
                least = max(least, int(scores[-1]))
        if len(got):
            yield q, ids[got], others[got], scores


def packed(most: int) -> Callable:
    """Rows (id, copies, v) of a task as rows (part, ids, copies, v) of at most `most` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, n = TaskContext.get().partitionId(), [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            row = [part, t["id"].to_numpy().astype("<i8").tobytes(), t["copies"].to_numpy().astype("<i8").tobytes(), t["v"].to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary())), strict=True)], names=["part", "ids", "copies", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                piece = batch.slice(at, most)
                if n and n + piece.num_rows > most:
                    yield out()
                    rows, n = [], 0
                rows.append(piece)
                n += piece.num_rows
        if n:
            yield out()

    return run


def few(rows: DataFrame, total: int) -> DataFrame:
    """About four times SAMPLE of the `total` rows (id, v) by their hashes, or all of few: each part of a sort sends its first rows to the driver."""
    if total <= 4 * SAMPLE:
        return rows
    return rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) < F.lit(4 * SAMPLE * (1 << 40) // total))


def exact_top_k(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block: int = QUERY_BLOCK, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for every row that satisfies the SQL condition `queries` on `id`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    numbers = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(whole_numbers, "id long, v binary").groupBy("id", "v").agg(F.count("*").alias("copies"))
    whole = scratch.write(numbers, "numbers")
    width, total, asks, wide_asks = whole.agg(F.max(F.expr(f"if({WIDE}, size(split(trim(cast(v as string)), ' ')), length(v) div 8)")), *[F.count_if(F.expr(w)) for w in (f"not {WIDE}", f"not {WIDE} and ({queries})", f"{WIDE} and ({queries})")]).first()
    width = width or 0
    taken = few(whole.where(f"not {WIDE}"), total).orderBy(F.xxhash64("id", "v"), "id", "v").limit(SAMPLE).toPandas()
    sample, sample_ids = matrix([bytes(v) for v in taken.v], width), taken.id.to_numpy(np.int64)
    points = choose_pivots(sample, pivots)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore", invalid="ignore")
        for batch in packed(tile)(batches):
            d = distances(matrix(batch.column(3)[0].as_py(), width), points)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d.astype("<f8").tobytes()], pa.binary())], names=["part", "ids", "copies", "v", "d"])

    shape = "ids binary, copies binary, v array<binary>"
    apart = lambda df, *parts: [df.where(w).repartition(n, F.xxhash64("id", "v")) for w, n in zip((f"not {WIDE}", WIDE), parts, strict=True)]
    tiles = [part.mapInArrow(measured, f"part int, {shape}, d binary") for part in apart(whole, groups, groups)]
    pivot_table = scratch.write(tiles[0].union(tiles[1]).drop("part"), "pivot_table")
    packs = [part.mapInArrow(packed(block), f"part int, {shape}") for part in apart(whole.where(queries).select("id", "copies", "v"), asks // block + 1, wide_asks // block + 1)]
    asked = scratch.write(packs[0].union(packs[1]).selectExpr("ids as q_ids", "copies as q_copies", "v as q_v"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, copies, v, d, q_ids, q_copies, q_v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                np.seterr(over="ignore", invalid="ignore")  # of wide vectors, whose bounds may overflow
                part = Block(np.frombuffer(q_ids, "<i8"), np.frombuffer(q_copies, "<i8"), matrix(q_v, width), points, sample_ids, sample, k)
                ids, copies, x = np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8"), matrix(v, width)
                for q, found, many, scores in search(part, ids, copies, x, np.frombuffer(d, "<f8").reshape(len(ids), -1), k):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.ids[q])), pa.array([hashlib.md5(q_v[q]).digest()] * n, pa.binary()), pa.array(np.full(n, part.copies[q])), pa.array(found), pa.array(np.minimum(many, k)), pa.array(scores)], names=["query_id", "of", "asks", "vec_id", "copies", "score"])

    # Tasks read their tiles and blocks from the written tables: no block is broadcast, copied for groups or shuffled.
    pairs = pivot_table.hint("shuffle_replicate_nl").crossJoin(asked).select("ids", "copies", "v", "d", "q_ids", "q_copies", "q_v")
    found = pairs.mapInArrow(run, "query_id long, of binary, asks long, vec_id long, copies long, score long")
    each = found.select("query_id", "of", "asks", "vec_id", "score", F.explode(F.expr("sequence(1L, copies)")))
    rank = F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.explode(F.expr("sequence(1L, asks)")).alias("_ask")).drop("_ask")
