"""Labelled rows for training: a bounded sample outside the held-out fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import modest_batches


def held_out(doc_id: Column) -> Column:
    """The third of the ids whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, more: tuple[str, ...] = ()) -> tuple[DataFrame, dict[int, float]]:
    """(text, y, then `more` columns) of at most `most` labelled documents, half of each class where there are enough, and each class's weight in the whole.

    Ids are taken in the order of a hash, so that reruns agree. Several labels of an id count as the largest. An id that stands at several documents
    gives that many rows, all of which count towards the bound; an id whose rows no longer fit is left out.
    """
    modest_batches(docs.sparkSession)
    known = labels.where(~held_out(F.col("doc_id"))).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    few = min(count.get(0, 0), count.get(1, 0), most // 2)
    take = {y: min(n, most - few if n > few else few) for y, n in count.items()}
    # At most `most` ids with their labels, in the order in which they are taken.
    picked = [r for y, n in sorted(take.items()) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    ids = docs.sparkSession.createDataFrame([(r.doc_id, int(r.y)) for r in picked], f"known_id {known.schema['doc_id'].dataType.simpleString()}, y int")
    rows_of = {r.known_id: r.n for r in docs.select("doc_id").join(F.broadcast(ids), F.col("doc_id") == F.col("known_id")).groupBy("known_id").agg(F.count("*").alias("n")).collect()}
    left, kept = dict(take), []
    for r in picked:
        n = rows_of.get(r.doc_id, 0)
        if 0 < n <= left[r.y]:
            left[r.y] -= n
            kept.append((r.doc_id, int(r.y)))
    rows = docs.select("doc_id", "text", *more).join(F.broadcast(docs.sparkSession.createDataFrame(kept, ids.schema)), F.col("doc_id") == F.col("known_id")).select("text", "y", *more)
    total = sum(count.values())
    return rows, {y: count[y] / total / (take[y] / sum(take.values())) for y in count}


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best non-decreasing fit of y on x with weights: the steps' right ends and values (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    x, y, w = x[order], y[order], w[order]
    ends, at = np.unique(x, return_index=True)
    sums, weights = np.add.reduceat(y * w, at) if len(at) else y, np.add.reduceat(w, at) if len(at) else w
    stack: list[list[float]] = []
    for e, s, n in zip(ends, sums, weights, strict=True):
        stack.append([e, s, n])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            e2, s2, n2 = stack.pop()
            stack[-1] = [e2, stack[-1][1] + s2, stack[-1][2] + n2]
    return np.array([k[0] for k in stack]), np.array([k[1] / k[2] for k in stack])
