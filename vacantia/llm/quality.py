"""Text quality by a factorisation machine on hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair term is computed in time linear in the number of non-zero inputs
as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Trained on a bounded sample of labelled rows outside the held-out fold (`examples`); every row of the table is scored. Null and empty
texts have only their (zero) statistics; a null or wrong n_chars counts as 0. Without labels of both classes every score is the share
of label 1, or 0.5. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.labelled import held_out, training_sample
from vacantia.llm.toxicity import distinct_words
from vacantia.llm.words import SPACED, slices, word_hashes

#: Most labelled rows that are learnt from, word inputs, and factors.
EXAMPLES, BUCKETS, FACTORS = 12_000, 4096, 8

STATISTICS = ("length", "words", "word_length", "upper", "digit", "mark", "bang", "bar", "symbol", "newline", "other", "distinct", "top", "repeat", "n_chars")

_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate((range(65, 91), range(48, 58), b".,;:'\"-()", b"!?", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b"\n\r", range(128, 256)), 1):
    _KIND[list(_bytes)] = _k


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the hashed words, and the statistics of each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = np.bincount(np.repeat(np.arange(n), size) * 9 + _KIND[data], minlength=9 * n).reshape(-1, 9)[:, 1:]
    hashes, first = word_hashes(data, offsets, SPACED)
    row, word, times = distinct_words(hashes, first)
    words = np.diff(first)
    distinct, top = np.bincount(row, minlength=n), np.zeros(n)
    np.maximum.at(top, row, times)
    own = np.repeat(np.arange(n), words)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    per = np.maximum(words, 1)
    stats = np.stack([np.log1p(size), np.log1p(words), size / per, *(kind / np.maximum(size, 1)[:, None]).T, distinct / per, top / per, np.bincount(own, again, n) / per, np.log1p(np.maximum(n_chars, 0))], axis=1)
    code = np.unique(row * BUCKETS + (word & np.uint64(BUCKETS - 1)).astype(np.int64))
    row, bucket = code // BUCKETS, code % BUCKETS
    return row, bucket, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row], stats


class FactorisationMachine:
    def __init__(self, inputs: int, factors: int, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.w0, self.w, self.v = np.zeros(1), np.zeros(inputs), rnd.normal(0, 0.02, (inputs, factors))

    def raw(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """w0 + linear + pair terms, in time linear in the non-zero inputs."""
        out = self.w0[0] + np.bincount(row, self.w[col] * value, n)
        for f in range(self.v.shape[1]):
            vx = self.v[col, f] * value
            out += 0.5 * (np.bincount(row, vx, n) ** 2 - np.bincount(row, vx * vx, n))
        return out

    def fit(self, x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.01, decay: float = 1e-5, seed: int = 11) -> None:
        """Weighted logistic loss by Adam over small batches; x: columns and values of each example."""
        rnd, params = np.random.default_rng(seed), (self.w0, self.w, self.v)
        moments, t = [(np.zeros_like(p), np.zeros_like(p)) for p in params], 0
        for _ in range(-(-steps * batch // len(y))):
            order = rnd.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                dense = np.zeros((len(pick), len(self.w)))
                for i, k in enumerate(pick):
                    dense[i, x[k][0]] = x[k][1]
                vx = dense @ self.v
                square = dense * dense
                z = self.w0[0] + dense @ self.w + 0.5 * (vx * vx - square @ (self.v * self.v)).sum(axis=1)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
                gv = dense.T @ (g[:, None] * vx) - (square.T @ g)[:, None] * self.v
                t += 1
                for p, d, (m, s) in zip(params, (np.array([g.sum()]), dense.T @ g + decay * self.w, gv + decay * self.v), moments, strict=True):
                    m += 0.1 * (d - m)
                    s += 0.001 * (d * d - s)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)


class Model:
    def __init__(self, machine: FactorisationMachine | None, mean: np.ndarray, scale: np.ndarray, base: float):
        self.machine, self.mean, self.scale, self.base = machine, mean, scale, base

    def inputs(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        n, k = z.shape
        return np.concatenate([row, np.repeat(np.arange(n), k)]), np.concatenate([bucket, np.tile(BUCKETS + np.arange(k), n)]), np.concatenate([value, z.reshape(-1)])

    def score(self, data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.machine is None:
            return np.full(n, self.base)
        return 1 / (1 + np.exp(-np.clip(self.machine.raw(*self.inputs(*features(data, offsets, n_chars)), n), -30, 30)))


def _chars(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES) -> Model:
    """Learn from at most `examples` labelled rows outside the held-out fold; their inputs pass the driver as small arrays."""
    rows, weight = training_sample(docs, labels, label, examples, ("n_chars",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                row, bucket, value, stats = features(data, offsets, _chars(part.column(2)))
                cut = np.searchsorted(row, np.arange(1, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array([b.astype("<u2").tobytes() for b in np.split(bucket, cut)], pa.binary()), pa.array([s.astype("<f8").tobytes() for s in stats], pa.binary())], names=["y", "buckets", "stats"])

    own = rows.mapInArrow(run, "y int, buckets binary, stats binary").toPandas().sort_values(["stats", "buckets", "y"], ignore_index=True)
    y = own.y.to_numpy(float)
    none = np.zeros(len(STATISTICS))
    if len(weight) < 2 or not len(y):
        return Model(None, none, none + 1, float(y.mean()) if len(y) else 0.5)
    stats = np.stack([np.frombuffer(s, "<f8") for s in own.stats])
    model = Model(FactorisationMachine(BUCKETS + len(STATISTICS), FACTORS), stats.mean(axis=0), stats.std(axis=0) + 1e-6, 0.5)
    z = np.clip((stats - model.mean) / model.scale, -5, 5)
    x = []
    for b, s in zip(own.buckets, z, strict=True):
        bucket = np.frombuffer(b, "<u2").astype(np.int64)
        x.append((np.concatenate([bucket, BUCKETS + np.arange(len(s))]), np.concatenate([np.full(len(bucket), 1 / np.sqrt(max(len(bucket), 1))), s])))
    model.machine.fit(x, y, np.array([weight[int(k)] for k in y]))
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS x FACTORS
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.score(data, offsets, _chars(rows.column(2))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, f"doc_id {kind}, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
