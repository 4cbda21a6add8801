"""Toxicity by nearest labelled examples: exact TF-IDF cosine with block-max inverted indexes.

A text's weight on a term (a word) is (1 + log count) x idf x |phi|: idf is counted over all documents, phi is the correlation of the term's presence
with the label in the training sample. Every word of the examples is a term; a factor near 0 makes a word that says nothing about the label light.

The examples (a bounded sample, see `examples`) lie in blocks. Postings of the less frequent terms are added up for each query; the most frequent terms
keep their largest weight in each block, which with the largest sum of the others bounds the cosines in it. A query visits blocks in the order of
their bounds until its k-th best cosine is not below the next bound, so the neighbours are exact. Neighbours vote with their cosine; an
isotonic fit on the examples' own leave-one-out votes turns votes into probabilities.

Texts without a known term (also null and empty ones) get the rate of toxic examples among such. Without training labels every score is 0.
Repeated rows are scored alike. Ties between neighbours go to the example that comes first in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.labelled import held_out, isotonic, training_sample
from vacantia.llm.words import ALNUM, slices, word_hashes

#: Most labelled rows that become examples.
EXAMPLES = 6000
NEIGHBOURS, BLOCK = 15, 256
#: Terms with a column in the blocks instead of postings; sets the work, not the result.
FREQUENT = 1024
#: Postings added up at once.
AT_ONCE = 1 << 21
REJECT_FROM = 0.7


def distinct_words(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, times) of each text's distinct words."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, row = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


class Vocabulary:
    """Words in the order of their fingerprints; a term is a word's place."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.size = len(self.words)
        self.low = np.zeros(1 << 22, bool)
        self.low[self._low(self.words)] = True

    @staticmethod
    def _low(words: np.ndarray) -> np.ndarray:
        return (words & np.uint64((1 << 22) - 1)).astype(np.int64)

    def terms(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), in the order of the texts."""
        hashes, first = word_hashes(data, offsets, ALNUM)
        mine = np.flatnonzero(self.low[self._low(hashes)])
        at = np.searchsorted(self.words, hashes[mine])
        at[at == self.size] = 0
        ok = self.words[at] == hashes[mine] if self.size else np.zeros(0, bool)
        row = np.searchsorted(first, mine[ok], side="right") - 1
        code, times = np.unique(row * self.size + at[ok], return_counts=True)
        return code // max(self.size, 1), code % max(self.size, 1), times


def association(term: np.ndarray, y: np.ndarray, size: int, n0: int, n1: int) -> np.ndarray:
    """|phi| of each term's presence and the label; term, y: of each (example, term)."""
    with_, toxic = np.bincount(term, minlength=size).astype(float), np.bincount(term[y > 0], minlength=size).astype(float)
    n = n0 + n1
    return np.abs(toxic * n - with_ * n1) / np.sqrt(np.maximum(with_ * (n - with_) * n0 * n1, 1e-9))


def unit(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights of rows of length 1."""
    return weight / np.maximum(np.sqrt(np.bincount(row, weight * weight, n)), 1e-12)[row]


class Index:
    """Examples in blocks. Frequent terms: a dense column each, and the largest weight of each block. Others: postings by term."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int, y: np.ndarray, class_weight: np.ndarray, frequent: int = FREQUENT):
        n = len(y)
        # Examples with the same heaviest term lie together.
        heavy = np.full(n, -1)
        by = np.argsort(weight, kind="stable")
        heavy[row[by]] = term[by]
        order = np.argsort(heavy, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.y, self.weight, self.place, row = y[order], class_weight[order], place, place[row]
        df = np.bincount(term, minlength=n_terms)
        top = np.sort(np.argsort(-df, kind="stable")[:frequent])
        self.column = np.full(n_terms, -1, np.int32)
        self.column[top] = np.arange(len(top))
        dense = self.column[term] >= 0
        self.dense = np.zeros((n, len(top)), np.float32)
        self.dense[row[dense], self.column[term[dense]]] = weight[dense]
        self.at = np.arange(0, n, BLOCK)
        self.block_max = np.maximum.reduceat(self.dense, self.at, axis=0) if n else self.dense
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        by = np.lexsort((row, term))
        self.example, self.own = row[by].astype(np.int32), weight[by].astype(np.float32)
        self.start = np.searchsorted(term[by], np.arange(n_terms + 1))

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of each query's k nearest examples (without: one example that each query leaves out). Queries: weights in the order of the rows."""
        score, who = np.full((n, k), -1.0, np.float32), np.full((n, k), -1, np.int64)
        if not len(self.y):
            return score, who
        cost = np.bincount(row, np.where(self.column[term] < 0, self.start[term + 1] - self.start[term], 0), n) + len(self.y)
        part = np.cumsum(cost) // AT_ONCE
        at = 0
        while at < n:
            to = int(np.searchsorted(part, part[at], side="right"))
            a, b = np.searchsorted(row, [at, to])
            self._some(row[a:b] - at, term[a:b], weight[a:b], score[at:to], who[at:to], None if without is None else without[at:to])
            at = to
        return score, who

    def _some(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, score: np.ndarray, who: np.ndarray, without: np.ndarray | None) -> None:
        n, k, examples = *score.shape, len(self.y)
        queries = np.zeros((n, self.dense.shape[1]), np.float32)
        dense = self.column[term] >= 0
        queries[row[dense], self.column[term[dense]]] = weight[dense]
        row, term, weight = row[~dense], term[~dense], weight[~dense]
        many = self.start[term + 1] - self.start[term]
        entry = np.arange(many.sum()) + np.repeat(self.start[term] - np.cumsum(many) + many, many)
        sums = np.bincount(np.repeat(row * examples, many) + self.example[entry], np.repeat(weight, many) * self.own[entry], n * examples).reshape(n, examples).astype(np.float32)
        bound = np.maximum.reduceat(sums, self.at, axis=1) + queries @ self.block_max.T
        cosine, visited = np.zeros((n, examples), np.float32), np.zeros(bound.shape, bool)

        def visit(wanted: np.ndarray) -> None:
            """Cosines in the blocks that are wanted, of the queries that want them."""
            for b in np.flatnonzero(wanted.any(axis=0)):
                q, a = np.flatnonzero(wanted[:, b]), self.at[b]
                cosine[q, a : a + BLOCK] = sums[q, a : a + BLOCK] + queries[q] @ self.dense[a : a + BLOCK].T
                if without is not None:
                    mine = q[(without[q] >= a) & (without[q] < a + BLOCK)]
                    cosine[mine, without[mine]] = 0
            visited[wanted] = True

        # First each query's most promising blocks, two more at a time while it has fewer than k cosines, then all that can still beat its k-th best.
        order = np.argsort(-bound, axis=1, kind="stable")
        for turn in range(0, bound.shape[1], 2):
            least = np.partition(cosine, max(examples - k, 0), axis=1)[:, max(examples - k, 0)] if turn else np.zeros(n, np.float32)
            few = np.flatnonzero((least <= 0) & (bound[np.arange(n), order[:, turn]] > 0))
            if not len(few):
                break
            wanted = np.zeros(bound.shape, bool)
            wanted[few[:, None], order[few, turn : turn + 2]] = True
            visit(wanted)
        least = np.partition(cosine, max(examples - k, 0), axis=1)[:, max(examples - k, 0)]
        visit((bound > 0) & (bound + 1e-6 >= least[:, None]) & ~visited)
        # The cosine's bits, then the example's number, make keys without ties.
        bits = int(examples).bit_length()
        key = (np.maximum(cosine, 0).view(np.int32).astype(np.int64) << bits) | ((1 << bits) - 1 - np.arange(examples))
        some = min(k, examples)
        top = np.argpartition(key, examples - some, axis=1)[:, examples - some :]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
        found = np.take_along_axis(cosine, top, 1)
        score[:, :some], who[:, :some] = np.where(found > 0, found, -1), np.where(found > 0, top, -1)

    def votes(self, score: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Share of toxic among the neighbours, by squared cosine and class weight; -1 without any."""
        w = np.where(who >= 0, np.maximum(score, 0) ** 2, 0) * self.weight[np.maximum(who, 0)]
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.y[np.maximum(who, 0)]).sum(axis=1) / np.maximum(total, 1e-30), -1.0)


class Model:
    def __init__(self, vocabulary: Vocabulary, factor: np.ndarray, index: Index, ends: np.ndarray, values: np.ndarray):
        self.vocabulary, self.factor, self.index, self.ends, self.values = vocabulary, factor, index, ends, values

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, and the neighbours' cosines and numbers as evidence."""
        n = len(offsets) - 1
        if not len(self.ends):
            return np.zeros(n), np.full((n, 1), -1.0), np.full((n, 1), -1)
        row, term, times = self.vocabulary.terms(data, offsets)
        cosine, who = self.index.nearest(row, term, unit(row, (1 + np.log(times)) * self.factor[term], n), n, NEIGHBOURS)
        return self.probability(self.index.votes(cosine, who)), cosine, who

    def probability(self, votes: np.ndarray) -> np.ndarray:
        return self.values[np.minimum(np.searchsorted(self.ends, votes), len(self.values) - 1)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> Model:
    """Learn from the labelled rows outside the held-out fold; `examples` bounds the sample."""
    rows, weight = training_sample(docs, labels, label, examples)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                row, word, times = distinct_words(*word_hashes(data, offsets, ALNUM))
                cut = np.searchsorted(row, np.arange(1, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), *(pa.array([x.tobytes() for x in np.split(v, cut)], pa.binary()) for v in (word, times.astype("<i8")))], names=["y", "words", "times"])

    # The words of at most `examples` texts.
    own = rows.mapInArrow(words, "y int, words binary, times binary").toPandas().sort_values(["words", "times", "y"], ignore_index=True)
    y = own.y.to_numpy(float)
    row = np.repeat(np.arange(len(own)), [len(w) // 8 for w in own.words]) if len(own) else np.zeros(0, np.int64)
    word, times = np.frombuffer(b"".join(own.words), np.uint64), np.frombuffer(b"".join(own.times), "<i8")
    vocabulary = Vocabulary(word)
    term = np.searchsorted(vocabulary.words, word)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n, each = 0, np.zeros(known.size, np.int64)
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                n += part.num_rows
                each += np.bincount(known.terms(data, offsets)[1], minlength=known.size)
        used = np.flatnonzero(each)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(each[used], n), pa.int64())], names=["term", "n"])

    # One row for each term.
    found = docs.select("text").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(vocabulary.size + 1)
    counts[found["term"].to_numpy()] = found["n"].to_numpy()
    n1 = int(y.sum())
    factor = (np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1e-3) * association(term, y[row], vocabulary.size, len(y) - n1, n1)
    value = unit(row, (1 + np.log(times)) * factor[term], len(y))
    says = value > 0
    index = Index(row[says], term[says], value[says], vocabulary.size, y, np.array([weight[int(k)] for k in y]))
    if not len(y):
        return Model(vocabulary, factor, index, np.zeros(0), np.zeros(0))
    # The examples as queries, in the order of the index.
    place = index.place
    at = np.argsort(place[row], kind="stable")
    votes = index.votes(*index.nearest(place[row][at], term[at], value[at], len(y), NEIGHBOURS, np.arange(len(y))))
    return Model(vocabulary, factor, index, *isotonic(votes, index.y, index.weight))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence (cosine, toxic of the nearest examples that share a term)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of EXAMPLES texts
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 20):
                p, cosine, who = m.score(data, offsets)
                evidence = [[{"cosine": float(c), "toxic": int(m.index.y[w])} for c, w in zip(cs[:3], ws[:3], strict=True) if w >= 0 and c > 0] for cs, ws in zip(cosine, who, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p.astype(float)), pa.array(evidence, pa.list_(pa.struct([("cosine", pa.float64()), ("toxic", pa.int32())])))], names=["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<cosine:double,toxic:int>>")


def without_toxic(docs: DataFrame, model: Model, reject_from: float = REJECT_FROM) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", 1 << 20):
                yield rows.filter(pa.array(shared.value.score(data, offsets)[0] < reject_from))

    return docs.mapInArrow(run, docs.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scores(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"), "evidence")
