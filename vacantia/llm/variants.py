"""Spelling variants of words: words that one edit takes into a more frequent word, grouped under the word at the end of such steps.

Two words are near if exactly one code point is inserted, deleted or replaced. Blocks of words are padded matrices of code points, once aligned to the left and once to
the right; two blocks are compared column by column, which gives the common prefix and the common suffix of every pair. A pair of different words is near if and only if prefix
plus suffix reach the longer length minus one.

No block meets all others: of a near pair whose longer word has M code points, the prefix or the suffix has M // 2 or more. So a word is dealt, for M its length and one
more, to the words with its first M // 2 code points and to those with its last ones. A pair with so long a common prefix counts among the first, and any
other among the last: each pair counts once. Sets of up to BLOCK words are packed into blocks, larger ones are cut into tiles that meet pairwise. A block sends on one
row a word (how many near words, and the most frequent), never a row a pair.

Null and empty texts have no words; rows without an id have the empty string for it; repeated rows count again; ties between forms go to the smaller word in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch, join_groups

RUN = "[a-zÀ-ÿ]+"
#: Words of a dense block, words of a tile of a larger set, and code points that a block holds at most (of long words, fewer make a block).
BLOCK, TILE, CODES = 256, 4096, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run) for every letter run of the whole texts, with A-Z in lower case."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    return docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), 0)).alias("run"))


def without_one(run: Column, id_: Column, every: int) -> Column:
    """The run, without one code point where `every` divides the checksum of id and run: misspellings that can be foretold."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def frequent(runs: DataFrame, word: Column, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) for words of at least `length` code points that occur at least `least` times."""
    return runs.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points aligned left and right; zeros where words are shorter than the longest."""
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    kind, width = np.uint8 if not len(codes) or codes.max() < 256 else np.uint32, int(sizes.max(initial=0))
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.zeros((width, len(words)), kind), np.zeros((width, len(words)), kind)
    left[at, row] = codes
    right[np.repeat(sizes, sizes) - 1 - at, row] = codes
    return sizes, left, right


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every pair of columns. Zeros meet only in equal columns or after a difference."""
    out = np.zeros((a.shape[1], b.shape[1]), np.uint8 if len(a) < 256 else np.int32)
    alive = np.ones(out.shape, bool)
    for x, y in zip(a, b, strict=False):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        out += alive
    return out


class Words:
    """Rows of some sets: set number, side (0: equal starts, 1: equal ends), longer length M, role (0, or 1 for the second of two tiles), word, count."""

    def __init__(self, t: pa.Table):
        key = t.select(["part", "i", "j"]).to_pandas().to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        self.sets, self.starts = np.cumsum(new), np.append(np.flatnonzero(new), len(new))
        self.side, self.longer, self.role, self.n = (t[c].to_numpy() for c in ("side", "longer", "role", "n"))
        self.words = t["word"].to_pylist()
        order = sorted(range(len(key)), key=lambda k: (-self.n[k], self.words[k]))
        self.order, self.place = np.array(order, np.int64), np.empty(len(key), np.int64)
        self.place[self.order] = np.arange(len(key))

    def near(self, a: slice, b: slice) -> np.ndarray:
        """Which pairs of two ranges of rows count as near in their set."""
        sizes, left, right = code_points(self.words[a])
        to_sizes, to_left, to_right = (sizes, left, right) if a == b else code_points(self.words[b])
        prefix, suffix = common(left, to_left).astype(np.int64), common(right, to_right)
        longer = np.maximum(sizes[:, None], to_sizes[None, :])
        reach = (prefix + suffix >= longer - 1) & (longer == self.longer[a][:, None]) & (self.sets[a][:, None] == self.sets[b][None, :])
        reach &= (prefix >= longer // 2) == (self.side[a] == 0)[:, None]
        return reach & ((prefix < longer) | (sizes[:, None] != to_sizes[None, :]))  # a word isn't near itself

    def blocks(self) -> Iterator[tuple[slice, slice]]:
        """Pairs of blocks to compare: small sets packed, larger ones cut; of two tiles, the blocks of one with those of the other."""
        at, most = 0, max(16, min(BLOCK, CODES // int(self.longer.max())))
        cut = lambda lo, hi: [slice(x, min(x + most, hi)) for x in range(lo, hi, most)]
        two_tiles = [self.role[hi - 1] != self.role[lo] for lo, hi in zip(self.starts[:-1], self.starts[1:], strict=True)]
        starts = self.starts.tolist()
        while at < len(two_tiles):
            lo, to = starts[at], at + 1
            if two_tiles[at]:
                middle = lo + int(np.argmax(self.role[lo : starts[to]]))
                yield from ((a, b) for a in cut(lo, middle) for b in cut(middle, starts[to]))
            elif starts[to] - lo > most:
                parts = cut(lo, starts[to])
                yield from ((a, b) for k, a in enumerate(parts) for b in parts[k:])
            else:
                while to < len(two_tiles) and starts[to + 1] - lo <= most and not two_tiles[to]:
                    to += 1
                yield slice(lo, starts[to]), slice(lo, starts[to])
            at = to

    def found(self) -> tuple[list[int], list[int], list[int]]:
        """Rows with near words, how many, and the row of the most frequent."""
        none = len(self.words)
        many, best = np.zeros(none, np.int64), np.full(none, none, np.int64)
        for a, b in self.blocks():
            near = self.near(a, b)
            if near.any():
                for own, other, f in [(a, b, near)] if a == b else [(a, b, near), (b, a, near.T)]:
                    many[own] += f.sum(axis=1)
                    best[own] = np.minimum(best[own], np.where(f, self.place[other][None, :], none).min(axis=1))
        rows = np.flatnonzero(many)
        return rows.tolist(), many[rows].tolist(), self.order[best[rows]].tolist()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted sets as rows (word, n_near, best_n, best). A set is worked on when all its rows are there; it has two tiles at most."""

    def work(t: pa.Table) -> pa.RecordBatch:
        w = Words(t)
        rows, many, best = w.found()
        return pa.RecordBatch.from_arrays([pa.array([w.words[k] for k in rows], pa.string()), pa.array(many, pa.int64()), pa.array([int(w.n[k]) for k in best], pa.int64()), pa.array([w.words[k] for k in best], pa.string())], names=["word", "n_near", "best_n", "best"])

    def key(b: pa.RecordBatch, k: int) -> tuple:
        return tuple(b[c][k].as_py() for c in ("part", "i", "j"))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        if held and key(held[-1], held[-1].num_rows - 1) == last:  # sorted: all of the batch belongs to the held set
            held.append(batch)
            continue
        lo, hi = 0, batch.num_rows - 1  # the last set's first row in this batch, by bisection
        while lo < hi:
            middle = (lo + hi) // 2
            lo, hi = (lo, middle) if key(batch, middle) == last else (middle + 1, hi)
        whole = [*held, batch.slice(0, lo)] if lo else held
        if whole:
            yield work(pa.Table.from_batches(whole))
        held = [batch.slice(lo)]
    if held:
        yield work(pa.Table.from_batches(held))


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, best_n, best) for each word of (word, n) that has near words; best is the most frequent of them."""
    size = F.length("word")
    dealt = words.select("word", "n", F.explode(F.array(*[F.struct((size + more).alias("longer"), F.lit(side).alias("side")) for more in (0, 1) for side in (0, 1)])).alias("x")).select("word", "n", "x.longer", "x.side")
    half = F.floor(F.col("longer") / 2).cast("int")
    end = F.when(F.col("side") == 0, F.substr("word", F.lit(1), half)).otherwise(F.substr("word", size - half + 1, half))
    dealt = dealt.withColumn("part", F.concat_ws(" ", "longer", "side", end))
    sets = scratch.write(dealt.groupBy("part").agg(F.count("*").alias("size")).where("size > 1"), "sets")
    tiles = F.ceil(F.col("size") / TILE).cast("long")
    placed = join_groups(dealt, sets, "part", "size").where("size is not null").withColumn("tile", F.pmod(F.xxhash64("word"), tiles))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), tiles - 1), lambda x: F.struct(F.least("tile", x).alias("i"), F.greatest("tile", x).alias("j"), (F.col("tile") > x).cast("int").alias("role")))
    rows = placed.select("longer", "side", "part", "word", "n", F.explode(meets).alias("x")).select("longer", "side", "part", "x.i", "x.j", "x.role", "word", "n")
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.repartition(n, "part", "i", "j").sortWithinPartitions("longer", "part", "i", "j", "role")
    found = blocks.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("x")).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where the links (word, root) end, by pointer doubling."""
    now, k = scratch.write(links, "roots0"), 0
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        k += 1
        following = scratch.write(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), f"roots{k}")
        if following.where("moved").isEmpty():
            return following.select("word", "root")
        now = following.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts (word, n).

    A word's form is its most frequent near word, if that is at least `times` as frequent; its root is where forms lead, the word itself without one. times is more than 1, so forms form no circle.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.write(words.select("word", "n"), "words")
    takes = F.col("best_n") >= times * F.col("n")
    joined = words.join(near_words(words, scratch), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"))
    formed = scratch.write(joined, "formed")
    ends = roots(formed.where("form is not null").select("word", F.col("form").alias("root")), scratch)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_report(docs: DataFrame) -> DataFrame:
    """Variants among the words of all documents, of which one in 97 pairs of document and run lost a code point."""
    return variants(frequent(runs(docs), without_one(F.col("run"), F.col("id"), 97)))
