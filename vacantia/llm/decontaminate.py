"""Benchmark decontamination with suffix arrays over the training texts.

Every shard of training documents (a slice of an Arrow batch, whole documents only) gets a word suffix array. Every suffix of the
benchmark is looked up in it by binary search (equal windows once), which gives the places of each window and, by stepping along the text, the longest
verbatim match with each item and where it lies. Documents with enough matched words are removed. Places of a window in a text and in the items meet in pieces of PAIRS pairs, so that
texts and items that repeat themselves, or a window that many items share, cost time but no memory.

Only suffixes that begin with two adjacent benchmark words (or with the word of a one-word item) are entered, as no other suffix can
hold a window. Nothing is shuffled: a document is judged where it is read, and the benchmark, a stated query set, goes to the tasks
in blocks of about BLOCK_WORDS words, at most BLOCKS_AT_ONCE of them in one pass over the documents. A larger benchmark takes more passes.

Null texts have no words; empty tables, items without words and repeated rows are all allowed. Matches are found for each row on its own, so
repeated ids change nothing. Items that share an id count as one, and so do all items without an id: their windows hit like any other, they count as one
item, and lists of ids leave them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch, modest_batches, own_names
from vacantia.llm.words import ALNUM, slices, word_hashes

WINDOW = 13
#: Words of benchmark text that one block of test suffixes holds (16 bytes each).
BLOCK_WORDS = 1 << 20
#: Blocks that one pass over the documents broadcasts.
BLOCKS_AT_ONCE = 8
#: Pairs of a place in a text and a place in an item that are held at once, but for those of a single place.
PAIRS = 1 << 20

MATCHES = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"


class TestBlock:
    """Words of some benchmark items: sorted vocabulary, word numbers, and the distinct windows with the items that hold them."""

    __test__ = False

    def __init__(self, ids: list[str], hashes: list[np.ndarray], window: int):
        self.ids = ids
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.vocab, numbers = np.unique(flat, return_inverse=True)
        lengths = np.array([len(h) for h in hashes], np.int64)
        starts = np.cumsum(lengths) - lengths
        #: Word numbers from 1; each item is followed by a 0.
        self.words = np.zeros(len(flat) + len(lengths) + 1, np.int64)
        item_of = np.repeat(np.arange(len(lengths)), lengths)
        self.words[np.arange(len(flat)) + item_of] = numbers + 1
        self.item_at = starts + np.arange(len(lengths))
        at, length, item = [], [], []
        for k, n in enumerate(lengths):
            if n:
                m = min(int(n), window)
                at.append(self.item_at[k] + np.arange(n - m + 1))
                length.append(np.full(n - m + 1, m))
                item.append(np.full(n - m + 1, k))
        none = [np.zeros(0, np.int64)]
        place, length, self.item_of_place = (np.concatenate(x or none).astype(np.int64) for x in (at, length, item))
        self.longest = int(length.max()) if len(length) else 0
        # Equal windows are one: `at` and `length` of each, and its places in the items from `first` on.
        offset = np.arange(self.longest)
        text = np.concatenate([self.words, np.zeros(self.longest + 1, np.int64)])
        rows = np.where(offset < length[:, None], text[place[:, None] + np.where(offset < length[:, None], offset, 0)], 0).astype(np.int32)
        same = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * self.longest))).reshape(-1) if len(rows) else np.zeros(0, np.int64)
        _, one, window_of = np.unique(same, return_index=True, return_inverse=True)
        self.at, self.length = place[one], length[one]
        order = np.argsort(window_of, kind="stable")
        self.places, self.item_of_place = place[order], self.item_of_place[order]
        self.first = np.searchsorted(window_of[order], np.arange(len(one) + 1))
        two = (self.words[:-1] > 0) & (self.words[1:] > 0)
        self.pairs = np.unique(self.words[:-1][two] * (len(self.vocab) + 1) + self.words[1:][two])
        self.single = np.unique(self.words[self.at[self.length == 1]])


def suffix_array(words: np.ndarray, active: np.ndarray, depth: int) -> np.ndarray:
    """Active positions in the order of the suffixes that start there, exact to `depth` words; by doubling of ranks.

    A suffix ends with the word of the first position that isn't active (see `ends`), and sorts before every longer one that it begins.
    """
    rank, order, span = words << 32, np.argsort(words[active], kind="stable"), 1
    rank[active] += 1
    padded = np.concatenate([rank, np.zeros(depth + 2, np.int64)])
    while span < depth and len(active):
        a, b = padded[active], padded[active + span]
        order = np.lexsort((b, a))
        new = np.ones(len(order), np.int64)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        dense = np.empty(len(order), np.int64)
        dense[order] = np.cumsum(new)
        padded[active] = (words[active] << 32) + dense
        if dense.max(initial=0) == len(active):
            break
        span *= 2
    return active[order]


def ends(n: int, active: np.ndarray) -> np.ndarray:
    """For each position the last one of its suffix: itself or the next that isn't active. No window reaches over it."""
    at = np.arange(n)
    at[active] = n
    return np.minimum.accumulate(at[::-1])[::-1]


def bounds(sa: np.ndarray, words: np.ndarray, last: np.ndarray, test: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test prefix (place and length) the range of suffix array entries that start with it; all searched at once.

    Words are compared as the array is sorted: after the end of a suffix stands a 0, less than any test word.
    """

    def search(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            place, want, left = sa[mid], at[open_], length[open_]
            less = np.full(len(open_), after)  # a suffix that starts with the prefix: on to the right if `after`
            same, d = np.arange(len(open_)), 0
            while len(same):
                same = same[d < left[same]]
                x, y = np.where(place[same] + d <= last[place[same]], words[place[same] + d], 0), test[want[same] + d]
                less[same[x < y]] = True
                less[same[x > y]] = False
                same, d = same[x == y], d + 1
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    return search(False), search(True)


def best_of(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (row, item, item word, text word, number of words) the longest of each row and item; ties go to the first in the text, then in the item."""
    row, item, item_word, text_word, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((item_word, text_word, -n, item, row))
    keep = np.ones(len(order), bool)
    keep[1:] = (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])
    return tuple(x[order][keep] for x in (row, item, item_word, text_word, n))


def longest_matches(start: np.ndarray, window: np.ndarray, row: np.ndarray, block: TestBlock) -> tuple[np.ndarray, ...]:
    """The longest match of each row and item, from the places of windows in the shard, which are in order. Windows that follow each other in a text and an item are one longer match."""
    many = block.first[window + 1] - block.first[window]
    total, at, found = np.cumsum(many), 0, [tuple(np.zeros(0, np.int64) for _ in range(5))]
    # Matches that reach the last place of a piece, as the place in the item less that in the text, with their first place.
    open_, since, last = np.zeros(0, np.int64), np.zeros(0, np.int64), -2
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        while to < len(start) and start[to] == start[to - 1]:
            to += 1
        n = many[at:to]
        which = np.repeat(np.arange(at, to), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.first[window[at:to]], n)
        text, test = start[which], block.places[place]
        item, length, diagonal = block.item_of_place[place], block.length[window[which]], test - text
        order = np.lexsort((text, diagonal))
        text, test, item, length, diagonal, which = (x[order] for x in (text, test, item, length, diagonal, which))
        new = np.ones(len(text), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (text[1:] != text[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(text)) - 1
        begin = text[head].copy()
        if len(open_):
            near = np.minimum(np.searchsorted(open_, diagonal[head]), len(open_) - 1)
            goes_on = (open_[near] == diagonal[head]) & (text[head] == last + 1)
            begin[goes_on] = since[near[goes_on]]
        shift = text[head] - begin
        found = [best_of([*found, (row[which[head]], item[head], test[head] - shift - block.item_at[item[head]], begin, text[tail] + length[tail] - begin)])]
        last = int(start[to - 1])
        reach = text[tail] == last
        by = np.argsort(diagonal[tail][reach], kind="stable")
        open_, since, at = diagonal[tail][reach][by], begin[reach][by], to
    return found[0]


def shard_matches(hashes: np.ndarray, first: np.ndarray, block: TestBlock) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of a shard the longest matches (row, item, word of the item, word of the row's text, number of words), and the hit words (row, start, end) of its windows."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5)), tuple(np.zeros(0, np.int64) for _ in range(3))
    n, rows = len(hashes), len(first) - 1
    if not n or not len(block.at):
        return none
    number = np.searchsorted(block.vocab, hashes)
    number[number == len(block.vocab)] = 0
    number = np.where(block.vocab[number] == hashes, number + 1, 0)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    words = np.zeros(n + rows + block.longest + 2, np.int64)
    words[np.arange(n) + row_of] = number
    two = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
    code = words[two] * (len(block.vocab) + 1) + words[two + 1]
    place = np.searchsorted(block.pairs, code)
    place[place == len(block.pairs)] = 0
    active = two[block.pairs[place] == code] if len(block.pairs) else two[:0]
    if len(block.single):
        active = np.union1d(active, np.flatnonzero(np.isin(words, block.single)))
    sa = suffix_array(words, active, block.longest)
    lo, hi = bounds(sa, words, ends(len(words), active), block.words, block.at, block.length)
    many = hi - lo
    if not many.sum():
        return none
    window = np.repeat(np.arange(len(many)), many)
    start = sa[np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    order = np.argsort(start, kind="stable")
    start, window = start[order], window[order]
    shifted = first[:-1] + np.arange(rows)
    row = np.searchsorted(shifted, start, side="right") - 1
    best = longest_matches(start, window, row, block)
    # A row's words are followed by a 0, so that no range reaches into the next row.
    begin, end = merged(start, start + block.length[window])
    of = np.searchsorted(shifted, begin, side="right") - 1
    return (*best[:3], best[3] - shifted[best[0]], best[4]), (of, begin - shifted[of], end - shifted[of])


def test_blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_words: int) -> Iterator[TestBlock]:
    """The benchmark in blocks; its rows pass the driver one block at a time."""
    modest_batches(benchmark.sparkSession)
    ids: list[str | None] = []
    hashes: list[np.ndarray] = []
    n, any_ = 0, False
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        data = np.frombuffer((r.t or "").encode(), np.uint8)
        h, _ = word_hashes(data, np.array([0, len(data)]), ALNUM)
        ids.append(r.i)
        hashes.append(h)
        n += len(h)
        if n >= block_words:
            yield TestBlock(ids, hashes, window)
            ids, hashes, n, any_ = [], [], 0, True
    if ids or not any_:
        yield TestBlock(ids, hashes, window)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else end


def row_matches(data: np.ndarray, offsets: np.ndarray, blocks: list) -> tuple[np.ndarray, list, list]:
    """Words of each row, its longest matches as (item_id, item_word, doc_word, n_words), and the ranges of its hit words."""
    hashes, first = word_hashes(data, offsets, ALNUM)
    matches: list[list[tuple]] = [[] for _ in offsets[1:]]
    hits: list[list[tuple]] = [[] for _ in offsets[1:]]
    for b in blocks:
        best, hit = shard_matches(hashes, first, b.value)
        for r, item, *rest in zip(*(x.tolist() for x in best), strict=True):
            matches[r].append((b.value.ids[item], *rest))
        for r, *range_ in zip(*(x.tolist() for x in hit), strict=True):
            hits[r].append(tuple(range_))
    return np.diff(first), matches, hits


_FIELDS = ("item_id", "item_word", "doc_word", "n_words")
_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str, block_words: int, names: tuple[str, str, str]) -> DataFrame:
    """docs and three more columns: number of words, the longest match with each item, and hits (the words inside any window of an item, merged)."""
    spark, scratch, columns = docs.sparkSession, Scratch(docs.sparkSession), docs.columns
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{names[0]}` long, `{names[1]}` {MATCHES}, `{names[2]}` array<struct<start:int,end:int>>"

    def one_pass(df: DataFrame, blocks: list) -> DataFrame:
        known = len(df.columns) > len(columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offsets in slices(batch, text_col):
                    n_words, found, ranges = row_matches(data, offsets, blocks)
                    matches = [[dict(zip(_FIELDS, m, strict=True)) for m in x] for x in found]
                    if known:
                        matches = [a + b for a, b in zip(rows.column(-2).to_pylist(), matches, strict=True)]
                        ranges = [[(h["start"], h["end"]) for h in a] + b for a, b in zip(rows.column(-1).to_pylist(), ranges, strict=True)]
                    hits = []
                    for x in ranges:
                        start, end = merged(*np.array(x, np.int64).reshape(-1, 2).T)
                        hits.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                    yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array(n_words, pa.int64()), pa.array(matches, _MATCH), pa.array(hits, _SPAN)], names=[*columns, *names])

        return df.mapInArrow(run, shape)

    out, blocks, done = docs, [], 0
    for block in test_blocks(benchmark, window, item_col, item_text, block_words):
        if len(blocks) == BLOCKS_AT_ONCE:
            out, blocks, done = scratch.write(one_pass(out, blocks), f"pass{done}"), [], done + 1
        blocks.append(spark.sparkContext.broadcast(block))
    return one_pass(out, blocks)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document's longest verbatim match with each benchmark item, of at least `window` words (a shorter item: all its words), and all its matched words.

    Returns id_col, n_words, matches (item_id, item_word, doc_word, n_words: ties go to the first in the document, then in the item), hits (start, end: the words inside any match, merged).
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_matches(source, benchmark, window, "text", item_col, item_text, block_words, ("n_words", "matches", "hits"))
    return found.select(F.col("id").alias(id_col), "n_words", "matches", "hits")


def _n_hit(hits: str) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + (h["end"] - h["start"]))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: tuple[int, int] = (1, 20), text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of which less than share[0]/share[1] of the words (or none) lie in a benchmark match; all their columns."""
    names = own_names(docs, "n_words", "matches", "hits")
    found = with_matches(docs, benchmark, window, text_col, item_col, item_text, block_words, names)
    hit = _n_hit(names[2])
    return found.where((hit == 0) | (share[1] * hit < share[0] * F.col(names[0]))).select(*[F.col(f"`{c}`") for c in docs.columns])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return digest(find_matches(docs, benchmark))


def digest(found: DataFrame) -> DataFrame:
    """Of find_matches for each document: words, hit words, items and the verdict."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0))
    return found.select("doc_id", "n_words", _n_hit("hits").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), longest.alias("longest_match")).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
