"""Token ids of texts in a compact binary table.

Ids are replaced by their rank in the corpus frequency, so that the common ones are small, and each rank is written in one to four
little-endian bytes. Lengths are kept apart from the data: one control byte holds those of four ids, two bits each. A block's data are
decoded with a table look-up by control byte, for all ids at once.

Format: a folder with two Parquet tables. `ranks`: one row, the id of every rank (32-bit little-endian). `blocks`: part, start (ids before this block within its part),
docs (64-bit ids of the documents), counts (32-bit ids per document), n, control, data. Blocks hold whole documents in ascending id
order; parts follow each other. A part is what one task wrote, so a lost executor repeats single parts.

Each document ends with end_id. Null texts are empty; rows that share an id stay separate, in an order that their texts fix. Rows without an id come first
and are written with the smallest 64-bit number as theirs.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch
from vacantia.llm.words import mix, slices

#: Ids of a block, if it holds more than one document.
BLOCK_IDS = 1 << 18

BLOCKS = "part int, start long, docs binary, counts binary, n long, control binary, data binary"

#: Bytes of each of the four ids of a control byte, and where each begins.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit numbers. The last control byte is filled up with ids of one byte that n leaves out."""
    r = ranks.astype("<u4")
    n = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The 32-bit numbers of encode()."""
    c = np.frombuffer(control, np.uint8)
    lengths = LENGTHS[c]
    group = lengths.sum(axis=1)
    at = ((np.cumsum(group) - group)[:, None] + STARTS[c]).reshape(-1)[:n]
    lengths = lengths.reshape(-1)[:n]
    source = np.frombuffer(data + bytes(4), np.uint8)
    out = source[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= source[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class PieceTable:
    """Pieces of up to SHORT bytes with their ids. Two 64-bit numbers hold a piece's bytes and length, so look-ups are exact; slots are found by linear probing."""

    SHORT = 15
    #: Pieces remembered, and their ids.
    MOST, MOST_IDS = 1 << 20, 1 << 22

    def __init__(self):
        self.slots = np.zeros(2 * self.MOST, np.int32)
        self.a, self.b = np.zeros(self.MOST + 1, np.uint64), np.zeros(self.MOST + 1, np.uint64)
        #: Entry 0 stands for an empty slot.
        self.start, self.ids, self.n = np.zeros(self.MOST + 2, np.int32), np.zeros(self.MOST_IDS, np.uint32), 1

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a ^ mix(b)) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry of each piece, 0 if it isn't known."""
        slot = self._slot(a, b)
        entry = self.slots[slot]
        open_ = np.flatnonzero((entry > 0) & ((self.a[entry] != a) | (self.b[entry] != b)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            entry[open_] = e = self.slots[slot[open_]]
            open_ = open_[(e > 0) & ((self.a[e] != a[open_]) | (self.b[e] != b[open_]))]
        return entry

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Remember different new pieces, as many of the first as there is room for: frequent ones come early."""
        many = min(self.MOST + 1 - self.n, int(np.searchsorted(np.cumsum(n_ids), self.MOST_IDS - self.start[self.n], side="right")))
        if many <= 0:
            return
        a, b, ends, new = a[:many], b[:many], self.start[self.n] + np.cumsum(n_ids[:many]), np.arange(self.n, self.n + many, dtype=np.int32)
        self.ids[self.start[self.n] : ends[-1]] = ids[: ends[-1] - self.start[self.n]]
        self.a[new], self.b[new], self.start[new + 1] = a, b, ends
        self.n += many
        slot = self._slot(a, b)
        while len(new):
            free = np.flatnonzero(self.slots[slot] == 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[free]] = new[free]
            left = np.ones(len(new), bool)
            left[free] = False
            new, slot = new[left], (slot[left] + 1) & (len(self.slots) - 1)


class PieceEncoder:
    """A byte-level BPE tokenizer with a memory of the pieces of text it has encoded.

    Such tokenizers split a text before they merge bytes: no token reaches over the start of a run of blanks, nor from a letter to a mark or (apostrophes
    apart) from a mark to a letter. So a text's ids are those of its pieces one after the other, and most pieces repeat. New pieces are encoded as one
    text and told apart by their ids' bytes. Texts with other white space or with the string of a special token are encoded whole.
    """

    #: Bytes of new pieces that are encoded as one text.
    JOINED = 1 << 16
    # The other white space, as bytes of UTF-8.
    OTHER_SPACE = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
    BLANK = np.isin(np.arange(256), list(b" \t\n\r"))
    #: ASCII letters 1, marks 2, the apostrophe 3.
    KIND = np.zeros(256, np.uint8)
    KIND[[*range(65, 91), *range(97, 123)]] = 1
    KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2
    KIND[39] = 3
    #: Bytes that begin other white space.
    RARE = np.isin(np.arange(256), [0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3])

    #: Second bytes of the letters from U+00C0 to U+00FF.
    LATIN = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.by_piece = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and self.tokenizer.normalizer is None and not getattr(self.tokenizer.model, "dropout", None)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A byte-level token has one character for each of its bytes.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.table = PieceTable()

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts can't be cut into pieces."""
        out = np.full(len(offsets) - 1, not self.by_piece)
        if self.by_piece and len(data):
            raw, at = data.tobytes(), []
            if self.RARE[data].any():
                at += [m.start() for m in self.OTHER_SPACE.finditer(raw)]
            for s in self.special:
                i = raw.find(s)
                while i >= 0:
                    at.append(i)
                    i = raw.find(s, i + 1)
            out[np.searchsorted(offsets, at, side="right") - 1] = True
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has."""
        n_texts, size = len(offsets) - 1, len(data)
        if not size:
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        whole = self.whole(data, offsets)
        blank = self.BLANK[data]
        begins = np.empty(size, bool)
        begins[0] = True
        np.logical_and(blank[1:], ~blank[:-1], out=begins[1:])
        kind = self.KIND[data]
        letter, mark = kind == 1, kind > 1
        letter[1:] |= self.LATIN[data[1:]] & (data[:-1] == 0xC3)
        begins[1:] |= (letter[:-1] & mark[1:]) | ((kind[:-1] == 2) & (kind[1:] == 1))
        for k in np.flatnonzero(whole):
            begins[offsets[k] : offsets[k + 1]] = False
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        first = np.flatnonzero(begins)
        length = np.diff(first, append=size)
        # The bytes of a piece as two numbers, little-endian, the last byte being its length.
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((size + 9,), "<u8", padded, 0, (1,))
        short = length <= PieceTable.SHORT
        at, n = first[short], length[short]
        a = eight[at] & self._low[np.minimum(n, 8)]
        b = (eight[at + 8] & self._low[np.maximum(n - 8, 0)]) | (n.astype(np.uint64) << np.uint64(56))
        entry = np.zeros(len(first), np.int32)
        entry[short] = self.table.find(a, b)
        start, count = self.table.start[entry].astype(np.int64), (self.table.start[entry + 1] - self.table.start[entry]).astype(np.int64)
        ids = self.table.ids
        missing = np.flatnonzero(entry == 0)
        if len(missing):
            of_text = np.searchsorted(offsets, first[missing], side="right") - 1
            is_short = short[missing]
            mine = (np.cumsum(short) - 1)[missing[is_short]]
            order = np.lexsort((b[mine], a[mine]))
            new = np.ones(len(order), bool)
            new[1:] = (a[mine][order][1:] != a[mine][order][:-1]) | (b[mine][order][1:] != b[mine][order][:-1])
            name = np.empty(len(order), np.int64)
            name[order] = np.cumsum(new) - 1
            one = order[new]  # of each new short piece, then all long ones
            apart = missing[~is_short]
            asked = np.concatenate([missing[is_short][one], apart])
            joinable = blank[first[asked]] & ~blank[first[asked] + length[asked] - 1] & ~np.concatenate([whole[of_text[is_short][one]], whole[of_text[~is_short]]])
            fresh, n_fresh = self._fresh(data, first[asked], length[asked], joinable)
            ends = np.cumsum(n_fresh)
            place = np.empty(len(asked), np.int64)
            place[np.concatenate([np.flatnonzero(joinable), np.flatnonzero(~joinable)])] = np.arange(len(asked))
            which = np.empty(len(missing), np.int64)
            which[is_short], which[~is_short] = place[name], place[len(one) :]
            used = self.table.start[self.table.n]
            ids = np.concatenate([ids[:used], fresh])
            start[missing], count[missing] = used + (ends - n_fresh)[which], n_fresh[which]
            joined = int(joinable.sum())
            for some, at in ((joinable, 0), (~joinable, joined)):  # of each the short pieces come first
                kept = one[some[: len(one)]]
                self.table.add(a[mine][kept], b[mine][kept], fresh[ends[at - 1] if at else 0 :], n_fresh[at : at + len(kept)])
        before = np.cumsum(count) - count
        out = ids[np.arange(count.sum()) + np.repeat(start - before, count)]
        total = np.append(before, count.sum())
        return out, np.diff(total[np.searchsorted(first, offsets)])

    _low = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

    def _fresh(self, data: np.ndarray, first: np.ndarray, length: np.ndarray, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has, first the joinable pieces, then the others."""
        parts, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0

        def one_by_one(pieces: np.ndarray) -> None:
            found = self.library([data[first[k] : first[k] + length[k]].tobytes().decode() for k in pieces])
            parts.extend(found)
            counts.append(np.array(list(map(len, found)), np.int64))

        together = np.flatnonzero(joinable)
        ends = np.cumsum(length[together])
        while at < len(together):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.JOINED, side="right")))
            part, own = together[at:to], ends[at:to] - (ends[at - 1] if at else 0)
            text = data[np.arange(own[-1]) + np.repeat(first[part] - own + length[part], length[part])].tobytes().decode()
            ids = self.library([text])[0]
            reach = np.cumsum(self.n_bytes[ids])
            cut = np.searchsorted(reach, own)
            if reach[-1] == own[-1] and (reach[cut] == own).all():
                parts.append(ids)
                counts.append(np.diff(cut, prepend=-1))
            else:  # an id whose bytes its token doesn't show
                one_by_one(part)
            at = to
        one_by_one(np.flatnonzero(~joinable))
        return np.concatenate(parts), np.concatenate(counts)


#: One in each Python worker.
_encoders: dict[str, PieceEncoder] = {}


def tokenized(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Blocks of raw ids, in the order of the rows: part, start, docs, counts, n, ids."""
    from pyspark import TaskContext

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = PieceEncoder(tokenizer_path)
    encoder = _encoders[tokenizer_path]
    part, start, total = TaskContext.get().partitionId(), 0, 0
    docs, counts, ids = [], [], []

    def block() -> pa.RecordBatch:
        row = [part, start, np.concatenate(docs).astype("<i8").tobytes(), np.concatenate(counts).astype("<u4").tobytes(), total, np.concatenate(ids).astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["part", "start", "docs", "counts", "n", "ids"])

    for batch in batches:
        for rows, data, offsets in slices(batch, "text"):
            own, n = encoder.encode(data, offsets)
            n += 1
            out = np.full(len(own) + len(n), end_id, np.uint32)
            inner = np.ones(len(out), bool)
            inner[np.cumsum(n) - 1] = False
            out[inner] = own
            docs.append(rows.column(0).fill_null(-(1 << 63)).to_numpy())
            counts.append(n)
            ids.append(out)
            total += len(out)
            if total >= BLOCK_IDS:
                yield block()
                start, total, docs, counts, ids = start + total, 0, [], [], []
    if docs:
        yield block()


def write_token_table(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every text and write the token table to `path`, documents in ascending order of their (integer) ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(max(n, ordered.rdd.getNumPartitions()), "id").sortWithinPartitions("id", "text")
    raw = scratch.write(ordered.mapInArrow(lambda b: tokenized(b, tokenizer_path, end_id), "part int, start long, docs binary, counts binary, n long, ids binary"), "raw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(np.frombuffer(ids.as_buffer(), "<u4"))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # One row for each id of the vocabulary, whose size the tokenizer bounds.
    by_rank = raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toPandas().id.to_numpy(np.int64)
    spark.createDataFrame([(bytearray(by_rank.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [encode(rank[np.frombuffer(ids.as_buffer(), "<u4")]) for ids in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1))], names=["part", "start", "docs", "counts", "n", "control", "data"])

    raw.mapInArrow(coded, BLOCKS).write.parquet(f"{path}/blocks")
    scratch.drop("raw")


def read_token_table(spark, path: str) -> DataFrame:
    """The documents of a token table: doc_id, start (ids before it in the whole table), n_tokens, ids (32-bit little-endian)."""
    first = spark.read.parquet(f"{path}/ranks").first()
    by_rank = np.frombuffer(bytes(first.ids), "<u4") if first else np.zeros(0, np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).selectExpr("part as p", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as before")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, start, docs, counts, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                each = np.frombuffer(counts, "<u4").astype(np.int64)
                ids = by_rank[decode(control, data, n)].astype("<u4")
                ends = np.cumsum(each)
                own = pa.Array.from_buffers(pa.large_binary(), len(each), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64) * 4), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), p), pa.int32()), pa.array(np.frombuffer(docs, "<i8")), pa.array(start + ends - each), pa.array(each), own], names=["part", "doc_id", "start", "n_tokens", "ids"])

    # `parts` has one row for each task that wrote.
    return blocks.mapInArrow(decoded, "part int, doc_id long, start long, n_tokens long, ids binary").join(F.broadcast(parts), F.col("part") == F.col("p")).selectExpr(f"nullif(doc_id, {-(1 << 63)}L) as doc_id", "start + before as start", "n_tokens", "ids")


def token_table_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token table of documents and describe each document as read back from it."""
    scratch = Scratch(docs.sparkSession)
    path = f"{scratch.path}/tokens"
    write_token_table(docs, path, tokenizer_path)
    return read_token_table(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    """The checksum of the report, for a list of ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
