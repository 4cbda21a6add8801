"""Removal of byte strings that occur more than once, by difference-cover sampling.

A difference cover D modulo V has, for any two positions, a common shift below V that takes both to positions whose residues lie in D. So two
equal strings of LENGTH bytes share an aligned pair of sampled positions, from which at least LENGTH - V + 1 bytes agree.

Different texts are dealt to chunks of about CHUNK bytes, in a table that stays bucketed by chunk, so that no later step moves a text.

1. Sampled positions are named by those leading bytes, and anchors (least of V neighbours by a fingerprint of the next few bytes, so that equal stretches have equal
   anchors) by LENGTH + V - 1 bytes. The names of the whole corpus are sorted in buckets and neighbours compared. An anchor whose name is there twice settles V positions:
   all strings of LENGTH bytes in its stretch are repeats. One occurrence of each such stretch speaks for the others.
2. The LENGTH-byte prefixes are named of positions that speak and of unsettled ones within reach of a sampled name that is there twice, sorted in buckets, and neighbours compared.
   Everything else is settled or unique and needs no sorting.
3. All bytes of repeated strings are removed.

Names move as packed arrays, one row for each chunk and bucket, in which a chunk gives a name twice at most; verdicts come back as one bit for each. So rows, names and verdicts grow
with the input, whatever the number of texts that share a string. The bucket holds a name's leading bits: 4 bytes follow in step 1 for sampled positions, where a false survivor only costs work,
7 bytes for all others. Texts that are equal as a whole are one class and count as repeated from the start; only one row of a class names its positions. Which rows
may keep still is told by bitmaps that never silence the one that has to speak, and a chunk has all rows of a class and takes one, so a full bitmap costs work and no result.

Null and empty texts have no bytes. Rows are judged by their text alone: repeated rows and ids are fine.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.shared import Scratch, bit_filter, join_groups, passes
from vacantia.llm.words import buffers, mix, powers

LENGTH = 200
# A perfect difference set modulo 91.
V, COVER = 91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)
#: Bytes of text in a chunk and in a file of chunks, on average.
CHUNK, FILE = 1 << 20, 1 << 23
#: Least leading bits of a name that are its bucket, and sampled names in a bucket, on average, beyond which there are more.
BITS, BUCKET = 10, 8_000_000
#: Bytes after the bucket that move of a sampled name and of others: the latter have all 64 bits.
SHORT, LONG = 4, 7
#: Bytes whose fingerprint chooses anchors.
GRAM = 16

_VALUES = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)
_SAMPLED = np.isin(np.arange(V), COVER)


def sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """least (or greatest) of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (width - span)], x[width - span :])


def twice(h: np.ndarray) -> np.ndarray:
    """Sorted, with what occurs more than once kept two times."""
    value, n = np.unique(h, return_counts=True)
    return np.repeat(value, np.minimum(n, 2))


def cuts(h: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets of a sorted array begin, and its end."""
    return np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(h))


def low_bytes(h: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(packed) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(packed, np.uint8).reshape(-1, n)
    return out.view("<u8").reshape(-1)


class Block:
    """The different texts of a chunk in the order of their classes, end to end."""

    def __init__(self, texts: pa.Table, length: int):
        # Rows of one class have one text.
        at = {c: k for k, c in enumerate(texts.column("cls").to_pylist())}
        self.cls, self.length = sorted(at), length
        texts = texts.take(pa.array([at[c] for c in self.cls], pa.int64()))
        self.data, self.offsets = buffers(texts.column("text").combine_chunks())
        self.place = np.arange(len(self.data))
        self.start, self.end = (np.repeat(o, np.diff(self.offsets)) for o in (self.offsets[:-1], self.offsets[1:]))
        power, self.inverse = powers(len(self.data))
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * power, out=self.sums[1:])

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the `length` bytes from each position of `at`."""
        return mix((self.sums[at + length] - self.sums[at]) * self.inverse[at])

    def sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions with enough bytes behind them in their text, and their names."""
        least = self.length - V + 1
        at = np.flatnonzero(_SAMPLED[(self.place - self.start) % V] & (self.place + least <= self.end))
        return at, self.names(at, least)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions that have the least fingerprint of some V neighbours, and the names of their stretches."""
        gram = (mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: max(0, len(self.data) - GRAM + 1)]) >> np.uint64(32)).astype(np.uint32)
        padded = np.pad(gram, V - 1, constant_values=np.uint32((1 << 32) - 1))
        at = np.flatnonzero(gram == sliding(np.maximum, sliding(np.minimum, padded, V), V)) if len(gram) else self.place[:0]
        whole = self.length + V - 1
        at = at[at + whole <= self.end[at]]
        return at, self.names(at, whole)

    def stretches(self, at: np.ndarray) -> np.ndarray:
        """Which positions lie less than V behind one of `at`."""
        edge = np.zeros(len(self.data) + V + 1, np.int32)
        edge[at] += 1
        edge[at + V] -= 1
        return np.cumsum(edge)[: len(self.data)] > 0

    def prefixes(self, masks: Masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose LENGTH bytes have to be compared, these strings' names, and which positions are settled."""
        at, h = self.sampled()
        hit = np.zeros(len(self.data) + V + 1, np.int32)
        hit[at[masks.all("sampled", h)] + 1] = 1
        np.cumsum(hit, out=hit)
        n = len(self.data)
        near = (self.place + self.length <= self.end) & (hit[V : V + n] > hit[:n])
        at, h = self.anchors()
        settled = self.stretches(at[masks.all("stretch", h)])
        place = np.flatnonzero((near & ~settled) | self.stretches(at[masks.first("speaks", h)]))
        return place, self.names(place, self.length), settled


def of_rows(flag: np.ndarray, row: np.ndarray, n: int) -> list[bytes]:
    """The flags of each of n rows as bits; row is sorted."""
    count = np.bincount(row, minlength=n)
    begin = np.append(0, np.cumsum((count + 7) // 8))
    bit = np.zeros(8 * begin[-1], bool)
    bit[8 * begin[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]] = flag
    packed = np.packbits(bit).tobytes()
    return [packed[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def verdicts(packed: list[bytes], width: int) -> tuple[list[bytes], list[bytes]]:
    """A bit for each different name of each row: is it there twice in the bucket, and is it then the first row to have it?"""
    h = from_low_bytes(b"".join(packed), width)
    row = np.repeat(np.arange(len(packed)), [len(p) // width for p in packed])
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    first[order[:1]] = True
    first[order[1:]] = ~same
    return of_rows(again[new], row[new], len(packed)), of_rows((again & first)[new], row[new], len(packed))


class Masks:
    """Verdicts on the names of one chunk."""

    def __init__(self, table: pa.Table, bits: int):
        self.bits, self.bucket = bits, table.column("bucket").to_pylist()
        self.of = {kind: table.column(kind).to_pylist() for kind in ("sampled", "stretch", "speaks", "prefix") if kind in table.column_names}

    def _flags(self, kind: str, value: np.ndarray) -> np.ndarray:
        at, out = cuts(value, self.bits), np.zeros(len(value), bool)
        for b, mask in zip(self.bucket, self.of[kind], strict=True):
            if mask:
                out[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=at[b + 1] - at[b])
        return out

    def all(self, kind: str, h: np.ndarray) -> np.ndarray:
        """The verdict on each of h."""
        value, of = np.unique(h, return_inverse=True)
        return self._flags(kind, value)[of]

    def first(self, kind: str, h: np.ndarray) -> np.ndarray:
        """Where the names with a verdict stand first in h."""
        value, at = np.unique(h, return_index=True)
        return at[self._flags(kind, value)]


class Speakers:
    """Rows that name their class's positions, by their keys: all but those in `silent`, unless they are in `speaks` too."""

    def __init__(self, silent: np.ndarray, speaks: np.ndarray):
        self.silent, self.speaks = silent, speaks

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy()
            yield batch.filter(pa.array(~passes(self.silent, key) | passes(self.speaks, key)))


def speakers(rows: DataFrame, copies: DataFrame) -> Speakers:
    """The first id of each class speaks. rows: key, cls, id; copies: cls, copies, first."""
    several = join_groups(rows.select("key", "cls", "id"), copies, "cls", "copies").where("copies > 1")
    silent = bit_filter(several.where("not (id <=> first)"), F.col("key"))

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(silent, batch.column(0).to_numpy())))

    first = join_groups(rows.select("key", "cls", "id"), copies, "cls", "copies").where("id <=> first").select("key")
    return Speakers(silent, bit_filter(first.mapInArrow(doubtful, "key long"), F.col("key")))


def name_rows(chunk: int, bits: int, kinds: dict[str, tuple[np.ndarray, int]]) -> pa.Table:
    """bucket, chunk and a column of packed names for each kind (names, bytes of each that move)."""
    packed: dict[str, list[bytes]] = {}
    for kind, (h, width) in kinds.items():
        h = twice(h)
        at, low = (width * cuts(h, bits)).tolist(), low_bytes(h, width)
        packed[kind] = [low[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    some = [b for b in range(1 << bits) if any(p[b] for p in packed.values())]
    columns = {kind: pa.array([p[b] for b in some], pa.binary()) for kind, p in packed.items()}
    return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int64()), **columns})


def _first_names(length: int, bits: int) -> Callable:
    def run(texts: pa.Table) -> pa.Table:
        block = Block(texts, length)
        return name_rows(texts.column("chunk")[0].as_py(), bits, {"sampled": (block.sampled()[1], SHORT), "stretch": (block.anchors()[1], LONG)})

    return run


def _first_verdicts(rows: pa.Table) -> pa.Table:
    sampled, _ = verdicts(rows.column("sampled").to_pylist(), SHORT)
    stretch, speaks = verdicts(rows.column("stretch").to_pylist(), LONG)
    columns = {"sampled": sampled, "stretch": stretch, "speaks": speaks}
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), **{kind: pa.array(masks, pa.binary()) for kind, masks in columns.items()}})


def _prefix_names(length: int, bits: int) -> Callable:
    def run(texts: pa.Table, masks: pa.Table) -> pa.Table:
        h = Block(texts, length).prefixes(Masks(masks, bits))[1]
        return name_rows(texts.column("chunk")[0].as_py(), bits, {"prefix": (h, LONG)})

    return run


def _prefix_verdicts(rows: pa.Table) -> pa.Table:
    masks, _ = verdicts(rows.column("prefix").to_pylist(), LONG)
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "prefix": pa.array(masks, pa.binary())})


def _removed(length: int, bits: int) -> Callable:
    """(cls, n_removed, n_spans, kept_sha256, spans) of the texts of a chunk that lose bytes."""

    def run(texts: pa.Table, verdict: pa.Table) -> pa.Table:
        block, masks = Block(texts, length), Masks(verdict, bits)
        place, h, settled = block.prefixes(masks)
        settled[place[masks.all("prefix", h)]] = True
        start = np.flatnonzero(settled)
        cover = np.zeros(len(block.data) + length + 1, np.int32)
        cover[start] += 1
        cover[start + length] -= 1
        gone = np.cumsum(cover)[: len(block.data)] > 0
        lost = np.append(0, np.cumsum(gone))[block.offsets]
        out = []
        for k in np.flatnonzero(np.diff(lost)):
            own = slice(block.offsets[k], block.offsets[k + 1])
            edge = np.diff(gone[own].astype(np.int8), prepend=0, append=0)
            spans = [{"s": int(a), "e": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            out.append((block.cls[k], int(lost[k + 1] - lost[k]), len(spans), hashlib.sha256(block.data[own][~gone[own]].tobytes()).hexdigest(), spans))
        kinds = {"cls": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))}
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256, spans (s, e: removed byte ranges) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cls = F.unhex(F.md5("text"))
    texts = source.select("text", F.xxhash64(cls, "id").alias("key"), cls.alias("cls")).where(F.octet_length("text") >= length)
    rows = scratch.write(source.select("id", F.octet_length("text").cast("long").alias("n_bytes"), cls.alias("cls"), F.sha2("text", 256).alias("sha"), F.xxhash64(cls, "id").alias("key")), "rows")
    copies = scratch.write(rows.groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "copies")
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(BITS, int(size * len(COVER) / V / BUCKET).bit_length())
    who = speakers(rows.where(F.col("n_bytes") >= length), copies)

    # A table that is bucketed by chunk is read by chunk again and again without a shuffle.
    table, n_files = f"repeats_{uuid.uuid4().hex}", size // FILE + 1
    dealt = texts.mapInArrow(who.of, texts.schema).select(F.expr(f"pmod(xxhash64(cls), {size // CHUNK + 1})").alias("chunk"), "cls", "text").repartition(n_files, "chunk")
    dealt.write.option("compression", "zstd").option("path", f"{scratch.path}/texts").bucketBy(n_files, "chunk").sortBy("chunk").saveAsTable(table)
    scratch.release()
    chunks = spark.table(table).groupBy("chunk")
    named = chunks.applyInArrow(_first_names(length, bits), "bucket int, chunk long, sampled binary, stretch binary")
    first = scratch.write(named.groupBy("bucket").applyInArrow(_first_verdicts, "chunk long, bucket int, sampled binary, stretch binary, speaks binary"), "masks")
    scratch.release()
    named = chunks.cogroup(first.groupBy("chunk")).applyInArrow(_prefix_names(length, bits), "bucket int, chunk long, prefix binary")
    second = scratch.write(named.groupBy("bucket").applyInArrow(_prefix_verdicts, "chunk long, bucket int, prefix binary"), "masks_of_prefixes")
    scratch.release()
    masks = first.unionByName(second, allowMissingColumns=True).groupBy("chunk")
    judged = scratch.write(chunks.cogroup(masks).applyInArrow(_removed(length, bits), "cls binary, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:long,e:long>>"), "judged")
    spark.sql(f"drop table {table}")
    for done in ("texts", "masks", "masks_of_prefixes"):
        scratch.drop(done)
    counted = join_groups(rows.select("id", "n_bytes", "cls", "sha"), copies, "cls", "copies")
    # Copies have no verdict of their own: they don't take part in the join.
    out = counted.where("copies = 1").join(judged, "cls", "left").unionByName(counted.where("copies > 1"), allowMissingColumns=True)
    whole = F.expr(f"copies > 1 and n_bytes >= {length}")
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_bytes").alias("e")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<s:long,e:long>>"))).alias("spans"),
    )
