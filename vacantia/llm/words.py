"""Words of text columns as numpy arrays of 64-bit fingerprints.

Texts stay in Arrow's byte buffers: a word is a run of bytes outside a separator set, which is safe on UTF-8 as long as every
separator is an ASCII byte. A word's fingerprint is a polynomial over random byte values modulo 2**64, taken from differences of a
running sum, so a whole chunk is hashed with a few array operations and no Python string is made. Different words agree with a
chance of about 2**-60 a pair.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer single word makes its own chunk longer.
CHUNK = 1 << 20
#: Bytes of text that one slice of an Arrow batch holds, if it has more than one row.
SLICE = 2 << 20

_libc = ctypes.CDLL(None) if sys.platform == "linux" else None
if hasattr(_libc, "mallopt"):
    # M_MMAP_THRESHOLD: arrays of a MB or more go back to the system when they are freed, instead of staying with a reused worker.
    _libc.mallopt(-3, 1 << 20)


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_R = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_RINV = pow(_R, -1, 1 << 64)


def _byte_values(separators: bytes) -> np.ndarray:
    """Random value for each byte, upper case as lower case, 0 for separators."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


#: Words as runs outside blank and control-space bytes.
SPACED = _byte_values(bytes([0x20, *range(0x09, 0x0E)]))
#: Words as runs of digits, letters a-z (after lower-casing) and non-ASCII characters.
ALNUM = _byte_values(bytes(b for b in range(0x80) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the multiplier and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for r in (_R, _RINV):
            a = np.full(max(n, CHUNK), r, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if off is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) pieces of a batch that hold about `most` bytes of text, or one row."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    give_back()


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and for each text the index of its first word (with one more at the end).

    With prefix, each word is followed by the fingerprint of its first `prefix` bytes, as a term of its own, and indexes count both.
    """
    found, places, at = [], [], 0
    starts_of_texts = np.unique(offsets[:-1])
    while at < len(data):
        to = min(len(data), at + CHUNK)
        if to < len(data):
            blank = np.flatnonzero(values[data[at:to]] == 0)
            if len(blank):
                to = at + int(blank[-1]) + 1
            else:  # one word fills the chunk: on to its end
                text_end = int(starts_of_texts[min(np.searchsorted(starts_of_texts, at, side="right"), len(starts_of_texts) - 1)])
                to = next((i + int(b[0]) + 1 for i in range(to, len(data), CHUNK) if len(b := np.flatnonzero(values[data[i : i + CHUNK]] == 0))), len(data))
                to = text_end if at < text_end < to else to
        v = values[data[at:to]]
        word = v != 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        cut = starts_of_texts[np.searchsorted(starts_of_texts, at) : np.searchsorted(starts_of_texts, to)] - at
        begins[cut] |= word[cut]
        cut = cut[cut > 0]
        ends[cut - 1] |= word[cut - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        power, inverse = powers(len(v))
        v *= power
        np.cumsum(v, out=v)
        h = v[last]
        h[first > 0] -= v[first[first > 0] - 1]
        h = mix(h * inverse[first])
        if prefix:
            start = v[np.minimum(first + prefix - 1, last)]
            start[first > 0] -= v[first[first > 0] - 1]
            h = np.stack([h, mix(start * inverse[first] + np.uint64(prefix))], axis=1).reshape(-1)
        found.append(h)
        places.append(first + at)
        at = to
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return hashes, np.searchsorted(place, offsets) * (2 if prefix else 1)
