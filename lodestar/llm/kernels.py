"""Vectorised text kernels over Arrow string columns.

All of them work on the UTF-8 bytes of many documents at once: one concatenated byte array and the
offsets of its documents. Words and shingles are identified by 64-bit hashes; nothing builds Python strings.
A chunk of documents is bounded by its bytes, so memory does not grow with the batch; one document is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20

_ODD = 0xD6E8FEB86659FD93
_MIX1 = 0xBF58476D1CE4E5B9
_MIX2 = 0x94D049BB133111EB
_GOLD = 0x9E3779B97F4A7C15


def space_table() -> np.ndarray:
    """True for bytes of words [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, dtype=bool)
    t[9:14] = False
    t[32] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (digits, a-z, everything beyond ASCII)."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(_MIX1)
    x ^= x >> U(27)
    x *= U(_MIX2)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]]
    return raw, off - off[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of documents of about `most` bytes."""
    raw, off = text_bytes(column)
    n = len(off) - 1
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (one entry more at the end)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.empty(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.take(table, data, out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = off[(off > 0) & (off < len(data))]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), U)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, U(_ODD))
        power[0] = U(1)
        np.multiply.accumulate(power, out=power)
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum((data.astype(U) + U(1)) * power[n:0:-1], out=total[1:])
        h = (total[ends] - total[starts]) * power[ends]
        # equal ranges carry the same power of the base now, but for the length of the buffer; the base has order 2**62
        h = h * _power_of(U(_ODD), (1 << 62) - n)
        return mix(h ^ ((ends - starts).astype(U) * U(_GOLD)))


def _power_of(base: np.uint64, n: int) -> np.uint64:
    return U(pow(int(base), n, 1 << 64))


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document, sorted, as one array and the offsets of its documents.

    A document with fewer than k words, but not none, has one shingle of its whole sequence.
    """
    n_docs = len(first) - 1
    n = len(hashes)
    count = np.diff(first)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(0, n - k + 1), U)
        for j in range(k):
            roll += hashes[j : j + len(roll)] * _odd(j)
        roll = mix(roll)
    out: list[np.ndarray] = []
    sizes = np.zeros(n_docs + 1, np.int64)
    for d in range(n_docs):
        c = count[d]
        if c >= k:
            s = np.unique(roll[first[d] : first[d] + c - k + 1])
        elif c:
            with np.errstate(over="ignore"):
                s = U(c)
                for j in range(c):
                    s = s * U(_MIX2) + hashes[first[d] + j] * _odd(j)
                s = mix(np.array([s], U) ^ U(_GOLD))
        else:
            continue
        out.append(s)
        sizes[d + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.cumsum(sizes)


def _odd(j: int) -> np.uint64:
    return U(((_GOLD * (2 * j + 3) + _MIX1 * (j + 1) ** 2) & (2**64 - 1)) | 1)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as a Spark long."""
    return np.ascontiguousarray(x).view(np.int64)
