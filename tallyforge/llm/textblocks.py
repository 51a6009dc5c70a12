"""Arrow string columns as blocks of bytes, words and 64-bit word hashes (NumPy)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: ASCII white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words above this many bytes are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts of a column as one run of UTF-8 bytes, and n + 1 offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None and len(filled) else b""
    return raw, (offsets - offsets[0] if len(filled) else np.zeros(1, dtype=np.int64))


def find_words(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of non-space bytes: their starts, lengths, and n + 1 offsets of each text's words."""
    data = np.frombuffer(raw, dtype=np.uint8)
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] |= ink[edges]
    last[edges - 1] |= ink[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def word_hashes(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    data = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    eight = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
    left = lengths.astype(np.int64)
    out = mix(lengths.astype(U64) * U64(0x9E3779B97F4A7C15) + (eight[starts] & masks[np.minimum(left, 8)]))
    rest = np.flatnonzero((left > 8) & (left <= LONG_WORD))
    at = 8
    while len(rest):
        more = left[rest] - at
        out[rest] = mix(out[rest] * U64(3) + (eight[starts[rest] + at] & masks[np.minimum(more, 8)]))
        rest = rest[more > 8]
        at += 8
    for k in np.flatnonzero(left > LONG_WORD):
        word = raw[starts[k] : starts[k] + lengths[k]]
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cut a batch into runs of rows with about ``most`` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        pa.default_memory_pool().release_unused()
        at = to
