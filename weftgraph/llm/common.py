"""Word hashing and batch plumbing shared by the text operators.

Words are the byte runs between ASCII white space (0x20, 0x09-0x0D) of a text's
UTF-8 form with A-Z lower-cased; `bytes.lower` and `bytes.split` mean just that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the rolling hash modulo 2**64, and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a weak 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for slot, base in enumerate((BASE, BASE_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[slot] = np.cumprod(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of the text, in order; equal words have equal hashes."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], gap.view(np.int8), [1]))))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` codes in a row."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * BASE + codes[k : k + n]
    return mix(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one of none has none."""
    codes = word_hashes(text)
    if 0 < len(codes) < width:
        codes_of_all = windows(codes, len(codes))
        return codes_of_all
    return np.unique(windows(codes, width))


def binary_column(rows: np.ndarray) -> pa.Array:
    """A 2-d array as one binary value per row."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def int_lists(rows: list[np.ndarray]) -> pa.Array:
    """List<int32> column from one array per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def pieces(batches, rows: int = 256):
    """The record batches cut to at most `rows` rows, so that a task holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker process goes on to other tasks


def by_size(batches, name: str, most: int):
    """The record batches cut so that the texts of a part have about `most` bytes at most."""
    for batch in batches:
        start = held = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_pylist()
        for at, size in enumerate(sizes):
            if at > start and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
