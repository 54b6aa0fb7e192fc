"""Byte-level text primitives on Arrow batches: whole columns at a time, no per-word Python objects.

A word is a maximal run of bytes outside ``0x20, 0x09-0x0D``; ASCII capitals are folded. Word identity is a 64-bit
hash, shingle identity a 64-bit hash of an ordered run of word hashes (chance of any clash among n values: n^2 / 2^65).
A span's hash adds a random number for each (place, byte), so two spans that differ anywhere differ by a random number:
no regular pattern, such as a Thue-Morse sequence and its complement, cancels, and two tables give independent hashes.
Null texts count as empty. Work arrays stay near four times the size of the text, since bytes are hashed in segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For terms: all ASCII but digits and letters.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Random numbers by place in a piece and byte; longer spans are several pieces.
PIECE = 1024
FIRST_TABLE, SECOND_TABLE = np.random.default_rng(20240501).integers(0, 1 << 64, (2, PIECE * 256), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def batch_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each row has; ``between``: by byte, whether it parts words."""
    n = len(offsets) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(n, np.int64)
    solid = ~between[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FIRST_TABLE) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap. Depends on the bytes alone."""
    size = ends - starts
    parts = np.maximum(1, -(-size // PIECE))
    first = np.cumsum(parts) - parts
    if len(starts) and parts.max() > 1:
        k = np.arange(int(parts.sum())) - np.repeat(first, parts)
        a = np.repeat(starts, parts) + k * PIECE
        sums = mix(_piece_sums(data, a, np.minimum(np.repeat(ends, parts), a + PIECE), table) + mix(k + 1))
        out = np.add.reduceat(sums, first)
    else:
        out = mix(_piece_sums(data, starts, ends, table) + mix(np.array([1]))[0])
    return mix(out + size.astype(U) * U(0xD6E8FEB86659FD93))


def _piece_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        stop = int(ends[j - 1])
        s, e = starts[i:j] - base, ends[i:j] - base
        place = np.arange(stop - base, dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(np.append(s, stop - base)))
        np.minimum(place, PIECE - 1, out=place)  # only between spans
        place <<= 8
        place |= data[base:stop]
        prefix = np.zeros(stop - base + 1, U)
        np.cumsum(table[place], out=prefix[1:])
        out[i:j] = prefix[e] - prefix[s]
        i = j
    return out


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row, and how many each row has; shorter rows: the whole as one, if any."""
    at = np.concatenate(([0], np.cumsum(counts)))
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(int(out_at[-1]), U)
    n = len(hashes) - k + 1
    if n > 0:
        h = hashes[:n].copy()
        for i in range(1, k):
            h *= U(0x9FB21C651E98DF25)
            h += hashes[i : i + n]
        h = mix(h + U(k))
        keep = np.repeat(counts >= k, counts)[:n] & (np.arange(n) < np.repeat(at[1:] - k + 1, counts)[:n])
        out[np.repeat(counts >= k, many)] = h[keep]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        x = U(0)
        with np.errstate(over="ignore"):
            for y in hashes[at[r] : at[r + 1]]:
                x = x * U(0x9FB21C651E98DF25) + y
            out[out_at[r]] = mix(np.array([x + U(counts[r])], U))[0]
    return out, many


def text_shingles(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, how many by row), in slices of rows."""
    data, offsets = batch_bytes(column)
    for i, j in slices(offsets):
        own = lowered(data[offsets[i] : offsets[j]])
        starts, ends, counts = words(own, offsets[i : j + 1] - offsets[i])
        yield i, j, *shingles(span_hashes(own, starts, ends), counts, k)


def distinct_by_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, one after another, and how many each row has."""
    at = np.concatenate(([0], np.cumsum(counts)))
    parts = []
    for i in range(len(counts)):
        s = np.sort(values[at[i] : at[i + 1]])
        parts.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
    return (np.concatenate(parts) if parts else values[:0]), np.array([len(p) for p in parts], np.int64)
