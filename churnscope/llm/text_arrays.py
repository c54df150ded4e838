"""Texts as flat numpy arrays: words and their 64-bit hashes without a Python
loop over words.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z count as
a-z.  Its hash is a polynomial over random 64-bit byte values, finished with
a mixing function; equal words have equal hashes, and two different words
among n collide with probability about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes hashed at once: some 8-byte numbers for each are held
_U = np.uint64
_ODD = 0x9E3779B97F4A7C55  # base of the polynomials, odd and so invertible


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> _U(27)) ^ (x >> _U(54))
    x *= _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> _U(30)) ^ (x >> _U(60))
    return x


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))


BYTE_VALUE = _byte_values()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED_VALUE = BYTE_VALUE[_LOWER]
END = int(mix(np.array([0x5851F42D4C957F2D], _U))[0])  # hash of the end token

_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.empty(size, _U)
        have[0] = 1
        done, step = 1, base
        while done < size:  # doubling: p[done:2*done] = p[:done] * base**done
            have[done : 2 * done] = have[:done] * _U(step)
            step = step * step % (1 << 64)
            done *= 2
        _powers[key] = have
    return have


def powers(n: int) -> np.ndarray:
    return _power_table(_ODD, n)


def inverse_powers(n: int) -> np.ndarray:
    return _power_table(pow(_ODD, -1, 1 << 64), n)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n+1 sums of values[i] * base**i; see ``span_hash``."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(len(values))[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed polynomial hash of each span [start, end)."""
    return (prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string or binary Arrow array;
    nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` with about ``most`` bytes of ``column`` each, at
    least one row."""
    if batch.num_rows == 0:
        return
    _, offs = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about PIECE bytes that end after white space
    (or at the end of the data), so that no word is cut."""
    at = 0
    while at < len(data):
        to = at + PIECE
        while to < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[to - 1 : to - 1 + PIECE]])
            if len(spaces):
                to += int(spaces[0])
                break
            to += PIECE
        to = min(to, len(data))
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, head: int = 0):
    """(hash of every word in order, n+1 offsets of the documents' words).
    With ``head``, also (hash of the first ``head`` bytes of every longer word,
    its document)."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    heads, head_docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    firsts = offsets[:-1]
    for lo, hi in _pieces(data):
        part = data[lo:hi]
        solid = ~_IS_SPACE[part]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        cut = firsts[(firsts >= lo) & (firsts < hi)] - lo  # documents that start here
        begin[cut] = solid[cut]
        start = np.flatnonzero(begin)
        if not len(start):
            continue
        stop = np.empty_like(solid)
        stop[:-1] = solid[:-1] & (~solid[1:] | begin[1:])
        stop[-1] = solid[-1]
        end = np.flatnonzero(stop) + 1
        prefix = prefix_hash(_LOWERED_VALUE[part])
        hashes.append(mix(span_hash(prefix, start, end) + (end - start).astype(_U)))
        doc = np.searchsorted(offsets, start + lo, side="right") - 1
        counts += np.bincount(doc, minlength=len(counts))
        if head:
            longer = start[end - start > head]
            heads.append(mix(span_hash(prefix, longer, longer + head) + _U(0x5DEECE66D)))
            head_docs.append(doc[end - start > head])
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out[1:])
    whole = np.concatenate(hashes) if hashes else np.zeros(0, _U)
    return (whole, out, np.concatenate(heads), np.concatenate(head_docs)) if head else (whole, out)


def planes(x: np.ndarray) -> bytes:
    """The bytes of integers by significance: rows of equal high bytes, which
    the shuffle's compression removes."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 as differences, by byte significance."""
    return planes(np.diff(keys, prepend=_U(0))) if len(keys) else b""


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, _U), dtype=_U)
