"""Vectorised work on blocks of whole texts: words, 64-bit names of byte strings, window minima.

A block is a run of documents as one array of UTF-8 bytes with the documents' offsets. The name of a byte string is
chained over its lanes of 8 bytes, each mixed in by a bijection, so that no pair of regular strings (Thue-Morse and its
like, which polynomials modulo 2**64 confuse) meets by construction. Names of all substrings of one length come from
running sums instead; they are used only where the bytes are compared afterwards, or are exact (8 bytes or fewer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_LANE = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=object).astype(np.uint64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK_BYTES + 1024)
        inverse = pow(int(BASE), -1, 1 << 64)
        _POWERS[:] = []
        for base in (int(BASE), inverse):
            step = np.full(n, U64(base))
            step[0] = 1
            _POWERS.append(np.multiply.accumulate(step))
    return _POWERS[0], _POWERS[1]


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[buf]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first document, bytes, offsets) of runs of documents of about `limit` bytes; a longer document is
    a block of its own. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _lanes(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as a number."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def name(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """Names of the substrings buf[start:end]; equal strings under equal seeds have equal names."""
    lanes, at, left, who = _lanes(buf), start, end - start, None
    out = held = mix(left.astype(np.uint64) * BASE + U64(seed))
    while len(at):
        held = mix((held ^ (lanes[at] & _LANE[np.minimum(left, 8)])) * BASE)
        if who is None:
            out = held
        else:
            out[who] = held
        more = np.flatnonzero(left > 8)  # what is longer goes on
        who = more if who is None else who[more]
        at, left, held = at[more] + 8, left[more] - 8, held[more]
    return out


def names_of_length(buf: np.ndarray, k: int) -> np.ndarray:
    """Names of all substrings of k bytes, by start: exact up to 8 bytes, else polynomials modulo 2**64."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 8:
        return mix((_lanes(buf)[:n] & _LANE[k]) + U64(k))
    ahead, back = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * ahead[: len(buf)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * back[:n])


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, per-document bounds) of the words between white space; words never cross documents."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    begins = ink & cut[:-1]
    begins[1:] |= ink[1:] & ~ink[:-1]
    ends = ink & cut[1:]
    ends[:-1] |= ink[:-1] & ~ink[1:]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def runs_of(names: np.ndarray, k: int) -> np.ndarray:
    """Names of all runs of k consecutive names, by start (also of those that cross documents)."""
    n = len(names) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= BASE
        out += names[i : i + n]
    return mix(out + U64(k))


def window_minimum(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of keys[i : i + w] for every i at which the window fits."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.empty(0, keys.dtype)
    pad = -len(keys) % w
    full = np.concatenate([keys, np.full(pad, np.iinfo(keys.dtype).max, keys.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def spread(lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """low, low + 1, ... (count of them) for each pair, in one array."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    keep = counts > 0
    lows, counts = lows[keep], counts[keep]
    if not total:
        return out
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out[at] = lows - np.concatenate([[0], (lows + counts - 1)[:-1]])
    return np.cumsum(out)
