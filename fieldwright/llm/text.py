"""Vectorised views of Arrow text columns: bytes, words, rolling hashes and windows.

Everything here works on one Arrow batch at a time and on pieces of about a
megabyte, so memory follows the piece and not the table. Null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Pieces of this many units are hashed at once.
PIECE = 1 << 19
BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_INV = pow(BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240517))
#: One random odd number for each byte; the lower-casing table gives A-Z the numbers of a-z.
BYTE_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = BYTE_TABLE[97:123]
#: Bytes between terms: ASCII that is neither a digit nor a letter.
IS_GAP = np.ones(256, bool)
IS_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: White space that separates words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 8192)
        out = np.empty(size, np.uint64)
        out[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            out[filled : filled + step] = out[:step] * U(pow(base, filled, 1 << 64))
            filled += step
        _powers[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts and ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    wide = np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    buf = buf[at[0] : at[-1]]
    starts, ends = at[:-1] - at[0], at[1:] - at[0]
    if column.null_count:
        ends = np.where(np.asarray(column.is_valid()), ends, starts)
    return buf, starts, ends


def numbers(column: pa.Array, missing: int = -1) -> np.ndarray:
    """A whole-number column as int64; nulls become `missing`."""
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def word_table(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, between: np.ndarray | None = None):
    """Words of each row: their first byte, end, 64-bit hash, and each row's first word (one more entry than rows).

    Words are maximal runs of bytes other than those `between` marks (0x20 and 0x09-0x0D) and never cross rows.
    """
    between = IS_SPACE if between is None else between
    table = LOWER_TABLE if lower else BYTE_TABLE
    edge = np.zeros(len(buf) + 1, bool)
    edge[starts] = True
    edge[ends] = True
    at, to, hs = [], [], []
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(n, lo + PIECE)
        if hi < n:  # end the piece where a word ends
            back = np.flatnonzero(between[buf[max(lo, hi - 4096) : hi]] | edge[max(lo, hi - 4096) + 1 : hi + 1])
            if len(back):
                hi = max(lo, hi - 4096) + int(back[-1]) + 1
            else:
                while hi < n and not (between[buf[hi - 1]] or edge[hi]):
                    hi = min(n, hi + 4096)
                    cut = np.flatnonzero(between[buf[hi - 4096 : hi]] | edge[hi - 4095 : hi + 1])
                    if len(cut):
                        hi = hi - 4096 + int(cut[0]) + 1
                        break
        piece = buf[lo:hi]
        solid = ~between[piece]
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[lo + 1 : hi]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[lo + 1 : hi]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.empty(len(piece) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[piece] * _power(BASE, len(piece)), out=total[1:])
        h = (total[e] - total[s]) * _power(_INV, len(piece) + 1)[s]
        hs.append(mix(h + (e - s).astype(np.uint64)))
        at.append(s + lo)
        to.append(e + lo)
        lo = hi
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(starts) + 1, np.int64)
    ws, we, wh = np.concatenate(at), np.concatenate(to), np.concatenate(hs)
    own = np.empty(len(starts) + 1, np.int64)
    own[:-1] = np.searchsorted(ws, starts)
    own[-1] = len(ws)
    if np.any(ends[:-1] > starts[1:]) or (len(ends) and own[-1] != np.searchsorted(ws, ends[-1])):
        keep = np.searchsorted(ws, ends)  # rows that were made empty own none of their bytes
        mask = np.zeros(len(ws) + 1, np.int64)
        np.add.at(mask, own[:-1], 1)
        np.add.at(mask, np.maximum(keep, own[:-1]), -1)
        inside = np.cumsum(mask)[:-1] > 0
        counts = np.maximum(keep - own[:-1], 0)
        ws, we, wh = ws[inside], we[inside], wh[inside]
        own = np.concatenate([[0], np.cumsum(counts)])
    return ws, we, wh, own


def prefix(units: np.ndarray) -> np.ndarray:
    """Sums from which hash_spans makes the hash of any span of these units."""
    total = np.empty(len(units) + 1, np.uint64)
    total[0] = 0
    np.cumsum(units * _power(BASE, len(units)), out=total[1:])
    return total


def hash_spans(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix((total[hi] - total[lo]) * _power(_INV, len(total))[lo] + (hi - lo).astype(np.uint64))


def hash_windows(total: np.ndarray, q: int) -> np.ndarray:
    """The hash of each window of q units; equal to hash_spans of the same windows."""
    n = len(total) - q
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((total[q:] - total[:-q]) * _power(_INV, len(total))[:n] + U(q))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each window of w values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def slices(starts: np.ndarray, ends: np.ndarray, most: int = 4 << 20):
    """Ranges of rows whose bytes are about `most` together; a longer row is alone."""
    if not len(starts):
        return
    used = np.cumsum(ends - starts)
    lo, base = 0, 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(used, base + most, side="right")))
        yield lo, hi
        base, lo = int(used[hi - 1]), hi
