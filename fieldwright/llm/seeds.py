"""Finding windows of a fixed length that several documents share, through sampled anchors.

Both substring operators use this frame; they differ in their units (bytes or
words) and in how they refine a bucket (`refine`).

1. Every window of `length` units selects its anchor: the q-gram of least hash
   in it, leftmost on ties. Equal windows select equal anchors, so windows can
   only be equal if their anchors are. Consecutive windows with one anchor form
   a run, kept as one entry (anchor hash, hash of the whole run, document, place).
2. Entries meet by anchor hash. An anchor in one document only is done with. A
   run that equals a run of a smaller document is a repeat as a whole. What is
   left (runs with one anchor but other surroundings) is asked for with its units.
3. The units of those runs meet by anchor, and `refine` finds the windows among
   them that a smaller document has too.

Entries that one map task sees twice leave it once, with the least document, so
a passage in a third of all documents sends one entry a task. A bucket with very
many different runs is dealt again by the content of single windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import text as T

#: An anchor with more different runs than this is dealt again by window content.
WIDE = 20_000
_LOW = np.uint64((1 << 20) - 1)


@dataclass(frozen=True)
class Shape:
    """length: units in a window; q: units in an anchor; units(buf, starts, ends) -> (units, first unit of each row and one more)."""

    length: int
    q: int
    units: Callable


@dataclass
class Runs:
    row: np.ndarray  # the row of the batch
    first: np.ndarray  # the first window's start, in its document
    more: np.ndarray  # further windows
    lead: np.ndarray  # from the first window's start to the anchor
    anchor: np.ndarray  # hash
    whole: np.ndarray  # hash of all units that the run covers


def find_runs(units: np.ndarray, own: np.ndarray, length: int, q: int) -> Runs:
    """Runs of windows with one anchor. own: the first unit of each row, and one more entry."""
    n, w = len(units), length - q + 1
    parts = []
    rows = np.repeat(np.arange(len(own) - 1, dtype=np.int32), np.diff(own)) if n else np.empty(0, np.int32)
    for lo in range(0, max(0, n - length + 1), T.PIECE):
        hi = min(n, lo + T.PIECE + length - 1)
        total = T.prefix(units[lo:hi])
        g = T.hash_windows(total, q)
        least = T.sliding_min((g & ~_LOW) | np.arange(len(g), dtype=np.uint64), w)
        row = rows[lo:hi]
        good = row[: len(least)] == row[length - 1 :]
        change = np.empty(len(least), bool)
        change[0] = True
        change[1:] = (least[1:] != least[:-1]) | (good[1:] != good[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
        at = np.flatnonzero(change)
        end = np.append(at[1:], len(least))
        at, end = at[good[at]], end[good[at]]
        p = (least[at] & _LOW).astype(np.int64)
        lead = p - at
        whole = T.hash_spans(total, at, end + (length - 1))
        whole = T.mix(whole + lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        r = row[at]
        parts.append((r, at + lo - own[r], end - at - 1, lead, g[p], whole))
    if not parts:
        z = np.empty(0, np.int64)
        return Runs(z, z, z, z, z.astype(np.uint64), z.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted key columns."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(at: np.ndarray, total: int, values: np.ndarray) -> np.ndarray:
    """Each group's value for each of its members."""
    return np.repeat(values, np.diff(np.append(at, total)))


RUN_DDL = "doc long, key long, first int, more int, lead int, anchor long, ask int"
_RUN = pa.schema(
    [("doc", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("more", pa.int32()), ("lead", pa.int32()), ("anchor", pa.int64()), ("ask", pa.int32())]
)


def _run_batches(doc, key, first, more, lead, anchor, ask, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(doc), most):
        s = slice(lo, lo + most)
        yield pa.record_batch(
            [
                pa.array(doc[s]),
                pa.array(key[s]),
                pa.array(first[s].astype(np.int32)),
                pa.array(more[s].astype(np.int32)),
                pa.array(lead[s].astype(np.int32)),
                pa.array(anchor[s].view(np.int64) if anchor.dtype == np.uint64 else anchor[s]),
                pa.array(np.broadcast_to(np.asarray(ask, np.int32), len(doc))[s].copy()),
            ],
            schema=_RUN,
        )


def _find(shape: Shape, keys: np.ndarray):
    n = len(keys)

    def run(batches):
        for batch in batches:
            doc, text_key = T.numbers(batch.column(0)), T.numbers(batch.column(2))
            buf, starts, ends = T.text_bytes(batch.column(1))
            rows: list[tuple[int, int, bytes]] = []
            parts = []
            for lo, hi in T.slices(starts, ends):
                a, b = starts[lo], ends[hi - 1]
                units, own = shape.units(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
                r = find_runs(units, own, shape.length, shape.q)
                parts.append((doc[lo:hi][r.row], text_key[lo:hi][r.row], r.first, r.more, r.lead, r.anchor >> np.uint64(16), r.whole >> np.uint64(16)))
            if not parts:
                continue
            d, key, first, more, lead, h, f = (np.concatenate(x) for x in zip(*parts, strict=True))
            # a run that a smaller document of this batch has: known here, and sent on as such
            order = np.lexsort((d, f, h))
            d, key, first, more, lead, h, f = (x[order] for x in (d, key, first, more, lead, h, f))
            at = groups(h, f)
            least = _spread(at, len(d), d[at])
            known = d > least
            if known.any():
                k = np.flatnonzero(known)
                bucket = (T.mix(d[k].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
                o, cut = X.split_by(bucket, n)
                for b in np.flatnonzero(np.diff(cut)):
                    i = k[o[cut[b] : cut[b + 1]]]
                    i = i[np.lexsort((first[i], key[i], d[i]))]
                    g = groups(d[i], key[i])
                    rows.append((int(keys[b]), 1, X.pack(d[i][g], key[i][g], np.diff(np.append(g, len(i))).astype(np.uint32), first[i].astype(np.uint32), more[i].astype(np.uint16))))
            # an anchor that two documents of this batch have is shared, whoever else has it
            k = np.flatnonzero(~known)
            d, key, first, more, lead, h, f = (x[k] for x in (d, key, first, more, lead, h, f))
            bucket = (h % np.uint64(n)).astype(np.int64)
            o, cut = X.split_by(bucket, n)
            for b in np.flatnonzero(np.diff(cut)):
                i = o[cut[b] : cut[b + 1]]
                i = i[np.lexsort((first[i], key[i], d[i]))]
                g = groups(d[i], key[i])
                at = first[i].astype(np.uint32)
                rows.append(
                    (
                        int(keys[b]),
                        0,
                        X.pack(
                            d[i][g], key[i][g], np.diff(np.append(g, len(i))).astype(np.uint32),
                            (at & np.uint32(0xFFFF)).astype(np.uint16), (at >> np.uint32(16)).astype(np.uint16),
                            more[i].astype(np.uint8 if shape.length < 256 else np.uint16), lead[i].astype(np.uint8 if shape.length < 256 else np.uint16),
                            *X.squeeze(h[i] << np.uint64(16)), *X.squeeze(f[i] << np.uint64(16)),
                        ),
                    )
                )
            yield from X.block_batches(rows)

    return run


def _meet(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    parts = []
    for kind, block in blocks:
        x = X.unpack(block)
        if kind == 1:
            d = np.repeat(x[0], x[2])
            zero = np.zeros(len(d), np.int64)
            yield from _run_batches(d, np.repeat(x[1], x[2]), x[3].astype(np.int64), x[4], zero, zero, 0)
        else:
            parts.append((np.repeat(x[0], x[2]), np.repeat(x[1], x[2]), x[3].astype(np.int64) | (x[4].astype(np.int64) << 16), x[5].astype(np.int32), x[6].astype(np.int32), X.unsqueeze(x[7], x[8]), X.unsqueeze(x[9], x[10])))
    if not parts:
        return
    d, key, first, more, lead, h, f = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # only anchors of more than one entry matter
    o = np.argsort(h)
    hs = h[o]
    at = groups(hs)
    sizes = np.diff(np.append(at, len(hs)))
    o = o[np.repeat(sizes > 1, sizes)]
    d, key, first, more, lead, h, f = (x[o] for x in (d, key, first, more, lead, h, f))
    if not len(d):
        return
    o = np.lexsort((d, f, h))
    d, key, first, more, lead, h, f = (x[o] for x in (d, key, first, more, lead, h, f))
    at = groups(h)
    least_all = _spread(at, len(d), np.minimum.reduceat(d, at))
    most_all = _spread(at, len(d), np.maximum.reduceat(d, at))
    same = groups(h, f)
    least = _spread(same, len(d), d[same])
    kinds = np.diff(np.append(np.searchsorted(same, at), len(same)))
    several = _spread(at, len(d), kinds)
    shared = least_all < most_all
    done = shared & (d > least)
    zero = np.zeros(len(d), np.int64)
    yield from _run_batches(d[done], key[done], first[done], more[done], zero[done], zero[done], 0)
    # others of the anchor: all occurrences in the least document of each run; only one where nothing smaller exists
    ask = shared & (d == least) & (several > 1)
    opening = np.zeros(len(d), bool)
    opening[same] = True
    ask &= (least > least_all) | opening
    how = np.where(several > WIDE, 2, 1)
    yield from _run_batches(d[ask], key[ask], first[ask], more[ask], lead[ask], h[ask].astype(np.int64), how[ask])


def _fetch(shape: Shape, keys: np.ndarray):
    """For each asked run: its units, to the bucket of its anchor (or of each window's content, where the anchor is a wide one)."""
    n = len(keys)

    def run(batches):
        for batch in batches:
            doc, text_key = T.numbers(batch.column(0)), T.numbers(batch.column(2))
            buf, starts, ends = T.text_bytes(batch.column(1))
            asked = batch.column(3)
            lists = asked.flatten()
            count = np.asarray(asked.value_lengths().fill_null(0))
            upto = np.concatenate([[0], np.cumsum(count)])
            first, more, lead, anchor, ask = (lists.field(k).to_numpy(zero_copy_only=False) for k in ("first", "more", "lead", "anchor", "ask"))
            rows = []
            for lo, hi in T.slices(starts, ends):
                a, b = starts[lo], ends[hi - 1]
                units, own = shape.units(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a, raw=True)
                s = slice(upto[lo], upto[hi])
                row = np.repeat(np.arange(hi - lo), count[lo:hi])
                f1, m1, l1, h1, k1 = first[s].astype(np.int64), more[s].astype(np.int64), lead[s].astype(np.int64), anchor[s].astype(np.uint64), ask[s]
                start = own[row] + f1
                wide = np.flatnonzero(k1 == 2)
                if len(wide):  # one entry for each window
                    times = m1[wide] + 1
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    src = np.repeat(wide, times)
                    ws = start[src] + step
                    content = T.hash_spans(T.prefix(units.astype(np.uint64) + np.uint64(1)), ws, ws + shape.length) >> np.uint64(16)
                    narrow = np.flatnonzero(k1 != 2)
                    row = np.concatenate([row[narrow], row[src]])
                    f1 = np.concatenate([f1[narrow], f1[src] + step])
                    l1 = np.concatenate([l1[narrow], np.zeros(len(src), np.int64)])
                    m1 = np.concatenate([m1[narrow], np.zeros(len(src), np.int64)])
                    h1 = np.concatenate([h1[narrow], content])
                    start = np.concatenate([start[narrow], ws])
                size = m1 + shape.length
                o, cut = X.split_by((h1 % np.uint64(n)).astype(np.int64), n)
                for b in np.flatnonzero(np.diff(cut)):
                    i = o[cut[b] : cut[b + 1]]
                    z = size[i]
                    inner = np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
                    rows.append((int(keys[b]), 0, X.pack(doc[lo:hi][row[i]], text_key[lo:hi][row[i]], f1[i].astype(np.uint32), m1[i].astype(np.uint16), l1[i].astype(np.uint16), h1[i], units[np.repeat(start[i], z) + inner])))
            yield from X.block_batches(rows)

    return run


def _refine(shape: Shape, refine: Callable):
    def run(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        d, key, first, more, lead, h, units = (np.concatenate(x) for x in zip(*(X.unpack(b) for _, b in blocks), strict=True))
        more, lead, first = more.astype(np.int64), lead.astype(np.int64), first.astype(np.int64)
        size = more + shape.length
        run_of, at = refine(shape.length, d, more, lead, h, units, np.cumsum(size) - size)
        if not len(run_of):
            return
        # neighbouring windows become one run again
        o = np.lexsort((at, run_of))
        run_of, at = run_of[o], at[o]
        new = np.ones(len(at), bool)
        new[1:] = (run_of[1:] != run_of[:-1]) | (at[1:] != at[:-1] + 1)
        g = np.flatnonzero(new)
        count = np.diff(np.append(g, len(at)))
        zero = np.zeros(len(g), np.int64)
        yield from _run_batches(d[run_of[g]], key[run_of[g]], first[run_of[g]] + at[g], count - 1, zero, zero, 0)

    return run


def repeated_runs(docs: DataFrame, shape: Shape, refine: Callable) -> DataFrame:
    """docs(doc long, text, key long) -> runs(doc, key, list of runs of windows that a smaller doc has too).

    Documents are compared by doc; rows are told apart by doc and key, a hash of the text, so that rows of one doc with
    different texts keep their own runs.
    """
    n = X.reducers(docs)
    keys = X.bucket_keys(n)
    found = X.arrow(docs, _find(shape, keys), X.BLOCKS_DDL)
    met = X.keep(X.reduce_blocks(found, n, _meet, RUN_DDL), "runs")
    asks = met.where("ask > 0").groupBy("doc", "key").agg(F.collect_list(F.struct("first", "more", "lead", "anchor", "ask")).alias("asked"))
    texts = docs.join(asks, ["doc", "key"]).select("doc", "text", "key", "asked")
    fetched = X.arrow(texts, _fetch(shape, keys), X.BLOCKS_DDL)
    refined = X.reduce_blocks(fetched, n, _refine(shape, refine), RUN_DDL)
    own = ("doc", "key", "first", "more")
    done = met.where("ask = 0").select(*own).unionByName(refined.select(*own))
    return done.groupBy("doc", "key").agg(F.collect_list(F.struct("first", "more")).alias("runs"))


def covered(starts: np.ndarray, ends: np.ndarray, runs: pa.Array, length: int, total: int) -> np.ndarray:
    """Which of `total` units the runs cover; row i owns units starts[i] to ends[i]."""
    mark = np.zeros(total + 1, np.int32)
    count = np.asarray(runs.value_lengths().fill_null(0))
    if count.sum():
        flat = runs.flatten()
        first = flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
        more = flat.field("more").to_numpy(zero_copy_only=False).astype(np.int64)
        lo = np.repeat(starts, count) + first
        hi = lo + more + length
        mark += np.bincount(lo, minlength=total + 1).astype(np.int32)
        mark -= np.bincount(hi, minlength=total + 1).astype(np.int32)
    return np.cumsum(mark[:-1]) > 0
