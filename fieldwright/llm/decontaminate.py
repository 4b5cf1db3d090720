"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words at its ones are hashed,
those at its zeros ignored, so a hit survives substitutions at the zeros. Seeds of
all benchmark items and of all documents are joined; around each hit the item is
laid over the document and an overlap counts if enough of its words agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import text as T

MASKS = ("110110111", "101101111", "111010011")
#: An overlap has at least WINDOW words (the whole item, if that is shorter), PERCENT of which agree at their places.
WINDOW = 13
PERCENT = 80
#: Bytes of benchmark text that are sent to the workers at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20
#: Masks besides MASKS, by the words of an overlap (more than WINDOW count as WINDOW): together they leave a hit for each
#: pattern of substitutions that PERCENT allows.
MORE = {
    5: ("11101", "1111", "11011", "10111"), 6: ("10111", "11101"), 7: ("111101", "110111", "1011101"), 8: ("111011", "1011101"), 9: ("1111101",),
    10: ("1110101", "1001111"), 11: ("11011101", "1100011011"), 12: ("110011101",), 13: ("1110000101011",),
}
#: Beyond so many patterns masks aren't tried on each, and a run of words is sought besides.
PATTERNS = 20_000


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            total += h[j : j + n] * np.uint64(pow(T.BASE, j + 1, 1 << 64))
    return T.mix(total)


def _complete(size: int, changes: int, masks: list[str]) -> bool:
    """Whether each pattern of `changes` substitutions in `size` words leaves a hit of one of the masks."""
    ones = {sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in masks for at in range(size - len(m) + 1)}
    return all(any(not w & o for o in ones) for w in (sum(1 << i for i in c) for c in combinations(range(size), changes)))


def seeds(size: int, changes: int, masks: tuple[str, ...] = MASKS) -> list[str]:
    """The masks by which overlaps of `size` words with up to `changes` substitutions are sought; none is missed."""
    out = [m for m in dict.fromkeys((*masks, *MORE.get(min(size, WINDOW), ()))) if len(m) <= size]
    if comb(size, changes) > PATTERNS or not _complete(size, changes, out):
        out.append("1" * max(1, -(-(size - changes) // (changes + 1))))  # so many words in a row always agree
    return out


class Index:
    """Seeds of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], window: int = WINDOW, percent: int = PERCENT):
        column = pa.array([t or "" for _, t in items], pa.string())
        _, _, self.words, own = T.word_table(*T.text_bytes(column), lower=True)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.at, self.size = own[:-1], np.diff(own)
        self.tables = []
        item = np.repeat(np.arange(len(items)), self.size)
        due = np.minimum(self.size, window)  # words of an overlap
        uses: dict[str, list[int]] = {}
        for n in np.unique(due[due > 0]).tolist():
            for mask in seeds(n, n + -percent * n // 100, masks):
                uses.setdefault(mask, []).append(n)
        for mask, sizes in uses.items():
            g = _masked(self.words, mask)
            ok = (item[: len(g)] == item[len(mask) - 1 :][: len(g)]) & np.isin(due, sizes)[item[: len(g)]]
            p = np.flatnonzero(ok)
            self.tables.append((mask, *self._sorted(g[p], item[p], p - self.at[item[p]])))

    @staticmethod
    def _sorted(h, item, place):
        o = np.argsort(h, kind="stable")
        h = h[o]
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return h, item[o], place[o], seen

    def hits(self, words: np.ndarray, row: np.ndarray):
        """(place in words, item, item's place) of every seed hit within a row."""
        out = []
        for mask, h, item, place, seen in self.tables:
            g, span = _masked(words, mask), len(mask)
            if not len(g) or not len(h):
                continue
            p = np.flatnonzero(seen[(g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            p = p[row[p] == row[p + span - 1]]
            lo, hi = np.searchsorted(h, g[p]), np.searchsorted(h, g[p], side="right")
            n = hi - lo
            src = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(p, n), item[src], place[src]))
        if not out:
            z = np.empty(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def overlaps(self, words: np.ndarray, own: np.ndarray, window: int, percent: int):
        """Verified overlaps: (row, item, first word in the row, words, words that agree)."""
        row = np.repeat(np.arange(len(own) - 1), np.diff(own))
        p, item, place = self.hits(words, row)
        if not len(p):
            return (np.empty(0, np.int64),) * 5
        key = np.unique(np.stack([row[p], item, p - place], 1), axis=0)  # one candidate for each alignment
        r, item, start = key[:, 0], key[:, 1], key[:, 2]
        n = self.size[item]
        at = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(at, n)
        w = np.repeat(start, n) + inner
        inside = (w >= np.repeat(own[r], n)) & (w < np.repeat(own[r + 1], n))
        same = inside & (words[np.where(inside, w, 0)] == self.words[np.repeat(self.at[item], n) + inner])
        agree = np.concatenate([[0], np.cumsum(same)])
        there = np.concatenate([[0], np.cumsum(inside)])
        size = np.minimum(n, window)
        # windows of the laid-over item that are in the document as a whole and agree well enough
        windows = n - size + 1
        src = np.repeat(np.arange(len(n)), windows)
        t = at[src] + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        z = size[src]
        good = (there[t + z] - there[t] == z) & (100 * (agree[t + z] - agree[t]) >= percent * z)
        src, t, z = src[good], t[good], z[good]
        if not len(src):
            return (np.empty(0, np.int64),) * 5
        first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        c = src[first]
        lo = np.minimum.reduceat(t, first)
        hi = np.maximum.reduceat(t + z, first)
        return r[c], item[c], start[c] + lo - at[c] - own[r[c]], hi - lo, agree[hi] - agree[lo]


_SCHEMA = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("items", pa.list_(pa.int64())), ("begins", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("agree", pa.list_(pa.int64()))])
_DDL = "doc long, key long, items array<long>, begins array<long>, lengths array<long>, agree array<long>"


def _search(shared, window: int, percent: int):
    def run(batches):
        index = shared.value
        for batch in batches:
            buf, starts, ends = T.text_bytes(batch.column(1))
            for lo, hi in T.slices(starts, ends):
                a, b = starts[lo], ends[hi - 1]
                _, _, h, own = T.word_table(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a, lower=True)
                r, item, begin, n, agree = index.overlaps(h, own, window, percent)
                o = np.lexsort((begin, index.ids[item] if len(item) else item, r))
                offsets = pa.array(np.searchsorted(r[o], np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[o].astype(np.int64))) for x in (index.ids[item] if len(item) else item, begin, n, agree)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *lists], schema=_SCHEMA)

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, percent: int = PERCENT) -> Iterator:
    """Broadcast indexes of the benchmark, one for each BLOCK_BYTES of it."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).orderBy("i", "t").collect()  # about BLOCK_BYTES
        yield spark.sparkContext.broadcast(Index([(r["i"] if r["i"] is not None else -1, r["t"]) for r in part], masks, window, percent))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, percent: int = PERCENT, **items) -> list[DataFrame]:
    """For each block of the benchmark: a row for each row of `docs`, with its id (as `doc`), a hash of its text (as `key`)
    and its verified overlaps."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    return [X.arrow(rows, _search(shared, window, percent), _DDL) for shared in benchmark_blocks(benchmark, window=window, percent=percent, **items)]


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, percent: int = PERCENT, **items) -> DataFrame:
    """The rows of `docs` without a verified overlap, with all their columns; each block of the benchmark takes its own away.

    Rows are judged each by their own text, whatever their ids: null and empty texts stay, repeated rows stay or go alike,
    very long texts are searched whole; an empty table gives no rows, an empty benchmark all.
    """
    at = docs.columns.index(text_col)

    def cleaner(search):
        def run(batches):
            for batch in batches:
                none = pa.nulls(batch.num_rows, pa.int64())
                pair = pa.record_batch([none, batch.column(at), none], names=["doc", "text", "key"])
                clean = [n == 0 for part in search([pair]) for n in part.column("items").value_lengths().to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for shared in benchmark_blocks(benchmark, window=window, percent=percent, **items):
        docs = X.arrow(docs, cleaner(_search(shared, window, percent)), docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """A row for each row of `docs`: doc_id, contaminated, n_overlaps, longest (words), n_items and items (sorted ids).

    Words are compared with A-Z lower-cased. A document is contaminated if one of its overlaps with an item is verified:
    at least WINDOW words of the item in a row (all of a shorter one) of which PERCENT agree at their places.

    Null and empty texts and items have no overlaps; an item of any number of words counts, if PERCENT of it agree (all of
    one to four words); equal items each count; repeated rows, and rows of one id with different texts, each get their own row; null ids stay null (null item ids are
    -1). Other columns are ignored, whatever their names.
    """
    found = find_overlaps(docs, benchmark, id_col, text_col, **how)
    if len(found) > 1:
        # rows of one id and one text have the same overlaps: each block's once, then all blocks' together, for each such row
        lists = ("items", "begins", "lengths", "agree")
        every = found[0].withColumn("block", F.lit(0))
        for i, one in enumerate(found[1:], 1):
            every = every.unionByName(one.withColumn("block", F.lit(i)))
        once = every.groupBy("block", "doc", "key").agg(F.first(F.struct(*lists)).alias("l"), F.count("*").alias("rows"))
        whole = once.groupBy("doc", "key").agg(*[F.flatten(F.collect_list(f"l.{c}")).alias(c) for c in lists], F.first("rows").alias("rows"))
        found = [whole.select("doc", *lists, F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))]
    return found[0].select(
        F.col("doc").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_overlaps"),
        F.coalesce(F.array_max("lengths"), F.lit(0)).alias("longest"), F.size(F.array_distinct("items")).cast("long").alias("n_items"),
        F.array_sort(F.array_distinct("items")).alias("items"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its overlaps with the benchmark; nulls, repeats, ties and empty tables as in `decontaminate`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
