"""Ranked lexical search: an index of postings by windows of documents, scored a window at a time.

`write_index` cuts each task's documents into windows of a fixed number of consecutive ones and writes a row for each:
its documents, their lengths, and its postings sorted by term. `search` reads the windows. For each item it adds the
terms' contributions into one array as long as a window, marks the blocks that were touched in a bitset, harvests
the touched documents that can still enter into the item's heap, and clears what it touched. A task keeps the best few for each
item, and these meet in two levels. Items go to the workers in blocks of bounded size.
"""

from __future__ import annotations

import contextlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import text as T

#: Documents in a window: an array of their scores is 64 KB.
WINDOW = 8192
#: Bytes of text after which a window ends early, so that its postings stay small; a longer text has a window of its own.
WINDOW_BYTES = 8 << 20
#: Index rows that a worker gets at a time.
ROWS_AT_ONCE = 8
#: Different terms and uses of terms in a block of items, at most (an item with more is alone).
BLOCK_USES = 200_000
BEST = 10
#: Length normalisation in hundredths, and what a frequency is multiplied by.
FLAT, SLOPE, LIFT = 25, 75, 1_000_000_000

_INDEX = "ids binary, lengths binary, terms binary, ends binary, docs binary, counts binary"
_NULL = np.iinfo(np.int64).max


def _terms(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first term of each row and one entry more)."""
    _, _, h, own = T.word_table(buf, starts, ends, lower=True, between=T.IS_GAP)
    return h, own


class _Window:
    """Postings of consecutive documents, until they fill a row of the index."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.hashes, self.docs, self.counts, self.n, self.size = [], [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, h: np.ndarray, own: np.ndarray, size: int) -> None:
        n = np.diff(own)
        doc = np.repeat(np.arange(len(ids)), n)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.ids.append(ids)
        self.lengths.append(n)
        self.hashes.append(h[at])
        self.docs.append((doc[at] + self.n).astype(np.uint16))
        self.counts.append(np.diff(np.append(at, len(h))).astype(np.uint32))
        self.n += len(ids)
        self.size += size

    def row(self) -> pa.RecordBatch:
        h, docs, counts = (np.concatenate(x) for x in (self.hashes, self.docs, self.counts))
        order = np.argsort(h, kind="stable")  # documents stay in order within a term
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        ends = np.append(first[1:], len(h))[: len(first)].astype(np.uint32)
        arrays = [np.concatenate(self.ids), np.concatenate(self.lengths).astype(np.int64), h[first], ends, docs[order], counts[order]]
        names = [x.split()[0] for x in _INDEX.split(", ")]
        return pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)


def _index(batches: Iterator[pa.RecordBatch], most: int = WINDOW, most_bytes: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    window = _Window()
    for batch in batches:
        ids = T.numbers(batch.column(0), _NULL)
        buf, starts, ends = T.text_bytes(batch.column(1))
        for lo, hi in T.slices(starts, ends, most_bytes // 4 + 1):
            a, b = int(starts[lo]), int(ends[hi - 1])
            h, own = _terms(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
            at = 0
            while at < hi - lo:
                if window.n == most or window.size >= most_bytes:
                    yield window.row()
                    window = _Window()
                to = min(hi - lo, at + most - window.n)
                window.add(ids[lo + at : lo + to], h[own[at] : own[to]], own[at : to + 1] - own[at], int(ends[lo + to - 1] - starts[lo + at]))
                at = to
    if window.n:
        yield window.row()


def write_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The index of all documents, a row for each window, as a table in the shared folder.

    A window is `window` consecutive documents of a task, 65,536 at most, or fewer where their texts are long. The id column must be a whole number. Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased,
    told apart by 64-bit hashes. Null and empty texts have no term; rows with equal or null ids are documents of their own; very
    long texts are indexed whole; other columns are ignored; an empty table gives an empty index.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return X.keep(X.arrow(rows, lambda batches: _index(batches, window), _INDEX), "postings")


@contextlib.contextmanager
def _few_rows_at_once(spark: SparkSession):
    """Index rows are of megabytes: workers get a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, ROWS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _column(batch: pa.RecordBatch, name: str, row: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind)


def _statistics(wanted):
    """Documents with a term, all terms, and for each wanted term the documents that hold it, by task."""

    def run(batches):
        terms = wanted.value
        documents, words, df = 0, 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                lengths = _column(batch, "lengths", row, np.int64)
                documents += int((lengths > 0).sum())
                words += int(lengths.sum())
                have, ends = _column(batch, "terms", row, np.uint64), _column(batch, "ends", row, np.uint32).astype(np.int64)
                at, found = _find(have, terms)
                df[found] += (ends - np.append(0, ends[:-1])[: len(ends)])[at]
        some = np.flatnonzero(df)
        term = np.append(some, -1).astype(np.int32)  # the last row tells of the documents
        yield pa.record_batch([pa.array(term), pa.array(np.append(df[some], documents)), pa.array(np.append(np.zeros(len(some), np.int64), words))], names=["term", "n", "words"])

    return run


def _find(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in `have`, numbers of the wanted terms found there); both arrays are sorted."""
    at = np.minimum(np.searchsorted(have, wanted), max(len(have) - 1, 0))
    found = np.flatnonzero(have[at] == wanted) if len(have) else np.empty(0, np.int64)
    return at[found], found


def _score(asked, best: int):
    """Rows (item, score, id): for each item the best documents of a task's windows."""

    def run(batches):
        terms, weight, item_ends, item_terms, repeats, norm = asked.value
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in item_ends]
        scores = np.zeros(WINDOW, np.int64)
        touched = np.zeros(WINDOW // 64, bool)  # one bit for each 64 documents
        number = 0
        for batch in batches:
            for row in range(len(batch)):
                ids, lengths = _column(batch, "ids", row, np.int64), _column(batch, "lengths", row, np.int64)
                if len(ids) > len(scores):
                    scores, touched = np.zeros(-(-len(ids) // 64) * 64, np.int64), np.zeros(-(-len(ids) // 64), bool)
                have, ends = _column(batch, "terms", row, np.uint64), _column(batch, "ends", row, np.uint32).astype(np.int64)
                docs, counts = _column(batch, "docs", row, np.uint16), _column(batch, "counts", row, np.uint32)
                at, found = _find(have, terms)
                slot = np.full(len(terms), -1, np.int64)
                slot[found] = np.arange(len(found))
                spread = (100 - SLOPE) + SLOPE * lengths * norm[0] // norm[1]
                given = []
                for place, term in zip(at.tolist(), found.tolist(), strict=True):
                    lo, hi = int(ends[place - 1]) if place else 0, int(ends[place])
                    own, tf = docs[lo:hi].astype(np.int64), counts[lo:hi].astype(np.int64)
                    given.append((own, weight[term] * (LIFT * tf // (1000 * tf + 8 * spread[own]))))
                first = 0
                for item, end in enumerate(item_ends.tolist()):
                    for k in range(first, end):
                        s = slot[item_terms[k]]
                        if s >= 0:
                            own, points = given[s]
                            scores[own] += points * repeats[k]  # a term has a document once
                            touched[own >> 6] = True
                    first = end
                    _harvest(scores, touched, ids, number, heaps[item], best)
                    touched[:] = False
                number += len(ids)
        out = [(item, *x) for item, heap in enumerate(heaps) for x in heap]
        if out:
            item, score, minus, _ = (np.array(x, np.int64) for x in zip(*out, strict=True))
            yield pa.record_batch([pa.array(item), pa.array(score), pa.array(-minus, mask=minus == -_NULL), pa.array(np.full(len(item), TaskContext.get().partitionId(), np.int32))], names=["item", "score", "id", "task"])

    return run


def _harvest(scores: np.ndarray, touched: np.ndarray, ids: np.ndarray, number: int, heap: list, best: int) -> None:
    """Push the touched documents that beat the heap's least; clear their scores."""
    blocks = np.flatnonzero(touched)
    if not len(blocks):
        return
    own = ((blocks << 6)[:, None] + np.arange(64)).ravel()
    got = scores[own]
    scores[own] = 0
    least = heap[0][0] if len(heap) == best else 1
    able = np.flatnonzero(got >= max(least, 1))
    if len(able) > best:  # of many, those of the best scores, equal ones by id
        able = able[np.lexsort((ids[own[able]], -got[able]))[:best]]
    for i in able.tolist():
        entry = (int(got[i]), -int(ids[own[i]]), -(number + int(own[i])))
        if len(heap) < best:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)


def _best(rows: DataFrame, by: list, best: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _blocks(items: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of `number`, so that each block of items has about BLOCK_USES uses of terms."""
    size = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 2)  # a term and what ends it are two bytes at least
    # blocks by running sums over parts of the numbers, of which there is one a task
    parts = items.groupBy(F.shiftright("number", 33).alias("part")).agg(F.sum(size).alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    run = F.sum(size).over(Window.partitionBy(F.shiftright("number", 33)).orderBy("number")) - size
    placed = items.select("number", F.shiftright("number", 33).alias("part"), run.alias("run")).join(before, "part")
    cut = placed.groupBy(F.floor((F.col("before") + F.col("run")) / BLOCK_USES).alias("block")).agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    for r in cut.orderBy("block").toLocalIterator():
        yield r["lo"], r["hi"]


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item with a score above 0, equal scores by id.

    `index` is a table of `write_index`. A null or empty item has no term and no row; items with equal or null ids are
    items of their own; a document without an id comes after others of its score; repeated documents are ranked each. An
    item's terms count as often as they occur. Empty tables give no rows; other columns are ignored.

    Items are taken in blocks whose terms are at most BLOCK_USES (a longer item is alone); each block goes through the
    index twice, for its terms' frequencies and for the scores, and its broadcasts are destroyed before the next block.
    """
    spark = index.sparkSession
    asked = X.keep(items.select(F.monotonically_increasing_id().alias("number"), F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")), "items")
    out = []
    for lo, hi in _blocks(asked):
        block = asked.where((F.col("number") >= lo) & (F.col("number") <= hi))
        rows = block.select("number", "text").orderBy("number").toArrow().combine_chunks()
        numbers = rows.column("number").to_numpy()
        h, own = _terms(*T.text_bytes(rows.column("text")))
        item = np.repeat(np.arange(len(numbers)), np.diff(own))
        terms, which = np.unique(h, return_inverse=True)
        uses, repeats = np.unique(item * max(len(terms), 1) + which, return_counts=True)
        out.append(_search_block(spark, index, numbers, terms, uses, repeats, best))
    if not out:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    rows = out[0]
    for other in out[1:]:
        rows = rows.unionByName(other)
    found = rows.join(asked.select("number", "item_id"), "number")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def _search_block(spark: SparkSession, index: DataFrame, numbers: np.ndarray, terms: np.ndarray, uses: np.ndarray, repeats: np.ndarray, best: int) -> DataFrame:
    """(number, rank, id, score) of the items of one block."""
    context = spark.sparkContext
    wanted = context.broadcast(terms)
    with _few_rows_at_once(spark):
        counted = X.arrow(index.select("lengths", "terms", "ends"), _statistics(wanted), "term int, n long, words long")
        counts = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()  # one row a term of the block
    wanted.destroy()
    whole = next((r for r in counts if r["term"] == -1), None)
    documents, words = (whole["n"], whole["words"]) if whole else (0, 0)
    df = {r["term"]: r["n"] for r in counts}
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    item, item_terms = np.divmod(uses, max(len(terms), 1))
    item_ends = np.searchsorted(item, np.arange(len(numbers)), side="right")
    asked = context.broadcast((terms, weight, item_ends, item_terms, repeats.astype(np.int64), (documents, max(words, 1))))
    with _few_rows_at_once(spark):
        found = X.arrow(index, _score(asked, best), "item long, score long, id long, task int")
        groups = F.pmod("task", F.lit(max(1, math.isqrt(X.reducers(index)))))
        ranked = _best(_best(found.withColumn("some", groups), ["item", "some"], best).drop("rank"), ["item"], best)
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(numbers))), "number": pa.array(numbers)}))
        kept = X.keep(ranked.join(names, "item").select("number", "rank", "id", "score"), "ranked")
    asked.destroy()
    return kept


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item; nulls, repeats, ties and empty tables as in `search`."""
    index = write_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id,
             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT i, item_id, term, count(*) AS uses
      FROM (SELECT row_number() OVER () AS i, item_id,
              unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
n AS MATERIALIZED (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY d),
c AS (SELECT count(*) AS n_docs, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_terms FROM n),
p AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT i, item_id, p.d, CAST(sum(uses * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (d), c GROUP BY i, item_id, p.d),
r AS (SELECT i, item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
      FROM s JOIN n USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
