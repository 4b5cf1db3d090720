"""Substring dedup over words by seed and extend.

Seeds are winnowed word q-grams (`seeds`): documents meet at the anchors they
share. All runs that meet at one anchor are extended together, word by word, to
the left and to the right: after each step the runs that still agree form one
class. Two windows around the anchor are equal exactly if their runs agree on as
many words to either side as the windows reach, so the classes of a left and a
right extension give the class of a window. Windows whose class holds a smaller
document are repeats; together they are the maximal repeats of at least the
threshold. No pair of runs is ever formed, whatever the size of an anchor's group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import seeds as S
from fieldwright.llm import text as T
from fieldwright.llm.suffix_dedup import _with_runs

WORDS = 13
SEED = 6


def _words_as_units(buf, starts, ends, raw: bool = False):
    _, _, h, own = T.word_table(buf, starts, ends)
    return h, own


def extend_seeds(length: int, doc, more, lead, anchor, units, begin):
    """Windows of these runs that a smaller document has too: (run, window in the run)."""
    end = begin + more + length
    pin = begin + lead
    base = np.unique(anchor, return_inverse=True)[1].astype(np.int64)
    top = int(lead.max(initial=0))
    reach = length  # words from the anchor's first to the right

    def grow(cls, word_at, inside):
        """Classes after one more word; runs that end before it get classes of their own."""
        word = np.where(inside, units[np.where(inside, word_at, 0)], np.uint64(0))
        word_id = np.unique(word, return_inverse=True)[1].astype(np.int64)
        both = np.unique(cls * (word_id.max() + 1) + word_id, return_inverse=True)[1].astype(np.int64)
        return both

    left = [base]
    for k in range(1, top + 1):
        at = pin - k
        left.append(grow(left[-1], at, at >= begin))
    right = [base]
    for k in range(reach):
        at = pin + k
        right.append(grow(right[-1], at, at < end))
    runs, steps = [], []
    for back in range(top + 1):  # windows that begin `back` words left of the anchor
        has = np.flatnonzero((lead >= back) & (lead - back <= more))
        if not len(has):
            continue
        a, b = left[back][has], right[length - back][has]
        cls = np.unique(a * (b.max() + 1) + b, return_inverse=True)[1]
        least = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, doc[has])
        hit = has[doc[has] > least[cls]]
        runs.append(hit)
        steps.append(lead[hit] - back)
    if not runs:
        z = np.empty(0, np.int64)
        return z, z
    return np.concatenate(runs), np.concatenate(steps)


def _apply(length: int):
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, starts, ends = T.text_bytes(batch.column(1))
            for lo, hi in T.slices(starts, ends):
                a, b = int(starts[lo]), int(ends[hi - 1])
                piece = buf[a:b]
                ws, we, _, own = T.word_table(piece, starts[lo:hi] - a, ends[lo:hi] - a)
                gone = S.covered(own[:-1], own[1:], batch.column(2).slice(lo, hi - lo), length, len(ws))
                stay = np.flatnonzero(~gone)
                upto = np.concatenate([[0], np.cumsum(~gone)])
                # all kept words, each followed by one space
                size = we[stay] - ws[stay] + 1
                at = np.cumsum(size) - size
                src = np.repeat(ws[stay] - at, size) + np.arange(size.sum())
                text = np.append(piece, np.uint8(32))[np.minimum(src, len(piece))]
                if len(size):
                    text[at + size - 1] = 32
                text = text.tobytes()
                edge = np.append(at, len(text))
                k = upto[own]
                kept = [text[edge[i] : max(edge[j] - 1, edge[i])] for i, j in zip(k[:-1].tolist(), k[1:].tolist(), strict=True)]
                n = own[1:] - own[:-1]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(n), pa.array(n - (k[1:] - k[:-1])), pa.array(kept, pa.binary())], schema=schema)

    return run, "doc long, n_words long, n_removed long, kept binary"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Remove each word that a window of `words` words covers whose sequence also starts in a document of smaller id.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, compared unchanged by a 64-bit hash. Returns one row
    for each row of `docs`: its id (as `doc`), n_words, n_removed and kept (the remaining words joined by one space, UTF-8).

    Null texts have no words; texts of fewer than `words` words lose nothing. Rows with equal ids (null ids are one id,
    below all others and returned as null) count as one document and don't remove each other's words, but each such row loses
    what its own text shares with smaller ids. Other columns are ignored, whatever their names.
    """
    shape = S.Shape(words, min(seed, words), _words_as_units)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return _with_runs(rows, shape, extend_seeds, *_apply(words))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, less windows that smaller ids have too; nulls, equal ids and repeats as in `substring_dedup`, an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s FROM d, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM r, unnest(range(0, 13)) AS t(k)),
gl AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
u AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
kept AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS txt FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.i = g.p WHERE g.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(gl.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM d LEFT JOIN gl ON d.doc_id = gl.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
