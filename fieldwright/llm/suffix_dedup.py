"""Suffix-array substring dedup by bucket-pointer refinement.

Suffixes start in buckets of their initial q-gram (the anchors of `seeds`, then
the first eight bytes). A bucket is refined by sorting its suffixes on the bucket
identifiers of later offsets: identifiers of depth 8 at offset 8 give depth 16,
those of depth 16 at offset 16 give depth 32, and so on; a last offset, of length
less the depth reached, gives the full length. Each round writes its new identifiers back and the next round
reuses them; a bucket of one suffix is left out of later rounds.

Only depth `length` is asked for, so no bucket is refined beyond it. Buckets of
anchors that a single document has never reach refinement.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import seeds as S
from fieldwright.llm import text as T

LENGTH = 50
ANCHOR = 16


def _bytes_as_units(buf, starts, ends, raw: bool = False):
    own = np.append(starts, ends[-1] if len(ends) else 0)
    return (buf if raw else T.BYTE_TABLE[buf]), own


def bucket_ids(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense identifiers of pairs; a pair that occurs once still has its own."""
    key = (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)
    return np.unique(key, return_inverse=True)[1].astype(np.uint32)


def refine_buckets(length: int, doc, more, lead, anchor, units, begin):
    """Windows of these runs that a smaller document has too: (run, window in the run).

    units: the bytes of all runs, one after another; begin: where each run's bytes start.
    """
    n = len(units)
    padded = np.concatenate([units, np.zeros(8, np.uint8)])
    grams = np.zeros(n, np.uint64)
    depth = min(8, length)
    for k in range(depth):
        grams = (grams << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    pointer = np.unique(grams, return_inverse=True)[1].astype(np.uint32)
    del grams
    times = more + 1
    run_of = np.repeat(np.arange(len(doc)), times)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    start = begin[run_of] + step
    anchors = np.unique(anchor, return_inverse=True)[1]
    # equal windows have their anchor at the same place: bucket = (anchor, place of the anchor in the window)
    place = lead[run_of] - step
    bucket = np.unique(anchors[run_of].astype(np.int64) * (length + 1) + place, return_inverse=True)[1]

    def alive(bucket):
        """Suffixes whose bucket holds more than one document."""
        lo = np.full(bucket.max() + 1, np.iinfo(np.int64).max)
        hi = np.full(bucket.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(lo, bucket, doc[run_of])
        np.maximum.at(hi, bucket, doc[run_of])
        return (lo < hi)[bucket], lo[bucket]

    targets = [x for x in (depth << k for k in range(1, 60)) if x < length] + [length]
    for target in targets:
        keep, _ = alive(bucket)
        run_of, start, step, bucket = run_of[keep], start[keep], step[keep], bucket[keep]
        if not len(run_of):
            return run_of, step
        # identifiers of depth `target` for every suffix that a later round can point to
        offset = target - depth
        if target < length:
            need = np.zeros(n + 1, np.int32)
            np.add.at(need, start, 1)
            np.add.at(need, np.minimum(start + (length - target + 1), n), -1)
            at = np.flatnonzero(np.cumsum(need[:-1]) > 0)
            at = at[at + offset < n]
            fresh = np.zeros(n, np.uint32)
            fresh[at] = bucket_ids(pointer[at], pointer[at + offset]) + np.uint32(1)
            pointer = fresh
            at_start = pointer[start]
        else:
            at_start = bucket_ids(pointer[start], pointer[start + offset])
        bucket = np.unique((bucket.astype(np.uint64) << np.uint64(32)) | at_start.astype(np.uint64), return_inverse=True)[1]
        depth = target
    keep, least = alive(bucket)
    repeat = keep & (doc[run_of] > least)
    return run_of[repeat], step[repeat]


def _apply(length: int):
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        for batch in batches:
            buf, starts, ends = T.text_bytes(batch.column(1))
            for lo, hi in T.slices(starts, ends):
                a, b = int(starts[lo]), int(ends[hi - 1])
                s, e = starts[lo:hi] - a, ends[lo:hi] - a
                gone = S.covered(s, e, batch.column(2).slice(lo, hi - lo), length, b - a)
                piece = buf[a:b]
                upto = np.concatenate([[0], np.cumsum(gone)])
                open_ = gone.copy()
                open_[1:] &= ~gone[:-1]
                open_[s[s < len(open_)]] = gone[s[s < len(open_)]]
                opens = np.flatnonzero(open_)
                shut = gone.copy()
                shut[:-1] &= ~gone[1:]
                shut[(e - 1)[e > s]] = gone[(e - 1)[e > s]]
                shuts = np.flatnonzero(shut) + 1
                which = np.searchsorted(opens, s), np.searchsorted(opens, e)
                kept = piece[~gone].tobytes()
                k = upto
                out_kept = [kept[x - int(k[x]) : y - int(k[y])] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                spans = [np.stack([opens[i:j] - x, shuts[i:j] - x], 1).tolist() for i, j, x in zip(*which, s, strict=True)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(e - s), pa.array(k[e] - k[s]), pa.array(which[1] - which[0]), pa.array(out_kept, pa.binary()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<long>>"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Remove each byte that a `length`-byte string covers which also starts in a document of smaller id.

    Returns one row for each row of `docs`: its id (as `doc`), n_bytes, n_removed, n_spans (maximal removed runs),
    kept (the remaining bytes) and spans ([begin, end) byte offsets of what was removed).

    Null texts are empty; empty texts and texts under `length` bytes lose nothing. Rows with equal ids (null ids
    are one id, below all others and returned as null) count as one document: they don't remove each other's bytes,
    and a string repeated within one document stays; each such row loses what its own text shares with smaller ids. Other columns are ignored, whatever their names.
    """
    shape = S.Shape(length, min(anchor, length), _bytes_as_units)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return _with_runs(rows, shape, refine_buckets, *_apply(length))


def _with_runs(rows: DataFrame, shape: S.Shape, refine, apply, ddl: str) -> DataFrame:
    rows = rows.withColumn("key", F.xxhash64("text"))
    runs = S.repeated_runs(rows, shape, refine)
    out = X.arrow(rows.join(runs, ["doc", "key"], "left").select("doc", "text", "runs"), apply, ddl)
    return out.withColumn("doc", F.when(F.col("doc") != -(1 << 63), F.col("doc")))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, less what smaller ids have too; nulls, equal ids and repeats as in `suffix_dedup`, an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n_bytes FROM d),
w AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS s FROM n, unnest(range(0, greatest(n_bytes - 49, 0))) AS t(i)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id),
ev AS (SELECT doc_id, p, sum(c) AS c FROM (SELECT doc_id, i AS p, 1 AS c FROM r UNION ALL SELECT doc_id, i + 50, -1 FROM r) GROUP BY doc_id, p),
run AS (SELECT doc_id, p, sum(c) OVER (PARTITION BY doc_id ORDER BY p) AS open, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM ev),
span AS (SELECT doc_id, p AS lo, nxt AS hi FROM run WHERE open > 0),
mrg AS (SELECT doc_id, lo, hi, CASE WHEN lag(hi) OVER (PARTITION BY doc_id ORDER BY lo) = lo THEN 0 ELSE 1 END AS new FROM span),
tot AS (SELECT doc_id, sum(hi - lo) AS n_removed, sum(new) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM mrg GROUP BY doc_id),
k AS (SELECT n.doc_id, n.n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, n.x,
             list_concat([0], coalesce(t.his, [])) AS a, list_concat(coalesce(t.los, []), [n.n_bytes]) AS b
      FROM n LEFT JOIN tot t ON n.doc_id = t.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda j: substring(x, 2 * a[j] + 1, 2 * (b[j] - a[j]))), ''))) AS kept_sha256
FROM k
"""
