"""Results of calls kept by key: what a rerun brings replaces what it had, and adds no row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwright.functions import parse as P

#: Parts of a model's results: a commit rewrites those that its keys fall in.
BUCKETS = 16
#: The last characters of a failed call's traceback that are kept.
TRACE = 2000
_own_folder: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or the context's checkpoint folder; in local mode without either, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="fieldwright-store-"))
        folder = _own_folder[0]
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def result_rows(calls: DataFrame) -> DataFrame:
    """Calls as results: calls(..., raw, error, traceback, refusal, finish_reason, input_tokens, output_tokens) with record,
    schema_violation, and what a failed call must not claim taken out.

    A call with an error has no record, no text, no tokens, violation call_failed and the last TRACE characters of its
    traceback, so a failure of the transport is never read as one of the model. Else the record is what can be read of
    the text; a refusal overrides a violation, and a cut output counts only where nothing else is wrong. Null texts are
    empty responses, null refusals none.
    """
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    r = calls.withColumns({"__failed": failed, "__parsed": P.parse_response(F.col("raw"))})
    f = F.col("__failed")
    violation = P.violation(F.col("error"), F.col("__parsed.violation"), F.when(~f, F.col("refusal")), F.when(~f, F.col("finish_reason")))
    columns = {
        "record": F.when(~f, F.col("__parsed.record")), "schema_violation": violation, "raw": F.when(f, "").otherwise(F.col("raw")),
        "traceback": F.when(f, F.right(F.col("traceback"), F.lit(TRACE))),
        **{n: F.when(f, F.lit(0).cast("long")).otherwise(F.col(n)) for n in ("input_tokens", "output_tokens")},
    }
    return r.withColumns(columns).drop("__failed", "__parsed")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _kept_schema(results: DataFrame) -> T.StructType:
    return T.StructType([*results.schema.fields, T.StructField("bucket", T.IntegerType())])


def read_store(spark: SparkSession, path: str, results: DataFrame) -> DataFrame:
    """The results kept at `path`, with the columns of `results`; none where nothing was kept yet."""
    system, p = _hadoop(spark, path)
    if not system.exists(p):
        return results.limit(0)
    return spark.read.schema(_kept_schema(results)).parquet(path).drop("bucket")


def commit(results: DataFrame, path: str, model: str = "model", keys: Iterable[str] = ("variant_id",), error: str = "error", overwrite: bool = False, buckets: int = BUCKETS) -> None:
    """Keep results by (model, keys): one row a key, whatever is committed how often.

    A success that is kept stays unless `overwrite`; a failure gives way to whatever comes. Of several new rows of one
    key a success counts before a failure, then the greatest by its JSON text. Null models and keys are values.

    New rows meet the kept ones of the (model, bucket) parts they fall in, the outcome is staged as a table, and the
    parts are replaced by a dynamic partition overwrite. A job that dies before leaves the store as it was; one that dies
    while parts are moved leaves each part whole, old or new; committing again completes it.
    """
    spark, keys = results.sparkSession, list(keys)
    system, p = _hadoop(spark, path)
    names = results.columns
    new = results.withColumns({"bucket": _bucket(keys, buckets), "__new": F.lit(1)})
    every = new
    if system.exists(p):
        kept = spark.read.schema(_kept_schema(results)).parquet(path)
        touched = new.select(F.col(model).alias("__m"), F.col("bucket").alias("__b")).distinct()
        old = kept.join(touched, kept[model].eqNullSafe(touched["__m"]) & (kept["bucket"] == touched["__b"]), "left_semi")
        every = new.unionByName(old.withColumn("__new", F.lit(0)))
    good = (F.coalesce(F.col(error), F.lit("")) == "").cast("int")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rank = F.struct(*((F.col("__new"), good) if overwrite else (good, F.when(good == 1, -F.col("__new")).otherwise(F.col("__new")))), F.to_json(row))
    best = every.groupBy("bucket", model, *keys).agg(F.max_by(row, rank).alias("__row")).select("__row.*", "bucket")
    staged = f"{path}-staged-{uuid.uuid4().hex}"
    best.select(*names, "bucket").write.parquet(staged)
    again = spark.read.schema(_kept_schema(results)).parquet(staged)
    again.repartition(F.col(model), F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(model, "bucket").parquet(path)
    fs, at = _hadoop(spark, staged)
    fs.delete(at, True)
