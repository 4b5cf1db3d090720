"""Result, manifest, review and price tables: reading, resuming, verifying, writing."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_DDL = (
    "variant_id string, doc_id string, level string, template_id string, model string, architecture string, record string, raw string,"
    " schema_violation string, error string, refusal boolean, finish_reason string, input_tokens long, output_tokens long, cached_input_tokens long,"
    " latency_s double, cost_usd double, prompt struct<prompt_version:string,schema_version:string,sha256:string>, extra map<string,string>"
)
MANIFEST_DDL = (
    "corpus_version string, n_documents long, documents array<struct<doc_id:string,seed:long,template_id:string,source:string,ground_truth:string,pdf:string,"
    "variants:map<string,struct<files:array<string>,sha256:array<string>>>>>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file of a call; values stay text, so odd types in a record cost no row."""
    return spark.read.schema(RESULT_DDL).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("model").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.schema(MANIFEST_DDL).option("multiLine", True).json(path)
    return m.select("corpus_version", F.explode("documents").alias("d")).select("corpus_version", "d.*")


def tasks(documents: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """One row for each variant of each document, at these levels."""
    out = documents.select("doc_id", F.coalesce("template_id", "doc_id").alias("template_id"), "ground_truth", F.explode("variants").alias("level", "variant"))
    out = out.where(F.col("level").isin(levels)) if levels else out
    return out.select(F.concat("doc_id", F.lit("__"), "level").alias("variant_id"), "doc_id", "template_id", "level", "ground_truth", "variant.files")


def first_tasks(wanted: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first tasks in a stated order."""
    return wanted.orderBy(*order).limit(most)


def write_manifest(documents: DataFrame, path: str, corpus_version: str, key: str = "doc_id") -> str:
    """Write documents in order of `key` as one manifest file of the driver and return its digest.

    The digest is that of the file without the digest's own field, which is the last one. Documents pass through the
    driver one after another, never all at once.
    """
    digest, n = hashlib.sha256(), 0
    with open(path, "w", encoding="utf-8") as out:

        def put(text: str) -> None:
            out.write(text)
            digest.update(text.encode())

        put('{"corpus_version": ' + json.dumps(corpus_version) + ', "documents": [')
        for row in documents.orderBy(key).select(F.to_json(F.struct("*")).alias("d")).toLocalIterator():
            put((",\n" if n else "\n") + row["d"])
            n += 1
        put(f'\n], "n_documents": {n}')
        whole = digest.copy()
        whole.update(b"}")
        out.write(', "manifest_sha256": "' + whole.hexdigest() + '"}')
    return whole.hexdigest()


def to_do(wanted: DataFrame, done: DataFrame, key: list[str], error: str = "error") -> DataFrame:
    """Wanted rows without a result that succeeded: failed ones run again."""
    good = done.where(F.coalesce(F.col(error), F.lit("")) == "")
    return wanted.join(good.select(*key), key, "left_anti")


def expand_repeats(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))


def verify_digests(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """ok, mismatch or missing for each expected (key, want) by what was found (key, have)."""
    status = F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("want"), "ok").otherwise("mismatch")
    return expected.join(found, key, "left").select(key, status.alias("status"))


def first_problems(verified: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The first files, in order of `key`, that are missing or differ: a report of `most` rows."""
    return verified.where("status <> 'ok'").orderBy(key).limit(most)


def cheapest(prices: DataFrame, price: str, most: float, k: int, tie: str) -> DataFrame:
    """The k cheapest offers up to a price."""
    return prices.where(F.col(price).between(0, most)).orderBy(price, tie).limit(k)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """The review queue as text columns; empty stays empty."""
    return spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\0").option("emptyValue", "").csv(path)


def write_review(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "webp", "tif", "tiff")) -> DataFrame:
    """(stem, image): the last file in order of each stem, without reading any content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[.]([^.]+)$", 1))
    return files.where(ext.isin(*suffixes)).groupBy(F.regexp_replace(name, r"[.][^.]+$", "").alias("stem")).agg(F.max("path").alias("image"))
