"""Incremental ingest of result files. The batch engine has no streams; this is an addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldwright.sources.calls import RESULT_DDL


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESULT_DDL).option("multiLine", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_success(stream: DataFrame) -> DataFrame:
    """Successful calls, each (model, variant_id) once."""
    return stream.where("error IS NULL OR error = ''").dropDuplicates(["model", "variant_id"])
