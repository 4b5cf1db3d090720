"""A kept table leaves no shuffle files behind, whenever the driver collects garbage."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from fieldwright.llm import exchange

DROPPING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_keep_drops_its_shuffles(spark):
    dropping = spark.conf.get(DROPPING)
    before = _shuffle_files(spark)
    frame = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    kept = exchange.keep(frame, "kept-shuffles")
    for _ in range(50):  # files are removed behind the query
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert kept.select(F.sum(F.size("ids"))).first()[0] == 10_000
    assert spark.conf.get(DROPPING) == dropping
