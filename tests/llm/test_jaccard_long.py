"""Texts with more counted shingles in one bucket than 16 bits hold."""

from __future__ import annotations

from fieldwright.llm import jaccard


def test_very_long_texts_are_joined(spark):
    words = [f"w{i}" for i in range(180_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1000])), (3, " ".join(f"v{i}" for i in range(180_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [(1, 179_996, 1), (2, 178_996, 1), (3, 179_996, 3)]
