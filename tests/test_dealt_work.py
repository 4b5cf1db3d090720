"""What a task holds doesn't grow with the tables."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import functions as F

from fieldwright.operators import resample, span
from fieldwright.plans import catalog, documents, invoices


def _exchanged(frame) -> list[str]:
    """The columns that each shuffle of a plan moves."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return re.findall(r"\) Exchange\nInput \[[0-9]+\]: (.*)", out.getvalue())


def test_pairs_of_a_nation_are_dealt_in_parts(spark, sf, monkeypatch):
    whole = sorted(map(tuple, catalog.queries()["levenshtein"](spark, sf).collect()))
    monkeypatch.setattr(documents, "_PAIRS_A_PART", 2)
    monkeypatch.setattr(documents, "_PAIRS_A_TASK", 5)
    dealt = catalog.queries()["levenshtein"](spark, sf)
    assert dealt.rdd.getNumPartitions() == -(-len(whole) // 5) and sorted(map(tuple, dealt.collect())) == whole


def test_evidence_is_not_shuffled(spark, sf):
    for name in ("triage_queue", "arithmetic_story"):
        moved = _exchanged(catalog.queries()[name](spark, sf))
        assert moved and not any("evidence" in c or "places" in c or "amounts" in c for c in moved)


def test_documents_are_dealt_by_their_number(spark, sf, monkeypatch):
    n = invoices.table(spark, sf, "orders").count()
    monkeypatch.setattr(invoices, "_DOCS_A_TASK", n // 50)
    assert invoices.results(spark, sf).rdd.getNumPartitions() == -(-n // (n // 50))


def test_positions_are_shuffled_once(spark):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = spark.createDataFrame([("a", i // 2, 1) for i in range(400)], "doc_id string, position int, weight int")  # two rows a position
        out = span.trimmed_span(frame)
        moved = [c for c in _exchanged(out) if re.search(r"\bp#", c) and "which#" not in c]
        assert len(moved) == 1 and [tuple(r) for r in out.collect()] == [("a", 3, 195, 200)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_bootstrap_makes_its_clusters_once(spark):
    rows = spark.createDataFrame([(m, c, c % 3, 2) for m in ("A", None) for c in range(50)], "model string, cluster int, num int, den int")
    sums = resample.cluster_sums(rows, ["model"], F.col("cluster"), {"num": F.sum("num"), "den": F.sum("den")})
    out = resample.hash_bootstrap(sums, ["model"], ["num", "den"], resample.ratio, 20)
    moved = [c for c in _exchanged(out) if "cluster#" in c]
    assert len(moved) == 1 and {(r["model"], r["point"], r["n_clusters"]) for r in out.collect()} == {("A", 0.49, 50), (None, 0.49, 50)}
