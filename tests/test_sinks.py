"""Review files, Markdown, discovery, intervals and pairwise tests, strict responses, last runs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwright.functions import normalize as N
from fieldwright.functions import parse as P
from fieldwright.operators import compare, report
from fieldwright.sources import calls


def test_review_files_keep_empty_texts_and_quotes(spark, tmp_path):
    rows = [("m", "a", 'say "x", y', ""), ("m", "b", "two\nlines", " 007 "), ("n", "c", "null", "été")]
    frame = spark.createDataFrame(rows, "model string, field string, ground_truth string, predicted string")
    calls.write_review(frame.select("model", "field", F.regexp_replace("ground_truth", "\n", " ").alias("ground_truth"), "predicted"), str(tmp_path / "q"))
    back = calls.read_review(spark, str(tmp_path / "q"))
    assert back.columns == frame.columns and {r["field"]: r["ground_truth"] for r in back.collect()} == {"a": 'say "x", y', "b": "two lines", "c": "null"}
    assert {r["field"]: r["predicted"] for r in back.collect()}["a"] == ""


def test_markdown_of_a_small_table(spark):
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "model string, rate double").orderBy("model")
    assert report.to_markdown(table, ["model", "rate"]).splitlines() == ["| model | rate |", "| --- | --- |", "| a | 1.5 |", "| b |  |"]
    with pytest.raises(ValueError):
        report.to_markdown(spark.range(5), ["id"], most=4)


def test_the_last_image_of_a_stem_is_found(spark, tmp_path):
    for name in ("a.png", "a.pdf", "b.JPG", "c.txt", "a.json"):
        (tmp_path / name).write_bytes(b"x")
    got = {r["stem"]: r["image"].rsplit("/", 1)[1] for r in calls.discover(spark, str(tmp_path)).collect()}
    assert got == {"a": "a.png", "b": "b.JPG"}


def _results(spark):
    rng = np.random.default_rng(4)
    rows = []
    for model, p in (("a", 0.9), ("b", 0.6)):
        for d in range(120):
            for f, row in (("x", None), ("y", None), ("z", 0)):
                rows.append((model, "L0", f"d{d}", f"t{d % 12}", f, row, "correct" if rng.random() < p else "wrong", False, True))
    return spark.createDataFrame(rows, "model string, level string, doc_id string, template_id string, field string, row int, outcome string, format_error boolean, critical boolean")


def test_intervals_hold_their_points(spark):
    r = _results(spark)
    keys = ["model", "level", "doc_id", "template_id"]
    got = {(x["model"], x["measure"]): x for x in report.leaderboard_intervals(r, keys, draws=400).collect()}
    assert set(got) == {(m, k) for m in "ab" for k in ("field_accuracy", "header_accuracy", "line_item_accuracy", "exact", "critical_exact")}
    for x in got.values():
        assert x["lo"] <= x["point"] <= x["hi"] and x["n_clusters"] == 12
    plain = r.where("model = 'a' AND row IS NULL").agg(F.avg((F.col("outcome") == "correct").cast("double"))).first()[0]
    assert got["a", "header_accuracy"]["point"] == pytest.approx(plain)
    test = report.pairwise_tests(r, keys, draws=300).collect()
    assert len(test) == 1 and test[0]["better"] == "a" and test[0]["p"] < 1e-3 and 0 < test[0]["lo"] <= test[0]["delta"] <= test[0]["hi"] and test[0]["n"] == 120


def test_detectable_difference_shrinks_with_documents(spark):
    got = [r[0] for r in spark.createDataFrame([(100,), (400,)], "n int").select(compare.detectable_difference(F.col("n"))).collect()]
    assert got[0] == pytest.approx(2 * got[1]) and got[0] == pytest.approx(2.8015852 * (0.5 / 100) ** 0.5, rel=1e-6)


def test_the_last_run_counts_once(spark):
    rows = [("d", "A", 1, True), ("d", "A", 2, False), ("d", "B", 1, True), ("e", "A", 1, True), ("e", None, 1, True), (None, "A", 1, None), (None, "B", 5, True), (None, "B", 4, False)]
    docs = spark.createDataFrame(rows, "doc_id string, model string, run int, exact boolean")
    got = {r["doc_id"]: (r["model_a"], r["model_b"], r["exact_a"], r["exact_b"]) for r in compare.paired(docs, unit=["doc_id"], order=["run"]).collect()}
    assert got == {"d": ("A", "B", False, True), None: ("A", "B", None, True)}
    assert compare.paired(docs, unit=["doc_id"]).count() == 2


def test_what_stands_behind_a_value_is_not_overlooked(spark):
    cases = {
        '{"a": 1}': ('{"a":1}', None), ' {"a": 1} done': ('{"a":1}', None), '{"a": 1} and {"b": 2}': (None, "malformed_json"), '"k": 5': (None, "no_json_object"), "1, 2": (None, "no_json_object"),
        "null": (None, "json_not_an_object"), "[1]": (None, "json_not_an_object"), "": (None, "no_json_object"), '{"a": 1,, }': (None, "malformed_json"), "```json\n{\"a\": [1, {\"b\": null}]}\n```": ('{"a":[1,{"b":null}]}', None),
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = {r["t"]: (r["r"]["record"], r["r"]["violation"]) for r in rows.select("t", P.parse_response(F.col("t")).alias("r")).collect()}
    assert got == cases | {None: (None, "empty_response")}


def test_projections_give_what_expressions_give(spark):
    rows = spark.createDataFrame([("Rs. 1,234.50", "3rd March 2024"), ("(12)", "n/a"), (None, "31/02/2024"), ("１２", "nonsense")], "m string, d string")
    a = N.normalized(rows, {"x": ("money", F.col("m")), "y": ("date", F.col("d"))}).select("x", "x_ok", "y", "y_ok").collect()
    b = rows.select(N.normalize("money", F.col("m")).alias("x"), N.normalize("date", F.col("d")).alias("y")).select("x.*", "y.*").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_leaderboard_cells(spark):
    r = _results(spark)
    calls_ = spark.createDataFrame([("a", None), ("a", "late"), ("c", "late")], "model string, error string")
    rows = report.leaderboard_table(r, ["model", "level", "doc_id", "template_id"], calls_, draws=200).collect()
    assert [(x["place"], x["model"], x["n"], x["failed"]) for x in rows] == [(1, "a", 120, "1"), (2, "b", 120, "")]
    plain = r.where("model = 'a'").agg(F.avg((F.col("outcome") == "correct").cast("double"))).first()[0]
    assert rows[0]["field_accuracy"].startswith(f"{100 * plain:.1f}% [") and rows[0]["hallucination_share"] == "100.0%"
    none = report.leaderboard_table(r.where("row IS NULL"), ["model", "level", "doc_id", "template_id"], draws=50).collect()
    assert none[0]["line_item_accuracy"] == "—" and none[0]["failed"] == ""


def test_degradation_cells(spark):
    rows = [("m", "L0", "correct"), ("m", "L0", "wrong"), ("m", "L1", "wrong"), ("n", "L0", "correct")]
    r = spark.createDataFrame(rows, "model string, level string, outcome string").withColumn("row", F.lit(None).cast("int"))
    assert [tuple(x) for x in report.degradation_table(r, ["L0", "L1"]).collect()] == [(1, "n", "100.0%", "—", "—"), (2, "m", "50.0%", "0.0%", "50.0 pts")]
