"""Rate cards, manifests, repeated runs and review joins on small tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from fieldwright.operators import report, triage
from fieldwright.sources import calls, rates


def test_rate_card(spark, tmp_path):
    models = [
        {"id": "a", "pricing": {"prompt": "0.000001", "completion": "0.0000025"}, "architecture": {"input_modalities": ["text", "image"]}, "context_length": 8},
        {"id": "b", "pricing": {"prompt": "-1", "completion": "-1"}}, {"id": "c", "pricing": {"prompt": "n/a"}}, {"id": "d", "pricing": {"prompt": None}},
        {"id": "e", "architecture": {"modality": "text+image->text"}}, {"id": "f", "pricing": {}, "architecture": {"input_modalities": ["image-like"], "modality": "image"}},
    ]
    (tmp_path / "c.json").write_text(json.dumps({"data": models}))
    got = {r["id"]: tuple(r)[1:] for r in rates.rates(rates.read_catalogue(spark, str(tmp_path / "c.json"))).collect()}
    assert got == {"a": (1.0, 2.5, True, 8), "e": (0.0, 0.0, True, None), "f": (0.0, 0.0, False, None)}
    (tmp_path / "none.json").write_text('{"data": []}')
    assert rates.rates(rates.read_catalogue(spark, str(tmp_path / "none.json"))).count() == 0


def test_manifest_and_its_digest(spark, tmp_path):
    docs = spark.sql("SELECT d AS doc_id, 7L AS seed, map('L0', struct(array('x.png') AS files, array('00') AS sha256)) AS variants FROM VALUES ('b'), ('a') t(d)")
    path = tmp_path / "manifest.json"
    digest = calls.write_manifest(docs, str(path), 'v"1')
    text = path.read_text()
    held = json.loads(text)
    assert held["n_documents"] == 2 and [d["doc_id"] for d in held["documents"]] == ["a", "b"] and held["manifest_sha256"] == digest
    assert hashlib.sha256(text.replace(f', "manifest_sha256": "{digest}"', "").encode()).hexdigest() == digest
    back = calls.read_manifest(spark, str(path))
    assert {r["variant_id"] for r in calls.tasks(back).collect()} == {"a__L0", "b__L0"} and back.first()["corpus_version"] == 'v"1'
    calls.write_manifest(docs.limit(0), str(path), "v2")
    assert json.loads(path.read_text())["documents"] == []


def test_repeated_runs(spark):
    ddl = "unit string, run int, field string, row int, pred_norm string, outcome string, lost boolean"
    rows = [("u", 0, "x", None, "1", "correct", False), ("u", 0, "y", None, None, "missing", False), ("u", 1, "x", None, "1", "correct", False), ("u", 1, "y", None, "2", "correct", False), ("u", 1, "z", 0, "9", "correct", False)]
    rows += [("v", 0, "x", None, "1", "correct", False), ("v", 1, "x", None, None, "missing", True), ("w", 0, "x", None, "1", "correct", False)]
    got = report.repeat_fields(spark.createDataFrame(rows, ddl), ["unit"], "run", [], F.col("lost")).first()
    assert tuple(got) == (2, 0.5, 0.5, 0.5)


def test_review_rows_are_not_doubled(spark):
    review = spark.createDataFrame([("a__L0", "lab/m"), ("b__L0", "lab/m")], "variant_id string, model string")
    truths = spark.createDataFrame([("a", "t"), ("a", "s")], "doc_id string, truth string")
    results = spark.createDataFrame([("a__L0", "lab_m", 1.0), ("a__L0", "lab/m", 2.0)], "variant_id string, model string, result double")
    got = {r["variant_id"]: (r["truth"], r["result"]) for r in triage.with_context(review, truths, results).collect()}
    assert got == {"a__L0": ("t", 2.0), "b__L0": (None, None)}


def test_cost_points_are_cheapest_first(spark):
    costs = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", None)], "model string, per_1000 double")
    right = spark.createDataFrame([("a", 0.5), ("b", 0.4), ("c", 0.9)], "model string, accuracy double")
    assert [r["model"] for r in report.cost_points(costs, right).collect()] == ["b", "a"]
