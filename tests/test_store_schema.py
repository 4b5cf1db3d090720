"""Keyed results, schema errors, registration, spans and accuracy by part on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from fieldwright.functions import schema
from fieldwright.operators import report, score, span
from fieldwright.sources import register, store

_CALL = "model string, variant_id string, raw string, error string, traceback string, refusal boolean, finish_reason string, input_tokens long, output_tokens long"


def _calls(spark, rows):
    return store.result_rows(spark.createDataFrame(rows, _CALL))


def test_failed_calls_claim_nothing(spark):
    rows = [("m", "a", '{"x": 1}', None, None, None, "length", 5, 6), ("m", "b", "no", "HTTP 402", "t" * 3000 + "end", True, "stop", 5, 6), ("m", "c", None, "", None, True, None, 1, 2), ("m", "d", "[1]", None, None, False, "length", 1, None)]
    got = {r["variant_id"]: r for r in _calls(spark, rows).collect()}
    assert got["a"]["schema_violation"] == "truncated_output" and json.loads(got["a"]["record"]) == {"x": 1}
    b = got["b"]
    assert (b["schema_violation"], b["record"], b["raw"], b["input_tokens"], len(b["traceback"]), b["traceback"][-3:]) == ("call_failed", None, "", 0, 2000, "end")
    assert got["c"]["schema_violation"] == "refusal" and got["d"]["schema_violation"] == "json_not_an_object"


def test_a_rerun_adds_no_row_and_a_success_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    one = _calls(spark, [("x/m", str(i), "{}", "late" if i % 3 == 0 else None, "tb", False, "stop", i, 1) for i in range(30)] + [(None, None, "{}", None, None, False, "stop", 1, 1)] * 2)
    assert store.read_store(spark, path, one).count() == 0
    store.commit(one, path, buckets=3)
    store.commit(one, path, buckets=3)

    def kept():
        return {(r["model"], r["variant_id"]): (r["error"], r["input_tokens"]) for r in store.read_store(spark, path, one).collect()}

    first = kept()
    assert len(first) == 31 == store.read_store(spark, path, one).count() and first["x/m", "3"] == ("late", 0) and first["x/m", "4"] == (None, 4)
    again = _calls(spark, [("x/m", "3", "{}", None, None, False, "stop", 77, 1), ("x/m", "4", "{}", None, None, False, "stop", 88, 1), ("x/m", "5", "{}", "worse", "tb", False, "stop", 99, 1), ("y", "5", "{}", "bad", "tb", False, "stop", 1, 1)])

    real, died = DataFrameWriter.parquet, []

    def dies(self, path_, **how):  # before the parts are replaced
        if "staged" not in str(path_):
            died.append(path_)
            raise RuntimeError("killed")
        return real(self, path_, **how)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(RuntimeError):
        store.commit(again, path, buckets=3)
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    assert died and kept() == first
    store.commit(again, path, buckets=3)
    now = kept()
    assert now["x/m", "3"] == (None, 77) and now["x/m", "4"] == (None, 4) and now["x/m", "5"] == (None, 5) and now["y", "5"] == ("bad", 0) and len(now) == 32
    store.commit(again, path, overwrite=True, buckets=3)
    assert kept()["x/m", "4"] == (None, 88)


def _record(**over):
    r = {f: None for f in schema.record_schema()["required"]} | {"invoice_number": "1", "invoice_date": "2024-01-01", "seller_name": "a", "seller_gstin": "b", "total_taxable_value": 1, "grand_total": 1.5, "line_items": []}
    return r | over


def test_errors_by_path(spark):
    line = dict.fromkeys(schema.record_schema()["properties"]["line_items"]["items"]["required"]) | {"description": "d", "taxable_value": 5}
    texts = {
        "ok": json.dumps(_record(line_items=[line], reverse_charge=True)), "null": None, "cut": '{"a":', "list": "[]", "text": json.dumps(_record(grand_total="x")),
        "deep": json.dumps(_record(line_items=[line, {**line, "quantity": [1], "taxable_value": None}, 3])), "lines": json.dumps(_record(line_items={"a": 1})), "buyer": json.dumps(_record(buyer_name={"first": "x"})),
    }
    frame = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r["k"]: [(e["path"], e["problem"]) for e in r["e"]] for r in frame.select("k", schema.schema_errors(F.col("t"), schema.record_schema()).alias("e")).collect()}
    assert got == {
        "ok": [], "null": [("$", "is not JSON")], "cut": [("$", "is not JSON")], "list": [("$", "array is not of type object")], "text": [("$.grand_total", "string is not of type number")],
        "deep": [("$.line_items[1].quantity", "array is not of type number or null"), ("$.line_items[1].taxable_value", "void is not of type number"), ("$.line_items[2]", "bigint is not of type object")],
        "lines": [("$.line_items", "object is not of type array")], "buyer": [("$.buyer_name", "object is not of type string or null")],
    }
    read = {r["k"]: r["r"] for r in frame.select("k", schema.typed_record(F.col("t")).alias("r")).collect()}
    assert read["null"] is None and read["cut"] is None and read["list"] is None and read["lines"]["line_items"] == []
    assert len(read["deep"]["line_items"]) == 2 and read["deep"]["line_items"][1]["quantity"] == "[1]" and read["buyer"]["buyer_name"] == '{"first":"x"}'
    assert read["ok"]["grand_total"] == "1.5" and read["ok"]["reverse_charge"] == "true" and read["ok"]["irn"] is None


def test_registration(spark):
    good = json.dumps(_record(_meta={"layout_group": "g"}))
    plain = json.dumps(_record())
    images = spark.createDataFrame([(n,) for n in ("a b.png", "a_b.pdf", "c.png", "d.png", "e.jpg", "f.png", "c.png", None, "held.png", "held#.png")], "image string")
    labels = spark.createDataFrame([("a b", "{}"), ("a_b", good), ("c", plain), ("d", "{"), ("e", plain), ("held", plain), ("held#", plain), (None, plain)], "stem string, label string")
    manifest = spark.createDataFrame([("real_held", "held#.png"), ("real_e", "e.jpg"), (None, "z")], "doc_id string, source_file string")
    got = {r["image"]: r for r in register.register(images, labels, manifest).collect()}
    assert {k for k, r in got.items() if r["status"] == "accepted"} == {"a_b.pdf", "c.png", "e.jpg", "held#.png"} and len(got) == 8
    assert got["a_b.pdf"]["template_id"] == "g" and "_meta" not in json.loads(got["a_b.pdf"]["ground_truth"]) and got["c.png"]["template_id"] == "real_c"
    assert got["d.png"]["problems"] == ["label is not valid JSON"] and got["f.png"]["problems"] == ["no label file (f.json)"]
    assert got["held.png"]["problems"] == ["document id real_held already taken by held#.png -- rename one"] and len(got["a b.png"]["problems"]) > 5
    assert register.register(images.limit(0), labels).count() == 0


def test_spans(spark):
    profiles = {"even": [1] * 100, "none": [0] * 7, "one": [0, 0, 5, 0], "ends": [9, 0, 0, 0, 9], "gap": [None, 3, None, 3]}
    rows = [(k, i, w) for k, p in profiles.items() for i, w in enumerate(p)] + [(None, 0, 4), ("even", None, 5)]
    frame = spark.createDataFrame(rows, "doc_id string, position int, weight int")
    for part in (1, 3, 4096):
        got = {r["doc_id"]: (r["lo"], r["hi"], r["size"]) for r in span.trimmed_span(frame, part=part).collect()}
        assert got == {"even": (1, 97, 100), "none": (0, 6, 7), "one": (2, 3, 4), "ends": (0, 4, 5), "gap": (1, 3, 4), None: (0, 1, 1)}


def test_parts_of_accuracy(spark):
    rows = [("m", None, "correct", False), ("m", None, "wrong", True), ("m", 0, "correct", False), ("n", None, "missing", False), ("n", None, "absent_ok", False)]
    r = spark.createDataFrame(rows, "model string, row int, outcome string, format_error boolean")
    got = {(x["model"], x["part"]): (x["accuracy"], x["n_due"], x["format_errors"]) for x in report.group_accuracy(r, ["model"]).collect()}
    assert got == {("m", "header"): (0.5, 2, 1), ("m", "line"): (1.0, 1, 0), ("m", "all"): (2 / 3, 3, 1), ("n", "header"): (0.0, 1, 0), ("n", "all"): (0.0, 1, 0)}
    assert score.CORRECT == "correct"
