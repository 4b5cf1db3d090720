"""The cascade of a document's findings: order, short circuit, each rule of a field."""

from __future__ import annotations

from fieldwright.operators import score, taxonomy

_LINE = "struct<hsn_sac:string,taxable_value:string>"
_RECORD = f"struct<invoice_number:string,invoice_date:string,cgst_amount:string,cess_amount:string,grand_total:string,line_items:array<{_LINE}>>"
_TRUTH = ("INV0", "2024-01-02", "90.00", None, "1180.00", [("84", "400.00"), ("85", "600.00"), ("86", "180.00")])


def _findings(spark, rows, calls=None):
    docs = spark.createDataFrame(rows, f"doc_id string, truth {_RECORD}, seen {_RECORD}, schema_violation string")
    ended = spark.createDataFrame(calls, "doc_id string, finish_reason string, refusal boolean") if calls else None
    out = {}
    for r in taxonomy.classify_documents(score.score_documents(docs, ["doc_id"]), ["doc_id"], ended).orderBy("doc_id", "place").collect():
        out.setdefault(r["doc_id"], []).append((r["place"], r["field"], r["row"], r["category"], r["detail"], r["gt"], r["pred"], r["needs_review"]))
    return out


def test_rules_of_fields_and_their_order(spark):
    seen = ("INVO", "02-13-2024x", "1180", "7.00", "90", [("84", "400.00"), ("85", "600.00"), ("86", "181.00"), ("99", "5555.00")])
    got = _findings(spark, [("d", _TRUTH, seen, None), ("right", _TRUTH, _TRUTH, None)])
    assert set(got) == {"d"}
    told = [x[1:] for x in got["d"]]
    assert told[:5] == [
        ("invoice_number", None, "character_misread", "known glyph confusion", "INV0", "INVO", False),
        ("invoice_date", None, "format_error", "unparseable as its type", "2024-01-02", "02-13-2024x", False),
        ("cgst_amount", None, "field_confusion", "value belongs to 'grand_total'", "90.00", "1180.00", False),
        ("cess_amount", None, "fabricated_on_null", "invented a value where the truth is null", None, "7.00", False),
        ("grand_total", None, "field_confusion", "value belongs to 'cgst_amount'", "1180.00", "90.00", False),
    ]
    assert ("taxable_value", 2, "character_misread", "small edit distance", "180.00", "181.00", False) in told
    assert told[-1][:3] == ("taxable_value", -1, "fabricated_on_null") and [x[0] for x in got["d"]] == list(range(len(told)))


def test_a_refusal_is_the_only_finding(spark):
    rows = [(k, _TRUTH, None, "no_json_object") for k in ("refused", "cut", "bad")] + [("late", _TRUTH, _TRUTH, None), ("token", _TRUTH, _TRUTH, "truncated_output")]
    calls = [("refused", "stop", True), ("refused", "length", False), ("cut", "length", False), ("late", "length", None), ("token", "stop", False)]
    got = _findings(spark, rows, calls)
    assert [x[3] for x in got["refused"]] == ["refusal"]
    assert [x[3:5] for x in got["late"]] == [("truncated_output", "output hit the token cap")] == [x[3:5] for x in got["token"]]
    assert got["cut"][0][3] == "truncated_output" and got["bad"][0][3:5] == ("schema_violation", "no_json_object")
    assert {x[3] for x in got["cut"][1:]} == {"omission"} and len(got["cut"]) == 1 + 4 + 6


def test_merged_and_split_lines_come_before_fields(spark):
    merged = ("INV0", "2024-01-02", "90.00", None, None, [("84", "1000.00"), ("86", "180.00")])
    split = (*_TRUTH[:5], [("84", "400.00"), ("85", "590.00"), ("86", "180.00"), ("77", "10.00")])
    got = _findings(spark, [("m", _TRUTH, merged, None), ("s", _TRUTH, split, None)])
    assert [(x[1], x[3]) for x in got["m"]] == [("line_items", "line_item_merge"), ("grand_total", "omission")]
    assert [x[3] for x in got["s"]] == ["line_item_split"]


def test_no_documents(spark):
    assert _findings(spark, []) == {}
