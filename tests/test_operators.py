"""Operators on small tables, and queries against their SQL."""

from __future__ import annotations

import itertools
import json
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldwright.operators import align, compare, consistency, score, taxonomy, triage
from fieldwright.operators.fields import BY_NAME
from fieldwright.plans import catalog
from fieldwright.sources import calls


def test_outcomes(spark):
    cases = [("igst_amount", None, "0", "absent_ok"), ("igst_amount", None, "450", "spurious"), ("igst_amount", "0.00", None, "absent_ok"), ("buyer_gstin", "27AAPFU0939F1ZV", None, "missing"), ("buyer_gstin", "27AAPFU0939F1ZV", "27AAPFU0939F1ZX", "wrong"), ("grand_total", "2950.00", "Rs. 2,950", "correct"), ("grand_total", "2950.00", "lots", "wrong"), ("grand_total", None, "0", "spurious"), ("seller_name", "Sharma Textiles Pvt Ltd", "Textiles Sharma", "correct")]
    for field, truth, seen, want in cases:
        row = spark.createDataFrame([(truth, seen)], "t string, s string").select(score.judge(BY_NAME[field], F.col("t"), F.col("s")).alias("j")).first()["j"]
        assert row["outcome"] == want, (field, truth, seen)
        assert row["format_error"] == (seen == "lots")


def test_assignment_is_optimal():
    r = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (4, 6), (6, 4), (5, 5), (0, 3), (2, 7)]:
        cost = r.random((n, m)).round(1)
        got = align.assign(cost)
        assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
        if n and m:
            a = cost if n <= m else cost.T
            best = min(sum(a[i, p[i]] for i in range(a.shape[0])) for p in itertools.permutations(range(a.shape[1]), a.shape[0]))
            assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def line(name, amount, code="1"):
    return {"description": name, "hsn_sac": code, "taxable_value": amount, "quantity": 1.0, "unit_price": amount}


def test_alignment():
    truth = [line("red cotton shirt", 100.0), line("blue steel pipe", 250.0, "2"), line("green glass jar", 40.0, "3")]
    m = align.match(truth, truth[::-1])
    assert m["pairs"] == [(0, 2), (1, 1), (2, 0)] and not m["missing"]
    m = align.match(truth, [line("red cotton shirt blue steel pipe", 350.0), truth[2]])
    assert m["merges"] == [([0, 1], 0)] and m["pairs"] == [(2, 1)] and not m["missing"]
    m = align.match(truth, [line("red cotton shirt", 60.0), line("red cotton shirt", 40.0), *truth[1:]])
    assert m["splits"] == [(0, [0, 1])]
    assert align.match(truth, truth[:1] + truth[2:])["missing"] == [1]
    assert align.match(truth, [])["missing"] == [0, 1, 2] and align.match([], truth)["spurious"] == [0, 1, 2]


def test_mcnemar_holm_bootstrap(spark):
    assert compare.mcnemar_p(0, 0) == 1 and compare.mcnemar_p(1, 1) == 1 and compare.mcnemar_p(18, 2) < 0.001 and compare.mcnemar_p(5, 5) == 1
    p = spark.createDataFrame([("a", 0.001), ("b", 0.30), ("c", 0.04)], "comparison string, p double")
    assert {r["comparison"] for r in compare.holm(p).where("rejected").collect()} == {"a"}
    r = random.Random(1)
    num = np.array([sum(r.random() < x for _ in range(40)) for x in [0.6, 0.95] * 5], float)
    _, lo, hi = compare.bootstrap_interval(num, np.full(10, 40.0), 2000, 0.05, 1)
    flat = 2 * 1.96 * np.sqrt(0.775 * 0.225 / 400)
    assert hi - lo > 2.5 * flat / 1.6
    assert np.isnan(compare.bootstrap_interval(np.empty(0), np.empty(0), 10, 0.05, 1)[0])


def test_document_findings_and_sample(spark):
    docs = spark.createDataFrame([("m", True, None, None, 1, 0), ("m", False, "no_json_object", None, 0, 0), ("m", False, None, "length", 1, 2)], "model string, refusal boolean, schema_violation string, finish_reason string, merges int, splits int")
    got = sorted(r["category"] for r in taxonomy.document_findings(docs).collect())
    assert got == sorted(["refusal", "schema_violation", "truncated_output", "line_item_merge", "line_item_split", "line_item_split"])


def test_triage(spark):
    def one(field, truth, seen, elsewhere=None, amounts=None, taxable=None):
        rows = spark.createDataFrame([(field, truth, seen, elsewhere, amounts, taxable)], "f string, t string, s string, e array<string>, a array<struct<name:string,value:double>>, x double")
        return rows.select(triage.suggest(*[F.col(c) for c in "ftseax"])).first()[0]

    assert one("seller_name", "a b", "") == "omission"
    assert one("seller_name", "a b", "x", ["buyer_name"]) == "field_confusion"
    assert one("grand_total", "2950.00", "2,950.00") == "format_error"
    assert one("grand_total", "2950.00", "2950.01") == "character_misread"
    assert one("cgst_amount", "10", "350", None, None, 2500.0) == "field_confusion"
    assert one("grand_total", "2950", "2050") == "AMBIGUOUS-numeric"
    assert one("grand_total", "2950", "29500") == "character_misread"
    assert one("seller_name", "deshmukh industries", "redbrick industries") == "entity_substitution"
    assert one("seller_name", "alpha beta", "gamma delta") == "AMBIGUOUS-text"
    assert one("seller_name", "maharashtra steel", "mahrashtr stee") == "character_misread"
    assert one("taxable_value", "alpha beta", "gamma delta", ["line[1].taxable_value", "round_off"]) == "AMBIGUOUS-text"


def test_confusion_is_with_the_first_field_in_order(spark):
    rows = [("d", "total_taxable_value", 11, "money", "5.00", "5.00", "correct"), ("d", "cgst_amount", 12, "money", "5.00", "5.00", "correct"), ("d", "grand_total", 17, "money", "7.00", "5.00", "wrong")]
    r = spark.createDataFrame(rows, "doc_id string, field string, ordinal int, ftype string, gt_norm string, pred_norm string, outcome string").selectExpr("*", "CAST(NULL AS INT) AS row", "false AS format_error")
    assert [(x["category"], x["other"]) for x in taxonomy.findings(r, ["doc_id"]).collect()] == [("field_confusion", "total_taxable_value")]


def test_consistency_applies_only_where_it_can(spark):
    ddl = "total_taxable_value decimal(18,2), cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2), cess_amount decimal(18,2), round_off decimal(18,2), grand_total decimal(18,2), invoice_date string, seller_gstin string, buyer_gstin string, place_of_supply string, line_items array<struct<quantity:decimal(18,3),unit_price:decimal(18,6),discount:decimal(18,2),taxable_value:decimal(18,2)>>"
    from decimal import Decimal as D

    full = (D(100), D(9), D(9), None, None, D(0), D(118), "2024-01-01", "27AAPFU0939F1ZV", None, "27", [(D(2), D(50), None, D(100))])
    none = (None,) * 12
    a, b = (r["checks"] for r in consistency.checks(spark.createDataFrame([full, none], ddl)).collect())
    assert all(v is not False for v in a.asDict().values()) and a["intrastate_pos_matches_seller"] is True
    assert all(v is None for k, v in b.asDict().items() if k != "parseable")


def test_results_round_trip(spark, tmp_path):
    (tmp_path / "m:free").mkdir()
    (tmp_path / "m:free" / "a.json").write_text('{"variant_id": "a__L0_clean",\n "model": "m", "record": {"grand_total": 1.5, "line_items": [1, "x", null]}, "error": null, "refusal": false}')
    (tmp_path / "m:free" / "b.json").write_text('{"variant_id": "b__L0_clean", "model": "m", "record": null, "error": "HTTP 402"}')
    got = calls.read_results(spark, str(tmp_path))
    assert got.count() == 2 and json.loads(got.where("error IS NULL").first()["record"]) == {"grand_total": 1.5, "line_items": [1, "x", None]}
    wanted = spark.createDataFrame([("a__L0_clean",), ("b__L0_clean",)], "variant_id string")
    assert [r[0] for r in calls.to_do(wanted, got, ["variant_id"]).collect()] == ["b__L0_clean"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = catalog.queries()[name](spark, sf).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)

    def text(df):
        out = df[cols].copy()
        for c in cols:
            out[c] = out[c].map(lambda v: "null" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, float) else str(v))
        return out.sort_values(cols).to_numpy().tolist()

    assert text(a) == text(b)
