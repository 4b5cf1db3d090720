"""Scalar functions against fixed vectors."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldwright.functions import gstin, normalize, parse, similarity, words


def values(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


def test_money(spark):
    cases = {
        "Rs. 2,950.00": "2950.00", "₹ 12,34,567.89": "1234567.89", "(450.00)": "-450.00", "INR 99": "99.00", "-450": "-450.00", "0": "0.00",
        "7.005": "7.01", "-7.005": "-7.01", "--5": "5.00", ".50": "50.00", "100 CR": "100.00", "1e25": "1" + "0" * 25 + ".00",
    }
    got = values(spark, normalize.money, list(cases))
    assert [(r["value"], r["ok"]) for r in got] == [(Decimal(v), True) for v in cases.values()]
    bad = ["approximately two thousand", "NaN", "Infinity", "-inf", "1e400", "1e26"]
    assert [(r["value"], r["ok"]) for r in values(spark, normalize.money, bad)] == [(None, False)] * len(bad)
    assert [(r["value"], r["ok"]) for r in values(spark, normalize.money, ["Rs.", None, "-"])] == [(None, True)] * 3


def test_quantity_and_percent(spark):
    assert [r["value"] for r in values(spark, normalize.quantity, ["75.177", "1,000"])] == [Decimal("75.177"), Decimal("1000.000")]
    assert [r["value"] for r in values(spark, normalize.percent, ["18", "18%", "0.18", "9", "0"])] == [Decimal(x) for x in ("18.00", "18.00", "18.00", "9.00", "0.00")]


def test_date(spark):
    same = ["15/01/26", "15-Jan-2026", "2026-01-15", "15.01.2026", "15 January 2026", "Dated: 15/01/2026", "15-JAN-2026", "15th January, 2026"]
    assert [r["value"] for r in values(spark, normalize.date, same)] == ["2026-01-15"] * len(same)
    assert [r["value"] for r in values(spark, normalize.date, ["05/03/2026", "01/01/68", "01/01/69"])] == ["2026-03-05", "2068-01-01", "1969-01-01"]
    bad = ["31/02/2026", "2026-01-159", "Jan 15, 2026", "soon"]
    assert [(r["value"], r["ok"]) for r in values(spark, normalize.date, bad)] == [(None, False)] * len(bad)


def test_state_bool_fuzzy(spark):
    assert {r["value"] for r in values(spark, normalize.state, ["27-Maharashtra", "Maharashtra", "27", "MH", "maharastra"])} == {"27"}
    assert [(r["value"], r["ok"]) for r in values(spark, normalize.state, ["", "Atlantis", None])] == [(None, False), (None, False), (None, True)]
    assert [r["value"] for r in values(spark, normalize.boolean, ["Yes", "n/a", "perhaps"])] == [True, False, None]
    assert [r["value"] for r in values(spark, normalize.fuzzy_key, ["Sharma Textiles Pvt. Ltd.", "देव"])] == ["sharma textiles", None]
    assert [r["value"] for r in values(spark, normalize.exact_alnum, ["6109", "6109-1000"])] == ["6109", "61091000"]
    assert values(spark, normalize.is_null_token, ["N/A", " ", None, "0", "nil"]) == [True, True, True, False, True]


def test_compatibility_forms(spark):
    assert [(str(r["value"]), r["ok"]) for r in values(spark, normalize.money, ["１２３．５０", "₹\u00a0１,０００", "\u3000７"])] == [("123.50", True), ("1000.00", True), ("7.00", True)]
    assert [r["value"] for r in values(spark, normalize.exact_upper, ["ＡＢ１", "ﬁx"])] == ["AB1", "FIX"]
    assert values(spark, normalize.clean_text, ["a\u2003 b\u00a0"]) == ["a b"]


def test_gstin(spark):
    good = ["27AAPFU0939F1ZV", "29AAGCB7383J1Z4", "24AAACC1206D1ZM", "27aapfu0939f1zv "]
    bad = ["27AAPFU0939F1ZX", "99AAPFU0939F1ZV", "27", None, "12345"]
    assert values(spark, gstin.is_valid, good + bad) == [True] * len(good) + [False] * len(bad)


def test_similarity(spark):
    assert similarity.token_set_ratio("sharma textiles", "textiles sharma") == 100
    assert similarity.token_set_ratio("sharma textiles", "verma steel works") < 60
    assert similarity.token_set_ratio(None, "a") == 0 == similarity.token_set_ratio("", "")
    assert similarity.indel_ratio("abcd", "abxd") == pytest.approx(75)
    rows = spark.createDataFrame([("B8", "88"), ("abc", "abd"), ("abc", "abc"), ("ab", "abc"), ("abcdef", "xyzdef")], "a string, b string")
    assert [r[0] for r in rows.select(similarity.char_misread(F.col("a"), F.col("b"))).collect()] == [True, False, None, False, None]


def test_words():
    assert words.rupees(Decimal("1234567.50")) == "Rupees Twelve Lakh Thirty Four Thousand Five Hundred and Sixty Seven and Fifty Paise Only"
    assert words.in_words(0) == "Zero" and words.in_words(10**14) == "One Crore Crore"


def test_parse(spark):
    texts = ['```json\n{"a": 1}\n```', 'Sure: {"a": NaN} done', "no", "[1]", '{"a": ', None, '{"a": {"b": [1, null]}}', 'x {"a": } y']
    got = values(spark, parse.parse_response, texts)
    assert [r["violation"] for r in got] == [None, None, "no_json_object", "json_not_an_object", "no_json_object", "empty_response", None, "malformed_json"]
    assert got[1]["record"] == '{"a":"NaN"}'
    assert values(spark, parse.looks_like_refusal, ["I'm unable to", '{"a":"cannot process"}', "", None]) == [True, False, False, False]
    assert [tuple(r) for r in values(spark, parse.split_variant, ["syn1__L0_clean#r2", "a__b__L1_scan"])] == [("syn1", "L0_clean", 2), ("a__b", "L1_scan", 0)]
    assert values(spark, parse.doc_id, ["my bill.pdf", "real_x"]) == ["real_my_bill_pdf", "real_x"]
