"""Texts in common shapes pass the steps of their type by, with the canonical text that the steps give."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from fieldwright.functions import constants as K
from fieldwright.functions import normalize as N

COMMON = {
    "exact_upper": ["12", " 7A ", "INV9"], "exact_alnum": ["12", "7A"], "money": ["0.00", "-0.00", "12.50", "-0.45", "Rs. 3.00", "1,234.56", "123456789012.34"], "quantity": ["5.000", "1,000.250", "-0.000"],
    "date": ["1998-02-28", "28/02/1998", "28-Feb-1998", "31-dec-2024", "29/02/2024"], "state": ["27-Maharashtra", "MAHARASHTRA", "goa", "09-x"],
}
ODD = [
    None, "", " ", "na", "NIL", "N/A", "-", "0", "00.50", "007", ".50", "1.5", "12.345", "(12.50)", "12.50 CR", "12.50-", "--1.00", "Rs. -1.00", "Rs.1.00", "rs. 1.00", "1,,2.34", "1,.50", ",1.00", "1 000.00", "\t1.00", "₹1.00", "12.50\n", "１２.50",
    "a7", "7a", "  7A", "7 A", "7-A", "7A\n", "İ7", "1998-02-30", "0000-01-01", "30/02/1998", "1/2/1998", "28/02/98", "28-Foo-1998", "28-Sept-1998", "28 Feb 1998", "1998/02/28", "1998-02-28 ", "31/04/2024",
    "27", "27 Maharashtra", "99-Nowhere", "27-Mahārāshtra", "Maharashtra ", "Tamil  Nadu", "TAMIL NADU", "bombay", "Pradesh", "J&K", "Kerala", "27-̸x", "28-Maharashtra",
]
PARTS = ["", "-", "Rs. ", " ", "0", "1", "12", ",", ".", ".0", ".00", "000", "A", "/", "-02-"]


@pytest.mark.parametrize("kind", list(COMMON))
def test_plain_agrees_with_the_steps(spark, kind):
    made = ["".join(p) for n in (2, 3) for p in itertools.product(PARTS, repeat=n)]
    texts = [*ODD, *itertools.chain(*COMMON.values()), *K.STATE_CODES.values(), *(v.upper() for v in K.STATE_CODES.values()), *made]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    whole = N.normalized(rows, {"v": (kind, F.col("t"))})
    told = whole.select("t", N.plain(kind, F.col("t")).alias("p"), N.is_null_token(F.col("t")).alias("none"), F.col("v").cast("string").alias("v"), "v_ok").collect()
    assert [r for r in told if r.p is not None and (r.none or not r.v_ok or r.p != r.v)] == []
    assert {r.t for r in told if r.p is not None} >= set(COMMON[kind])


def test_plain_words_agree_with_the_steps(spark):
    texts = [*ODD, *K.NULL_TOKENS, "part 12 line 3", "a", "na na", "acme ltd", "acme co", "co", "limited", "limits", "a  b", "a b\n", " a", "a.b", "Acme", "acme and sons", "and sons", "traders inc", "incs", "café", "x" * 40]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    told = N.normalized(rows, {"v": ("fuzzy", F.col("t"))}).select("t", N.plain("fuzzy", F.col("t")).alias("p"), "v").collect()
    assert [r for r in told if r.p is not None and r.p != r.v] == []
    assert {r.t for r in told if r.p is not None} >= {"part 12 line 3", "a", "na na", "limits", "incs"}


def test_rare_texts_are_read_as_by_the_steps(spark):
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys([*ODD, *itertools.chain(*COMMON.values())]) if t is not None], "t string")
    for kind in N.STEPS:
        got = rows.select("t", N.read(kind, F.col("t")).alias("r")).select("t", "r.*")
        staged = N.staged(rows.withColumn("f", N.fold(F.col("t"))), {"v": N.STEPS[kind](F.col("f"))}).select("t", F.col("v").cast("string").alias("value"), F.col("v_ok").alias("ok"))
        assert sorted(map(str, got.collect())) == sorted(map(str, staged.collect())), kind
