"""Amounts in words, in lakh and crore."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SMALL = "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
_TENS = "Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()


def in_words(n: int) -> str:
    if n < 20:
        return _SMALL[n]
    if n < 100:
        return _TENS[n // 10 - 2] + (f" {_SMALL[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_SMALL[n // 100]} Hundred" + (f" and {in_words(n % 100)}" if n % 100 else "")
    name, size = next((w, s) for w, s in (("Crore", 10**7), ("Lakh", 10**5), ("Thousand", 10**3)) if n >= s)
    return f"{in_words(n // size)} {name}" + (f" {in_words(n % size)}" if n % size else "")


def rupees(amount: Decimal) -> str:
    whole = int(amount)
    paise = int((amount - whole) * 100)
    return f"Rupees {in_words(whole)}" + (f" and {in_words(paise)} Paise" if paise else "") + " Only"


@F.pandas_udf(StringType())
def rupees_in_words(amount: pd.Series) -> pd.Series:
    return amount.map(lambda a: None if a is None or a < 0 else rupees(Decimal(a)))
