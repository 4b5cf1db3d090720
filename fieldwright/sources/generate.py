"""Synthetic invoices with exact totals; each row depends on its seed alone, so partitions don't matter."""

from __future__ import annotations

import random
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fieldwright.code import ship_code
from fieldwright.functions.gstin import ALPHABET
from fieldwright.functions.words import rupees

DDL = (
    "doc_id string, seed long, template_id string, seller_gstin string, buyer_gstin string, place_of_supply string, invoice_date string, total_taxable_value string, cgst_amount string,"
    " sgst_amount string, igst_amount string, round_off string, grand_total string, amount_in_words string, line_items array<struct<description:string,quantity:string,unit_price:string,taxable_value:string,tax_rate:string>>"
)
TEMPLATES = 12
#: Shares of documents by number of lines.
LINES = ((0.45, 1, 3), (0.35, 4, 8), (0.15, 9, 16), (0.05, 17, 28))
_PLACES = ("27", "29", "33", "24", "07")


def _cents(x: Decimal) -> Decimal:
    return x.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)


def check_digit(prefix: str) -> str:
    total = sum(sum(divmod(ALPHABET.index(c) * (1 + i % 2), 36)) for i, c in enumerate(prefix))
    return ALPHABET[-total % 36]


def registration(r: random.Random, state: str) -> str:
    letters = "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(6))
    prefix = f"{state}{letters[:5]}{r.randrange(10_000):04d}{letters[5]}1Z"
    return prefix + check_digit(prefix)


def invoice(seed: int, n_lines: int | None = None) -> dict:
    r = random.Random(seed)
    if n_lines is None:
        _, lo, hi = r.choices(LINES, [share for share, _, _ in LINES])[0]
        n_lines = r.randint(lo, hi)
    place, inter = r.choice(_PLACES), r.random() < 0.4
    buyer = r.choice([p for p in _PLACES if p != place]) if inter else place
    rate = Decimal(r.choice((5, 12, 18, 28)))
    lines = []
    for k in range(n_lines):
        price, count = _cents(Decimal(10 ** r.uniform(1, 4))), r.randint(1, 20)
        lines.append({"description": f"item {r.randrange(1000)}-{k}", "quantity": str(count), "unit_price": str(price), "taxable_value": str(_cents(price * count)), "tax_rate": str(rate)})
    taxable = sum((Decimal(x["taxable_value"]) for x in lines), Decimal(0))
    half = _cents(taxable * rate / 200)
    exact = taxable + 2 * half
    grand = exact.quantize(Decimal(1), rounding=ROUND_HALF_UP)
    day = pd.Timestamp(2025, 4, 1) + pd.Timedelta(days=r.randint(0, 364))
    return {
        "doc_id": f"syn{seed:05d}", "seed": seed, "template_id": f"t{seed % TEMPLATES:02d}", "seller_gstin": registration(r, place), "buyer_gstin": registration(r, buyer), "place_of_supply": buyer,
        "invoice_date": day.strftime("%Y-%m-%d"), "total_taxable_value": str(taxable), "cgst_amount": None if inter else str(half), "sgst_amount": None if inter else str(half),
        "igst_amount": str(2 * half) if inter else None, "round_off": str(grand - exact), "grand_total": str(_cents(grand)), "amount_in_words": rupees(grand), "line_items": lines,
    }


def invoices(spark: SparkSession, n: int, first_seed: int = 0, n_lines: int | None = None) -> DataFrame:
    ship_code(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([invoice(int(i), n_lines) for i in pdf["id"]])

    return spark.range(first_seed, first_seed + n).mapInPandas(run, DDL)
