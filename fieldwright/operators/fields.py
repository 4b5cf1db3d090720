"""The field registry."""

from __future__ import annotations

from typing import NamedTuple


class Field(NamedTuple):
    name: str
    ftype: str
    critical: bool = False
    nullable: bool = False
    zero_is_null: bool = False


HEADER = (
    Field("invoice_number", "exact_upper", critical=True),
    Field("invoice_date", "date", critical=True),
    Field("seller_name", "fuzzy", critical=True),
    Field("seller_gstin", "exact_upper", critical=True),
    Field("seller_address", "fuzzy", nullable=True),
    Field("buyer_name", "fuzzy", critical=True, nullable=True),
    Field("buyer_gstin", "exact_upper", critical=True, nullable=True),
    Field("buyer_address", "fuzzy", nullable=True),
    Field("place_of_supply", "state", nullable=True),
    Field("reverse_charge", "bool", nullable=True),
    Field("irn", "exact_upper", nullable=True),
    Field("total_taxable_value", "money", critical=True),
    Field("cgst_amount", "money", critical=True, nullable=True, zero_is_null=True),
    Field("sgst_amount", "money", critical=True, nullable=True, zero_is_null=True),
    Field("igst_amount", "money", critical=True, nullable=True, zero_is_null=True),
    Field("cess_amount", "money", nullable=True, zero_is_null=True),
    Field("round_off", "money", nullable=True, zero_is_null=True),
    Field("grand_total", "money", critical=True),
    Field("amount_in_words", "fuzzy", nullable=True),
)
LINE = (
    Field("description", "fuzzy"),
    Field("hsn_sac", "exact_alnum", critical=True, nullable=True),
    Field("quantity", "quantity", nullable=True),
    Field("unit", "exact_upper", nullable=True),
    Field("unit_price", "money", nullable=True),
    Field("discount", "money", nullable=True, zero_is_null=True),
    Field("taxable_value", "money", critical=True),
    Field("tax_rate", "percent", critical=True, nullable=True),
)
BY_NAME = {f.name: f for f in (*HEADER, *LINE)}
#: What each line field weighs when lines are matched.
MATCH_WEIGHTS = {"description": 0.40, "hsn_sac": 0.20, "taxable_value": 0.25, "quantity": 0.075, "unit_price": 0.075}
