"""Typed normalisation: each type gives struct(value, ok).

ok is false where a value can't be read as its type; (null, true) is a value that
was cleaned to nothing. Nothing is ever repaired.

A normaliser is written once, as steps over a folded text (`fold`): a generator that yields a Column to be worked out and
receives it back as a name for the result. `staged` runs the steps of many normalisers as projections of a frame, one after
another, which keeps them in generated code; the functions on Columns (`money`, `date`, ...) bind the same steps within one
expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.functions import constants as K

AMOUNT = "decimal(28,2)"
QUANTITY = "decimal(28,3)"
#: Steps end in (value, ok).
Steps = Generator[Column, Column, tuple[Column, Column]]
#: White space of ASCII beyond the space; folding leaves no other.
_BLANKS = "\t\n\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(steps: Generator, end: Callable) -> Column:
    """Steps as one expression; `end` makes it of what they return."""

    def go(sent: Column | None) -> Column:
        try:
            value = steps.send(sent)
        except StopIteration as stop:
            return end(stop.value)
        return let(value, go)

    return go(None)


def inline(steps: Callable[..., Steps]) -> Callable[..., Column]:
    """Steps over a folded text as a function on any text Column, to struct(value, ok)."""

    def bound(c: Column, *args) -> Column:
        return let(fold(c), lambda x: bind(steps(x, *args), lambda end: result(*end)))

    bound.__doc__ = steps.__doc__
    return bound


def staged(frame: DataFrame, columns: dict[str, Steps]) -> DataFrame:
    """The frame with <name> and <name>_ok for each of the steps; all their n-th steps are one projection."""
    running, sent, spare = dict(columns), dict.fromkeys(columns), []
    while running:
        now = {}
        for name, run in list(running.items()):
            try:
                value = run.send(sent[name])
            except StopIteration as end:
                now[name], now[f"{name}_ok"] = end.value
                del running[name]
            else:
                step = f"__step{len(spare)}_{name}"
                now[step], sent[name] = value, F.col(f"`{step}`")
                spare.append(step)
        frame = frame.withColumns(now)
    return frame.drop(*spare)


def result(value: Column, ok: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def nfkc(c: Column) -> Column:
    """Unicode compatibility form, by the library that Spark ships for collations."""
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def fold(c: Column) -> Column:
    """Texts of other than ASCII characters in compatibility form, their white space as spaces; others unchanged."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(nfkc(c), r"(?U)\s", " ")).otherwise(c)


def _clean(c: Column) -> Column:
    """A folded text with runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Compatibility forms to plain ones, runs of white space to one space, trimmed."""
    return _clean(fold(c))


def is_null_token(c: Column) -> Column:
    """Null, or a text that means 'no value'."""
    return c.isNull() | F.lower(F.btrim(c, F.lit(f" {_BLANKS}\u00a0"))).isin(*K.NULL_TOKENS)


def _solid(c: Column) -> Column:
    """A folded text without white space."""
    return F.translate(c, f" {_BLANKS}", "")


def _exact_upper(c: Column) -> Steps:
    """Upper case, without spaces."""
    v = yield _solid(F.upper(c))
    return F.nullif(v, F.lit("")), F.lit(True)


def _exact_alnum(c: Column) -> Steps:
    """Letters and digits, upper case."""
    v = yield F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    return F.nullif(v, F.lit("")), F.lit(True)


def _decimal(c: Column, kind: str, percent: bool = False) -> Steps:
    """An amount: currency, separators and CR/DR go, parentheses and one leading '-' are a minus."""
    text = F.translate(F.replace(c, F.lit("%"), F.lit("")) if percent else c, _BLANKS, " " * len(_BLANKS))
    s = F.regexp_replace(text, f"(?i){K.CURRENCY}", "")
    s = yield F.rtrim(F.ltrim(s, F.lit(".:/ ")), F.lit(" .:"))
    around = yield s.startswith("(") & s.endswith(")") & (F.length(s) > 1)
    s = F.when(around, s.substr(F.lit(2), F.length(s) - 2)).otherwise(s)
    s = yield F.translate(F.regexp_replace(s, r"(?i)\b(CR|DR)\b", ""), ", ", "")
    minus = yield s.startswith("-")
    digits = yield F.when(minus, s.substr(F.lit(2), F.length(s))).otherwise(s)
    wide = yield digits.try_cast("decimal(38,9)" if percent else kind)
    value = yield F.when(minus | around, -wide).otherwise(wide)
    empty = yield digits.isin("", "-", ".")
    value = F.when((value > 0) & (value < 1), value * 100).otherwise(value).try_cast(kind) if percent else value
    value = yield F.when(~empty, value)
    return value, digits.isNull() | empty | value.isNotNull()


def _money(c: Column) -> Steps:
    """Two decimals, half up."""
    return (yield from _decimal(c, AMOUNT))


def _quantity(c: Column) -> Steps:
    """Three decimals, half up."""
    return (yield from _decimal(c, QUANTITY))


def _percent(c: Column) -> Steps:
    """Percent with two decimals; a fraction below 1 is taken times 100."""
    return (yield from _decimal(c, AMOUNT, True))


_MONTHS = "january february march april may june july august september october november december".split()
#: Shapes of dates, each to 'year|month|day': year first, day first, with a month's short or full name. A two-digit year
#: stands behind a number with '-', '/' or '.', or behind a short name.
_SHAPES = (
    (r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$", "$1|$3|$4"),
    (r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})$", "$4|$3|$1"),
    (r"^([0-9]{1,2}) ([0-9]{1,2}) ([0-9]{4})$", "$3|$2|$1"),
    (r"^([0-9]{1,2})([- ])([a-z]{3})\2([0-9]{4}|[0-9]{2})$", "$4|$3|$1"),
    (r"^([0-9]{1,2})([- ])([a-z]{4,})\2([0-9]{4})$", "$4|$3|$1"),
)


def _date(c: Column) -> Steps:
    """ISO text of a date, day first; two-digit years from 69 are of the 20th century."""
    s = F.regexp_replace(F.lower(_clean(c)), r"^(dated?|invoice date|dt\.?)\s*[:\-]?\s*", "")
    s = F.replace(F.regexp_replace(s, r"([0-9])(st|nd|rd|th)\b", "$1"), F.lit(","), F.lit(" "))
    s = yield F.trim(F.regexp_replace(s, " +", " "))
    for shape, order in _SHAPES:
        s = F.regexp_replace(s, shape, order)
    s = yield s
    parts = [F.substring_index(s, "|", 1), F.substring_index(F.substring_index(s, "|", 2), "|", -1), F.substring_index(s, "|", -1)]
    year, month, day = parts
    number = _map({**{m[:3]: f"{i + 1:02d}" for i, m in enumerate(_MONTHS)}, **{m: f"{i + 1:02d}" for i, m in enumerate(_MONTHS)}})
    month = yield F.when(month.rlike("^[0-9]"), F.lpad(month, 2, "0")).otherwise(F.try_element_at(number, month))
    year = yield F.when(F.length(year) == 2, F.concat(F.when(year >= "69", "19").otherwise("20"), year)).otherwise(year)
    iso = yield F.when(F.contains(s, F.lit("|")) & (year != "0000"), F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0")))
    value = yield F.when(iso.try_cast("date").isNotNull(), iso)
    return value, c.isNull() | value.isNotNull()


def _map(d: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in d.items()) + ")")


def _state(c: Column) -> Steps:
    """Two-digit code of a state given by code, code and name, name, alias or part of a name."""
    names = F.expr("array(" + ", ".join(f"named_struct('name', '{v.lower()}', 'code', '{k}')" for k, v in K.STATE_CODES.items()) + ")")
    by_name, by_alias = _map({v.lower(): k for k, v in K.STATE_CODES.items()}), _map(K.STATE_ALIASES)
    s = yield F.lower(_clean(c))
    code = yield F.regexp_extract(s, r"^([0-9]{2})\b", 1)
    n = yield F.trim(F.regexp_replace(F.regexp_replace(s, r"^[0-9]{1,2}\s*[-–:]\s*", ""), "[^a-z& .]", ""))
    named = yield F.coalesce(F.when(code.isin(*K.STATE_CODES), code), F.try_element_at(by_name, n), F.try_element_at(by_alias, n))
    part = F.filter(names, lambda x: (n != "") & (F.contains(x["name"], n) | F.contains(n, x["name"])))
    v = yield F.when(named.isNull() & n.isNotNull(), F.get(part, F.lit(0))["code"]).otherwise(named)
    return v, c.isNull() | v.isNotNull()


def _boolean(c: Column) -> Steps:
    """Yes or no, by two lists of words."""
    s = yield F.lower(_clean(c))
    v = yield F.when(s.isin(*K.TRUE_WORDS), True).when(s.isin(*K.FALSE_WORDS), False)
    return v, c.isNull() | v.isNotNull()


def _fuzzy_key(c: Column, address: bool = False) -> Steps:
    """Lower-case words of a name or address, without those that say nothing."""
    s = F.regexp_replace(F.lower(_clean(c)), K.ADDRESS_NOISE if address else K.LEGAL_SUFFIX, " ")
    s = yield F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.nullif(s, F.lit("")), F.lit(True)


def _address(c: Column) -> Steps:
    """As names, by the words of addresses."""
    return (yield from _fuzzy_key(c, True))


STEPS: dict[str, Callable[[Column], Steps]] = {
    "exact_upper": _exact_upper, "exact_alnum": _exact_alnum, "date": _date, "money": _money, "quantity": _quantity,
    "percent": _percent, "state": _state, "bool": _boolean, "fuzzy": _fuzzy_key, "address": _address,
}

exact_upper, exact_alnum, date, money, quantity, percent, state, boolean, fuzzy_key = (
    inline(s) for s in (_exact_upper, _exact_alnum, _date, _money, _quantity, _percent, _state, _boolean, _fuzzy_key)
)


#: Common shapes of texts, to canonical texts. They are ASCII, no null tokens, and need no step of their type; `$` would let a line feed pass.
_CODE = "[0-9A-Z]*[0-9][0-9A-Z]*"
_WORDS = r"^[a-z0-9]+(?: [a-z0-9]+)*\z"
_AMOUNT_SHAPE = r"^(?:Rs\. |-)?(?:0|[1-9][0-9,]{0,14})\.[0-9]{%d}\z"


def _plain_amount(c: Column, decimals: int) -> Column:
    bare = F.replace(F.replace(c, F.lit("Rs. "), F.lit("")), F.lit(","), F.lit(""))
    zero = "0." + "0" * decimals
    return F.when(c.rlike(_AMOUNT_SHAPE % decimals), F.when(bare == f"-{zero}", zero).otherwise(bare))


def _plain_date(c: Column) -> Column:
    month = F.try_element_at(_map({m[:3]: f"{i + 1:02d}" for i, m in enumerate(_MONTHS)}), F.lower(c.substr(4, 3)))
    first = c.substr(1, 2)
    iso = (
        F.when(c.rlike(r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z"), c)
        .when(c.rlike(r"^[0-9]{2}/[0-9]{2}/[1-9][0-9]{3}\z"), F.concat(c.substr(7, 4), F.lit("-"), c.substr(4, 2), F.lit("-"), first))
        .when(c.rlike(r"^[0-9]{2}-[A-Za-z]{3}-[1-9][0-9]{3}\z"), F.concat(c.substr(8, 4), F.lit("-"), month, F.lit("-"), first))
    )
    return F.when(iso.try_cast("date").isNotNull(), iso)


def _plain_state(c: Column) -> Column:
    named = {v.lower(): k for k, v in K.STATE_CODES.items() if re.fullmatch("[a-z&.]+(?: [a-z&.]+)*", v.lower())}
    code = c.substr(1, 2)
    return F.when(c.rlike(r"^[0-9]{2}-[ -~]*\z"), F.when(code.isin(*K.STATE_CODES), code)).otherwise(F.try_element_at(_map(named), F.lower(c)))


_PLAIN: dict[str, Callable[[Column], Column]] = {
    "exact_upper": lambda c: F.when(c.rlike(rf"^ ?{_CODE} ?\z"), F.trim(c)), "exact_alnum": lambda c: F.when(c.rlike(rf"^{_CODE}\z"), c),
    "money": lambda c: _plain_amount(c, 2), "quantity": lambda c: _plain_amount(c, 3), "date": _plain_date, "state": _plain_state,
    "fuzzy": lambda c: F.when(c.rlike(_WORDS) & ~c.rlike(K.LEGAL_SUFFIX) & ~c.isin(*K.NULL_TOKENS), c),
}


def plain(kind: str, c: Column) -> Column:
    """The canonical text of a text in a common shape of its type, which needs no steps; null for others, which do."""
    return _PLAIN[kind](c) if kind in _PLAIN else F.lit(None).cast("string")


def kind_of(ftype: str, field: str = "") -> str:
    """The normaliser of a field: its type, but addresses have a rule of their own."""
    return "address" if ftype == "fuzzy" and "address" in field else ftype


def present(c: Column) -> Column:
    """The value, null where it means 'no value'."""
    return F.when(~is_null_token(c), c)


def normalized(frame: DataFrame, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """The frame with <name> and <name>_ok for each name: (type, text), worked out as projections one after another.

    `normalize` gives the same as one expression, which leaves generated code.
    """
    folded = frame.withColumns({f"__{n}": fold(present(c)) for n, (_, c) in columns.items()})
    return staged(folded, {n: STEPS[ftype](F.col(f"`__{n}`")) for n, (ftype, _) in columns.items()}).drop(*[f"__{n}" for n in columns])


def read(kind: str, c: Column) -> Column:
    """struct(value as text, ok) of a text that isn't null, by its normaliser."""
    return let(fold(c), lambda x: bind(STEPS[kind](x), lambda end: result(end[0].cast("string"), end[1])))


def normalize(ftype: str, c: Column, field: str = "") -> Column:
    """struct(value, ok) by field type; values that mean 'no value' are null first."""
    return inline(STEPS[kind_of(ftype, field)])(present(c))
