"""Five-way outcomes of fields, as one long fact table.

Records become rows of fields before anything is normalised, so each type's rules stand in the plan once, whatever the
number of fields; truth that is compared with many predictions is normalised before it meets them (`prepare_truth`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwright.code import ship_code
from fieldwright.functions import constants as K
from fieldwright.functions import normalize as N
from fieldwright.functions.similarity import fuzzy_score
from fieldwright.operators.align import match_lines
from fieldwright.operators.fields import BY_NAME, HEADER, LINE, Field

CORRECT, WRONG, MISSING, SPURIOUS, ABSENT_OK = "correct", "wrong", "missing", "spurious", "absent_ok"
OUTCOMES = (CORRECT, WRONG, MISSING, SPURIOUS, ABSENT_OK)
NUMBERS = ("money", "quantity", "percent")
#: Canonical texts of a zero amount.
ZEROS = ("0.00", "0.000")
ORDINAL = {n: i for i, n in enumerate(BY_NAME)}
TRUTHS = "array<struct<ordinal:int,field:string,family:string,value:string>>"


def family(ftype: str) -> str:
    """Values are compared within a family of types: a zero amount is not the same as 'no'."""
    return "number" if ftype in NUMBERS else "bool" if ftype == "bool" else "text"


def _adjust(zero: Column | bool, t: Column, s: Column, t_null: Column, s_null: Column) -> N.Steps:
    """Whether truth and prediction count as null: a zero for 'does not apply' is no invention, the prediction's first."""
    zero = F.lit(zero) if isinstance(zero, bool) else zero
    s_null = yield s_null | (zero & t_null & F.coalesce(s.isin(*ZEROS), F.lit(False)))
    return t_null | (zero & s_null & F.coalesce(t.isin(*ZEROS), F.lit(False))), s_null


def _outcome(t_null: Column, s_null: Column, bad: Column, equal: Column) -> Column:
    return F.when(t_null & s_null, ABSENT_OK).when(t_null, SPURIOUS).when(s_null, MISSING).when(bad, WRONG).when(equal, CORRECT).otherwise(WRONG)


def judge(field: Field, truth: Column, seen: Column, threshold: float = K.FUZZY_THRESHOLD) -> Column:
    """struct(outcome, format_error, gt_norm, pred_norm, similarity) of one field, as one expression."""
    fuzzy = field.ftype == "fuzzy"
    t, s = N.normalize(field.ftype, truth, field.name), N.normalize(field.ftype, seen, field.name)
    score = fuzzy_score(t["value"], s["value"]) if fuzzy else F.lit(None).cast("double")

    def decide(c: Column):
        t_null, s_null = yield from _adjust(field.zero_is_null, c["t"], c["s"], c["tn"], c["sn"])
        null = yield F.struct(t_null.alias("t"), s_null.alias("s"))
        equal = F.coalesce(c["score"] >= threshold if fuzzy else c["t"] == c["s"], F.lit(False))
        return F.struct(
            _outcome(null["t"], null["s"], c["bad"], equal).alias("outcome"), c["bad"].alias("format_error"),
            F.when(~null["t"], c["t"]).alias("gt_norm"), F.when(~null["s"], c["s"]).alias("pred_norm"), c["score"].alias("similarity"),
        )

    tn, sn = N.is_null_token(truth), N.is_null_token(seen)
    sides = F.struct(t["value"].cast("string").alias("t"), s["value"].cast("string").alias("s"), tn.alias("tn"), sn.alias("sn"), (~s["ok"] & ~sn).alias("bad"), score.alias("score"))
    return N.let(sides, lambda c: N.bind(decide(c), lambda end: end))


def prepare_truth(frame: DataFrame, fields: Iterable[str]) -> DataFrame:
    """The frame with gn_<field>, the canonical text of each gt_<field>, for field_results to use."""
    names = list(fields)
    kinds = {n: N.kind_of(BY_NAME[n].ftype, n) for n in names}
    out = frame.withColumns({f"__p_{n}": N.plain(kinds[n], F.col(f"gt_{n}").cast("string")) for n in names})
    whole = {n: N.normalize(BY_NAME[n].ftype, F.col(f"gt_{n}").cast("string"), n)["value"].cast("string") for n in names}
    out = out.withColumns({f"gn_{n}": F.when(F.col(f"__p_{n}").isNotNull(), F.col(f"__p_{n}")).otherwise(whole[n]) for n in names})
    return out.drop(*[f"__p_{n}" for n in names])


def truths(fields: Iterable[str]) -> Column:
    """All true values of a prepared record, in field order, for telling confusions of fields."""
    each = [F.struct(F.lit(ORDINAL[n]).alias("ordinal"), F.lit(n).alias("field"), F.lit(family(BY_NAME[n].ftype)).alias("family"), F.when(~N.is_null_token(F.col(f"gt_{n}").cast("string")), F.col(f"gn_{n}")).alias("value")) for n in fields]
    return F.array(*each)


def hold(c: Column) -> Column:
    """The same value, in a projection below which no filter is pushed.

    A filter on a late column would carry the expressions of all stages below it, each as often as it is named.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def _is(names: Iterable[str]) -> Column:
    """Whether a row is of one of these fields."""
    return F.col("ordinal").isin([ORDINAL[n] for n in names])


def _told() -> dict[str, Column]:
    """What the registry tells of a row's field."""
    return {n: F.get(F.array(*[F.lit(getattr(f, of)) for f in BY_NAME.values()]), F.col("ordinal")) for n, of in (("field", "name"), ("ftype", "ftype"), ("critical", "critical"))}


def judge_rows(rows: DataFrame, fields: Iterable[str], threshold: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """rows(ordinal, gt_raw, pred_raw[, gt_text], ...) with field, ftype, critical, outcome, format_error, gt_norm, pred_norm, similarity.

    ordinal is a field's place in the registry, one of `fields`; gt_text is the truth's canonical text where it is known
    already, else it is worked out. Rows are not moved.
    """
    names = list(fields)
    by_kind: dict[str, list[str]] = {}
    for n in names:
        by_kind.setdefault(N.kind_of(BY_NAME[n].ftype, n), []).append(n)
    known = "gt_text" in rows.columns

    def plain(c: Column) -> Column:
        return F.coalesce(*[F.when(_is(of), N.plain(k, c)) for k, of in by_kind.items()])

    def read(c: Column) -> Column:
        """struct(value, ok) of the texts that need the steps of their type."""
        out = F
        for k, of in by_kind.items():
            out = out.when(_is(of) & c.isNotNull(), N.read(k, c))
        return out

    # Texts in a common shape pass the steps by. The others are read by one expression, which is only worked out for them:
    # as projections of all rows the steps made methods that are too long for the JVM's compiler.
    r = rows.withColumns({"__p_seen": plain(F.col("pred_raw")), "__p_truth": F.col("gt_text") if known else plain(F.col("gt_raw"))})
    r = r.withColumns({"__tn": F.col("__p_truth").isNull() & N.is_null_token(F.col("gt_raw")), "__sn": F.col("__p_seen").isNull() & N.is_null_token(F.col("pred_raw"))})
    sides = {"__seen": F.when(F.col("__p_seen").isNull() & ~F.col("__sn"), F.col("pred_raw"))}
    sides |= {} if known else {"__truth": F.when(F.col("__p_truth").isNull() & ~F.col("__tn"), F.col("gt_raw"))}
    r = r.withColumns(sides).withColumns({f"{side}_read": read(F.col(side)) for side in sides})

    def text(side: str) -> Column:
        return F.coalesce(f"__p{side[1:]}", f"{side}_read.value")

    bad = ~F.coalesce("__seen_read.ok", F.lit(True))
    r = r.withColumns({"__s": hold(text("__seen")), "__bad": bad & ~F.col("__sn"), "__t": F.col("gt_text") if known else text("__truth")})
    zero = [n for n in names if BY_NAME[n].zero_is_null]
    r = N.staged(r, {"__null": _adjust(_is(zero) if zero else False, F.col("__t"), F.col("__s"), F.col("__tn"), F.col("__sn"))})
    r = r.withColumn("__same", F.coalesce(F.col("__t") == F.col("__s"), F.lit(False)))
    fuzzy = [n for n in names if BY_NAME[n].ftype == "fuzzy"]
    if fuzzy:  # equal texts need no comparison, so Python sees few rows that are not null
        ship_code(rows.sparkSession)
        due = _is(fuzzy) & ~F.col("__null") & ~F.col("__null_ok")
        r = r.withColumn("__u", fuzzy_score(F.when(due & ~F.col("__same"), F.col("__t")), F.when(due & ~F.col("__same"), F.col("__s"))))
        r = r.withColumn("similarity", F.when(due, F.when(F.col("__same"), 100.0).otherwise(F.col("__u"))))
        equal = F.when(_is(fuzzy), F.coalesce(F.col("similarity") >= threshold, F.lit(False))).otherwise(F.col("__same"))
    else:
        r, equal = r.withColumn("similarity", F.lit(None).cast("double")), F.col("__same")

    r = r.withColumns(_told() | {
        "outcome": _outcome(F.col("__null"), F.col("__null_ok"), F.col("__bad"), equal), "format_error": F.col("__bad"),
        "gt_norm": F.when(~F.col("__null"), F.col("__t")), "pred_norm": F.when(~F.col("__null_ok"), F.col("__s")),
    })
    return r.select(*[c for c in r.columns if not c.startswith("__") and c != "gt_text"])


def _entry(f: Field, truth: Column, seen: Column, text: Column | None = None, row: Column | None = None) -> Column:
    parts = [F.lit(ORDINAL[f.name]).alias("ordinal"), truth.alias("gt_raw"), seen.alias("pred_raw")]
    parts += [] if text is None else [text.alias("gt_text")]
    parts += [] if row is None else [row.alias("row")]
    return F.struct(*parts)


def field_results(pairs: DataFrame, keys: Iterable[str], fields: Iterable[str], row: str | None = None, carry: Iterable[str] = ()) -> DataFrame:
    """One row for each field of each row of `pairs`, which has columns gt_<field> and pred_<field>.

    `row` names a line index column (null: header; -1: a predicted line without a true one). Truth that was prepared
    (gn_<field>) is not normalised again. `carry` names columns that each row keeps besides the keys.
    """
    keys, names = [*keys, *carry], list(fields)
    known = all(f"gn_{n}" in pairs.columns for n in names)
    each = [_entry(BY_NAME[n], F.col(f"gt_{n}").cast("string"), F.col(f"pred_{n}").cast("string"), F.col(f"gn_{n}") if known else None) for n in names]
    line = F.col(row).cast("int") if row else F.lit(None).cast("int")
    return judge_rows(pairs.select(*keys, line.alias("row"), F.explode(F.array(*each)).alias("f")).select(*keys, "row", "f.*"), names)


#: Amounts that need no reading but a cast, as they are and behind a currency; texts that are their own canonical form.
_PLAIN = {"money": r"[0-9]{1,15}(?:\.[0-9]{1,2})?", "quantity": r"[0-9]{1,15}(?:\.[0-9]{1,3})?"}
_PLAIN_CODE, _PLAIN_WORDS = "^[0-9A-Z]*[0-9][0-9A-Z]*$", "^[a-z0-9]+(?: [a-z0-9]+)*$"


def _for_matching(f: Field, x: Column) -> Column:
    """A line value as lines are matched by it. Within arrays the steps of a type are costly, so plain texts pass them by."""
    kind = N.kind_of(f.ftype, f.name)
    whole = N.normalize(f.ftype, x, f.name)["value"].cast("double" if f.ftype in NUMBERS else "string")
    if kind in _PLAIN:
        return F.when(x.isNull(), None).when(x.rlike(f"^{_PLAIN[kind]}$"), x.cast("double")).when(x.rlike(f"^Rs\\. {_PLAIN[kind]}$"), x.substr(F.lit(5), F.length(x)).cast("double")).otherwise(whole)
    if kind == "exact_alnum":
        return F.when(x.rlike(_PLAIN_CODE), x).otherwise(whole)
    if kind == "fuzzy":
        return F.when(x.rlike(_PLAIN_WORDS) & ~x.rlike(K.LEGAL_SUFFIX) & ~x.isin(*K.NULL_TOKENS), x).otherwise(whole)
    return whole


def _lines_for_matching(items: Column) -> Column:
    """Line structs of texts as the normalised values by which lines are matched."""
    names = ("description", "hsn_sac", "taxable_value", "quantity", "unit_price")
    return F.transform(items, lambda x: F.struct(*[_for_matching(BY_NAME[n], x[n]).alias(n) for n in names]))


def score_documents(docs: DataFrame, keys: Iterable[str]) -> DataFrame:
    """All field rows of whole documents: docs(keys, truth, seen, schema_violation) with records as structs of texts.

    A record has the header fields and line_items, an array of structs of the line fields; fields that a struct lacks are
    null. An unreadable output (seen is null) is not left out: all its fields are missing. Lines are matched, missing lines
    are compared with null and spurious ones are row -1; merged and split lines are counted in `structure` alone.
    Each row carries schema_violation and structure, so that documents need no second pass. Null lines are dropped.
    """
    keys = list(keys)

    def record(side: str) -> tuple[set[str], set[str]]:
        kind = docs.schema[side].dataType
        lines = kind["line_items"].dataType.elementType.names if "line_items" in kind.names else []
        return set(kind.names), set(lines)

    (t_head, t_line), (s_head, s_line) = record("truth"), record("seen")
    empty = "array<struct<" + ",".join(f"{f.name}:string" for f in LINE) + ">>"

    def items(side: str, head: set[str], line: set[str]) -> Column:
        if "line_items" not in head:
            return F.array().cast(empty)
        whole = F.transform(F.filter(F.col(f"{side}.line_items"), lambda x: x.isNotNull()), lambda x: F.struct(*[(x[f.name].cast("string") if f.name in line else F.lit(None).cast("string")).alias(f.name) for f in LINE]))
        return F.coalesce(whole, F.array().cast(empty))

    ship_code(docs.sparkSession)
    d = docs.withColumns({"__t": items("truth", t_head, t_line), "__s": items("seen", s_head, s_line)})
    d = d.withColumns({"__a": _lines_for_matching(F.col("__t")), "__b": _lines_for_matching(F.col("__s"))})
    d = d.withColumn("__m", match_lines("__a", "__b")).withColumn("__m", hold(F.col("__m")))
    structure = F.struct(
        F.size("__m.merges").alias("merges"), F.size("__m.splits").alias("splits"), F.size("__m.missing").alias("missing_rows"),
        F.size("__m.spurious").alias("spurious_rows"), F.size("__t").alias("rows_gt"), F.size("__s").alias("rows_pred"),
    )
    none = F.lit(None).cast("string")

    def side(name: str, head: set[str], f: Field) -> Column:
        return F.col(f"{name}.{f.name}").cast("string") if f.name in head else none

    header = F.array(*[_entry(f, side("truth", t_head, f), side("seen", s_head, f), None, F.lit(None).cast("int")) for f in HEADER])
    absent = F.lit(None).cast("struct<" + ",".join(f"{f.name}:string" for f in LINE) + ">")
    rows = F.concat(
        F.transform("__m.pairs", lambda p: F.struct(p["truth"].alias("row"), F.get(F.col("__t"), p["truth"]).alias("t"), F.get(F.col("__s"), p["seen"]).alias("s"))),
        F.transform("__m.missing", lambda i: F.struct(i.alias("row"), F.get(F.col("__t"), i).alias("t"), absent.alias("s"))),
        F.transform("__m.spurious", lambda j: F.struct(F.lit(-1).alias("row"), absent.alias("t"), F.get(F.col("__s"), j).alias("s"))),
    )
    line = F.flatten(F.transform(rows, lambda r: F.array(*[_entry(f, r["t"][f.name], r["s"][f.name], None, r["row"]) for f in LINE])))
    # Fields that are null on both sides are judged as one row and come apart behind it.
    place = lambda e: F.struct(e["ordinal"].alias("ordinal"), e["row"].alias("row"))
    both = lambda e: e["gt_raw"].isNull() & e["pred_raw"].isNull()
    whole = d.select(*keys, "schema_violation", structure.alias("structure"), F.concat(header, line).alias("__e"))
    there = F.transform(F.filter("__e", lambda e: ~both(e)), lambda e: F.struct(e["ordinal"].alias("ordinal"), e["gt_raw"].alias("gt_raw"), e["pred_raw"].alias("pred_raw"), F.array(place(e)).alias("places")))
    absent = F.struct(F.lit(0).alias("ordinal"), none.alias("gt_raw"), none.alias("pred_raw"), F.transform(F.filter("__e", both), place).alias("places"))
    long = whole.select(*keys, "schema_violation", "structure", F.explode(F.concat(there, F.array(absent))).alias("f")).select(*keys, "schema_violation", "structure", "f.*")
    judged = judge_rows(long, BY_NAME).drop("ordinal")
    out = judged.select("*", F.explode("places").alias("p")).select("*", "p.*").drop("p", "places").withColumns(_told())
    first = [*keys, "schema_violation", "structure", "ordinal", "gt_raw", "pred_raw", "row"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def due(populated_only: bool = True) -> Column:
    """Fields that accuracy is over: those with a true value, or all."""
    return F.col("outcome").isin(CORRECT, WRONG, MISSING) if populated_only else F.lit(True)


def right(populated_only: bool = True) -> Column:
    return (F.col("outcome") == CORRECT) if populated_only else F.col("outcome").isin(CORRECT, ABSENT_OK)


def accuracy(group: str | None = None, field: str | None = None, populated_only: bool = True) -> Column:
    """Correct over due fields, of the header or the line items or one field if asked; null where nothing is due."""
    of = F.lit(True)
    if group:
        of = F.col("row").isNull() if group == "header" else F.col("row").isNotNull()
    if field:
        of = of & (F.col("field") == field)
    return F.try_divide(F.count_if(of & right(populated_only)).cast("double"), F.count_if(of & due(populated_only)).cast("double"))


def share_exact() -> Column:
    return F.avg(F.col("exact").cast("double"))


def hallucination_rate() -> Column:
    made = F.count_if(F.col("outcome").isin(WRONG, SPURIOUS))
    return F.try_divide(made.cast("double"), (made + F.count_if(F.col("outcome") == MISSING)).cast("double"))


def structural(s: Column) -> Column:
    return s["merges"] + s["splits"] + s["missing_rows"] + s["spurious_rows"]


def document_results(results: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row a document: exact and critical_exact, the number of fields and of each outcome.

    A document is exact if all its (critical) fields are right, its output was no violation and its lines match one to
    one; the latter two are judged where the results carry them (`score_documents`) and are given beside.
    """
    ok = F.col("outcome").isin(CORRECT, ABSENT_OK)
    whole = [c for c in ("schema_violation", "structure") if c in results.columns]
    counts = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES]
    d = results.groupBy(*keys).agg(F.every(ok).alias("exact"), F.every(ok | ~F.col("critical")).alias("critical_exact"), F.count("*").alias("n_fields"), *counts, *[F.first(c).alias(c) for c in whole])
    clean = F.lit(True)
    if "schema_violation" in whole:
        clean = clean & F.col("schema_violation").isNull()
    if "structure" in whole:
        clean = clean & (structural(F.col("structure")) == 0)
    return d.withColumns({"exact": F.col("exact") & clean, "critical_exact": F.col("critical_exact") & clean}) if whole else d


def rates_by(docs: DataFrame, by: Iterable[str]) -> DataFrame:
    """accuracy, hallucination and exact of groups of documents, from the counts of document_results."""
    c, w, m, s = (F.sum(f"n_{o}") for o in (CORRECT, WRONG, MISSING, SPURIOUS))
    return docs.groupBy(*by).agg(
        F.try_divide(c.cast("double"), (c + w + m).cast("double")).alias("accuracy"), F.try_divide((w + s).cast("double"), (w + s + m).cast("double")).alias("hallucination"),
        share_exact().alias("exact"), F.avg(F.col("critical_exact").cast("double")).alias("critical_exact"), F.count("*").alias("n"),
    )


def field_table(results: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Field by outcome counts, with format errors."""
    return results.groupBy(*keys, "field").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count_if("format_error").alias("format_errors"))


def with_calls(docs: DataFrame, calls: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Scored documents with finish_reason and refusal of their call: null and false where there is none, the greatest of several."""
    keys = list(keys)
    call = calls.groupBy(*keys).agg(F.max("finish_reason").alias("finish_reason"), F.bool_or("refusal").alias("refusal"))
    return docs.join(call, keys, "left").withColumn("refusal", F.coalesce("refusal", F.lit(False)))
