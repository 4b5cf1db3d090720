"""Error categories of failing fields, first matching rule wins; samples for review."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.functions.normalize import let
from fieldwright.functions.similarity import char_misread
from fieldwright.operators import score as S

CATEGORIES = (
    "refusal", "schema_violation", "truncated_output", "line_item_merge", "line_item_split", "field_confusion",
    "character_misread", "format_error", "omission", "fabricated_on_null", "wrong_value",
)


def with_truths(results: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Results that lack `truths` get them: the true header values of their document, in field order."""
    keys = list(keys)
    kind = F.when(F.col("ftype").isin(*S.NUMBERS), "number").when(F.col("ftype") == "bool", "bool").otherwise("text")
    own = F.struct("ordinal", "field", kind.alias("family"), F.col("gt_norm").alias("value"))
    each = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("row").isNull() & F.col("gt_norm").isNotNull(), own))).alias("truths"))
    matched = [results[k].eqNullSafe(each[k]) for k in keys]
    return results.join(each, reduce(and_, matched)).select(results["*"], each["truths"])


def findings(results: DataFrame, keys: Iterable[str]) -> DataFrame:
    """One row for each failing field: category, other (the field whose true value it is), needs_review.

    A wrong value that is the truth of another header field of its document is a confusion with the first such field in
    field order. Results that carry `truths` (score.truths) need no join; others are gathered by document first.
    """
    keys = list(keys)
    r = results if "truths" in results.columns else with_truths(results, keys)
    failing = r.where(F.col("outcome").isin("wrong", "missing", "spurious"))
    kind = F.when(F.col("ftype").isin(*S.NUMBERS), "number").when(F.col("ftype") == "bool", "bool").otherwise("text")
    same = F.filter("truths", lambda x: (x["value"] == F.col("pred_norm")) & (x["field"] != F.col("field")) & (x["family"] == kind))
    sought = (F.col("outcome") != "missing") & ~F.col("format_error") & F.col("pred_norm").isNotNull()
    misread = char_misread(F.col("gt_norm"), F.col("pred_norm"))
    found = failing.withColumn("other", S.hold(F.when(sought, F.get(same, F.lit(0))["field"]))).drop("truths")
    found = found.withColumn("known_glyph", F.when((F.col("outcome") == "wrong") & ~F.col("format_error") & F.col("other").isNull(), misread))
    category = (
        F.when(F.col("outcome") == "missing", "omission")
        .when((F.col("outcome") == "wrong") & F.col("format_error"), "format_error")
        .when(F.col("other").isNotNull(), "field_confusion")
        .when(F.col("outcome") == "spurious", "fabricated_on_null")
        .when(F.col("known_glyph").isNotNull(), "character_misread")
        .otherwise("wrong_value")
    )
    out = found.withColumn("category", category)
    return out.withColumn("needs_review", F.col("category") == "wrong_value")


def document_findings(docs: DataFrame) -> DataFrame:
    """Findings about whole outputs: docs(..., refusal, schema_violation, finish_reason, merges, splits)."""
    cut = (F.col("schema_violation") == "truncated_output") | (F.col("finish_reason") == "length")
    whole = F.when(F.coalesce(F.col("refusal"), F.lit(False)), "refusal").when(F.coalesce(cut, F.lit(False)), "truncated_output").when(F.col("schema_violation").isNotNull(), "schema_violation")
    each = F.when(whole == "refusal", F.array(whole)).otherwise(
        F.concat(
            F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array().cast("array<string>")),
            F.array_repeat(F.lit("line_item_merge"), F.coalesce("merges", F.lit(0)).cast("int")),
            F.array_repeat(F.lit("line_item_split"), F.coalesce("splits", F.lit(0)).cast("int")),
        )
    )
    return docs.withColumn("category", F.explode(each))


def _family() -> Column:
    return F.when(F.col("ftype").isin(*S.NUMBERS), "number").when(F.col("ftype") == "bool", "bool").otherwise("text")


_FINDING = "struct<field:string,row:int,category:string,detail:string,gt:string,pred:string>"


def _said(field, row, category, detail, gt=None, pred=None) -> Column:
    parts = {"field": field, "row": row, "category": category, "detail": detail, "gt": gt, "pred": pred}
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in parts.items()]).cast(_FINDING)


def _field_finding(x: Column, truths: Column) -> Column:
    """The finding of one failing field, most specific rule first. Categories and details are fixed values."""
    same = F.filter(truths, lambda t: (t["value"] == x["pred_norm"]) & (t["field"] != x["field"]) & (t["family"] == x["family"]))

    def judged(other: Column, misread: Column) -> Column:
        at = lambda category, detail, gt=x["gt_norm"], pred=x["pred_norm"]: _said(x["field"], x["row"], category, detail, gt, pred)
        owner, none = F.concat(F.lit("value belongs to '"), other, F.lit("'")), F.lit(None).cast("string")
        wrong = (
            F.when(x["format_error"], at("format_error", "unparseable as its type", pred=x["pred_raw"]))
            .when(other.isNotNull(), at("field_confusion", owner))
            .when(misread.isNotNull(), at("character_misread", F.when(misread, "known glyph confusion").otherwise("small edit distance")))
            .otherwise(at("wrong_value", "needs review"))
        )
        spurious = F.when(other.isNotNull(), at("field_confusion", owner, none)).otherwise(at("fabricated_on_null", "invented a value where the truth is null", none))
        missing = at("omission", "returned null where a value is printed", pred=none)
        return F.when(x["outcome"] == S.MISSING, missing).when(x["outcome"] == S.SPURIOUS, spurious).otherwise(wrong)

    found = F.struct(F.get(same, F.lit(0))["field"].alias("other"), char_misread(x["gt_norm"], x["pred_norm"]).alias("misread"))
    return let(found, lambda f: judged(f["other"], f["misread"]))


def classify_documents(results: DataFrame, keys: Iterable[str], calls: DataFrame | None = None, call_keys: Iterable[str] | None = None) -> DataFrame:
    """The findings of each document, in order: keys, place, field, row, category, detail, gt, pred, needs_review.

    results are field rows as `score.score_documents` gives them (with schema_violation and structure); calls(call_keys,
    finish_reason, refusal) tell how the call of a document ended. A refusal is a document's only finding. Else it has one
    for output that was cut off, or for another violation, one for each merged and each split line, and one for each
    failing field: of the header in field order, then of lines in order, rows without a true line last. A document
    without a failing field or a fault has no row. A document's failing fields and true header values meet in one row.
    """
    keys = list(keys)
    failing = F.col("outcome").isin(S.WRONG, S.MISSING, S.SPURIOUS)
    order = F.when(F.col("row").isNull(), -1).when(F.col("row") < 0, 1 << 30).otherwise(F.col("row"))
    own = F.struct(order.alias("at"), "ordinal", "field", "row", _family().alias("family"), "outcome", "format_error", "gt_norm", "pred_norm", F.col("pred_raw").cast("string").alias("pred_raw"))
    truth = F.struct("ordinal", "field", _family().alias("family"), F.col("gt_norm").alias("value"))
    d = results.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(failing, own))).alias("failing"), F.array_sort(F.collect_list(F.when(F.col("row").isNull() & F.col("gt_norm").isNotNull(), truth))).alias("truths"),
        F.first("schema_violation").alias("schema_violation"), F.first("structure").alias("structure"),
    )
    if calls is None:
        d = d.withColumns({"finish_reason": F.lit(None).cast("string"), "refusal": F.lit(False)})
    else:
        d = S.with_calls(d, calls, call_keys or keys)
    none = F.array().cast(f"array<{_FINDING}>")
    cut = F.coalesce(F.col("schema_violation") == "truncated_output", F.lit(False)) | F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    output = F.when(cut, F.array(_said("*", None, "truncated_output", "output hit the token cap"))).when(F.col("schema_violation").isNotNull(), F.array(_said("*", None, "schema_violation", F.col("schema_violation")))).otherwise(none)
    lines = F.concat(
        F.array_repeat(_said("line_items", None, "line_item_merge", "predicted row spans several printed rows"), F.coalesce("structure.merges", F.lit(0)).cast("int")),
        F.array_repeat(_said("line_items", None, "line_item_split", "printed row split across predictions"), F.coalesce("structure.splits", F.lit(0)).cast("int")),
    )
    each = F.concat(output, lines, F.transform("failing", lambda x: _field_finding(x, F.col("truths"))))
    every = F.when(F.col("refusal"), F.array(_said("*", None, "refusal", "model declined the document"))).otherwise(each)
    found = d.select(*keys, F.posexplode(every).alias("place", "f")).select(*keys, "place", "f.*")
    return found.withColumn("needs_review", F.col("category") == "wrong_value")


def distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("model").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])


def stratified_sample(rows: DataFrame, strata: list[str], k: int, identity: list[str], seed: int = 0) -> DataFrame:
    """At most k rows of each stratum, those of least hash of identity and seed."""
    place = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))))
    w = Window.partitionBy(*strata).orderBy(place, *identity)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
