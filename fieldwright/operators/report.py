"""Report tables over field and document results."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwright.operators import compare as C
from fieldwright.operators import score as S
from fieldwright.operators.resample import hash_bootstrap, ratio
from fieldwright.operators.select import rank_picks


def error_mix(results: DataFrame) -> DataFrame:
    counts = results.groupBy("model").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in S.OUTCOMES])
    made = F.col("wrong") + F.col("spurious")
    return counts.withColumn("made_share", F.round(F.try_divide(made.cast("double"), (made + F.col("missing")).cast("double")), 6))


def group_accuracy(results: DataFrame, by: Iterable[str]) -> DataFrame:
    """(by, part, accuracy, hallucination, n_due, format_errors) for the header, the lines and all fields, by one aggregation.

    A group without lines has no row for them. The parts are grouping sets, so rows are read and shuffled once.
    """
    by = list(by)
    part = F.when(F.col("row").isNull(), "header").otherwise("line")
    r = results.withColumn("part", part)
    keys = [F.col(c) for c in by]
    sets = r.groupingSets([[*keys, F.col("part")], keys], *keys, F.col("part")).agg(
        F.grouping("part").alias("__all"), S.accuracy().alias("accuracy"), S.hallucination_rate().alias("hallucination"), F.count_if(S.due()).alias("n_due"), F.count_if("format_error").alias("format_errors")
    )
    return sets.withColumn("part", F.when(F.col("__all") == 1, "all").otherwise(F.col("part"))).drop("__all")


def degradation_curve(results: DataFrame, levels: list[str]) -> DataFrame:
    """Accuracy by model and level, and the drop from the first level to the last."""
    by = results.groupBy("model").pivot("level", levels).agg(F.round(S.accuracy(), 6))
    return by.withColumn("accuracy_drop", F.round(F.col(levels[0]) - F.col(levels[-1]), 6))


def leaderboard(results: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Models by accuracy, with the rates of their documents; structural and violation counts where the results carry them."""
    docs = S.document_results(results, keys)
    rates = S.rates_by(docs, ["model"]).select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "hallucination", "exact", "critical_exact")])
    if "structure" in docs.columns:
        s = F.col("structure")
        counted = docs.groupBy("model").agg(F.sum(s["merges"] + s["splits"]).alias("structural_errors"), F.count("schema_violation").alias("schema_violations"))
        rates = rates.join(counted, "model")
    return rates.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last("accuracy"), "model")))


def leaderboard_intervals(results: DataFrame, keys: Iterable[str], cluster: str = "template_id", draws: int = 2000) -> DataFrame:
    """Cluster-bootstrap intervals of a model's measures, a row a measure: field, header and line accuracy, exact matches."""
    docs = S.document_results(results, keys)

    def ratio(rows: DataFrame, name: str, num: Column, den: Column) -> DataFrame:
        return rows.groupBy("model", F.lit(name).alias("measure"), F.col(cluster).alias("cluster")).agg(F.count_if(num).alias("num"), F.count_if(den).alias("den"))

    header, every = F.col("row").isNull(), F.lit(True)
    parts = [ratio(results, n, g & S.right(), g & S.due()) for n, g in (("field_accuracy", every), ("header_accuracy", header), ("line_item_accuracy", ~header))]
    parts += [ratio(docs, n, F.col(n), every) for n in ("exact", "critical_exact")]
    return C.bootstrap(reduce(DataFrame.unionByName, parts), ["model", "measure"], draws)


def pairwise_tests(results: DataFrame, keys: Iterable[str], unit: Iterable[str] = ("level", "doc_id"), cluster: str = "template_id", draws: int = 1000) -> DataFrame:
    """McNemar's test of each pair of models on exact matches of their common documents, with the interval of the difference."""
    docs = S.document_results(results, keys)
    both = C.paired(docs, unit=[*unit, cluster])
    delta = C.bootstrap(C.paired_delta(both, ["model_a", "model_b"], cluster), ["model_a", "model_b"], draws)
    tests = C.mcnemar(C.mcnemar_counts(both))
    return tests.join(delta.select("model_a", "model_b", F.col("point").alias("delta"), "lo", "hi"), ["model_a", "model_b"])


def infra_split(calls: DataFrame, error: str = "error") -> DataFrame:
    """Calls with `failed`: failed calls count as such and are no errors of the model."""
    return calls.withColumn("failed", F.coalesce(F.col(error), F.lit("")) != "")


def cost_summary(calls: DataFrame, by: str, latency: str, tokens_in: str, tokens_out: str, cost: str, inr: float = 83.0) -> DataFrame:
    """Means, totals and picked (not interpolated) percentiles of successful calls; no group is sorted in one place."""
    sums = calls.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(tokens_in), 6).alias("mean_in"), F.round(F.avg(tokens_out), 6).alias("mean_out"),
        F.round(F.sum(cost), 6).alias("total"), F.round(F.sum(cost) / F.count("*") * 1000, 6).alias("per_1000"), F.round(F.sum(cost) / F.count("*") * 1000 * inr, 6).alias("per_1000_inr"),
    )
    picks = rank_picks(calls, [by], latency, {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.least(n - 1, F.floor(n * 0.95))})
    other = picks.withColumnRenamed(by, "__by")
    return sums.join(other, sums[by].eqNullSafe(other["__by"]), "left").select(by, "n", "mean_in", "mean_out", "p50", "p95", "total", "per_1000", "per_1000_inr")


def repeat_variance(runs: DataFrame, unit: list[str], value: str, score: Column, by: str) -> DataFrame:
    """Over units with several runs: how many have different values, and the spread of a score."""
    groups = runs.groupBy(*unit).agg(F.count_distinct(value).alias("kinds"), (F.max(score) - F.min(score)).alias("spread"), F.count("*").alias("runs")).where("runs > 1")
    return groups.groupBy(by).agg(F.count("*").alias("groups"), F.count_if(F.col("kinds") > 1).alias("disagreeing"), F.max("spread").alias("most"), F.round(F.avg("spread"), 6).alias("mean"))


def repeat_fields(results: DataFrame, unit: list[str], run: str, by: list[str], failed: Column | None = None) -> DataFrame:
    """How far repeated runs on one input agree: header fields with different values, and the spread of a document's accuracy.

    n_repeated counts units of several runs; the other measures leave failed runs out, and units with fewer than two
    runs then. A null value is a value; units where nothing was due have no spread.
    """
    seen = F.when(F.col("row").isNull(), F.struct("field", "pred_norm"))  # collect_set leaves out the null of other rows
    lost = F.lit(False) if failed is None else failed
    runs = results.groupBy(*unit, run).agg(S.accuracy().alias("score"), F.collect_set(seen).alias("seen"), F.bool_or(lost).alias("lost"))
    good = lambda c: F.when(~F.col("lost"), c)
    units = runs.groupBy(*unit).agg(
        F.count("*").alias("runs"), F.count_if(~F.col("lost")).alias("used"), (F.max(good(F.col("score"))) - F.min(good(F.col("score")))).alias("spread"),
        F.array_distinct(F.flatten(F.collect_list(good(F.col("seen"))))).alias("seen"),
    ).where("runs > 1")
    names = F.transform("seen", lambda x: x["field"])
    counted = units.withColumn("names", names).withColumn("fields", F.array_distinct("names"))
    differ = F.size(F.filter("fields", lambda f: F.size(F.filter("names", lambda x: x == f)) > 1))
    use = lambda c: F.when(F.col("used") > 1, c)
    return counted.groupBy(*by).agg(
        F.count("*").alias("n_repeated"), F.round(F.try_divide(F.sum(use(differ)).cast("double"), F.sum(use(F.size("fields"))).cast("double")), 6).alias("field_disagreement"),
        F.round(F.avg(use(F.col("spread"))), 6).alias("mean_spread"), F.round(F.max(use(F.col("spread"))), 6).alias("most_spread"),
    )


def curve_points(results: DataFrame, levels: list[str]) -> DataFrame:
    """Points of the degradation chart: (line: models by accuracy at the first level, model, x, level, accuracy). No rows without these levels."""
    points = results.where(F.col("level").isin(levels)).groupBy("model", "level").agg(F.round(S.accuracy(), 6).alias("accuracy"))
    x = F.array_position(F.array(*map(F.lit, levels)), F.col("level")).cast("int") - 1
    first = F.coalesce(F.max(F.when(F.col("level") == levels[0], F.col("accuracy"))).over(Window.partitionBy("model")), F.lit(0.0))
    placed = points.withColumn("x", x).withColumn("first", first)
    return placed.select(F.dense_rank().over(Window.orderBy(F.desc("first"), "model")).alias("line"), "model", "x", "level", "accuracy")


def error_shares(results: DataFrame) -> DataFrame:
    """Segments of the error chart: each kind's share of a model's errors, from left to right, 0 where a model made none."""
    kinds = (S.MISSING, S.WRONG, S.SPURIOUS)
    counts = error_mix(results)
    total = F.greatest(F.col(S.MISSING) + F.col(S.WRONG) + F.col(S.SPURIOUS), F.lit(1)).cast("double")
    segments = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.round(F.col(k) / total, 6).alias("share")) for i, k in enumerate(kinds)])
    return counts.select("model", F.inline(segments))


def cost_points(costs: DataFrame, accuracies: DataFrame, key: str = "model") -> DataFrame:
    """Points of the cost chart, cheapest first; a model without either value has no point."""
    return costs.join(accuracies, key).select(key, "per_1000", "accuracy").where("per_1000 IS NOT NULL AND accuracy IS NOT NULL").orderBy("per_1000", key)


def _percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.1f%%", 100 * c)).otherwise("—")  # a null would be written as a word


def leaderboard_table(results: DataFrame, keys: Iterable[str], calls: DataFrame | None = None, cluster: str = "template_id", draws: int = 1000) -> DataFrame:
    """The leaderboard as text cells, best field accuracy first: place, model, n, failed, and each measure with its interval.

    calls(model, error) tell how many calls of a model failed; without them, and for models that they lack, the cell is
    empty, so that a row of few documents doesn't look like one of all. Intervals are by hash weights over clusters, so no
    model's clusters meet in one place. A measure that nothing was due for is a dash.
    """
    docs = S.document_results(results, keys)
    header, every = F.col("row").isNull(), F.lit(True)

    def sums(rows: DataFrame, name: str, num: Column, den: Column) -> DataFrame:
        return rows.groupBy("model", F.lit(name).alias("measure"), F.col(cluster).alias("cluster")).agg(F.count_if(num).alias("num"), F.count_if(den).alias("den"))

    parts = [sums(results, n, g & S.right(), g & S.due()) for n, g in (("field_accuracy", every), ("header_accuracy", header), ("line_item_accuracy", ~header))]
    parts += [sums(docs, n, F.col(n), every) for n in ("exact", "critical_exact")]
    ends = hash_bootstrap(reduce(DataFrame.unionByName, parts), ["model", "measure"], ["num", "den"], ratio, draws)
    held = F.when(F.col("lo").isNotNull(), F.format_string(" [%.1f, %.1f]", 100 * F.col("lo"), 100 * F.col("hi"))).otherwise("")
    cells = ends.withColumn("cell", F.concat(_percent(F.col("point")), held))
    measures = ["field_accuracy", "header_accuracy", "line_item_accuracy", "exact", "critical_exact"]
    wide = cells.groupBy("model").agg(*[F.coalesce(F.max(F.when(F.col("measure") == m, F.col("cell"))), F.lit("—")).alias(m) for m in measures])
    out = leaderboard(results, keys).select("place", "model", "n", _percent(F.col("hallucination")).alias("hallucination_share")).join(wide, "model")
    if calls is None:
        return out.select("place", "model", "n", F.lit("").alias("failed"), *measures, "hallucination_share").orderBy("place")
    lost = calls.groupBy("model").agg(F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").cast("string").alias("failed"))
    return out.join(lost, "model", "left").select("place", "model", "n", F.coalesce("failed", F.lit("")).alias("failed"), *measures, "hallucination_share").orderBy("place")


def degradation_table(results: DataFrame, levels: list[str]) -> DataFrame:
    """Accuracy by level and the drop from the first to the last as text cells; best at the first level first."""
    curve = degradation_curve(results, levels)
    first = F.coalesce(F.col(levels[0]), F.lit(0.0))
    place = F.row_number().over(Window.orderBy(F.desc("__first"), "model"))
    cells = [_percent(F.col(n)).alias(n) for n in levels]
    drop = F.when(F.col("accuracy_drop").isNotNull(), F.format_string("%.1f pts", 100 * F.col("accuracy_drop"))).otherwise("—").alias("accuracy_drop")
    return curve.withColumn("__first", first).select(place.alias("place"), "model", *cells, drop).orderBy("place")


def cost_table(costs: DataFrame, key: str = "model") -> DataFrame:
    """Rows of `cost_summary` as text cells, halves to even, cheapest first."""
    forms = {"mean_in": (0, "%.0f"), "mean_out": (0, "%.0f"), "p50": (2, "%.2fs"), "p95": (2, "%.2fs"), "per_1000": (2, "$%.2f"), "per_1000_inr": (0, "₹%.0f")}
    place = F.row_number().over(Window.orderBy("per_1000", key))
    return costs.select(place.alias("place"), key, *[F.when(F.col(c).isNotNull(), F.format_string(f, F.bround(c, digits))).otherwise("—").alias(c) for c, (digits, f) in forms.items()]).orderBy("place")


def distribution_table(found: DataFrame, categories: Iterable[str]) -> DataFrame:
    """Findings by category and model: a row a category that any model has, in the order of `categories`, and the totals
    last. Models are columns, in order of name; they are few, and read once."""
    models = [r["model"] for r in found.select("model").distinct().orderBy("model").collect()]
    order = {c: i for i, c in enumerate(categories)}
    place = F.coalesce(*[F.when(F.col("category") == c, i) for c, i in order.items()], F.lit(len(order)))
    counts = [F.count_if(F.col("model").eqNullSafe(F.lit(m))).alias(str(m)) for m in models]
    sets = found.rollup("category").agg(F.grouping("category").alias("__all"), *counts)
    named = sets.withColumn("place", F.when(F.col("__all") == 1, len(order) + 1).otherwise(place))
    label = F.when(F.col("__all") == 1, "total findings").otherwise(F.replace(F.col("category"), F.lit("_"), F.lit(" ")))
    return named.select(F.col("place").cast("int").alias("place"), label.alias("category"), *[F.col(f"`{m}`") for m in models]).orderBy("place")


def to_markdown(table: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A small table as Markdown; more than `most` rows is an error, not a cut."""
    rows = table.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report table")
    lines = [columns, ["---"] * len(columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
