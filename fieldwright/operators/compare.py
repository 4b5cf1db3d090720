"""Comparisons of models: pairs, McNemar, Holm, cluster bootstrap, detectable differences."""

from __future__ import annotations

import math
from collections.abc import Iterable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldwright.code import ship_code
from fieldwright.operators import score as S


def pairs(models: DataFrame) -> DataFrame:
    """All unordered pairs of the different models."""
    m = models.select("model").distinct()
    return m.select(F.col("model").alias("model_a")).join(m.select(F.col("model").alias("model_b")), F.col("model_a") < F.col("model_b"))


def paired(docs: DataFrame, flag: str = "exact", unit: Iterable[str] = ("level", "doc_id"), order: Iterable[str] = ()) -> DataFrame:
    """Units that two models both have, with both flags: one aggregation by unit, whose models and runs are few.

    Of several runs of a model on one unit the last by `order` counts, among equals the one with the greatest flag (null
    is least); so each pair of models has a unit once. Null units are a unit; a null model pairs with none.
    """
    unit = list(unit)
    run = F.struct("model", F.struct(*[F.col(c) for c in order], F.lit(0).alias("none")).alias("at"), F.col(flag).alias("flag"))
    runs = docs.where(F.col("model").isNotNull()).groupBy(*unit).agg(F.array_sort(F.collect_list(run)).alias("m"))
    last = F.filter("m", lambda a, i: F.coalesce(F.get("m", i + 1)["model"] != a["model"], F.lit(True)))
    m = runs.withColumn("m", F.transform(last, lambda a: F.struct(a["model"].alias("model"), a["flag"].alias("flag"))))
    both = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return m.select(*unit, F.explode(both).alias("p")).select(
        *unit, F.col("p.a.model").alias("model_a"), F.col("p.b.model").alias("model_b"), F.col("p.a.flag").alias(f"{flag}_a"), F.col("p.b.flag").alias(f"{flag}_b")
    )


def mcnemar_counts(pairs_: DataFrame, by: Iterable[str] = (), flag: str = "exact") -> DataFrame:
    a, b = F.col(f"{flag}_a"), F.col(f"{flag}_b")
    return pairs_.groupBy(*by, "model_a", "model_b").agg(F.count_if(a & ~b).alias("n10"), F.count_if(b & ~a).alias("n01"), F.count("*").alias("n"))


def mcnemar_p(n10: int, n01: int) -> float:
    """Exact two-sided binomial up to 24 discordant pairs, else chi-squared with continuity correction."""
    n = n10 + n01
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(n10, n01) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(n10 - n01) - 1) ** 2 / n / 2))


@F.pandas_udf(DoubleType())
def _p(n10: pd.Series, n01: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(n10, n01, strict=True)], dtype=float)


def mcnemar(counts: DataFrame) -> DataFrame:
    ship_code(counts.sparkSession)
    exact = F.when(F.col("n10") + F.col("n01") < 25, "exact binomial").otherwise("chi-squared")
    p = _p("n10", "n01")
    better = F.when(F.col("n10") == F.col("n01"), "no difference").when(F.col("n10") > F.col("n01"), F.col("model_a")).otherwise(F.col("model_b"))
    return counts.withColumns({"p": p, "method": exact, "better": better})


def holm(p: DataFrame, alpha: float = 0.05, by: Iterable[str] = ()) -> DataFrame:
    """p values with adjusted ones and the step-down decision; as many rows as comparisons."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    order = part.orderBy("p", "comparison")
    i, m = F.row_number().over(order), F.count("*").over(part)
    r = p.withColumns({"_left": m - i + 1})
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("p") <= alpha / F.col("_left")
    r = r.withColumns({"rejected": F.every(ok).over(running), "adjusted": F.least(F.lit(1.0), F.max(F.col("p") * F.col("_left")).over(running))})
    return r.drop("_left")


def ratio_by_cluster(results: DataFrame, by: Iterable[str], cluster: str) -> DataFrame:
    """(num, den) of accuracy for each cluster: all that resampling clusters needs."""
    due = F.col("outcome").isin(S.CORRECT, S.WRONG, S.MISSING)
    return results.groupBy(*by, cluster).agg(F.count_if(F.col("outcome") == S.CORRECT).alias("num"), F.count_if(due).alias("den")).withColumnRenamed(cluster, "cluster")


#: Numbers that a block of draws may hold.
BLOCK = 4_000_000


def bootstrap_interval(num: np.ndarray, den: np.ndarray, draws: int, alpha: float, seed: int) -> tuple[float, float, float]:
    """Point and percentile interval of sum(num) / sum(den), resampling clusters.

    A draw of as many clusters as there are is how often each cluster comes; draws are made in blocks, so memory follows
    the clusters and not the draws.
    """
    k = len(num)
    if not k or den.sum() == 0:
        return (float("nan"),) * 3
    r = np.random.default_rng(seed)
    values = []
    for lo in range(0, draws, max(1, BLOCK // k)):
        times = r.multinomial(k, np.full(k, 1 / k), min(max(1, BLOCK // k), draws - lo))
        top, low = times @ num, times @ den
        values.append(top[low > 0] / low[low > 0])
    lo, hi = np.quantile(np.concatenate(values), [alpha / 2, 1 - alpha / 2])
    return float(num.sum() / den.sum()), float(lo), float(hi)


def bootstrap(clusters: DataFrame, by: list[str], draws: int = 10_000, alpha: float = 0.05, seed: int = 20260101) -> DataFrame:
    """point, lo, hi and clusters of each group; a group is one row a cluster."""
    ship_code(clusters.sparkSession)
    types = dict(clusters.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in by) + ", point double, lo double, hi double, n_clusters long"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        point, lo, hi = bootstrap_interval(pdf["num"].to_numpy(float), pdf["den"].to_numpy(float), draws, alpha, seed)
        return pd.DataFrame([(*key, point, lo, hi, len(pdf))], columns=[*by, "point", "lo", "hi", "n_clusters"])

    return clusters.groupBy(*by).applyInPandas(run, ddl)


def paired_delta(pairs_: DataFrame, by: list[str], cluster: str, flag: str = "exact") -> DataFrame:
    """(num, den) of the mean difference of two models' flags for each cluster, for bootstrap()."""
    d = F.col(f"{flag}_a").cast("int") - F.col(f"{flag}_b").cast("int")
    return pairs_.groupBy(*by, cluster).agg(F.sum(d).alias("num"), F.count("*").alias("den")).withColumnRenamed(cluster, "cluster")


def detectable_difference(n: Column, p: float = 0.5, rho: float = 0.0, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.lit(z) * F.sqrt(F.lit(2 * p * (1 - p)) / (n / (1 + rho)))
