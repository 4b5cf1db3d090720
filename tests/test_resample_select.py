"""Bootstrap by hashes against the kernel, exact ranks against sorting."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from fieldwright.operators import compare, report, resample, select


def test_weights_are_poisson(spark):
    cells = spark.range(20_000).select(F.lit("x").alias("x"), F.col("id").alias("cluster"))
    one, two = resample.cluster_hashes(F.col("cluster"))
    cells = cells.select(one.alias("__one"), two.alias("__two"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("__draw"))
    w = resample.with_times(cells, 7)
    got = {r["__times"]: r["count"] / 200_000 for r in w.groupBy("__times").count().collect()}
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613, 0.0153)):
        assert abs(got[k] - p) < 0.005
    by_draw = w.groupBy("__draw").agg(F.sum("__times").alias("n")).collect()
    assert all(abs(r["n"] - 20_000) < 900 for r in by_draw) and len({r["n"] for r in by_draw}) > 5
    m = w.groupBy("__one", "__two").pivot("__draw", list(range(10))).agg(F.first("__times")).drop("__one", "__two").toPandas().to_numpy(float)
    assert np.abs(np.corrcoef(m.T) - np.eye(10)).max() < 0.05  # draws are independent


def test_weights_of_many_draws_are_those_of_the_columns(spark):
    hashes = [0, 1, 7, 123_456_789, resample.PRIME - 1, 268_435_455]
    cells = spark.createDataFrame([(d, a, b) for d in range(300) for a in hashes for b in hashes], "__draw long, __one long, __two long")
    rows = resample.with_times(cells, 20260101).collect()
    one, two = (np.array([x for a in hashes for b in hashes for x in ((a, b)[i],)]) for i in (0, 1))
    times = resample.times_of(one, two, np.arange(300), 20260101)
    got = {(d, int(a), int(b)): int(times[i, d]) for i, (a, b) in enumerate(zip(one, two, strict=True)) for d in range(300)}
    assert {(r["__draw"], r["__one"], r["__two"]): r["__times"] for r in rows} == got and max(got.values()) > 3


def test_accuracy_has_all_its_draws(spark, sf, monkeypatch):
    from fieldwright.plans import catalog, reports

    seen = []
    own = resample.hash_bootstrap
    monkeypatch.setattr(reports.B, "hash_bootstrap", lambda *a, **k: seen.append(a) or own(*a, **k))
    catalog.queries()["bootstrap_by_hash"](spark, sf)
    assert seen[0][4:] == (1000,) and "range(0, 1000) r(draw)" in catalog.oracle_sql()["bootstrap_by_hash"]


def test_sums_that_a_task_sends_on_are_added(spark, monkeypatch):
    rows = [(g, c, float(c % 5), 5.0) for g in ("a", "b", None) for c in range(900)]
    clusters = spark.createDataFrame(rows, "g string, cluster long, num double, den double")
    whole = sorted(map(str, resample.hash_bootstrap(clusters, ["g"], ["num", "den"], resample.ratio, 40).collect()))
    monkeypatch.setattr(resample, "_CELLS", 400)
    monkeypatch.setattr(resample, "_HELD", 1)
    few = resample.hash_bootstrap(clusters, ["g"], ["num", "den"], resample.ratio, 40)
    assert sorted(map(str, few.collect())) == whole and len(whole) == 3


def test_intervals_are_near_the_kernels(spark):
    r = random.Random(3)
    rows = [(g, i, float(r.randint(0, 30 if g == "a" else 20)), 30.0) for g in ("a", None) for i in range(400)]
    clusters = spark.createDataFrame(rows, "g string, cluster long, num double, den double")
    got = {x["g"]: x for x in resample.hash_bootstrap(clusters, ["g"], ["num", "den"], resample.ratio, 1500).collect()}
    for g in ("a", None):
        own = [(n, d) for k, _, n, d in rows if k == g]
        point, lo, hi = compare.bootstrap_interval(np.array([n for n, _ in own]), np.array([d for _, d in own]), 4000, 0.05, 5)
        assert got[g]["n_clusters"] == 400 and abs(got[g]["point"] - point) < 1e-9
        assert abs(got[g]["lo"] - lo) < 0.08 * (hi - lo) and abs(got[g]["hi"] - hi) < 0.08 * (hi - lo)


def test_a_million_clusters_and_no_value(spark):
    many = spark.range(1_000_000).select(F.lit("m").alias("g"), F.col("id").alias("cluster"), (F.col("id") % 2).cast("double").alias("num"), F.lit(1.0).alias("den"))
    none = spark.createDataFrame([("z", None, 0.0, 0.0), ("z", 1, None, None)], "g string, cluster long, num double, den double")
    got = {r["g"]: r for r in resample.hash_bootstrap(many.unionByName(none), ["g"], ["num", "den"], resample.ratio, 20).collect()}
    assert got["m"]["n_clusters"] == 1_000_000 and 0.498 < got["m"]["lo"] < 0.5 < got["m"]["hi"] < 0.502
    assert got["z"]["n_clusters"] == 2 and got["z"]["lo"] is None and got["z"]["point"] is None
    again = resample.hash_bootstrap(many, ["g"], ["num", "den"], resample.ratio, 20).first()
    assert again["lo"] == got["m"]["lo"]
    assert resample.hash_bootstrap(none.where("g = 'x'"), ["g"], ["num", "den"], resample.ratio, 20).count() == 0


def test_picks_are_those_of_sorting(spark):
    r = random.Random(8)
    rows = [("even", r.uniform(-5, 5)) for _ in range(900)] + [("ties", float(r.randint(0, 3))) for _ in range(500)] + [("tail", r.random() ** -4) for _ in range(700)]
    rows += [(None, 4.0), (None, 2.0), ("one", 1.5), ("even", None), ("even", float("nan")), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    ranks = {"least": lambda n: F.lit(0), "p50": lambda n: F.floor(n / 2), "p95": lambda n: F.least(n - 1, F.floor(n * 0.95)), "most": lambda n: n - 1}
    for levels, ranges in ((2, 4096), (1, 3), (3, 2)):
        got = {x["g"]: tuple(x)[1:] for x in select.rank_picks(frame, ["g"], "v", ranks, levels, ranges).collect()}
        assert set(got) == {"even", "ties", "tail", "one", None}
        for g, picked in got.items():
            v = sorted(x for k, x in rows if k == g and x is not None and x == x)
            assert picked == (v[0], v[len(v) // 2], v[min(len(v) - 1, int(len(v) * 0.95))], v[-1])
    assert select.rank_picks(frame.where("v > 1e300"), ["g"], "v", ranks).count() == 0


def test_costs_of_a_group_of_one_call(spark):
    calls = spark.createDataFrame([("m", 2.0, 10, 5, 0.5)], "model string, latency double, tin int, tout int, cost double")
    r = report.cost_summary(calls, "model", "latency", "tin", "tout", "cost").first()
    assert (r["n"], r["p50"], r["p95"], r["per_1000"]) == (1, 2.0, 2.0, 500.0)
