"""Queries over field results: outcomes, accuracy, rates, comparisons of models, findings and samples."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldwright.operators import compare as C
from fieldwright.operators import report as R
from fieldwright.operators import score as S
from fieldwright.operators import taxonomy as X
from fieldwright.operators import triage as G
from fieldwright.plans import invoices as I
from fieldwright.plans.registry import SQL, query

R6 = "round({}, 6)"
ACC = "sum(CASE WHEN outcome = 'correct' THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN outcome IN ('correct', 'wrong', 'missing') THEN 1 ELSE 0 END) AS DOUBLE), 0)"
HAL = "sum(CASE WHEN outcome IN ('wrong', 'spurious') THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN outcome IN ('wrong', 'spurious', 'missing') THEN 1 ELSE 0 END) AS DOUBLE), 0)"
DOCS = "docs AS (SELECT model, level, doc_id, template_id, bool_and(outcome IN ('correct', 'absent_ok')) AS exact, bool_and(outcome IN ('correct', 'absent_ok') OR NOT critical) AS critical_exact FROM results GROUP BY ALL)"


def six(c, name):
    return F.round(c, 6).alias(name)


@query("headline", I.sql(f"SELECT a.model, a.level, accuracy, hallucination, exact FROM (SELECT model, level, round({ACC}, 6) AS accuracy, round({HAL}, 6) AS hallucination FROM results GROUP BY ALL) a JOIN (SELECT model, level, round(avg(CAST(exact AS INT)), 6) AS exact FROM docs GROUP BY ALL) b ON a.model = b.model AND a.level = b.level", I.RESULTS_SQL + ", " + DOCS))
def headline(spark, sf):
    docs = S.document_results(I.results(spark, sf), I.KEYS)
    return S.rates_by(docs, ["model", "level"]).select("model", "level", *[six(F.col(c), c) for c in ("accuracy", "hallucination", "exact")])


@query("field_outcome", I.sql("SELECT model, level, doc_id, field, outcome, format_error FROM results"))
def field_outcome(spark, sf):
    return I.results(spark, sf).select("model", "level", "doc_id", "field", "outcome", "format_error")


@query("doc_exact_match", I.sql("SELECT model, level, doc_id, exact, critical_exact FROM docs", I.RESULTS_SQL + ", " + DOCS))
def doc_exact_match(spark, sf):
    return S.document_results(I.results(spark, sf), I.KEYS).select("model", "level", "doc_id", "exact", "critical_exact")


_COUNTS = ", ".join(f"CAST(sum(CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END) AS BIGINT) AS {o}" for o in S.OUTCOMES)


@query("field_table_pivot", I.sql(f"SELECT model, field, {_COUNTS}, CAST(sum(CAST(format_error AS INT)) AS BIGINT) AS format_errors FROM results GROUP BY ALL"))
def field_table_pivot(spark, sf):
    return S.field_table(I.results(spark, sf), ["model"])


@query("accuracy_overall", I.sql(f"SELECT model, round({ACC}, 6) AS accuracy FROM results GROUP BY ALL"))
def accuracy_overall(spark, sf):
    return I.results(spark, sf).groupBy("model").agg(six(S.accuracy(), "accuracy"))


@query("accuracy_header", I.sql(f"SELECT model, round({ACC}, 6) AS accuracy FROM results GROUP BY ALL"))
def accuracy_header(spark, sf):
    return I.results(spark, sf).groupBy("model").agg(six(S.accuracy("header"), "accuracy"))


@query("accuracy_by_field", I.sql(f"SELECT model, level, field, round({ACC}, 6) AS accuracy FROM results GROUP BY ALL"))
def accuracy_by_field(spark, sf):
    return I.results(spark, sf).groupBy("model", "level", "field").agg(six(S.accuracy(), "accuracy"))


@query("accuracy_rollup", I.sql(f"SELECT model, level, field, round({ACC}, 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM results GROUP BY ROLLUP (model, level, field)"))
def accuracy_rollup(spark, sf):
    return I.results(spark, sf).rollup("model", "level", "field").agg(six(S.accuracy(), "accuracy"), F.count("*").alias("n"))


@query("exact_match_rate", I.sql("SELECT model, level, round(avg(CAST(exact AS INT)), 6) AS exact_rate, round(avg(CAST(critical_exact AS INT)), 6) AS critical_rate FROM docs GROUP BY ALL", I.RESULTS_SQL + ", " + DOCS))
def exact_match_rate(spark, sf):
    d = S.document_results(I.results(spark, sf), I.KEYS)
    return d.groupBy("model", "level").agg(six(S.share_exact(), "exact_rate"), six(F.avg(F.col("critical_exact").cast("double")), "critical_rate"))


@query("hallucination_rate", I.sql(f"SELECT model, level, round({HAL}, 6) AS rate FROM results GROUP BY ALL"))
def hallucination_rate(spark, sf):
    return I.results(spark, sf).groupBy("model", "level").agg(six(S.hallucination_rate(), "rate"))


@query("error_mix", I.sql(f"SELECT *, round((wrong + spurious) / nullif(CAST(wrong + spurious + missing AS DOUBLE), 0), 6) AS made_share FROM (SELECT model, {_COUNTS} FROM results GROUP BY ALL)"))
def error_mix(spark, sf):
    return R.error_mix(I.results(spark, sf))


@query("degradation_curve", I.sql(f"""SELECT *, round("L0_clean" - "L3_harsh", 6) AS accuracy_drop FROM (
  SELECT model, {", ".join(f"round(sum(CASE WHEN outcome = 'correct' AND level = '{n}' THEN 1 ELSE 0 END) / nullif(CAST(sum(CASE WHEN outcome IN ('correct', 'wrong', 'missing') AND level = '{n}' THEN 1 ELSE 0 END) AS DOUBLE), 0), 6) AS \"{n}\"" for n, _, _ in I.LEVELS)} FROM results GROUP BY ALL)"""))
def degradation_curve(spark, sf):
    return R.degradation_curve(I.results(spark, sf), [n for n, _, _ in I.LEVELS])


@query("leaderboard_points", I.sql(f"""SELECT x.model, x.accuracy, x.hallucination, y.n, y.exact, y.critical_exact, CAST(rank() OVER (ORDER BY x.accuracy DESC, x.model) AS INT) AS place FROM (SELECT model, round({ACC}, 6) AS accuracy, round({HAL}, 6) AS hallucination FROM results GROUP BY ALL) x
  JOIN (SELECT model AS m2, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(exact AS INT)), 6) AS exact, round(avg(CAST(critical_exact AS INT)), 6) AS critical_exact FROM docs GROUP BY ALL) y ON x.model = y.m2""", I.RESULTS_SQL + ", " + DOCS))
def leaderboard_points(spark, sf):
    return R.leaderboard(I.results(spark, sf), I.KEYS)


@query("paired_self_join", I.sql("SELECT level, doc_id, min(model) AS model_a, max(model) AS model_b, arg_min(exact, model) AS exact_a, arg_max(exact, model) AS exact_b FROM docs GROUP BY level, doc_id HAVING count(DISTINCT model) = 2", I.RESULTS_SQL + ", " + DOCS))
def paired_self_join(spark, sf):
    return C.paired(S.document_results(I.results(spark, sf), I.KEYS))


@query("paired_last_runs", """WITH e AS MATERIALIZED (SELECT user_id, event_type AS model, arg_max(value > 50, event_id) AS flag FROM events GROUP BY ALL)
  SELECT a.user_id, a.model AS model_a, b.model AS model_b, a.flag AS good_a, b.flag AS good_b FROM e a JOIN e b ON a.user_id = b.user_id AND a.model < b.model""")
def paired_last_runs(spark, sf):
    """A user's events of one type are runs of one model on one unit: the last one counts."""
    e = I.table(spark, sf, "events").select("user_id", F.col("event_type").alias("model"), "event_id", (F.col("value") > 50).alias("good"))
    return C.paired(e, "good", ["user_id"], ["event_id"])


@query("model_pairs", "SELECT a.e AS model_a, b.e AS model_b FROM (SELECT DISTINCT event_type AS e FROM events) a JOIN (SELECT DISTINCT event_type AS e FROM events) b ON a.e < b.e")
def model_pairs(spark, sf):
    return C.pairs(I.table(spark, sf, "events").select(F.col("event_type").alias("model")))


@query("mcnemar_counts", I.sql("SELECT level, model_a, model_b, CAST(sum(CASE WHEN exact_a AND NOT exact_b THEN 1 ELSE 0 END) AS BIGINT) AS n10, CAST(sum(CASE WHEN exact_b AND NOT exact_a THEN 1 ELSE 0 END) AS BIGINT) AS n01, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.level, a.model AS model_a, b.model AS model_b, a.exact AS exact_a, b.exact AS exact_b FROM docs a JOIN docs b ON a.doc_id = b.doc_id AND a.level = b.level AND a.model < b.model) GROUP BY ALL", I.RESULTS_SQL + ", " + DOCS))
def mcnemar_counts(spark, sf):
    return C.mcnemar_counts(C.paired(S.document_results(I.results(spark, sf), I.KEYS)), ["level"])


@query("mcnemar_test", SQL["mcnemar_counts"].replace("SELECT level, model_a, model_b, CAST(sum", "SELECT *, CASE WHEN n10 = n01 THEN 'no difference' WHEN n10 > n01 THEN model_a ELSE model_b END AS better, CASE WHEN n10 + n01 < 25 THEN 'exact binomial' ELSE 'chi-squared' END AS method FROM (SELECT level, model_a, model_b, CAST(sum", 1) + ")")
def mcnemar_test(spark, sf):
    """Without the p value, which SQL has no function for; the unit tests hold that."""
    return C.mcnemar(mcnemar_counts(spark, sf)).drop("p")


@query("holm", "WITH p AS (SELECT event_type AS comparison, (user_id % 97 + 1) / 1000.0 AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p, comparison) AS i, count(*) OVER () AS m FROM (SELECT comparison, CAST(min(p) AS DOUBLE) AS p FROM p GROUP BY ALL)) SELECT comparison, p, p <= 0.05 / (m - i + 1) AND bool_and(p <= 0.05 / (m - i + 1)) OVER (ORDER BY i) AS rejected FROM r")
def holm(spark, sf):
    e = I.table(spark, sf, "events")
    p = e.groupBy(F.col("event_type").alias("comparison")).agg(F.min((F.col("user_id") % 97 + 1) / 1000.0).alias("p"))
    return C.holm(p).select("comparison", "p", "rejected")


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf):
    return C.bootstrap(C.ratio_by_cluster(I.results(spark, sf), ["model", "level"], "template_id"), ["model", "level"])


@query("mdd", "SELECT model, n, round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * 0.5 * 0.5 / (n / 1.0)), 6) AS mdd FROM (SELECT o_orderstatus AS model, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL)")
def mdd(spark, sf):
    o = I.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(F.count("*").alias("n"))
    return o.withColumn("mdd", F.round(C.detectable_difference(F.col("n"), 0.5, 0.0), 6))


_MISREAD = """CASE WHEN length(gt_norm) > 0 AND length(pred_norm) > 0 AND abs(length(gt_norm) - length(pred_norm)) <= 1 AND levenshtein(gt_norm, pred_norm) BETWEEN 1 AND 2 THEN true END"""
FINDINGS = f"""other AS MATERIALIZED (SELECT r.model, r.level, r.doc_id, r.field, arg_min(o.field, o.ordinal) AS other FROM results r JOIN results o ON r.model = o.model AND r.level = o.level AND r.doc_id = o.doc_id AND r.field <> o.field AND r.pred_norm = o.gt_norm
  AND ((r.field IN ('invoice_number', 'invoice_date', 'place_of_supply')) = (o.field IN ('invoice_number', 'invoice_date', 'place_of_supply'))) WHERE r.outcome IN ('wrong', 'spurious') AND NOT r.format_error GROUP BY ALL),
findings AS MATERIALIZED (SELECT r.model, r.level, r.doc_id, r.template_id, r.field, other.other, CASE r.outcome WHEN 'missing' THEN 'omission'
  WHEN 'spurious' THEN CASE WHEN other.other IS NOT NULL THEN 'field_confusion' ELSE 'fabricated_on_null' END
  ELSE CASE WHEN r.format_error THEN 'format_error' WHEN other.other IS NOT NULL THEN 'field_confusion' WHEN {_MISREAD} THEN 'character_misread' ELSE 'wrong_value' END END AS category
  FROM results r LEFT JOIN other USING (model, level, doc_id, field) WHERE r.outcome IN ('wrong', 'missing', 'spurious'))"""


def _findings(spark, sf):
    return X.findings(I.results(spark, sf, ("truths",)), I.KEYS)


@query("taxonomy_findings", I.sql("SELECT model, level, doc_id, field, category FROM findings", I.RESULTS_SQL + ", " + FINDINGS))
def taxonomy_findings(spark, sf):
    return _findings(spark, sf).select("model", "level", "doc_id", "field", "category")


@query("field_confusion", I.sql("SELECT model, level, doc_id, field, other FROM findings WHERE category = 'field_confusion'", I.RESULTS_SQL + ", " + FINDINGS))
def field_confusion(spark, sf):
    return _findings(spark, sf).where("category = 'field_confusion'").select("model", "level", "doc_id", "field", "other")


@query("taxonomy_distribution", I.sql("SELECT model, " + ", ".join(f"CAST(sum(CASE WHEN category = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in X.CATEGORIES) + " FROM findings GROUP BY ALL", I.RESULTS_SQL + ", " + FINDINGS))
def taxonomy_distribution(spark, sf):
    return X.distribution(_findings(spark, sf))


@query("stratified_topk", I.sql("SELECT model, level, doc_id, field FROM (SELECT *, row_number() OVER (PARTITION BY model, level ORDER BY md5(concat(doc_id, '|', field, '|0')), doc_id, field) AS k FROM findings) WHERE k <= 15", I.RESULTS_SQL + ", " + FINDINGS))
def stratified_topk(spark, sf):
    f = _findings(spark, sf)
    return X.stratified_sample(f, ["model", "level"], 15, ["doc_id", "field"]).select("model", "level", "doc_id", "field")


@query("repeat_variance", "WITH v AS (SELECT conv_id, role, count(DISTINCT text) AS kinds, CAST(max(length(text)) - min(length(text)) AS BIGINT) AS spread, count(*) AS runs FROM conversations GROUP BY ALL HAVING count(*) > 1) SELECT role, CAST(count(*) AS BIGINT) AS groups, CAST(sum(CASE WHEN kinds > 1 THEN 1 ELSE 0 END) AS BIGINT) AS disagreeing, CAST(max(spread) AS BIGINT) AS most, round(avg(spread), 6) AS mean FROM v GROUP BY ALL")
def repeat_variance(spark, sf):
    c = I.table(spark, sf, "conversations")
    return R.repeat_variance(c, ["conv_id", "role"], "text", F.length("text").cast("long"), "role")




def _triage(spark, sf):
    r = _findings(spark, sf).where("needs_review AND ftype = 'money'")
    t = I.truth(spark, sf)
    names = ("total_taxable_value", "cgst_amount", "igst_amount", "grand_total", "round_off")
    amounts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"gt_{n}").cast("double").alias("value")) for n in names])
    d = t.select("doc_id", amounts.alias("amounts"), F.col("gt_total_taxable_value").cast("double").alias("taxable"))
    s = G.suggest(F.col("field"), F.col("gt_norm"), F.col("pred_norm"), F.array().cast("array<string>"), F.col("amounts"), F.col("taxable"))
    return r.join(d, "doc_id").select("model", "level", "doc_id", "field", s.alias("suggested"))


_SLABS = " OR ".join(f"abs(pn - taxable * {x / d}) <= greatest(0.02, abs(taxable * {x / d}) * 1e-4)" for x in (5, 12, 18, 28) for d in (200.0, 100.0))
_NEAR = " OR ".join(f"(field <> '{n}' AND {n} IS NOT NULL AND abs(pn - {n}) <= greatest(0.02, abs({n}) * 1e-4))" for n in ("total_taxable_value", "cgst_amount", "igst_amount", "grand_total", "round_off"))
TRIAGE = f"""tri AS MATERIALIZED (SELECT model, level, f.doc_id, f.field, CASE WHEN regexp_replace(gt_norm, '[^0-9]', '', 'g') = regexp_replace(pred_norm, '[^0-9]', '', 'g') THEN 'format_error'
  WHEN abs(pn - gn) <= abs(gn) * 1e-3 THEN 'character_misread' WHEN {_NEAR} OR (taxable <> 0 AND ({_SLABS})) THEN 'field_confusion'
  WHEN gn <> 0 AND (pn / gn BETWEEN 8.5 AND 11.0 OR pn / gn BETWEEN 0.09 AND 0.11) THEN 'character_misread' ELSE 'AMBIGUOUS-numeric' END AS suggested
  FROM (SELECT fi.*, r.gt_norm, r.pred_norm, CAST(r.gt_norm AS DOUBLE) AS gn, CAST(r.pred_norm AS DOUBLE) AS pn FROM findings fi JOIN results r USING (model, level, doc_id, field)
        WHERE fi.category = 'wrong_value' AND fi.field NOT IN ('invoice_number', 'invoice_date', 'place_of_supply')) f
  JOIN (SELECT doc_id AS k, CAST(gt_total_taxable_value AS DOUBLE) AS taxable, CAST(gt_total_taxable_value AS DOUBLE) AS total_taxable_value, CAST(gt_cgst_amount AS DOUBLE) AS cgst_amount,
        CAST(gt_igst_amount AS DOUBLE) AS igst_amount, CAST(gt_grand_total AS DOUBLE) AS grand_total, CAST(gt_round_off AS DOUBLE) AS round_off FROM truth) t ON t.k = f.doc_id)"""


@query("triage_suggest", I.sql("SELECT * FROM tri", ", ".join((I.RESULTS_SQL, FINDINGS, TRIAGE))))
def triage_suggest(spark, sf):
    return _triage(spark, sf)


@query("triage_summary", I.sql("SELECT suggested, CAST(count(*) AS BIGINT) AS count FROM tri GROUP BY ALL", ", ".join((I.RESULTS_SQL, FINDINGS, TRIAGE))))
def triage_summary(spark, sf):
    return G.summarise(_triage(spark, sf))
