"""Queries over rate cards, charts, repeated runs, and the joins of reviews and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwright.functions import json_safe as J
from fieldwright.operators import report as R
from fieldwright.operators import resample as B
from fieldwright.operators import score as S
from fieldwright.operators import taxonomy as X
from fieldwright.operators import triage as G
from fieldwright.operators.select import rank_picks
from fieldwright.plans import invoices as I
from fieldwright.plans.registry import query
from fieldwright.plans.documents import _calls, _CALLS
from fieldwright.plans.scoring import ACC
from fieldwright.sources import calls as C
from fieldwright.sources import rates as P

LEVELS = [n for n, _, _ in I.LEVELS]


def _card(spark, sf):
    """Parts as models: prices of some are no numbers, negative or not named; modalities are a list or a text."""
    p, k = I.table(spark, sf, "part"), F.col("p_partkey")
    price = F.when(k % 7 == 0, "free").when(k % 11 == 0, "-1").otherwise((F.col("p_retailprice") / 1e9).cast("string"))
    pricing = F.when(k % 13 == 0, F.create_map(F.lit("completion"), price)).when(k % 17 != 0, F.create_map(F.lit("prompt"), price, F.lit("completion"), price))
    # "image-like" is no image in a list of inputs, but a modality's text that has it names one
    kind = F.when(F.col("p_type") == "PROMO", "image").when(F.col("p_type") == "ECONOMY", "image-like").otherwise(F.lower("p_type"))
    words = F.array(F.lit("text"), kind)
    listed = F.when(k % 2 == 0, words)
    architecture = F.struct(listed.alias("input_modalities"), F.when(k % 3 != 0, F.concat_ws("+", words)).alias("modality"))
    return P.rates(p.select(F.col("p_partkey").cast("string").alias("id"), pricing.alias("pricing"), architecture.alias("architecture"), F.col("p_size").cast("long").alias("context_length")))


_CARD = """c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS BIGINT) AS context, p_partkey AS k, p_type IN ('PROMO', 'ECONOMY') AS named, p_type = 'PROMO' AS listed,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN -1.0 ELSE round(p_retailprice / 1e9 * 1e6, 6) END AS price FROM part),
card AS (SELECT id, CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN 0.0 ELSE price END AS input_per_mtok, CASE WHEN k % 17 = 0 AND k % 13 <> 0 THEN 0.0 ELSE price END AS output_per_mtok,
  CASE WHEN k % 2 = 0 THEN listed ELSE named AND k % 3 <> 0 END AS vision, context FROM c)"""


@query("rate_card", f"WITH {_CARD} SELECT * FROM card WHERE input_per_mtok >= 0 AND output_per_mtok >= 0")
def rate_card(spark, sf):
    return _card(spark, sf)


@query("vision_models", f"WITH {_CARD} SELECT id, input_per_mtok FROM card WHERE input_per_mtok >= 0 AND output_per_mtok >= 0 AND vision AND input_per_mtok <= 0.95")
def vision_models(spark, sf):
    return P.vision_models(_card(spark, sf), 0.95).select("id", "input_per_mtok")


@query("curve_points", I.sql(f"""SELECT CAST(dense_rank() OVER (ORDER BY first DESC, model) AS INT) AS line, model, x, level, accuracy FROM (
  SELECT *, coalesce(max(CASE WHEN x = 0 THEN accuracy END) OVER (PARTITION BY model), 0) AS first FROM (
    SELECT model, level, CAST(substr(level, 2, 1) AS INT) AS x, round({ACC}, 6) AS accuracy FROM results GROUP BY ALL))"""))
def curve_points(spark, sf):
    return R.curve_points(I.results(spark, sf), LEVELS)


@query("error_shares", I.sql("""SELECT model, CAST(place AS INT) AS place, kind, round(coalesce(n, 0) / greatest(total, 1), 6) AS share FROM (VALUES (0, 'missing'), (1, 'wrong'), (2, 'spurious')) k(place, kind)
  CROSS JOIN (SELECT model, CAST(sum(CASE WHEN outcome IN ('missing', 'wrong', 'spurious') THEN 1 ELSE 0 END) AS DOUBLE) AS total FROM results GROUP BY ALL)
  LEFT JOIN (SELECT model AS m2, outcome, count(*) AS n FROM results GROUP BY ALL) ON m2 = model AND outcome = kind"""))
def error_shares(spark, sf):
    return R.error_shares(I.results(spark, sf))


@query("repeat_fields", I.sql(f"""SELECT level, CAST(count(*) AS BIGINT) AS n_repeated, round(sum(differing) / CAST(sum(fields) AS DOUBLE), 6) AS field_disagreement, round(avg(spread), 6) AS mean_spread, round(max(spread), 6) AS most_spread
  FROM (SELECT level, doc_id, max(score) - min(score) AS spread FROM (SELECT level, doc_id, model, {ACC} AS score FROM results GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1)
  JOIN (SELECT level AS l2, doc_id AS d2, count(*) AS fields, sum(CASE WHEN kinds > 1 THEN 1 ELSE 0 END) AS differing FROM (SELECT level, doc_id, field, count(DISTINCT coalesce(pred_norm, chr(1))) AS kinds FROM results GROUP BY ALL) GROUP BY ALL)
  ON level = l2 AND doc_id = d2 GROUP BY level"""))
def repeat_fields(spark, sf):
    """The two models stand for two runs on one image."""
    return R.repeat_fields(I.results(spark, sf), ["level", "doc_id"], "model", ["level"])


@query("json_safe", """SELECT o_orderkey, '{"grand_total":"' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '","note":null,"amounts":["' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || '"],"number":' || CAST(o_custkey AS VARCHAR) || '}' AS v FROM orders""")
def json_safe(spark, sf):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    r = I.table(spark, sf, "orders").select("o_orderkey", F.struct(amount.alias("grand_total"), F.lit(None).cast("string").alias("note"), F.array(amount).alias("amounts"), F.col("o_custkey").alias("number")).alias("r"))
    return r.select("o_orderkey", J.json_safe(F.col("r"), r.schema["r"].dataType).alias("v"))


@query("join_call_metadata", "SELECT o_orderkey AS doc_id, event_type AS finish_reason, coalesce(value > 50, false) AS refusal FROM orders LEFT JOIN events ON event_id = o_orderkey")
def join_call_metadata(spark, sf):
    calls = I.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("finish_reason"), (F.col("value") > 50).alias("refusal"))
    return S.with_calls(I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")), calls, ["doc_id"])


@query("join_review", "SELECT CAST(e.event_id AS VARCHAR) || '__L' || CAST(e.user_id % 4 AS VARCHAR) AS variant_id, 'lab/' || e.event_type AS model, CAST(e.event_id AS VARCHAR) AS doc_id, o_orderstatus AS truth, CASE WHEN e.value > 50 THEN e.value END AS result FROM events e LEFT JOIN orders ON o_orderkey = e.event_id")
def join_review(spark, sf):
    e, o = I.table(spark, sf, "events"), I.table(spark, sf, "orders")
    rows = e.select(F.concat(F.col("event_id").cast("string"), F.lit("__L"), (F.col("user_id") % 4).cast("string")).alias("variant_id"), F.concat(F.lit("lab/"), "event_type").alias("model"), "value")
    results = rows.where("value > 50").select("variant_id", "model", F.col("value").alias("result"))
    return G.with_context(rows.drop("value"), o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderstatus").alias("truth")), results)


@query("first_tasks", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40")
def first_tasks(spark, sf):
    return C.first_tasks(I.table(spark, sf, "orders"), 40, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("first_problems", "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'missing' ELSE 'mismatch' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL OR quality <> 1 ORDER BY d.doc_id LIMIT 50")
def first_problems(spark, sf):
    want = I.table(spark, sf, "documents").select("doc_id", F.lit(1).cast("long").alias("want"))
    have = I.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("have"))
    return C.first_problems(C.verify_digests(want, have, "doc_id"), "doc_id")


_BOUNDS = " + ".join(f"CAST(u >= {b} AS INT)" for b in B.BOUNDS)
#: Draws of the interval of accuracies, the operator's own number, and of the other statistic's.
_DRAWS, _FEW_DRAWS = 1000, 50


def _bootstrap_sql(clusters: str, by: str, statistic: str, parts: tuple[str, ...], draws: int, out: str) -> str:
    """The same weights in SQL: clusters(by, cluster, parts)."""
    a, b, c = B.STEPS
    p, seed = B.PRIME, 20260101 % B.PRIME
    sums = ", ".join(f"sum(times * {x}) AS {x}" for x in parts)
    return f"""clusters AS MATERIALIZED ({clusters}),
hashed AS (SELECT *, CAST('0x' || substr(md5('=' || CAST(cluster AS VARCHAR)), 1, 7) AS BIGINT) AS h1, CAST('0x' || substr(md5('=' || CAST(cluster AS VARCHAR)), 8, 7) AS BIGINT) AS h2 FROM clusters),
s0 AS (SELECT *, (h1 + (draw + {seed}) * {b}) % {p} AS x FROM hashed, range(0, {draws}) r(draw)),
s1 AS MATERIALIZED (SELECT *, ((x * x) % {p} * {a} + h2) % {p} AS y FROM s0), s2 AS (SELECT *, ((y * y) % {p} * {b} + draw * {c} + h1) % {p} AS z FROM s1),
s3 AS MATERIALIZED (SELECT *, ((z * z) % {p} * {c} + h2 + x) % {p} AS u FROM s2), s4 AS (SELECT *, {_BOUNDS} AS times FROM s3),
drawn AS (SELECT {by}, draw, {sums} FROM s4 GROUP BY ALL),
ends AS (SELECT {by}, quantile_cont({statistic}, 0.025) AS lo, quantile_cont({statistic}, 0.975) AS hi FROM drawn GROUP BY ALL),
points AS (SELECT {by}, {statistic} AS point, n_clusters FROM (SELECT {by}, {", ".join(f"CAST(sum({x}) AS DOUBLE) AS {x}" for x in parts)}, CAST(count(*) AS BIGINT) AS n_clusters FROM clusters GROUP BY ALL))
{out}"""


_RIGHT = "SELECT model, level, doc_id AS cluster, CAST(sum(CASE WHEN outcome = 'correct' THEN 1 ELSE 0 END) AS DOUBLE) AS num, CAST(sum(CASE WHEN outcome IN ('correct', 'wrong', 'missing') THEN 1 ELSE 0 END) AS DOUBLE) AS den FROM results GROUP BY ALL"


@query("bootstrap_by_hash", f"WITH {I.RESULTS_SQL}, " + _bootstrap_sql(_RIGHT, "model, level", "num / nullif(den, 0)", ("num", "den"), _DRAWS, "SELECT p.model, p.level, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, n_clusters FROM points p JOIN ends e ON p.model = e.model AND p.level = e.level"))
def bootstrap_by_hash(spark, sf):
    """Accuracy by model and level with its interval; every document is a cluster."""
    num, den = F.count_if(F.col("outcome") == S.CORRECT), F.count_if(S.due())
    clusters = B.cluster_sums(I.results(spark, sf), ["model", "level"], F.col("doc_id"), {"num": num, "den": den})
    out = B.hash_bootstrap(clusters, ["model", "level"], ["num", "den"], B.ratio, _DRAWS)
    return out.select("model", "level", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")], "n_clusters")


_LOSS = "SELECT l_returnflag AS flag, l_suppkey AS cluster, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS off, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS pieces FROM lineitem GROUP BY ALL"


@query("bootstrap_statistic", "WITH " + _bootstrap_sql(_LOSS, "flag", "(gross - off) / nullif(pieces, 0)", ("off", "gross", "pieces"), _FEW_DRAWS, "SELECT p.flag, round(point, 4) AS point, round(lo, 4) AS lo, round(hi, 4) AS hi, n_clusters FROM points p JOIN ends e ON p.flag = e.flag"))
def bootstrap_statistic(spark, sf):
    """A statistic of three sums, the net price of a piece, with suppliers as clusters."""
    d = lambda c, kind="decimal(18,2)": F.col(c).cast(kind)
    parts = {"off": F.sum(d("l_extendedprice") * d("l_discount", "decimal(4,2)")), "gross": F.sum(d("l_extendedprice")), "pieces": F.sum(d("l_quantity"))}
    clusters = B.cluster_sums(I.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], F.col("l_suppkey"), parts)
    out = B.hash_bootstrap(clusters, ["flag"], list(parts), lambda off, gross, pieces: F.try_divide(gross - off, pieces), _FEW_DRAWS)
    return out.select("flag", *[F.round(c, 4).alias(c) for c in ("point", "lo", "hi")], "n_clusters")


@query("rank_picks", "WITH r AS (SELECT l_returnflag AS flag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT flag, max(CASE WHEN k = 0 THEN v END) AS least, max(CASE WHEN k = n // 10 THEN v END) AS p10, max(CASE WHEN k = n // 2 THEN v END) AS p50, max(CASE WHEN k = n * 99 // 100 THEN v END) AS p99, max(CASE WHEN k = n - 1 THEN v END) AS most FROM r GROUP BY ALL")
def rank_picks_by_flag(spark, sf):
    lines = I.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    whole = lambda c: F.floor(c).cast("long")
    ranks = {"least": lambda n: F.lit(0), "p10": lambda n: whole(n / 10), "p50": lambda n: whole(n / 2), "p99": lambda n: whole(n * 99 / 100), "most": lambda n: n - 1}
    return rank_picks(lines, ["flag"], "l_extendedprice", ranks)


@query("cost_table", f"""WITH {_CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM priced WHERE error IS NULL),
  s AS (SELECT model, round(avg(tin), 6) AS i, round(avg(tout), 6) AS o, max(CASE WHEN pos = n // 2 THEN latency END) AS p50, max(CASE WHEN pos = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN latency END) AS p95, round(sum(cost) / count(*) * 1000, 6) AS k, round(sum(cost) / count(*) * 1000 * 83.0, 6) AS r FROM r GROUP BY model)
  SELECT CAST(row_number() OVER (ORDER BY k, model) AS INT) AS place, model, printf('%.0f', i) AS mean_in, printf('%.0f', o) AS mean_out, printf('%.2fs', p50) AS p50, printf('%.2fs', p95) AS p95, printf('$%.2f', k) AS per_1000, printf('₹%.0f', r) AS per_1000_inr FROM s""")
def cost_table(spark, sf):
    return R.cost_table(R.cost_summary(_calls(spark, sf).where("error IS NULL"), "model", "latency", "tin", "tout", "cost"))


@query("distribution_table", """WITH f AS (SELECT event_type AS model, CASE user_id % 5 WHEN 0 THEN 'omission' WHEN 1 THEN 'wrong_value' WHEN 2 THEN 'refusal' ELSE 'format_error' END AS category FROM events),
  c AS (SELECT CASE category WHEN 'refusal' THEN 0 WHEN 'format_error' THEN 7 WHEN 'omission' THEN 8 WHEN 'wrong_value' THEN 10 END AS place, replace(category, '_', ' ') AS category, model FROM f UNION ALL SELECT 12, 'total findings', model FROM f)
  SELECT CAST(place AS INT) AS place, category, CAST(sum(CASE WHEN model = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS click, CAST(sum(CASE WHEN model <> 'click' THEN 1 ELSE 0 END) AS BIGINT) AS others FROM c GROUP BY ALL""")
def distribution_table(spark, sf):
    """Events as findings of two models, clicks and all others."""
    e, k = I.table(spark, sf, "events"), F.col("user_id") % 5
    category = F.when(k == 0, "omission").when(k == 1, "wrong_value").when(k == 2, "refusal").otherwise("format_error")
    found = e.select(F.when(F.col("event_type") == "click", "click").otherwise("others").alias("model"), category.alias("category"))
    return R.distribution_table(found, X.CATEGORIES)
