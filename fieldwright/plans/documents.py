"""Queries over scalar functions, checks, joins, costs and the other driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwright.functions import constants as C
from fieldwright.functions import gstin as G
from fieldwright.functions import normalize as N
from fieldwright.functions import parse as P
from fieldwright.functions import similarity as M
from fieldwright.operators import align as A
from fieldwright.operators import consistency as K
from fieldwright.operators import report as R
from fieldwright.plans import invoices as I
from fieldwright.plans.registry import query
from fieldwright.sources import calls as S


def t(spark, sf, name):
    return I.table(spark, sf, name)


@query("norm_exact_upper", "SELECT p_partkey, nullif(replace(upper(trim(' ' || p_type || ' ')), ' ', ''), '') AS v FROM part")
def norm_exact_upper(spark, sf):
    return t(spark, sf, "part").select("p_partkey", N.exact_upper(F.concat(F.lit(" "), "p_type", F.lit(" ")))["value"].alias("v"))


@query("norm_exact_alnum", "SELECT p_partkey, upper(regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')) AS v FROM part")
def norm_exact_alnum(spark, sf):
    return t(spark, sf, "part").select("p_partkey", N.exact_alnum(F.col("p_brand"))["value"].alias("v"))


@query("norm_money", "SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 2) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS DOUBLE) AS v FROM orders")
def norm_money(spark, sf):
    x = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), x, F.lit(")"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Rs. "), x)).otherwise(F.concat(F.lit("INR "), x, F.lit(" CR")))
    return N.normalized(t(spark, sf, "orders"), {"v": ("money", shown)}).select("o_orderkey", F.col("v").cast("double").alias("v"))


@query("norm_quantity", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(18,3)) AS DOUBLE) AS v FROM lineitem")
def norm_quantity(spark, sf):
    q = F.col("l_quantity").cast("decimal(18,3)").cast("string")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", N.quantity(q)["value"].cast("double").alias("v"))


@query("norm_percent", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(abs(CAST(l_tax AS DECIMAL(4,2))) * 100 AS DOUBLE) AS v FROM lineitem")
def norm_percent(spark, sf):
    f = F.abs(F.col("l_tax").cast("decimal(4,2)"))
    shown = F.when(F.col("l_linenumber") % 2 == 0, f.cast("string")).otherwise(F.concat((f * 100).cast("string"), F.lit("%")))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", N.percent(shown)["value"].cast("double").alias("v"))


@query("norm_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders")
def norm_date(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    forms = ("dd/MM/yyyy", "d-MMM-yyyy", "yyyy.MM.dd", "d MMMM yyyy", "dd.MM.yyyy")
    shown = F.coalesce(*[F.when(k == i, F.concat(F.lit("Dated: " if i == 0 else ""), F.date_format(d, f))) for i, f in enumerate(forms)])
    return N.normalized(t(spark, sf, "orders"), {"v": ("date", shown)}).select("o_orderkey", "v")


@query("norm_state", I.sql("SELECT doc_id, gt_place_of_supply AS v FROM truth", I.TRUTH_SQL))
def norm_state(spark, sf):
    r = I.truth(spark, sf)
    shown = I.shown("place_of_supply", F.col("gt_place_of_supply"), F.col("doc_id"))
    return r.select("doc_id", N.state(shown)["value"].alias("v"))


@query("norm_bool", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS v FROM orders")
def norm_bool(spark, sf):
    shown = F.get(F.array(*[F.lit(x) for x in ("YES", " n/a ", "Applicable", "perhaps")]), (F.col("o_orderkey") % 4).cast("int"))
    return t(spark, sf, "orders").select("o_orderkey", N.boolean(shown)["value"].alias("v"))


@query("norm_fuzzy_key", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS v FROM customer")
def norm_fuzzy_key(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", N.fuzzy_key(F.concat("c_name", F.lit(" Pvt. Ltd.")))["value"].alias("v"))


@query("is_null_token", "SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2, 3) AS v FROM orders")
def is_null_token(spark, sf):
    shown = F.get(F.array(*[F.lit(x) for x in ("N/A", " ", None, "nil", "0", "none at all")]), (F.col("o_orderkey") % 6).cast("int"))
    return t(spark, sf, "orders").select("o_orderkey", N.is_null_token(shown).alias("v"))


@query("numeric_similarity", "SELECT l_orderkey, l_partkey, l_linenumber, (CASE WHEN a = b OR greatest(abs(a), abs(b)) = 0 THEN 1.0 ELSE greatest(0.0, 1 - CAST(abs(a - b) AS DOUBLE) / CAST(greatest(abs(a), abs(b)) AS DOUBLE)) END) AS v FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS a, CAST(CAST(l_quantity AS DECIMAL(18,2)) * 1000 AS DECIMAL(18,2)) AS b FROM lineitem)")
def numeric_similarity(spark, sf):
    a, b = F.col("l_extendedprice").cast("decimal(18,2)"), (F.col("l_quantity").cast("decimal(18,2)") * 1000).cast("decimal(18,2)")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", M.numeric_similarity(a, b).alias("v"))


@query("close_match", "SELECT o_orderkey, abs(o_totalprice - floor(o_totalprice)) <= greatest(0.02, abs(floor(o_totalprice)) * 1e-4) AS v FROM orders")
def close_match(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", M.close(F.col("o_totalprice"), F.floor("o_totalprice").cast("double")).alias("v"))


#: Pairs of names of one part of a nation, and of one task.
_PAIRS_A_PART, _PAIRS_A_TASK = 500_000, 10_000_000


@query("levenshtein", "SELECT c_custkey, CAST(levenshtein(c_name, s_name) AS INT) AS v FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def levenshtein(spark, sf):
    """All customers with all suppliers of their nation; nations are few, so each is dealt in parts and meets all of its suppliers in each."""
    c, s = t(spark, sf, "customer"), t(spark, sf, "supplier")
    pairs = c.groupBy("c_nationkey").count().join(s.groupBy("s_nationkey").agg(F.count("*").alias("n")), F.expr("c_nationkey = s_nationkey")).agg(F.max(F.col("count") * F.col("n")), F.sum(F.col("count") * F.col("n"))).first()
    parts = max(1, -(-(pairs[0] or 0) // _PAIRS_A_PART))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(pairs[1] or 0) // _PAIRS_A_TASK))
    c = c.select("c_custkey", "c_name", "c_nationkey", F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).alias("part")).repartition(tasks, "c_nationkey", "part")
    s = s.select("s_name", "s_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("s_part")).repartition(tasks, "s_nationkey", "s_part")
    j = c.join(s.hint("merge"), F.expr("c_nationkey = s_nationkey AND part = s_part"))
    return j.select("c_custkey", F.levenshtein("c_name", "s_name").alias("v"))


@query("char_misread", "SELECT o_orderkey, CASE WHEN contains(CAST(o_orderkey AS VARCHAR), '8') AND length(replace(CAST(o_orderkey AS VARCHAR), '8', '')) >= length(CAST(o_orderkey AS VARCHAR)) - 2 THEN true END AS v FROM orders")
def char_misread(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return t(spark, sf, "orders").select("o_orderkey", M.char_misread(k, F.translate(k, "8", "B")).alias("v"))


_GST = "CAST(10 + c_custkey % 15 AS VARCHAR) || 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z'"
_ALPHA = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_CHK = f"substr({_ALPHA}, CAST((36 - list_sum(list_transform(range(1, 15), lambda i: (((instr({_ALPHA}, substr(g, i, 1)) - 1) * (2 - i % 2)) // 36) + ((instr({_ALPHA}, substr(g, i, 1)) - 1) * (2 - i % 2)) % 36)) % 36) % 36 AS BIGINT) + 1, 1)"


def _gst():
    return F.concat((10 + F.col("c_custkey") % 15).cast("string"), F.lit("ABCDE"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z"))


@query("gstin_checksum", f"SELECT c_custkey, {_CHK} AS v FROM (SELECT c_custkey, {_GST} AS g FROM customer)")
def gstin_checksum(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", G.check_character(_gst()).alias("v"))


@query("gstin_valid", f"SELECT c_custkey, {_CHK} = substr({_ALPHA}, CAST(c_custkey % 36 AS BIGINT) + 1, 1) AS v FROM (SELECT c_custkey, {_GST} AS g FROM customer)")
def gstin_valid(spark, sf):
    last = F.lit(G.ALPHABET).substr((F.col("c_custkey") % 36 + 1).cast("int"), F.lit(1))
    return t(spark, sf, "customer").select("c_custkey", G.is_valid(F.concat(_gst(), last)).alias("v"))


@query("date_forms", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS f0, strftime(o_orderdate, '%d-%m-%Y') AS f1, strftime(o_orderdate, '%d-%b-%Y') AS f2, strftime(o_orderdate, '%d.%m.%Y') AS f3, strftime(o_orderdate, '%-d %B %Y') AS f4, strftime(o_orderdate, '%d/%m/%y') AS f5 FROM orders")
def date_forms(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", *[c.alias(f"f{i}") for i, c in enumerate(P.date_forms(F.col("o_orderdate")))])


@query("sha256", "SELECT doc_id, sha256(text) AS h, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def sha256(spark, sf):
    h = F.sha2("text", 256)
    return t(spark, sf, "documents").select("doc_id", h.alias("h"), F.substring(h, 1, 16).alias("fingerprint"))


@query("verify_hash", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'ok' ELSE 'mismatch' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def verify_hash(spark, sf):
    d, lab = t(spark, sf, "documents"), t(spark, sf, "labels")
    expected = d.select("doc_id", F.sha2("text", 256).alias("want"))
    found = d.join(lab, "doc_id").select("doc_id", F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("have"))
    return S.verify_digests(expected, found, "doc_id")


@query("doc_id_sanitise", "SELECT doc_id, 'real_' || trim(regexp_replace(' ' || source || '/' || lang || '.' || doc_id || '#', '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS v FROM documents")
def doc_id_sanitise(spark, sf):
    name = F.concat(F.lit(" "), "source", F.lit("/"), "lang", F.lit("."), F.col("doc_id").cast("string"), F.lit("#"))
    return t(spark, sf, "documents").select("doc_id", P.doc_id(name).alias("v"))


@query("left_join_reject", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def left_join_reject(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("join_template_left", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS template FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_template_left(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("template"))


@query("join_result_truth", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_result_truth(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


@query("price_topk", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 1500 AND p_type LIKE '%S%' ORDER BY p_retailprice, p_partkey LIMIT 20")
def price_topk(spark, sf):
    return S.cheapest(t(spark, sf, "part").where(F.contains("p_type", F.lit("S"))).select("p_partkey", "p_retailprice"), "p_retailprice", 1500, 20, "p_partkey")


_CALLS = "calls AS (SELECT event_type AS model, event_id, user_id, value AS latency, CASE WHEN event_id % 13 = 0 THEN 'HTTP 402' END AS error, user_id % 4000 AS tin, user_id % 500 AS cached, event_id % 900 AS tout FROM events), priced AS (SELECT *, (greatest(0, tin - cached) * 0.5 + cached * 0.1 + tout * 1.5) / 1e6 AS cost FROM calls)"


def _calls(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("model"), "event_id", "user_id", F.col("value").alias("latency"), F.expr("CASE WHEN event_id % 13 = 0 THEN 'HTTP 402' END").alias("error"), F.expr("user_id % 4000").alias("tin"), F.expr("user_id % 500").alias("cached"), F.expr("event_id % 900").alias("tout"))
    return e.withColumn("cost", P.call_cost(F.col("tin"), F.col("cached"), F.col("tout"), F.lit(0.5), F.lit(0.1), F.lit(1.5)))


@query("call_cost", f"WITH {_CALLS} SELECT event_id, round(cost, 9) AS cost FROM priced")
def call_cost(spark, sf):
    return _calls(spark, sf).select("event_id", F.round("cost", 9).alias("cost"))


@query("infra_excluded", f"WITH {_CALLS} SELECT model, CAST(sum(CASE WHEN error IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS scored, CAST(count(error) AS BIGINT) AS failed FROM calls GROUP BY ALL")
def infra_excluded(spark, sf):
    return R.infra_split(_calls(spark, sf)).groupBy("model").agg(F.count_if(~F.col("failed")).alias("scored"), F.count_if("failed").alias("failed"))


@query("cost_summary", f"WITH {_CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM priced WHERE error IS NULL) SELECT model, CAST(count(*) AS BIGINT) AS n, round(avg(tin), 6) AS mean_in, round(avg(tout), 6) AS mean_out, max(CASE WHEN pos = n // 2 THEN latency END) AS p50, max(CASE WHEN pos = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN latency END) AS p95, round(sum(cost), 6) AS total, round(sum(cost) / count(*) * 1000, 6) AS per_1000, round(sum(cost) / count(*) * 1000 * 83.0, 6) AS per_1000_inr FROM r GROUP BY model")
def cost_summary(spark, sf):
    return R.cost_summary(_calls(spark, sf).where("error IS NULL"), "model", "latency", "tin", "tout", "cost")


@query("resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_id % 13 <> 0)")
def resume_anti_join(spark, sf):
    done = t(spark, sf, "events").select(F.col("event_id").alias("o_orderkey"), F.expr("CASE WHEN event_id % 13 = 0 THEN 'failed' END").alias("error"))
    return S.to_do(t(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("parse_response", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS INT) WHEN 1 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, CASE event_id % 4 WHEN 2 THEN 'no_json_object' WHEN 3 THEN 'json_not_an_object' END AS violation FROM events")
def parse_response(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" done"))).when(k == 2, "sorry").otherwise("[1, 2]")
    return t(spark, sf, "events").select("event_id", P.parse_response(raw).alias("r")).select("event_id", F.get_json_object("r.record", "$.k").cast("int").alias("k"), "r.violation")


@query("violation_precedence", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 7 = 0 THEN 'refusal' ELSE 'call_failed' END WHEN event_id % 7 = 0 THEN 'refusal' WHEN event_id % 5 = 0 THEN 'no_json_object' WHEN event_id % 3 = 0 THEN 'truncated_output' END AS v FROM events")
def violation_precedence(spark, sf):
    e = F.col("event_id")
    v = P.violation(F.when(e % 11 == 0, "boom"), F.when(e % 5 == 0, "no_json_object"), e % 7 == 0, F.when(e % 3 == 0, "length").otherwise("stop"))
    return t(spark, sf, "events").select("event_id", v.alias("v"))


@query("refusal_like", "SELECT page_id, page_id % 3 = 0 AS v FROM pages")
def refusal_like(spark, sf):
    text = F.when(F.col("page_id") % 3 == 0, "I'm unable to read it").when(F.col("page_id") % 3 == 1, '{"a": "i cannot help"}').otherwise("all good")
    return t(spark, sf, "pages").select("page_id", P.looks_like_refusal(text).alias("v"))


@query("ladder_range_join", "SELECT event_id, CASE WHEN value >= 300 THEN 'L0_clean/L1_scan' WHEN value >= 150 THEN 'L2_photo' WHEN value >= 72 THEN 'L3_harsh' END AS below, CASE WHEN value < 72 THEN 'L3_harsh' WHEN value < 150 THEN 'L2_photo' WHEN value < 300 THEN 'L0_clean/L1_scan' END AS above FROM events")
def ladder_range_join(spark, sf):
    return t(spark, sf, "events").select("event_id", P.ladder_place(F.col("value")).alias("p")).select("event_id", "p.*")


@query("regex_extract", "SELECT page_id, lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS d, 'INV/' || (page_id + 1000) AS number, CAST(page_id * 1.5 AS DOUBLE) AS total FROM pages")
def regex_extract(spark, sf):
    p = t(spark, sf, "pages")
    text = F.concat(F.lit("Invoice No: INV/"), (F.col("page_id") + 1000).cast("string"), F.lit(" dated 2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("\nGrand Total Rs. "), (F.col("page_id") * F.lit(1.5).cast("decimal(4,1)")).cast("string"))
    e = P.extract_fields(text)
    return p.select("page_id", F.substring(e["invoice_date"], 9, 2).alias("d"), e["invoice_number"].alias("number"), e["grand_total"].cast("double").alias("total"))


@query("expand_repeats", "SELECT conv_id, turn, r AS run FROM conversations, range(0, 3) t(r) WHERE role = 'user'")
def expand_repeats(spark, sf):
    return S.expand_repeats(t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn"), 3)


@query("hsn_summary", I.sql("SELECT part % 50 AS hsn, CAST(tax_frac AS DOUBLE) AS rate, CAST(CAST(sum(taxable_value) AS DECIMAL(28,2)) AS DOUBLE) AS taxable, CAST(CAST(sum(half) AS DECIMAL(28,2)) AS DOUBLE) AS tax FROM lines GROUP BY ALL", I.LINES_SQL))
def hsn_summary(spark, sf):
    g = I.lines(spark, sf).groupBy((F.col("part") % 50).alias("hsn"), F.col("tax_frac").cast("double").alias("rate"))
    return g.agg(F.sum("taxable_value").cast("double").alias("taxable"), F.sum("half").cast("double").alias("tax"))


@query("invoice_totals", I.sql("SELECT doc_id, gt_total_taxable_value AS taxable, gt_round_off AS round_off, gt_grand_total AS grand_total FROM truth", I.TRUTH_SQL))
def invoice_totals(spark, sf):
    r = I.truth(spark, sf)
    return r.select("doc_id", F.col("gt_total_taxable_value").alias("taxable"), F.col("gt_round_off").alias("round_off"), F.col("gt_grand_total").alias("grand_total"))


def _records(spark, sf):
    """Documents with their lines as arrays; a few are made wrong."""
    line = I.lines(spark, sf)
    items = line.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", F.col("quantity").alias("quantity"), (F.col("gross") / F.col("quantity")).cast("decimal(18,6)").alias("unit_price"), "discount", "taxable_value", (F.col("tax_frac") * 100).alias("tax_rate")))).alias("line_items"))
    r = I.truth(spark, sf)
    d = lambda c: F.col(f"gt_{c}").cast("decimal(18,2)")
    wrong = F.when(F.col("doc_id") % 7 == 0, 5).otherwise(0)
    return r.join(items, "doc_id").select("doc_id", (d("total_taxable_value") + wrong).cast("decimal(18,2)").alias("total_taxable_value"), d("cgst_amount").alias("cgst_amount"), (d("cgst_amount") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("sgst_amount"), d("igst_amount").alias("igst_amount"), F.lit(None).cast("decimal(18,2)").alias("cess_amount"), d("round_off").alias("round_off"), d("grand_total").alias("grand_total"), F.col("gt_invoice_date").alias("invoice_date"), F.lit(None).cast("string").alias("seller_gstin"), F.lit(None).cast("string").alias("buyer_gstin"), F.col("gt_place_of_supply").alias("place_of_supply"), "line_items")


_CHECKS = I.sql("""SELECT *, CAST(line_items_sum_to_subtotal AS INT) + CAST(totals_reconcile AS INT) + CAST(coalesce(cgst_equals_sgst, false) AS INT) + 1 + CAST(date_parseable AS INT) AS passed,
  3 + CASE WHEN cgst_equals_sgst IS NULL THEN 0 ELSE 1 END + 1 AS due FROM (
  SELECT doc_id, NOT doc_id % 7 = 0 OR n * 0.05 >= 5 AS line_items_sum_to_subtotal, abs(5 * CAST(doc_id % 7 = 0 AS INT) + CASE WHEN doc_id % 5 >= 2 AND doc_id % 11 = 0 THEN 1 ELSE 0 END) <= 1 AS totals_reconcile,
  CASE WHEN doc_id % 5 >= 2 AND CAST(gt_cgst_amount AS DECIMAL(18,2)) + (CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END) <> 0 THEN doc_id % 11 <> 0 END AS cgst_equals_sgst, abs(CAST(gt_round_off AS DECIMAL(18,2))) < 1 AS round_off_plausible, true AS date_parseable
  FROM truth JOIN (SELECT doc_id AS k, count(*) AS n FROM lines GROUP BY ALL) ON k = doc_id)""", I.TRUTH_SQL)


@query("consistency_checks", _CHECKS.replace("SELECT *, CAST(line_items", "SELECT doc_id, line_items_sum_to_subtotal, totals_reconcile, cgst_equals_sgst, round_off_plausible, date_parseable FROM (SELECT *, CAST(line_items", 1) + ")")
def consistency_checks(spark, sf):
    c = K.checks(_records(spark, sf))
    return c.select("doc_id", *[F.col(f"checks.{k}").alias(k) for k in ("line_items_sum_to_subtotal", "totals_reconcile", "cgst_equals_sgst", "round_off_plausible", "date_parseable")])


#: Of the checks those that apply here: both sums, the round-off and the date always; the split tax and the place where local.
_SCORE = I.sql("""SELECT doc_id, round(passed / CAST(due AS DOUBLE), 6) AS score FROM (
  SELECT doc_id, CAST(a AS INT) + CAST(b AS INT) + CAST(coalesce(c, false) AS INT) + CAST(coalesce(t, false) AS INT) + CAST(coalesce(l, false) AS INT) + 2 AS passed,
    4 + CASE WHEN c IS NULL THEN 0 ELSE 1 END + CASE WHEN t IS NULL THEN 0 ELSE 1 END + CASE WHEN l IS NULL THEN 0 ELSE 1 END AS due FROM (
  SELECT truth.doc_id, NOT truth.doc_id % 7 = 0 OR n * 0.05 >= 5 AS a, abs(5 * CAST(truth.doc_id % 7 = 0 AS INT) + CASE WHEN truth.doc_id % 5 >= 2 AND truth.doc_id % 11 = 0 THEN 1 ELSE 0 END) <= 1 AS b,
    CASE WHEN truth.doc_id % 5 >= 2 AND CAST(gt_cgst_amount AS DECIMAL(18,2)) + (CASE WHEN truth.doc_id % 11 = 0 THEN 1 ELSE 0 END) <> 0 THEN truth.doc_id % 11 <> 0 END AS c,
    CAST(NULL AS BOOLEAN) AS t, fine AS l
  FROM truth JOIN (SELECT doc_id AS k, count(*) AS n, bool_and(abs(quantity * CAST(gross / quantity AS DECIMAL(18,6)) - discount - taxable_value) <= 1) AS fine FROM lines GROUP BY ALL) ON k = truth.doc_id))""", I.TRUTH_SQL)


@query("consistency_score", _SCORE)
def consistency_score(spark, sf):
    c = K.checks(_records(spark, sf))
    return c.select("doc_id", F.round(K.score(F.col("checks")), 6).alias("score"))


@query("line_diagnosis", I.sql("SELECT doc_id, line_no, CASE WHEN abs(quantity * shown - discount - taxable_value) <= 1 THEN NULL WHEN tax_frac > 0 AND abs(quantity * shown - discount - taxable_value - taxable_value * tax_frac) <= 1 THEN 'tax_inclusive' WHEN quantity > 1 AND abs(shown - taxable_value) <= 1 THEN 'line_total_as_unit_price' WHEN discount <> 0 AND abs(quantity * shown - taxable_value) <= 1 THEN 'discount_twice' ELSE 'other' END AS diagnosis FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN taxable_value ELSE CAST(1 AS DECIMAL(18,2)) END AS shown FROM lines)", I.LINES_SQL))
def line_diagnosis(spark, sf):
    x = I.lines(spark, sf).withColumn("shown", F.when(F.col("doc_id") % 3 == 0, F.col("taxable_value")).otherwise(F.lit(1).cast("decimal(18,2)")))
    return x.select("doc_id", "line_no", K.diagnose(F.col("quantity"), F.col("shown"), F.col("discount"), F.col("taxable_value"), F.col("tax_frac") * 100).alias("diagnosis"))


@query("line_full_outer", I.sql("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line_no, b.line_no) AS line_no, CASE WHEN b.line_no IS NULL THEN 'missing' WHEN a.line_no IS NULL THEN 'spurious' ELSE 'paired' END AS kind FROM (SELECT * FROM lines WHERE part % 9 <> 0) a FULL JOIN (SELECT * FROM lines WHERE part % 7 <> 0) b ON a.doc_id = b.doc_id AND a.line_no = b.line_no", I.LINES_SQL))
def line_full_outer(spark, sf):
    x = I.lines(spark, sf).select("doc_id", "line_no", "part")
    a, b = x.where("part % 9 <> 0").select("doc_id", "line_no", F.lit(1).alias("a")), x.where("part % 7 <> 0").select("doc_id", "line_no", F.lit(1).alias("b"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "spurious").otherwise("paired")
    return a.join(b, ["doc_id", "line_no"], "full_outer").select("doc_id", "line_no", kind.alias("kind"))


@query("band_join_amounts", I.sql("SELECT doc_id, line_no FROM (SELECT lines.doc_id, line_no, taxable_value, half FROM lines) x JOIN (SELECT doc_id AS k, CAST(gt_total_taxable_value AS DOUBLE) AS total FROM truth) y ON k = x.doc_id WHERE abs(CAST(taxable_value AS DOUBLE) - total) <= greatest(0.02, abs(total) * 1e-4)", I.TRUTH_SQL))
def band_join_amounts(spark, sf):
    total = I.truth(spark, sf).select("doc_id", F.col("gt_total_taxable_value").cast("double").alias("total"))
    x = I.lines(spark, sf).join(total, "doc_id")
    return x.where(M.close(F.col("taxable_value").cast("double"), F.col("total"))).select("doc_id", "line_no")


@query("hungarian_align")
def hungarian_align(spark, sf):
    x = I.lines(spark, sf)
    item = F.struct("line_no", F.concat(F.lit("part "), F.col("part").cast("string")).alias("description"), F.col("part").cast("string").alias("hsn_sac"), F.col("taxable_value").cast("double").alias("taxable_value"), F.col("quantity").cast("double").alias("quantity"), (F.col("gross") / F.col("quantity")).cast("double").alias("unit_price"))
    docs = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("truth"), F.sort_array(F.collect_list(F.when(F.col("part") % 9 != 0, item)), asc=False).alias("seen"))
    return A.align(docs, "doc_id")


@query("norm_bool_flags", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN false END AS v, l_returnflag = 'N' AS ok FROM lineitem")
def norm_bool_flags(spark, sf):
    """Flags as they stand in the table, of which one is a word for no and the others can't be read."""
    return N.normalized(t(spark, sf, "lineitem"), {"v": ("bool", F.col("l_returnflag"))}).select("l_orderkey", "l_linenumber", "l_partkey", "v", F.col("v_ok").alias("ok"))


_TOKENS = ", ".join(f"'{x}'" for x in C.NULL_TOKENS)


@query("null_words", rf"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN lower(trim(word)) IN ({_TOKENS}) THEN 1 ELSE 0 END) AS BIGINT) AS none
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY doc_id""")
def null_words(spark, sf):
    """How many of each text's words mean that there is no value; two blanks have an empty one between them."""
    words = t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(N.is_null_token(F.col("word"))).alias("none"))


_MARKS = " OR ".join("contains(x, '" + m.replace("'", "''") + "')" for m in C.REFUSAL_MARKERS)


@query("refusals_in_turns", f"SELECT conv_id, turn, NOT starts_with(x, '{{') AND ({_MARKS}) AS v FROM (SELECT *, substr(lower(trim(said)), 1, 600) AS x FROM (SELECT *, CASE WHEN role = 'assistant' AND conv_id % 4 = 0 THEN 'Sorry, I cannot help: ' || text ELSE text END AS said FROM conversations))")
def refusals_in_turns(spark, sf):
    """Which turns read like a refusal; in a quarter of the conversations the assistant refuses."""
    refused = (F.col("role") == "assistant") & (F.col("conv_id") % 4 == 0)
    said = F.when(refused, F.concat(F.lit("Sorry, I cannot help: "), "text")).otherwise(F.col("text"))
    return t(spark, sf, "conversations").select("conv_id", "turn", P.looks_like_refusal(said).alias("v"))


_KEY = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("response_recovery", f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN {_KEY} WHEN 1 THEN {_KEY} WHEN 2 THEN {_KEY} WHEN 8 THEN {_KEY} END AS k,
  CASE event_id % 9 WHEN 3 THEN 'malformed_json' WHEN 4 THEN 'malformed_json' WHEN 5 THEN 'json_not_an_object' WHEN 6 THEN 'no_json_object' WHEN 7 THEN 'empty_response' END AS violation FROM events""")
def response_recovery(spark, sf):
    """The events' JSON as models pack it: bare, fenced, in prose, with NaN beside it; broken off, doubled commas, listed, absent, null."""
    props, prose = F.col("props"), lambda c: F.concat(F.lit("Here you are:\n"), c, F.lit("\nAnything else?"))
    broken = F.concat(F.substring(props, F.lit(1), F.length(props) - 1), F.lit(",,}"))
    forms = (props, F.concat(F.lit("```\n"), props, F.lit("\n```")), prose(props), prose(broken), F.concat(F.lit("{ "), props), F.concat(F.lit("["), props, F.lit("]")), F.regexp_replace(props, "[{}]", ""), F.lit(None).cast("string"), F.concat(F.lit('{"x": NaN, '), F.substring(props, F.lit(2), F.length(props))))
    raw = F.get(F.array(*forms), (F.col("event_id") % 9).cast("int"))
    return t(spark, sf, "events").select("event_id", P.parse_response(raw).alias("r")).select("event_id", F.get_json_object("r.record", "$.k").cast("int").alias("k"), "r.violation")
