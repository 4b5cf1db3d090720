"""URL filters: rules indexed by their rarest literal token, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many rules the index fits into the plan, as a map from token to rules; a longer one is joined as a table.
PLAN_RULES = 2_000
#: Join keys over which the urls of one token are spread, where the index is a table.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """host_re and path_re are Java patterns, searched for in host and path; tokens must all be among the url's tokens."""

    name: str | None
    verdict: str
    host_re: str
    path_re: str
    tokens: tuple[str, ...]
    length: int = field(default=0)


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def site_rule(verdict: str, rule: str) -> Rule:
    """A rule 'host/path' for a host with all its subdomains and the paths that begin so."""
    host, slash, path = rule.partition("/")
    host, path = host.lower(), slash + path
    kept = path if path.endswith("/") or not path else path[: re.search(r"[A-Za-z0-9]*\Z", path).start()]  # a last token may go on
    return Rule(rule, verdict, rf"\A(?:[\s\S]*\.)?{re.escape(host)}\z", rf"\A{re.escape(path)}", tuple(tokens_of(f"{host} {kept}")), len(rule))


def pattern_rule(verdict: str, host_re: str, path_re: str, *tokens: str) -> Rule:
    """A rule by patterns; tokens: whole tokens that a fitting url must have."""
    return Rule(None, verdict, host_re, path_re, tokens)


SITE_RULES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
)
#: Words that a host has as a whole part of a label, and a path as a whole segment, where a page is a link farm, a shop of
#: pills, a gambling or an adult site, or a mirror of copied software.
HOST_WORDS = (
    "spam", "casino", "poker", "roulette", "slots", "bookmaker", "sportsbet", "jackpots", "viagra", "cialis", "payday", "linkfarm", "backlinks", "escorts", "porn", "xxx", "warez", "torrents",
)
PATH_WORDS = ("xxx", "porn", "casino", "poker", "warez", "backlinks", "linkfarm")
#: What is offered, behind one of the words that offer it: cheap-pills.example.org, /buy-followers/.
OFFERS = ("cheap", "buy", "free", "replica")
GOODS = ("pills", "meds", "followers", "likes", "watches", "handbags", "essays", "proxies")
#: The method's own verdict where no site rule fits; anything else is allowed.
PATTERN_RULES = (
    *[pattern_rule("block", rf"(\A|[.-]){w}[.-]", "", w) for w in HOST_WORDS],
    *[pattern_rule("block", "", rf"(?i)/{w}(/|\z)", w) for w in PATH_WORDS],
    *[pattern_rule("block", rf"(\A|[.-])({'|'.join(OFFERS)})-{w}[.-]", "", w) for w in GOODS],
    *[pattern_rule("block", "", rf"(?i)/({'|'.join(OFFERS)})-{w}(/|\z)", w) for w in GOODS],
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without '://'."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    has = F.coalesce(at > 0, F.lit(False))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lowered).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.concat_ws(" ", host, path)), "[^a-z0-9]+"))


def _structs(rules) -> Column:
    return F.array(*[
        F.struct(F.lit(r.length).alias("length"), F.lit(r.name).cast("string").alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.host_re).alias("host_re"), F.lit(r.path_re).alias("path_re"))
        for r in rules
    ])


def filter_urls(pages: DataFrame, url_col: str = "url", site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """All columns of `pages`, and url_host, url_path, url_rule and url_verdict.

    Each rule is indexed under the one of its literal tokens that fewest urls have (counted over all urls). A url's tokens
    fetch its candidate rules and only their patterns run. Of the site rules that fit, the longest decides (`url_rule`
    names it); where none fits, url_rule is null and the verdict is block if a pattern rule fits, else `default`.

    Null and empty urls and urls without '://' have empty host and path and get the default verdict; repeated rows each
    get their result; an empty table gives no rows. Columns of `pages` with these four names are replaced; other names
    can't clash. The index is a map in the plan up to PLAN_RULES rules, and each token of a url looks its rules up there;
    an index that doesn't fit is joined to the tokens of the distinct urls, with the same result.
    """
    rules = (*site_rules, *pattern_rules)
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = pages.withColumns({"url_host": host, "url_path": path})
    tokens = _tokens(F.col("url_host"), F.col("url_path"))
    words = sorted({t for r in rules for t in r.tokens})
    if len(rules) > PLAN_RULES:
        return _joined(rows, rules, words, default)
    seen = rows.select(F.explode(F.array_intersect(tokens, F.lit(words).cast("array<string>"))).alias("token")) if words else None
    counts = {r["token"]: r["count"] for r in seen.groupBy("token").count().collect()} if words else {}  # at most one row for each token of the rules
    index: dict[str, list[Rule]] = {}
    always = [r for r in rules if not r.tokens]
    for r in rules:
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    candidates = _structs(always) if always else F.array().cast(_TYPE)
    if index:
        by_token = F.create_map(*[x for t in sorted(index) for x in (F.lit(t), _structs(index[t]))])
        fetched = F.filter(F.transform(tokens, lambda t: F.try_element_at(by_token, t)), lambda r: r.isNotNull())
        candidates = F.concat(candidates, F.flatten(fetched))
    return _judged(rows.withColumn("url_verdict", candidates), F.col("url_verdict"), default).select(*[F.col(f"`{c}`") for c in rows.columns if c not in _ADDED], *_ADDED)


_ADDED = ("url_host", "url_path", "url_rule", "url_verdict")
_TYPE = "array<struct<length:int,name:string,verdict:string,host_re:string,path_re:string>>"


def _judged(rows: DataFrame, candidates: Column, default: str) -> DataFrame:
    fits = F.filter(candidates, lambda r: F.rlike(F.col("url_host"), r["host_re"]) & F.rlike(F.col("url_path"), r["path_re"]))
    named = F.array_max(F.filter(fits, lambda r: r["name"].isNotNull()))
    own = F.when(F.size(F.filter(fits, lambda r: r["name"].isNull() & (r["verdict"] == "block"))) > 0, "block").otherwise(default)
    return rows.withColumns({"url_rule": named["name"], "url_verdict": F.coalesce(named["verdict"], own)})


def _joined(rows: DataFrame, rules, words: list[str], default: str) -> DataFrame:
    """For long rule lists: rules and token counts are tables, and distinct urls fetch candidates by a join."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, r.length, r.name, r.verdict, r.host_re, r.path_re, list(r.tokens)) for i, r in enumerate(rules)], "id int, length int, name string, verdict string, host_re string, path_re string, tokens array<string>")
    places = rows.select("url_host", "url_path").distinct()
    tokens = places.select("url_host", "url_path", F.explode(_tokens(F.col("url_host"), F.col("url_path"))).alias("token"))
    listed = table.select("id", F.explode("tokens").alias("token"))
    counts = tokens.join(listed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    best = listed.join(counts, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = best.join(table.drop("tokens"), "id").select("token", F.struct("length", "name", "verdict", "host_re", "path_re").alias("rule"))
    always = [r for r in rules if not r.tokens]
    # a token of very many urls is SALTS keys
    tokens = tokens.withColumn("salt", F.pmod(F.xxhash64("url_host", "url_path"), F.lit(SALTS)).cast("int"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = tokens.join(index, ["token", "salt"]).where(F.rlike(F.col("url_host"), F.col("rule.host_re")) & F.rlike(F.col("url_path"), F.col("rule.path_re")))
    found = fits.groupBy("url_host", "url_path").agg(F.collect_set("rule").alias("url_fits"))
    out = rows.join(found, ["url_host", "url_path"], "left")
    candidates = F.coalesce(F.col("url_fits"), F.array().cast(_TYPE))
    if always:
        candidates = F.concat(candidates, _structs(always))
    return _judged(out, candidates, default).select(*[F.col(f"`{c}`") for c in rows.columns if c not in _ADDED], *_ADDED)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; nulls, repeats, long rule lists and empty tables as in `filter_urls`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP5_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rule, rhost, rpath, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
      ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (SELECT h.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, f.rule,
       coalesce(f.verdict, CASE WHEN regexp_matches(host, '(^|[.-])(@HOST)[.-]') OR regexp_matches(path, '(?i)/(@PATH)(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f ON h.page_id = f.page_id
""".replace("@HOST", "|".join([*HOST_WORDS, f"({'|'.join(OFFERS)})-({'|'.join(GOODS)})"])).replace("@PATH", "|".join([*PATH_WORDS, f"({'|'.join(OFFERS)})-({'|'.join(GOODS)})"]))
