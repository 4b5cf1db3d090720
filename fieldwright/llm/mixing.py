"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share_percent: int, times: int) -> DataFrame:
    """(source_key, source_size, target) of each source of sized(source_key, source, size).

    All sources share share_percent % of the total size by weight. No target exceeds `times` times its source's size:
    in the order of cap per weight, sources are capped as long as the level of the rest would lift the next above its
    cap. One row a source takes part, so the windows here are as long as the list of sources.
    """
    total = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (rank % len(weights) + 1).cast("int")).cast("long")
    everything = Window.partitionBy(F.lit(1))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    t = total.select("source_key", "source_size", w.alias("w"), (F.col("source_size") * times).alias("cap"))
    t = t.withColumns(
        {
            # 100 x what is left for this source and those after it, if all before it are capped
            "left": share_percent * F.sum("source_size").over(everything) - 100 * (F.sum("cap").over(by_cap) - F.col("cap")),
            "w_left": F.sum("w").over(everything) - (F.sum("w").over(by_cap) - F.col("w")),
        }
    )
    # capped: the level with all before it capped is at or above its own cap; this holds for a first part of the order
    t = t.withColumn("full", F.col("left") * F.col("w") >= 100 * F.col("cap") * F.col("w_left"))
    first_open = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "source_key", "left", "w_left"))).over(everything)
    t = t.withColumn("open", first_open)
    level = F.col("w") * F.col("open.left").cast("double") / (100 * F.col("open.w_left")).cast("double")
    return t.select("source_key", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def _queued(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], share_percent: int, times: int, seed: int, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(row, id, source_key, size, source_size, target, place, start): each document in its source's shuffled queue.

    `row` are the columns of `docs` that are carried, as one struct, so none of their names can clash; start is the words
    before it in its queue.
    """
    n = X.reducers(docs)
    ident, source, text = F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`")
    name = F.coalesce(ident.cast("string"), F.concat(F.lit("null"), F.xxhash64(text).cast("string")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row"), ident.alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("source_key"),
        word_count(text).alias("size"), F.md5(F.concat_ws("|", name, F.lit(str(seed)))).alias("place"),
    )
    # parts of a queue: consecutive stretches of places, as many as there are reducers
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("place", 1, 12), 16, 10).cast("double") / float(16**12) * n).cast("long"))
    parts = X.keep(rows.groupBy("source_key", "part").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "mix-parts")
    targets = source_targets(parts, weights, share_percent, times)
    before = F.sum("size").over(Window.partitionBy("source_key").orderBy("part")) - F.col("size")
    known = parts.select("source_key", "part", before.alias("before")).join(targets, "source_key")
    queue = Window.partitionBy("source_key", "part").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(queue)).join(known, ["source_key", "part"])
    return placed.select("row", "id", "source_key", "size", "source_size", "target", "place", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))


#: The order of packets: by virtual finish time, ties by source and place in the queue.
_ORDER = ("finish", "source_key", "end")


def _packets(times: int) -> Column:
    """A document's packets in all passes of its queue: its words, cut in two where time 1 falls among them.

    A packet's virtual finish time is the words of its source up to its end over the source's target. Packets without
    words, and those of sources with target 0, aren't sent.
    """
    whole = F.floor("target").cast("long")
    each = []
    for k in range(times):
        lo = F.col("start") + k * F.col("source_size")
        hi = lo + F.col("size")
        cut = F.least(F.greatest(whole, lo), hi)
        each += [F.struct(F.lit(k).alias("pass"), cut.alias("end"), (cut - lo).alias("words")), F.struct(F.lit(k).alias("pass"), hi.alias("end"), (hi - cut).alias("words"))]
    return F.filter(F.array(*each), lambda p: (p["words"] > 0) & (F.col("target") > 0))


def _cut(queued: DataFrame, times: int, most: int | None = None) -> DataFrame:
    """One row: the last packet that the budget pays for (finish, source_key, end) and how many of its words it pays.

    All packets are range-sorted by virtual finish time; a running total, first over the ranges and then within the one
    where the budget ends, finds the place. Null where the budget pays for everything.
    """
    n = X.reducers(queued)
    budget = queued.groupBy("source_key").agg(F.floor(F.first("target")).cast("long").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0)).alias("budget"))
    if most is not None:
        budget = budget.select(F.least("budget", F.lit(most).cast("long")).alias("budget"))
    sent = queued.select("source_key", "target", F.explode(_packets(times)).alias("p")).select((F.col("p.end") / F.col("target")).alias("finish"), "source_key", F.col("p.end").alias("end"), F.col("p.words").alias("words"))
    sorted_ = X.keep(sent.repartitionByRange(n, *_ORDER).withColumn("range", F.spark_partition_id()), "mix-packets")
    sums = sorted_.groupBy("range").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.orderBy("range"))  # one row a range
    ends = sums.withColumn("before", upto - F.col("words")).join(budget).where("budget > before AND budget <= before + words").select("range", "before", "budget")
    inside = sorted_.join(ends, "range").withColumn("at", F.col("before") + F.sum("words").over(Window.partitionBy("range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.where("at >= budget AND at - words < budget")  # a budget of 0 has no last packet
    return last.agg(F.min(F.struct(*_ORDER)).alias("last"), F.min(F.col("budget") - F.col("at") + F.col("words")).alias("paid"))


def _mixed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], share_percent: int, times: int, seed: int, carry: tuple[str, ...] | None = None, budget: int | None = None) -> DataFrame:
    """(row, size, source_size, target, taken, passes, finish) for each row of `docs`."""
    queued = X.keep(_queued(docs, id_col, source_col, text_col, weights, share_percent, times, seed, carry), "mix-queued")
    judged = queued.join(F.broadcast(_cut(queued, times, budget)))  # one row

    def paid(p: Column) -> Column:
        key = F.struct((p["end"] / F.col("target")).alias("finish"), F.col("source_key"), p["end"].alias("end"))
        return F.when(F.col("last").isNull() | (key < F.col("last")), p["words"]).when(key == F.col("last"), F.col("paid")).otherwise(F.lit(0))

    got = F.transform(_packets(times), lambda p: F.struct(p["pass"].alias("pass"), paid(p).cast("long").alias("words")))
    judged = judged.withColumn("got", F.filter(got, lambda p: p["words"] > 0))
    taken = F.aggregate("got", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    passes = F.size(F.array_distinct(F.transform("got", lambda p: p["pass"])))
    finish = F.try_divide((F.col("start") + F.col("size")).cast("double"), F.col("target"))
    return judged.select("row", "size", "source_size", "target", taken.alias("taken"), passes.alias("passes"), finish.alias("finish"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, times: int = 2, seed: int = 0, carry: tuple[str, ...] | None = None, budget: int | None = None,
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Documents of a source queue in the order of a hash of id and seed; a queue is gone through up to `times` times. A
    document's virtual finish time is the words of its source up to its end, divided by the source's target. All documents
    are range-sorted by it, and the mix is their running total up to the budget, which is all sources' targets: sources
    reach theirs at time 1, where the document in service is cut in two, so each source gives its target's whole words.
    A smaller `budget` (of 1 word at least) ends the mix earlier, at the time at which all sources together have given it:
    each has then given the same part of its target, but for the document in service, and one packet is paid in part.

    Returns all columns of `docs` (or those named in `carry`, so that texts needn't move) and mix_size, mix_source_size, mix_target, mix_taken (repeats counted), mix_passes (the
    times that any of its words are taken) and mix_finish (its first virtual finish time; null where the target is 0).

    Null texts have size 0 and give nothing; a null source is a source of its own, last in order; rows with equal or null
    ids are documents of their own, tied documents following each other by size; an empty table gives no rows. Columns of
    `docs` with these six names are replaced. Running sums go over parts of each queue, then over the parts' sums, so no
    source meets in one task; lists as long as the sources, and as the ranges, do.
    """
    names = {c: f"mix_{c}" for c in ("size", "source_size", "target", "taken", "passes", "finish")}
    out = _mixed(docs, id_col, source_col, text_col, weights, share_percent, times, seed, carry, budget)
    return out.select(*[F.col(f"row.`{c}`") for c in (docs.columns if carry is None else carry) if c not in names.values()], *[F.col(c).alias(m) for c, m in names.items()])


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, times: int = 2, seed: int = 0,
) -> DataFrame:
    """The mix itself: each document as often as the mix takes any of its words, whole each time, with the columns of `docs`.

    Null and empty texts have no words and are never taken; repeated rows, ties, null sources and ids, very long texts and
    empty tables are as in `mix_sources`.
    """
    out = _mixed(docs, id_col, source_col, text_col, weights, share_percent, times, seed).where("passes > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; nulls, ties, repeats and empty tables as in `mix_sources`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("size", "source_size", "target", "taken")
    return mix_sources(docs, carry=("doc_id",)).select("doc_id", *[F.col(f"mix_{c}").alias(c) for c in names])


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|0') AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS BIGINT) AS w FROM s),
c AS (SELECT *, 2 * source_size AS cap FROM w),
p AS (SELECT *, CAST(150 * (sum(source_size) OVER ()) - 100 * (sum(cap) OVER o - cap) AS BIGINT) AS rest,
             CAST((sum(w) OVER ()) - (sum(w) OVER o - w) AS BIGINT) AS w_rest
      FROM c WINDOW o AS (ORDER BY cap / w, source)),
f AS (SELECT *, rest * w >= 100 * cap * w_rest AS is_full FROM p),
l AS (SELECT arg_min(rest, (cap / w, source)) AS rest, arg_min(w_rest, (cap / w, source)) AS w_rest FROM f WHERE NOT is_full),
t AS (SELECT f.source, f.source_size, CASE WHEN f.is_full THEN CAST(f.cap AS DOUBLE)
             ELSE f.w * CAST(l.rest AS DOUBLE) / CAST(100 * l.w_rest AS DOUBLE) END AS target FROM f LEFT JOIN l ON true),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken
FROM q
"""
