"""N-gram Jaccard join of whole texts, as a blocked sparse product of the document by n-gram incidence matrix.

1. Rows that can't link are left out: of each document the least 40 % of its shingle hashes are counted by how many
   documents have them. A linked document misses at most a quarter of its shingles in its partner, so if more than that
   are its alone already in the sample, it has no partner.
2. Equal sets become one row of the matrix. Rows that share one of their rarest shingles (the prefix in which any linked
   pair must meet) form families; no linked pair is split between families.
3. Each family is a block of rows. A large one is cut by size into bands, and these into blocks: linked sets have sizes
   within a ratio of 100 to p, so only blocks of one band or of neighbouring ones meet. A task multiplies two blocks,
   adding up overlap counts over blocks of columns, and keeps the pairs whose count reaches the bound that their sizes
   set: 100 c >= p (x + y - c).
   Out of a task come links of a spanning forest and each row's number of links, not all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import text as T
from fieldwright.llm.components import components

WORDS = 5
PERCENT = 75
#: Rows of a block and columns that are multiplied at once.
BLOCK_ROWS = 1500
#: Join keys over which the members of one class of equal sets are spread.
SALTS = 16
BLOCK_COLUMNS = 4096
_H48 = np.uint64((1 << 48) - 1)


def shingle_sets(buf, starts, ends, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of 48 bits) of each row's different shingles, sorted; at most 65,535 rows."""
    _, _, h, own = T.word_table(buf, starts, ends, lower=True)
    total = T.prefix(h)
    row_of = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(own))
    g = T.hash_windows(total, words)
    inside = row_of[: len(g)] == row_of[words - 1 :] if len(g) else np.empty(0, bool)
    n = np.diff(own)
    short = np.flatnonzero((n > 0) & (n < words))
    gs = T.hash_spans(total, own[short], own[short + 1])
    key = np.concatenate([(row_of[: len(g)][inside] << np.uint64(48)) | (g[inside] >> np.uint64(16)), (short.astype(np.uint64) << np.uint64(48)) | (gs >> np.uint64(16))])
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(48)).astype(np.int64), key & _H48


def _parts(starts, ends):
    for lo, hi in T.slices(starts, ends):
        for a in range(lo, hi, 65_000):
            yield a, min(hi, a + 65_000)


def missing(n, percent: int):
    """Shingles of n that a linked document may lack at most."""
    return n - (n * percent + 99) // 100


def sampled(n, percent: int):
    """How many of n shingles are counted: three fifths more than may be missing, and one."""
    return np.minimum(n, missing(n, percent) * 8 // 5 + 1)


def _sample(keys: np.ndarray, words: int, percent: int):
    n_buckets = len(keys)

    def run(batches):
        for batch in batches:
            doc = T.numbers(batch.column(0))
            buf, starts, ends = T.text_bytes(batch.column(1))
            ds, hs, sizes = [], [], np.zeros(len(doc), np.int64)
            for lo, hi in _parts(starts, ends):
                a, b = starts[lo], ends[hi - 1]
                row, h = shingle_sets(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a, words)
                n = np.bincount(row, minlength=hi - lo)
                sizes[lo:hi] = n
                rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = rank < sampled(n, percent)[row]
                ds.append(row[keep] + lo)
                hs.append(h[keep])
            rows: list[tuple[int, int, bytes]] = []
            d = np.concatenate(ds) if ds else np.empty(0, np.int64)
            h = np.concatenate(hs) if hs else np.empty(0, np.uint64)
            # a shingle that two rows of this batch have is shared: counted here, and sent on once
            o = np.argsort(h)
            d, h = d[o], h[o]
            first = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(h)))
            many = np.repeat(size > 1, size)
            shared = np.bincount(d[many], minlength=len(doc))
            both = h[at[size > 1]]
            d, h = d[~many], h[~many]
            bucket = (T.mix(doc.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
            o, cut = X.split_by(bucket, n_buckets)
            for b in np.flatnonzero(np.diff(cut)):
                i = o[cut[b] : cut[b + 1]]
                rows.append((int(keys[b]), 1, X.pack(doc[i], sizes[i].astype(np.uint32), shared[i].astype(np.uint32))))
            o, cut = X.split_by((both % np.uint64(n_buckets)).astype(np.int64), n_buckets)
            for b in np.flatnonzero(np.diff(cut)):
                rows.append((int(keys[b]), 2, X.pack(*X.squeeze(both[o[cut[b] : cut[b + 1]]] << np.uint64(16)))))
            o, cut = X.split_by((h % np.uint64(n_buckets)).astype(np.int64), n_buckets)
            for b in np.flatnonzero(np.diff(cut)):
                i = o[cut[b] : cut[b + 1]]
                i = i[np.argsort(d[i], kind="stable")]
                g = np.flatnonzero(np.append(True, d[i][1:] != d[i][:-1]))
                rows.append((int(keys[b]), 0, X.pack(doc[d[i][g]], np.diff(np.append(g, len(i))).astype(np.uint32), *X.squeeze(h[i] << np.uint64(16)))))
            yield from X.block_batches(rows)

    return run


def _count(keys: np.ndarray):
    """Blocks of (document, shingles, shared ones) by document, from the blocks of one range of shingle hashes."""
    n = len(keys)

    def run(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        out = []
        ds, hs, flags = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for kind, block in blocks:
            x = X.unpack(block)
            if kind == 1:  # this bucket's own documents
                out.append(x)
                continue
            hs.append(X.unsqueeze(*x[-2:]))
            ds.append(np.repeat(x[0], x[1]) if kind == 0 else np.zeros(len(hs[-1]), np.int64))
            flags.append(np.full(len(hs[-1]), kind == 2))
        d, h, flagged = np.concatenate(ds), np.concatenate(hs), np.concatenate(flags)
        if len(h):
            o = np.argsort(h)
            d, h, flagged = d[o], h[o], flagged[o]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(at, len(h)))
            u, c = np.unique(d[np.repeat(size > 1, size) & ~flagged], return_counts=True)
            out.append((u, np.zeros(len(u), np.uint32), c.astype(np.uint32)))
        d, m, c = (np.concatenate(x) for x in zip(*out, strict=True))
        o, cut = X.split_by((T.mix(d.astype(np.uint64)) % np.uint64(n)).astype(np.int64), n)
        yield from X.block_batches([(int(keys[b]), 0, X.pack(d[i], m[i], c[i])) for b in np.flatnonzero(np.diff(cut)) for i in [o[cut[b] : cut[b + 1]]]])

    return run


def _total(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(doc, n, shared) of each document of a bucket."""
    d, m, c = (np.concatenate(x) for x in zip(*(X.unpack(b) for _, b in blocks), strict=True))
    u, back = np.unique(d, return_inverse=True)
    n = np.zeros(len(u), np.int64)
    np.maximum.at(n, back, m.astype(np.int64))
    shared = np.bincount(back, weights=c).astype(np.int64)
    for lo in range(0, len(u), 200_000):
        s = slice(lo, lo + 200_000)
        yield pa.record_batch([pa.array(u[s]), pa.array(n[s]), pa.array(shared[s])], names=["doc", "n", "shared"])


def _sets(words: int):
    def run(batches):
        for batch in batches:
            buf, starts, ends = T.text_bytes(batch.column(1))
            for lo, hi in _parts(starts, ends):
                a, b = starts[lo], ends[hi - 1]
                row, h = shingle_sets(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a, words)
                offsets = np.searchsorted(row, np.arange(hi - lo + 1))
                sig = np.array([np.frombuffer(hashlib.blake2b(h[x:y], digest_size=16).digest(), np.int64) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(-1, 2)
                grams = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.astype(np.int64)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sig[:, 0].copy()), pa.array(sig[:, 1].copy()), grams], names=["doc", "n", "s1", "s2", "grams"])

    return run


def overlap_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each left with each right set (of all pairs of left, if right is None)."""
    sets = left if right is None else [*left, *right]
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    use = count[column] > 1
    row, column = row[use], column[use]
    _, column = np.unique(column, return_inverse=True)
    o = np.argsort(column, kind="stable")
    row, column = row[o], column[o]
    m = len(left)
    total = np.zeros((m, m if right is None else len(right)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, last, BLOCK_COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + BLOCK_COLUMNS])
        block = np.zeros((len(sets), min(BLOCK_COLUMNS, last - lo)), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        total += block[:m] @ (block if right is None else block[m:]).T
    return total.astype(np.int64)


def _linked(sets_a, sets_b, percent: int) -> np.ndarray:
    na = np.array([len(s) for s in sets_a])
    nb = na if sets_b is None else np.array([len(s) for s in sets_b])
    c = overlap_counts(sets_a, sets_b)
    out = 100 * c >= percent * (na[:, None] + nb[None, :] - c)
    if sets_b is None:
        np.fill_diagonal(out, False)
    return out


def _forest(adjacent: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each node the least doc that it reaches; adjacent is symmetric."""
    root = doc.copy()
    todo = np.ones(len(doc), bool)
    for i in np.argsort(doc):
        if not todo[i]:
            continue
        todo[i] = False
        front = np.array([i])
        while len(front):
            near = np.flatnonzero(adjacent[front].any(axis=0) & todo)
            todo[near] = False
            root[near] = doc[i]
            front = near
    return root


def _product(percent: int):
    """Sorted rows (family, i, j, block, doc, copies, grams) -> for each doc of each task (doc, root, links)."""

    def solve(block, doc, copies, sets, i, j):
        if i == j:
            adjacent = _linked(sets, None, percent)
            links = adjacent @ copies
            return doc, _forest(adjacent, doc), links
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(a) or not len(b):
            return None
        cross = _linked([sets[k] for k in a], [sets[k] for k in b], percent)
        m = len(a)
        d = np.concatenate([doc[a], doc[b]])
        adjacent = np.zeros((len(d), len(d)), bool)
        adjacent[:m, m:] = cross
        adjacent[m:, :m] = cross.T
        return d, _forest(adjacent, d), adjacent @ np.concatenate([copies[a], copies[b]])

    def run(batches):
        now, held = None, []

        def done():
            r = solve(np.array([x[0] for x in held]), np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64), [x[3] for x in held], now[1], now[2])
            if r is not None:
                yield pa.record_batch([pa.array(np.asarray(x, np.int64)) for x in r], names=["doc", "root", "links"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            block, doc, copies = (batch.column(k).to_pylist() for k in (3, 4, 5))
            grams = batch.column(6)
            at = np.concatenate([[0], np.cumsum(np.asarray(grams.value_lengths()))])
            flat = grams.flatten().to_numpy(zero_copy_only=False)
            for r, key in enumerate(keys):
                if key != now:
                    if len(held) > 1:
                        yield from done()
                    now, held = key, []
                held.append((block[r], doc[r], copies[r], flat[at[r] : at[r + 1]]))
        if len(held) > 1:
            yield from done()

    return run


def _band_width(percent: int) -> float:
    """The width of a band in logarithms of sizes: a little over what linked sets can differ by, whatever is lost in rounding."""
    return max(float(np.log(100 / percent)), 0.01) * 1.0001


def _key(ident: Column, text: Column, unique: bool) -> Column:
    return ident if unique else F.xxhash64(ident, text)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_shingles, component_id (least id reachable by links) and n_links.

    A document's set are its different shingles of `words` words (A-Z lower-cased; words are maximal runs of bytes other
    than 0x20 and 0x09-0x0D); with fewer words, the whole sequence is the one shingle. Two documents link when 100 times
    the intersection is at least `percent` times the union. n_links counts the other documents a document links with.

    Documents without words (null or empty texts) have an empty set, no links and their own id as component. Rows with
    equal or null ids are documents of their own; rows alike in id and text are one document with several rows. A null id
    is the component's id only if all its ids are null. Other columns are ignored, whatever their names.
    """
    out, unique = _rooted(docs, id_col, text_col, words, percent)
    if unique:
        return out.select("doc_id", "n_shingles", F.col("root").alias("component_id"), "n_links")
    out = X.keep(out, "rows-by-root")
    return out.join(out.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: that of least id (where ids repeat or are null, of least id and text hash).

    Null and empty texts are linked with nothing and stay; of repeated rows one stays; very long texts are shingled whole;
    an empty table gives no rows.
    """
    out, unique = _rooted(docs, id_col, text_col, words, percent)
    stay = out.where("doc = root").select(F.col("doc").alias("key")).distinct()
    key = _key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"), unique)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # one column, so no name of `docs` can clash
    kept = docs.select(key.alias("key"), whole.alias("row")).join(stay.hint("merge"), "key", "left_semi")
    return (kept if unique else kept.dropDuplicates(["key"])).select("row.*")


def _rooted(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, bool]:
    """(doc_id, doc: the key of the row, n_shingles, root: the least key of its component, n_links), and whether ids are the keys."""
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    again = docs.select(ident.alias("i")).groupBy("i").count().where("count > 1 OR i IS NULL")
    unique = again.isEmpty()
    rows = docs.select(ident.alias("doc_id"), _key(ident, text, unique).alias("doc"), text.alias("text"))
    texts = rows.select("doc", "text")
    n = X.reducers(docs)
    keys = X.bucket_keys(n)
    blocks = X.arrow(texts, _sample(keys, words, percent), X.BLOCKS_DDL)
    met = X.reduce_blocks(blocks, n, _count(keys), X.BLOCKS_DDL)
    counts = X.keep(X.reduce_blocks(met, n, _total, "doc long, n long, shared long"), "shingle-counts")
    lack = F.col("n") - F.expr(f"(n * {percent} + 99) div 100")
    take = F.least(F.col("n"), F.expr(f"(n - (n * {percent} + 99) div 100) * 8 div 5") + 1)
    rest = counts.where((F.col("n") > 0) & (F.col("shared") >= take - lack)).select("doc")

    sets = X.arrow(texts.join(rest.hint("merge"), "doc").select("doc", "text"), _sets(words), "doc long, n long, s1 long, s2 long, grams array<long>")
    sets = X.keep(sets if unique else sets.dropDuplicates(["doc"]), "shingle-sets")
    classes = sets.groupBy("s1", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    # one very large class is one key: its members are spread over SALTS keys, each with a copy of the class
    salted = classes.where("copies > 1").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = sets.select("doc", "s1", "s2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    members = own.join(salted.hint("merge"), ["s1", "s2", "salt"], "left")
    members = X.keep(members.select("doc", F.coalesce("rep", "doc").alias("rep"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies")), "members")
    reps = X.keep(sets.join(members.where("doc = rep").select("doc", "copies").hint("merge"), "doc").select("doc", "n", "copies", "grams"), "rows")

    entries = reps.select("doc", "n", F.explode("grams").alias("g"))
    postings = entries.groupBy("g").agg(F.count("*").alias("c"), F.min("doc").alias("m")).where("c > 1")
    shared = entries.join(postings.hint("merge"), "g")
    # sets beside the shared shingles: those of one document only come first in order and take their share of the prefix
    per_doc = "PARTITION BY doc"
    ranked = shared.select("doc", "m", F.expr(f"row_number() OVER ({per_doc} ORDER BY c, g) + n - count(*) OVER ({per_doc})").alias("place"), (F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1).alias("prefix"))
    links = ranked.where("place <= prefix").select(F.col("doc").alias("a"), F.col("m").alias("b"))
    families = components(links).withColumnRenamed("a", "doc").withColumnRenamed("root", "family")

    sized = families.join(reps.select("doc", "n"), "doc").withColumn("band", F.floor(F.ln("n") / F.lit(_band_width(percent))))
    bands = sized.groupBy("family", "band").count()
    blocks = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("count") / F.lit(BLOCK_ROWS)).alias("blocks"))))
    large = bands.groupBy("family").agg(F.sum("count").alias("rows"), blocks.alias("of")).where(F.col("rows") > BLOCK_ROWS).drop("rows")
    # blocks are (band, number in it), as one long; a family of one block is block 0
    near = [f"if(map_contains_key(of, band + {k}), transform(sequence(0L, of[band + {k}] - 1), x -> (band + {k}) * 4294967296L + x), array())" for k in (-1, 0, 1)]
    tasks = (
        sized.join(large, "family", "left")
        .withColumn("block", F.expr("if(of IS NULL, 0L, band * 4294967296L + pmod(xxhash64(doc), of[band]))"))
        .withColumn("with", F.expr(f"if(of IS NULL, array(0L), concat({', '.join(near)}))"))
        .select("doc", "family", "block", F.explode(F.expr("transform(with, x -> struct(least(x, block) AS i, greatest(x, block) AS j))")).alias("t"))
        .select("doc", "family", "block", "t.i", "t.j")
    )
    rows_of = tasks.join(reps.hint("merge"), "doc").select("family", "i", "j", "block", "doc", "copies", "grams")
    dealt = rows_of.repartition(X.reducers(docs), "family", "i", "j").sortWithinPartitions("family", "i", "j")
    found = X.keep(X.arrow(dealt, _product(percent), "doc long, root long, links long"), "links-found")
    roots = components(found.where("doc <> root").select(F.col("doc").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("doc").agg(F.sum("links").alias("links"))
    classed = (
        members.join(roots.withColumnRenamed("a", "rep"), "rep", "left")
        .join(degree.withColumnRenamed("doc", "rep"), "rep", "left")
        .select("doc", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = rows.select("doc_id", "doc").join(counts.select("doc", "n"), "doc", "left").join(classed, "doc", "left")
    out = out.select("doc_id", "doc", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("root", "doc").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out, unique


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component; nulls, repeats, ties and empty tables as in `jaccard_components`."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS reach FROM (SELECT DISTINCT a FROM l) UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY doc_id),
k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, CAST(coalesce(k.links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN k ON d.doc_id = k.a
"""
