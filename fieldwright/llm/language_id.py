"""Language identification by character language models with interpolated Kneser-Ney smoothing.

One model for each language, over the letters of words (four start marks, the
letters, an end mark). All models share sorted arrays of n-gram hashes; beside
each hash stand the log probabilities of that n-gram, and of leaving its context,
in every language. A text gets the language of least cross-entropy for each
symbol; texts that every model finds far stranger than the texts it was
calibrated on are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import text as T

ORDER = 5
#: The sample that models are fitted on: documents for each language, characters that a document of it may have, and pieces
#: that these are taken in, from all over a longer text.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
SAMPLE_PIECES = 10
#: One document in so many of the sample is for calibration.
CALIBRATION = 5
#: How far above its own texts a language's limit is where no other was learned.
STRANGE = 1.0
UNKNOWN = "und"
_START, _END = np.uint64(1), np.uint64(2)
_STORE_WORDS = 500_000
_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(ORDER)], np.uint64)
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs of words, lower-cased, each with start marks and end mark: symbols, the word of each, whether it is predicted."""
    text = "\n".join(words).lower()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[code]
    word = np.cumsum(code == 10)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = e - s
    size = n + ORDER
    out = np.full(size.sum(), _START, np.uint64)
    at = np.cumsum(size) - size
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(at + ORDER - 1, n) + inner] = code[np.repeat(s, n) + inner].astype(np.uint64) + np.uint64(16)
    out[at + size - 1] = _END
    predicted = np.ones(len(out), bool)
    if len(at):
        predicted[(at[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return out, np.repeat(word[s], size), predicted


def grams(sym: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams of order 1 to ORDER that end at these places."""
    out, total = [], np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        total = total + (sym[at - k] + np.uint64(1)) * _MULT[k] * (sym[at - k] + np.uint64(7919))
        out.append(T.mix(total + np.uint64(k + 1)))
    return out


def contexts(sym: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts (of 0 to ORDER - 1 symbols) before these places."""
    out, total = [], np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        if k:
            total = total + (sym[at - k] + np.uint64(1)) * _MULT[k - 1] * (sym[at - k] + np.uint64(7919))
        out.append(T.mix(total + np.uint64(1000 + k)))
    return out


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray]  # by order: sorted hashes of n-grams
    logp: list[np.ndarray]  # their log probabilities, a column a language; NaN where a language has not seen one
    ctx: list[np.ndarray]  # by order: sorted hashes of contexts
    leave: list[np.ndarray]  # the log weight of the shorter context; 0 where not seen
    base: float
    limit: np.ndarray  # by language: cross-entropy above which a text is rejected


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return i, keys[i] == x if len(keys) else np.zeros(len(x), bool)


def _kneser_ney(texts: list[str], base: float):
    """For each order: (n-gram hashes, log p), (context hashes, log weight)."""
    sym, _, predicted = symbols([w for t in texts for w in t.split()])
    at = np.flatnonzero(predicted)
    g, c = grams(sym, at), contexts(sym, at)
    # types of the highest order; a lower n-gram counts the different n-grams that end in it
    kinds, first, count = np.unique(g[-1], return_index=True, return_counts=True)
    counts: list = [None] * ORDER
    types: list = [None] * ORDER
    for k in range(ORDER - 1, -1, -1):
        counts[k], types[k] = count, first
        if k:
            shorter = g[k - 1][first]
            _, i, count = np.unique(shorter, return_index=True, return_counts=True)
            first = first[i]
    out = []
    lower_key, lower_p = None, None
    for k in range(ORDER):
        i, n = types[k], counts[k].astype(np.float64)
        key, context = g[k][i], c[k][i]
        n1, n2 = (n == 1).sum(), (n == 2).sum()
        discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 + n2 else 0.5
        ctx, back = np.unique(context, return_inverse=True)
        total = np.bincount(back, weights=n)
        kinds_after = np.bincount(back)
        weight = discount * kinds_after / total
        below = np.full(len(key), np.exp(base)) if k == 0 else lower_p[np.searchsorted(lower_key, g[k - 1][i])]
        p = np.maximum(n - discount, 0) / total[back] + weight[back] * below
        o = np.argsort(key)
        lower_key, lower_p = key[o], p[o]
        out.append(((key[o], np.log(p[o])), (ctx, np.log(weight))))
    return out


def fit_models(sample: list[tuple[str, str]]) -> Models:
    """Models from (language, text) pairs; every CALIBRATION-th text of a language only sets its limit."""
    by: dict[str, list[str]] = {}
    for language, text in sample:
        by.setdefault(language, []).append(text)
    languages = sorted(by)
    base = -np.log(200.0)
    fitted = {}
    for language in languages:
        texts = by[language]
        fit = [t for i, t in enumerate(texts) if i % CALIBRATION] or texts
        fitted[language] = _kneser_ney(fit, base)
    keys, logp, ctx, leave = [], [], [], []
    for k in range(ORDER):
        for part, to_key, to_value, empty in ((0, keys, logp, np.nan), (1, ctx, leave, 0.0)):
            every = [fitted[x][k][part] for x in languages]
            key = np.unique(np.concatenate([e[0] for e in every])) if every else np.empty(0, np.uint64)
            value = np.full((len(key), len(languages)), empty, np.float32)
            for j, (a, v) in enumerate(every):
                value[np.searchsorted(key, a), j] = v
            to_key.append(key)
            to_value.append(value)
    models = Models(languages, keys, logp, ctx, leave, base, np.full(len(languages), np.inf))
    models.limit[:] = _limits(models, [by[x][::CALIBRATION] for x in languages])
    return models


def _entropies(m: Models, texts: list[str]) -> np.ndarray:
    """Cross-entropy of each text in every language; texts without a letter have no row."""
    total, n = score_words(m, [w for t in texts for w in t.split()] or ["1"])
    own = np.repeat(np.arange(len(texts)), [len(t.split()) for t in texts])
    if not len(own):
        return np.empty((0, len(m.languages)))
    size = np.bincount(own, weights=n, minlength=len(texts))
    h = np.stack([-np.bincount(own, weights=total[:, j], minlength=len(texts)) for j in range(len(m.languages))], 1)
    return h[size > 0] / size[size > 0][:, None]


def _limits(m: Models, texts: list[list[str]]) -> np.ndarray:
    """By language, the cross-entropy above which a text is rejected, from texts that no model has learned.

    Each language is left out in turn: its texts go to the nearest of the others, as those of a language that nobody has
    learned would. A language's limit is half way between what its own texts reach at most (0.99 of them) and what such
    strangers have at least (0.95 of those that came to it, or of all where none did), never below the former. With one
    language there are no strangers, and it is STRANGE above its own.
    """
    each = [_entropies(m, x) for x in texts]
    strangers: list[list[float]] = [[] for _ in texts]
    for i, h in enumerate(each):
        if len(texts) > 1:
            rest = np.delete(h, i, 1)
            nearest = np.delete(np.arange(len(texts)), i)[rest.argmin(1)] if len(h) else np.empty(0, np.int64)
            for j, x in zip(nearest.tolist(), rest.min(1).tolist() if len(h) else [], strict=True):
                strangers[j].append(x)
    every = [x for s in strangers for x in s]
    out = np.full(len(texts), np.inf)
    for j, h in enumerate(each):
        if len(h):
            own = np.quantile(h[:, j], 0.99)
            out[j] = max(own, (own + np.quantile(strangers[j] or every, 0.05)) / 2) if every else own + STRANGE
    return out


def score_words(m: Models, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word: log probability in every language, and predicted symbols (0: it has no letter)."""
    sym, word, predicted = symbols(words)
    at = np.flatnonzero(predicted)
    total = np.zeros((len(words), len(m.languages)))
    if not len(at):
        return total, np.zeros(len(words), np.int64)
    g, c = grams(sym, at), contexts(sym, at)
    _, first, back = np.unique(g[-1], return_index=True, return_inverse=True)
    p = np.full((len(first), len(m.languages)), m.base, np.float32)
    for k in range(ORDER):
        i, has = _find(m.ctx[k], c[k][first])
        p[has] += m.leave[k][i[has]]
        i, has = _find(m.keys[k], g[k][first])
        mine = m.logp[k][i[has]]
        p[has] = np.where(np.isnan(mine), p[has], mine)
    own = word[at]
    for j in range(len(m.languages)):
        total[:, j] = np.bincount(own, weights=p[back, j], minlength=len(words))
    return total, np.bincount(own, minlength=len(words))


_stores: dict[str, dict] = {}


def _predict(shared, name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    def look_up(m: Models, store: dict, hashes, spell):
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(store["hash"], unique)
        known = place < len(store["hash"])
        known[known] = store["hash"][place[known]] == unique[known]
        if not known.all():
            if len(unique) + len(store["hash"]) > 2 * _STORE_WORDS:
                store |= {"hash": np.empty(0, np.uint64), "p": np.empty((0, len(m.languages))), "n": np.empty(0, np.int64)}
                known[:] = False
            new = np.flatnonzero(~known)
            p, n = score_words(m, [spell(i) for i in first[new].tolist()])
            h = np.concatenate([store["hash"], unique[new]])
            o = np.argsort(h, kind="stable")
            store |= {"hash": h[o], "p": np.concatenate([store["p"], p])[o], "n": np.concatenate([store["n"], n])[o]}
            place = np.searchsorted(store["hash"], unique)
        return place[back]

    def run(batches):
        m = shared.value
        if name not in _stores:
            _stores.clear()
            _stores[name] = {"hash": np.empty(0, np.uint64), "p": np.empty((0, len(m.languages))), "n": np.empty(0, np.int64)}
        store = _stores[name]
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            buf, starts, ends = T.text_bytes(batch.column(1))
            for lo, hi in T.slices(starts, ends):
                a, b = int(starts[lo]), int(ends[hi - 1])
                piece = buf[a:b]
                ws, we, h, own = T.word_table(piece, starts[lo:hi] - a, ends[lo:hi] - a)
                raw = piece.tobytes()
                at = look_up(m, store, h, lambda i, raw=raw, ws=ws, we=we: raw[ws[i] : we[i]].decode("utf-8", "replace")) if len(h) else np.empty(0, np.int64)
                rows, k = hi - lo, len(m.languages)
                row = np.repeat(np.arange(rows), np.diff(own))
                n = np.bincount(row, weights=store["n"][at], minlength=rows)
                total = np.zeros((rows, k))
                for j in range(k):
                    total[:, j] = np.bincount(row, weights=store["p"][at, j], minlength=rows)
                known = (n > 0) & (k > 0)
                mean = total / np.maximum(n, 1)[:, None]
                best = np.argmax(mean, 1) if k else np.zeros(rows, np.int64)
                entropy = -mean[np.arange(rows), best] if k else np.zeros(rows)
                # posterior of the best, as if from 100 symbols at most
                z = (mean - mean.max(1, keepdims=True)) * np.minimum(n, 100)[:, None] if k else np.zeros((rows, 1))
                score = np.where(known, 1 / np.exp(z).sum(1), 0.0)
                limit = (m.limit[best] if k else np.zeros(rows)) + 3 / np.sqrt(np.maximum(n, 1))
                rejected = ~known | (entropy > limit)
                lang = names[np.where(known, best, k)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, mask=~known), pa.array(rejected)], schema=schema)
            batch = buf = piece = raw = None  # not held while the next batch is read

    return run


def keep_identified(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose language is accepted, with all their columns: `identify_language` says which.

    Null and empty texts and texts without a letter go; rows are judged each by their own text, so repeated ones alike; of
    equal entropies the first language counts; very long texts are judged whole; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    predict = _predict(shared, f"{spark.sparkContext.applicationId}-{shared._path}")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            pair = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            lo = 0
            for part in predict([pair]):  # what is kept leaves piece by piece, not as a copy of the batch
                yield batch.slice(lo, part.num_rows).filter(pc.invert(part.column(4)))
                lo += part.num_rows
            batch = pair = part = None  # not held while the next batch is read

    return X.arrow(docs, run, docs.schema)


def held_out(ident: Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _all_over(text: Column, chars: int, pieces: int = SAMPLE_PIECES) -> Column:
    """A text of up to `chars` characters whole; of a longer one, whole words of `pieces` pieces that lie evenly in it (a
    piece without a blank as it is)."""
    size, n = max(1, chars // pieces), F.length(text)

    def taken(i: int) -> Column:
        piece = F.substring(text, (F.lit(1) + F.floor((n - size) * i / max(1, pieces - 1))).cast("int"), F.lit(size))
        return F.coalesce(F.nullif(F.regexp_replace(piece, r"^\S+|\S+$", ""), F.lit("")), piece)

    return F.when(n > chars, F.concat_ws(" ", *[taken(i) for i in range(pieces)])).otherwise(text)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most `most` (language, text) pairs for each language, those of least id hash; of a text longer than `chars` characters,
    pieces of as many together (`_all_over`)."""
    ident = F.col(f"`{id_col}`")
    rows = docs.where(~held_out(ident)).select(F.col(f"`{lang_col}`").alias("lang"), _all_over(F.col(f"`{text_col}`"), chars).alias("text"), F.xxhash64(ident.cast("string"), F.lit(7)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    # a cut in the hash that leaves about three times the sample, and the least of those
    cut = F.lit(None).cast("double")
    for lang, n in counts.items():
        cut = F.when(F.col("lang") == lang, min(1.0, 3 * most / n)).otherwise(cut)
    near = rows.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= cut)
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return [(r["lang"], r["text"]) for r in near.withColumn("rank", order).where(F.col("rank") <= most).orderBy("lang", "rank").select("lang", "text").collect()]


def identify_language(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: doc_id, lang_pred, score (0 to 1), cross_entropy and rejected.

    Null and empty texts and texts without a letter are 'und' with score 0 and rejected; so is everything where no language
    was learned. Equal cross-entropies: the first language in order. Repeated rows each get their row; null ids stay null.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return X.arrow(rows, _predict(shared, f"{spark.sparkContext.applicationId}-{shared._path}"), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_DOCS) -> Models:
    return fit_models(training_sample(docs, id_col, text_col, lang_col, most))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; nulls, ties, repeats and empty tables as in `identify_language`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify_language(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
