"""Languages that were not learned are rejected, learned ones kept; the models' probabilities sum to 1; pieces of long texts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldwright.llm import language_id as L

ROWS = "/root/testdata/sf0.01/documents.parquet"


def _documents():
    try:
        rows = pq.read_table(ROWS).to_pylist()
    except FileNotFoundError:
        pytest.skip("no test data here")
    return [(r["doc_id"], r["lang"], r["text"]) for r in rows if r["text"] and r["lang"]]


@pytest.mark.parametrize("absent", [None, "de", "en", "es", "fr"])
def test_a_language_left_out_is_rejected(absent):
    docs = _documents()
    models = L.fit_models([(lang, t[: L.SAMPLE_CHARS]) for i, lang, t in docs if lang != absent and zlib.crc32(str(i).encode()) % 4 != 2])
    gone: dict[str, list[bool]] = {}
    for _, lang, text in docs:
        total, n = L.score_words(models, text.split())
        h, size = -total.sum(0) / max(n.sum(), 1), n.sum()
        j = int(h.argmin())
        gone.setdefault(lang, []).append(bool(size == 0 or h[j] > models.limit[j] + 3 / np.sqrt(size)))
    for lang, lost in gone.items():
        assert np.mean(lost) >= 0.9 if lang == absent else np.mean(lost) == 0.0, (lang, np.mean(lost))


def test_probabilities_sum_to_one_after_every_context():
    texts = ["abcab abd bad cab abba", "dab acd abcd", "cad bad dad abc", "ab ab cab", "abc dab"] * 2
    m = L.fit_models([("x", t) for t in texts])
    start, end = 1, 2
    letters = [ord(c) + 16 for c in "abcd"]
    unseen = 9_999

    def p(context, symbol):
        sym = np.array([*context, symbol], np.uint64)
        at = np.array([L.ORDER - 1])
        g, c = L.grams(sym, at), L.contexts(sym, at)
        value = m.base
        for k in range(L.ORDER):
            i, has = L._find(m.ctx[k], c[k])
            value += float(m.leave[k][i[0], 0]) if has[0] else 0.0
            i, has = L._find(m.keys[k], g[k])
            value = float(m.logp[k][i[0], 0]) if has[0] else value
        return np.exp(value)

    a, b, c, d = letters
    for context in ([start] * 4, [start, start, start, a], [start, start, a, b], [start, a, b, c], [a, b, c, a], [b, c, d, d], [unseen] * 4, [unseen, start, c, a]):
        known = sum(p(context, s) for s in [*letters, end])
        assert known + (200 - len(letters) - 1) * p(context, unseen) == pytest.approx(1.0, abs=1e-5)
    with np.errstate(all="ignore"):
        one = L.fit_models([("x", t) for t in texts])
    assert one.limit[0] == pytest.approx(L._entropies(one, texts[:: L.CALIBRATION])[:, 0].max(), abs=0.5 + L.STRANGE)


def test_pieces_come_from_all_over(spark):
    text = " ".join(f"w{i}" for i in range(5000))
    rows = spark.createDataFrame([("short text",), (text,), ("x" * 30_000,), (None,)], "t string").select(L._all_over(F.col("t"), 1000).alias("p"))
    short, long, solid, none = (r["p"] for r in rows.collect())
    assert short == "short text" and none is None and solid == " ".join(["x" * 100] * 10)
    words = long.split()
    assert len(long) <= 1010 and set(words) <= set(text.split()) and any(w in text[:200].split() for w in words) and any(w in text[-200:].split() for w in words)
