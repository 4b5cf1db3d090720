"""Ranked search against a plain scoring of every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldwright.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def _plain(docs, items, best):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            n, score = sum(c.values()), 0
            for t in _terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + (75 * n * n_docs) // n_terms
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(scored[:best])]
    return out


def _order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def _corpus(seed):
    r = random.Random(seed)
    words = ["alpha", "Alpha", "beta", "x1", "été", "ÉTÉ", "日本", "common", "common", "Common-sense", "a_b", "rare%d" % seed]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 40])))) for i in range(200)]
    docs += [(i, "copied words alpha") for i in range(400, 460)] + [(5, "copied words alpha"), (5, "another alpha"), (None, "copied words alpha"), (None, None), (500, None), (501, "--- !!"), (502, "beta " * 20_000)]
    items = [(1, "alpha beta beta"), (1, "copied words"), (None, "ÉTÉ x1 common"), (3, None), (4, "nowhere"), (5, ""), (6, "common common sense a b Rare%d" % seed), (7, "copied ALPHA")]
    return docs, items


@pytest.mark.parametrize("window, uses, best", [(8192, 200_000, 10), (64, 200_000, 10), (64, 4, 3)])
def test_against_plain_scoring(spark, monkeypatch, window, uses, best):
    monkeypatch.setattr(ranked_search, "BLOCK_USES", uses)
    docs, items = _corpus(window + best)
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, score string, number int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int").repartition(3)
    got = ranked_search.search(ranked_search.write_index(frame, window=window), asked, best=best).collect()
    assert _order([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got]) == _order(_plain(docs, items, best))


def test_windows_are_cut_by_documents_and_bytes():
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array(["word%d and more" % i for i in range(50)])], names=["id", "text"])
    whole = list(ranked_search._index(iter([batch])))
    assert len(whole) == 1
    docs = np.frombuffer(whole[0].column(4)[0].as_buffer(), np.uint16)
    terms = np.frombuffer(whole[0].column(2)[0].as_buffer(), np.uint64)
    assert len(docs) == 150 and len(terms) == 52 and (np.diff(terms.astype(object)) > 0).all()


def test_small_windows_give_more_rows():
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array(["word%d and more" % i for i in range(50)])], names=["id", "text"])
    assert [len(b.column(0)[0].as_buffer()) // 8 for b in ranked_search._index(iter([batch]), 16)] == [16, 16, 16, 2]
    by_bytes = [len(b.column(0)[0].as_buffer()) // 8 for b in ranked_search._index(iter([batch]), 16, 40)]
    assert sum(by_bytes) == 50 and max(by_bytes) < 16


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert ranked_search.search(ranked_search.write_index(docs.where("doc_id < 0")), items).count() == 0
    none = ranked_search.search(ranked_search.write_index(docs), items.where("item_id < 0"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
