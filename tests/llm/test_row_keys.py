"""Rows of one id with different texts keep what is theirs."""

from __future__ import annotations

import random

from fieldwright.llm import decontaminate, substring_dedup, suffix_dedup


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_dedup_goes_back_to_the_row_that_repeats(spark):
    passage, other = _words(1, 30), _words(2, 40)
    rows = [(1, passage + " tail"), (2, passage), (2, other), (2, None), (None, _words(3, 40)), (None, _words(4, 40)), (3, _words(3, 40) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bytes_ = sorted(((r["doc"] is not None, r["doc"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(docs).collect()), key=str)
    n = len(passage.encode())
    assert bytes_ == sorted([(True, 1, n + 5, 0), (True, 2, n, n), (True, 2, len(other), 0), (True, 2, 0, 0), (False, None, len(rows[4][1]), 0), (False, None, len(rows[5][1]), 0), (True, 3, len(rows[6][1]), len(rows[4][1]))], key=str)
    words = sorted(((r["doc"] is not None, r["doc"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()), key=str)
    assert words == sorted([(True, 1, 31, 0), (True, 2, 30, 30), (True, 2, 40, 0), (True, 2, 0, 0), (False, None, 40, 0), (False, None, 40, 0), (True, 3, 41, 40)], key=str)


def test_blocks_of_the_benchmark_give_what_one_gives(spark, monkeypatch):
    items = [(i, _words(10 + i, 20)) for i in range(6)]
    rows = [(7, items[0][1]), (7, _words(90, 20)), (None, items[1][1] + " " + items[2][1]), (None, _words(91, 20)), (None, None), (8, items[3][1]), (8, items[3][1]), (9, " x ".join(t for _, t in items))]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    whole = decontaminate.decontaminate(docs, asked)
    one = sorted((str(tuple(r)) for r in whole.collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    several = decontaminate.decontaminate(docs, asked)
    assert sorted(str(tuple(r)) for r in several.collect()) == one and len(one) == len(rows)
    assert sum("False" in x for x in one) == 3
    assert decontaminate.keep_clean(docs, asked).count() == 3


def test_overlaps_against_every_alignment(spark, monkeypatch):
    """The registered columns by plain search: every alignment of every item with every text."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 8, 13, 25])))) for i in range(12)]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 10, 60]))]
        if i % 3 == 0:
            planted = r.choice(items)[1].split()
            if i % 2:
                planted[r.randrange(len(planted))] = "changed"
            words += planted
        rows.append((i, " ".join(words)))
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontaminate.decontaminate(docs, asked).collect()}
    for i, text in rows:
        words, want = text.split(), set()
        for item, t in items:
            own = t.split()
            for shift in range(-len(own) + 1, len(words)):
                same = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(own)]
                n = min(decontaminate.WINDOW, len(own))
                need = n if len(own) < 5 else -(-decontaminate.PERCENT * n // 100)
                inside = [0 <= shift + k < len(words) for k in range(len(own))]
                if any(sum(same[k : k + n]) >= need and all(inside[k : k + n]) for k in range(len(own) - n + 1)):
                    want.add(item)
        assert set(got[i]["items"]) == want and got[i]["n_items"] == len(want) and got[i]["contaminated"] == bool(want)
        assert got[i]["n_overlaps"] >= len(want) and (got[i]["longest"] > 0) == bool(want)
