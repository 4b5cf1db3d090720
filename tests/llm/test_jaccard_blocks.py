"""Families of many blocks: size bands lose no link."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fieldwright.llm import jaccard


def test_linked_sizes_are_in_one_band_or_neighbouring_ones():
    for percent in (1, 50, 75, 99, 100):
        width = jaccard._band_width(percent)
        n = np.arange(1, 20_001)
        low = -(-n * percent // 100)  # the least size that a set of n can be linked with
        assert (np.floor(np.log(n) / width) - np.floor(np.log(np.maximum(low, 1)) / width)).max() <= 1


@pytest.mark.parametrize("percent", [50, 75])
def test_families_of_many_blocks(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    r = random.Random(percent)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(90):  # prefixes of one text with a few words replaced: one family of many sizes
        words = base[: r.randint(5, 120)]
        for _ in range(r.choice((0, 0, 1, 2))):
            words[r.randrange(len(words))] = f"x{r.randrange(1000)}"
        texts[i] = " ".join(words)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    linked = {i: [j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in sets}
    root = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += linked[j]
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in jaccard.jaccard_components(docs, percent=percent).collect()}
    assert got == {i: (len(sets[i]), root[i], len(linked[i])) for i in sets}
