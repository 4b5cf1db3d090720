"""Every overlap that the rule accepts is found, whatever words are substituted."""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
import pytest

from fieldwright.llm import decontaminate as D
from fieldwright.llm import text as T


def found(item: list[str], docs: list[list[str]], window: int = D.WINDOW, percent: int = D.PERCENT) -> set[int]:
    how = () if (window, percent) == (D.WINDOW, D.PERCENT) else (window, percent)
    index = D.Index([(1, " ".join(item))], D.MASKS, *how)
    _, _, words, own = T.word_table(*T.text_bytes(pa.array([" ".join(d) for d in docs])), lower=True)
    return set(index.overlaps(words, own, window, percent)[0].tolist())


def changed(words: list[str], most: int):
    for k in range(most + 1):
        for some in combinations(range(len(words)), k):
            yield [f"other{i}" if i in some else w for i, w in enumerate(words)]


@pytest.mark.parametrize("n", range(1, D.WINDOW + 1))
@pytest.mark.parametrize("percent", [D.PERCENT, 60, 100])
def test_every_allowed_pattern_of_a_whole_item(n, percent):
    item = [f"w{i}" for i in range(n)]
    docs = [["before", *d, "behind"] for d in changed(item, n * (100 - percent) // 100)]
    assert found(item, docs, percent=percent) == set(range(len(docs)))


def test_every_allowed_pattern_of_a_quotation():
    item = [f"w{i}" for i in range(20)]
    docs = [["before", *d, "behind"] for at in range(8) for d in changed(item[at : at + 13], 2)]
    assert found(item, docs) == set(range(len(docs)))


def test_every_allowed_pattern_of_a_longer_item():
    item = [f"w{i}" for i in range(15)]
    docs = [d for d in changed(item, 3) if any(sum(a == b for a, b in zip(d[i : i + 13], item[i : i + 13], strict=True)) >= 11 for i in range(3))]
    assert found(item, docs) == set(range(len(docs)))


def test_too_many_substitutions_are_no_overlap():
    item = [f"w{i}" for i in range(9)]
    docs = [d for d in changed(item, 2) if sum(w.startswith("other") for w in d) == 2]
    assert not found(item, docs)


@pytest.mark.parametrize("window", [3, 8, 20])
def test_other_windows(window):
    item = [f"w{i}" for i in range(24)]
    docs = list(changed(item[2 : 2 + window], window * 20 // 100))
    assert found(item, docs, window=window) == set(range(len(docs)))
