"""Suffix dedup by lengths below, between and beyond the refinement's powers of two, against a plain version."""

from __future__ import annotations

import random

import pytest

from fieldwright.llm import suffix_dedup


def removed(rows: list[tuple[int, str]], length: int) -> dict[int, int]:
    least: dict[bytes, int] = {}
    for d, t in rows:
        for i in range(len(t) - length + 1):
            least[t[i : i + length]] = min(d, least.get(t[i : i + length], d))
    return {d: len({i + k for i in range(len(t) - length + 1) if least[t[i : i + length]] < d for k in range(length)}) for d, t in rows}


@pytest.mark.parametrize("length", [5, 20, 64, 100, 150])
def test_any_length(spark, length):
    r = random.Random(length)
    make = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    base = make(400)
    rows = [(1, base)]
    for d in range(2, 40):
        at, n = r.randrange(200), r.randint(max(1, length - 5), length + 40)
        rows.append((d, make(60) + base[at : at + n] + make(60)))
    for d, agree in enumerate(range(length // 2, length + 3), 40):  # agree in so many characters, then differ
        rows.append((d, make(30) + base[100 : 100 + agree] + "z" + base[101 + agree : 300]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc"]: x["n_removed"] for x in suffix_dedup.suffix_dedup(docs, length=length).collect()} == removed(rows, length)
