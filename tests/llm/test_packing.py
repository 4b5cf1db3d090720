"""Packing: every piece against the tokenizer, every sequence gapless, bounds against the exact optimum, odd inputs."""

from __future__ import annotations

import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from fieldwright.llm import exchange, packing, tokens


def _optimum(lengths: list[int], size: int) -> int:
    """Fewest sequences, by trying every place for every piece."""
    best = len(lengths)

    def place(i: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                left = list(rooms)
                left[left.index(room)] -= lengths[i]
                place(i + 1, tuple(left))
        place(i + 1, (*rooms, size - lengths[i]))

    place(0, ())
    return best


@pytest.mark.parametrize("seed", range(30))
def test_bounds_hold_and_best_fit_is_close(seed):
    r = random.Random(seed)
    size = r.choice([10, 16, 30])
    lengths = sorted((r.randint(1, size) for _ in range(8)), reverse=True)
    distinct, counts = np.unique(lengths, return_counts=True)
    bound, _, _ = packing.lower_bound(distinct, counts, size)
    sequence, offset, n = packing.best_fit_decreasing(np.array(lengths), size)
    best = _optimum(lengths, size)
    assert bound <= best <= n <= best + 1
    ends = {}
    for s, at, length in sorted(zip(sequence.tolist(), offset.tolist(), lengths, strict=True)):
        assert at == ends.get(s, 0)
        ends[s] = at + length
    assert max(ends.values()) <= size and len(ends) == n


def test_functions_are_dual_feasible():
    size = 12
    lengths = np.arange(1, size + 1)
    fitting = [x for k in (1, 2, 3, 4) for x in itertools.combinations_with_replacement(range(1, size + 1), k) if sum(x) <= size]
    for weights, full in packing.dual_feasible(lengths, size):
        assert all(sum(weights[i - 1] for i in x) <= full for x in fitting)


def test_the_bound_sees_more_than_the_sum():
    """Seven pieces over half a sequence need seven, however little they sum to."""
    assert packing.lower_bound(np.array([11]), np.array([7]), 20)[0] == 7
    assert packing.lower_bound(np.array([7]), np.array([6]), 20)[0] == 3  # two at most go together


def _rows(spark, texts, n=3):
    return spark.createDataFrame(texts, "doc_id long, text string, sequence_id string, part string").repartition(n)


def test_pieces_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    r = random.Random(5)
    words = ["alpha", "Beta", "gamma!", "été", "日本", "x1", "don't"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 12, 60, 200])))) for i in range(150)]
    texts += [(7, "a second row of id seven"), (None, None), (None, None), (300, None), (301, ""), (302, " \n"), (400, "word " * 9000)]
    docs = _rows(spark, [(i, t, "clash", "clash") for i, t in texts])
    path = tokens.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    size = 100
    want = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), size):
            part = ids[p : p + size]
            want.append((i, p // size, p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = packing.pack_documents(docs, path, size=size).collect()
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=order) == sorted(want, key=order)
    ends = {}
    for row in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert row["offset"] == ends.get(row["sequence_id"], 0)
        ends[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(ends.values()) <= size
    distinct, counts = np.unique([x[3] for x in want], return_counts=True)
    assert len(ends) <= packing.lower_bound(distinct, counts, size)[0] + 1


@pytest.mark.parametrize("sizes, over", [((1100, 700, 260, 90, 33, 5, 2048), 1.07), (range(1, 600), 1.02), ((1030, 1200, 1500), 1.0), ((2048,), 1.0)])
def test_exchange_comes_near_the_bound_over_many_buckets(spark, monkeypatch, sizes, over):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 40)
    r = random.Random(9)
    lengths = [r.choice(sizes) for _ in range(700)]
    rows = [(0, i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    pieces = exchange.keep(spark.createDataFrame(rows, packing._PIECES), "test-pieces")
    got = packing.place_pieces(pieces).collect()
    assert sorted(x["number"] for x in got) == list(range(700))
    used = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == used.get(x["sequence_id"], 0)
        used[x["sequence_id"]] = x["offset"] + x["length"]
    distinct, counts = np.unique(lengths, return_counts=True)
    bound, _, _ = packing.lower_bound(distinct, counts, packing.SEQUENCE)
    assert max(used.values()) <= packing.SEQUENCE and bound <= len(used) <= over * bound


def test_sequences_hold_the_ids(spark):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = {i: "some words and more " * (i % 9) for i in range(40)}
    docs = _rows(spark, [(i, t, "", "") for i, t in texts.items()])
    got = packing.packed_sequences(docs, path, size=16).collect()
    pieces = {}
    for row in got:
        assert len(row["ids"]) <= 16
        for p in row["parts"]:
            pieces[p["doc_id"], p["piece"]] = row["ids"][p["offset"] : p["offset"] + p["length"]]
    for i, t in texts.items():
        whole = [x for k in sorted(k for k in pieces if k[0] == i) for x in pieces[k]]
        assert whole == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_an_empty_table_packs_to_nothing(spark):
    docs = _rows(spark, [(1, "x", "", "")]).where("doc_id < 0")
    assert packing.pack_documents(docs, tokens.tokenizer_path()).count() == 0
