"""The trie of turns against dictionaries, the merge against sorting, odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from fieldwright.llm import exchange, prefix_trie


def _plain(turns):
    """Rows of op11 by dictionaries; turns are (conv_id, turn, role, text)."""
    original = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            original.setdefault(c, []).append(((turn is not None, turn or 0), digest, role, text))
    original = {c: [(role, text) for _, _, role, text in sorted(rows)] for c, rows in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(original.get(c - c % 5, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, path in rebuilt.items():
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    return [
        (min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, m in members.items()
    ]


def _order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def _turns(seed, n):
    r = random.Random(seed)
    out = []
    for c in range(n):
        deep = r.choice([0, 1, 2, 3, 5, 9, 12])
        same = r.random() < 0.3
        for t in range(deep):
            out.append((c, t if r.random() < 0.97 else None, r.choice(["user", None]) if not same else "user", r.choice(["hi", "yes", "no é", None, "long " * 50]) if not same else f"turn {t}"))
    return out


_DDL = "conv_id long, turn long, role string, text string, id int, depth string"


def _result(spark, turns, parts=4, **how):
    frame = spark.createDataFrame([(*t, 1, "clash") for t in turns], _DDL).repartition(parts)
    sequences = exchange.keep(prefix_trie.rebuilt_sequences(frame), "test-sequences")
    nodes = prefix_trie.prefix_trie(sequences, **how)
    ends = {bytes(r["node"]): r["ends_sha256"] for r in prefix_trie.ends_digests(sequences).collect()}
    rows = nodes.collect()
    assert len({bytes(r["id"]) for r in rows}) == len(rows)
    return [(r["least"], r["depth"], r["parent_least"], r["n"], r["children"], r["leaves"], r["saved"], ends.get(bytes(r["id"]), prefix_trie.EMPTY_SHA256)) for r in rows]


@pytest.mark.parametrize("seed, group, run_bytes", [(1, 64, 32 << 20), (2, 2, 32 << 20), (3, 2, 3000)])
def test_against_dictionaries(spark, monkeypatch, seed, group, run_bytes):
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        turns = _turns(seed, 300) + [(None, 0, "user", "of none")] * 3
        turns += turns[:5]  # repeated rows
        assert _order(_result(spark, turns, run_bytes=run_bytes)) == _order(_plain(turns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_hot_path_and_a_long_conversation(spark):
    turns = [(c, t, "user", "the same") for c in range(200) for t in range(4)] + [(1000, t, "user", f"{t}") for t in range(3000)]
    assert _order(_result(spark, turns)) == _order(_plain(turns))


def test_conversations_without_turns_are_members_of_the_root(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    assert _order(_result(spark, [(c, 0, "a", "b"), (c, 1, "a", "c")])) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_an_empty_table(spark):
    frame = spark.createDataFrame([(1, 1, "a", "b", 1, "x")], _DDL).where("conv_id < 0")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt_sequences(frame)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_the_loser_tree_sorts_and_knows_what_is_shared(seed):
    r = random.Random(seed)
    digests = [bytes([i]) * prefix_trie.DIGEST for i in range(3)]
    streams, every = [], []
    for _ in range(r.randint(1, 9)):
        keys = sorted(b"".join(r.choice(digests) for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 30)))
        streams.append([(k, prefix_trie._shared(keys[i - 1], k, 0) if i else 0, None) for i, k in enumerate(keys)])
        every += keys
    tree = prefix_trie.LoserTree([iter(s) for s in streams])
    merged = list(tree)
    assert [k for k, _, _ in merged] == sorted(every)
    for (a, _, _), (b, shared, _) in zip(merged, merged[1:]):
        assert shared == prefix_trie._shared(a, b, 0)
    if len(streams) > 3:
        assert tree.compared < len(every) * len(streams)  # most matches are decided by what is known


def test_shared_turns_by_steps():
    r = random.Random(4)
    for _ in range(300):
        n, m = r.randint(0, 40), r.randint(0, 40)
        both = r.randint(0, min(n, m))
        head = r.randbytes(both * prefix_trie.DIGEST)
        a, b = head + b"a" * ((n - both) * prefix_trie.DIGEST), head + b"b" * ((m - both) * prefix_trie.DIGEST)
        assert prefix_trie._shared(a, b, r.randint(0, both)) == both
