"""The trie of conversations' turns, by mergesort of turn sequences that keeps the lengths of common prefixes.

A conversation is a key: the 16-byte digests of its turns in order. Tasks sort their keys into runs in which each key
knows how many turns it shares with the one before. Keys are range-partitioned, and a range merges its slices of the
runs by a loser tree: two heads are told apart by their common-prefix lengths with the last key alone, and only where
these are equal by their turns behind the shared ones. The merged stream goes over a stack of the open path: a key closes the
nodes below its common prefix with the last, and a closed node is finished, as no later key can reach it.

What a range can't finish, the nodes on the paths of its first and last keys, goes on as partial nodes; groups
of neighbouring ranges are run over the same stack, until one group is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X

#: Bytes of keys in a sorted run.
RUN_BYTES = 32 << 20
#: Neighbouring ranges whose partial nodes meet in one task.
GROUP = 64
DIGEST = 16
ROOT = bytes(DIGEST)
EMPTY_SHA256 = hashlib.sha256().hexdigest()
#: Rows in a batch of results.
BATCH = 20_000

_RUN = "key binary, sizes binary, n long, least long, run int, place long, shared int"
_NODE = "id binary, parent binary, depth int, size long, ends long, n long, least long, children long, leaves long, saved long"
_STREAMED = f"finished boolean, spot int, place long, {_NODE}, parent_least long"
_STREAMED_NAMES = [x.split()[0] for x in _STREAMED.split(", ")]


# --- conversations as sequences of turns ---


def _gathered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(base, id, turns), partitioned by base = id - id % 5; a conversation's turns, at some 30 bytes each, are one row."""
    ident = F.col(f"`{id_col}`").cast("long")
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = turns.select((ident - ident % 5).alias("base"), ident.alias("id"), turn.alias("t")).where("id IS NOT NULL")
    gathered = rows.repartition(X.reducers(turns), "base").groupBy("base", "id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("base", "id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def turn_sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns (digest of role and text, bytes of text) in order of turn, null first.

    Null roles and texts are empty; turns with equal numbers go by digest, and repeated rows are turns of their own; rows
    without a conversation id belong to no conversation; of a very long text only the digest goes on; other columns, whatever their
    names, are ignored; an empty table gives no rows.
    """
    return _gathered(turns, id_col, turn_col, role_col, text_col).select("id", "turns")


def head_turns(ident: Column) -> Column:
    """How many turns a conversation takes from its base: CRC-32 of the decimal id, modulo 9."""
    return (F.crc32(ident.cast("string").cast("binary")) % 9).cast("int")


def rebuilt_sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): the first turns of each conversation's base, then its own turns behind as many.

    The base of id is conversation id - id % 5. One that is absent gives no turns, a shorter one all it has; what is left can
    be a conversation without turns. Nulls, ties, repeats, long texts and empty tables as in `turn_sequences`. The few
    conversations of one base meet in one row.
    """
    of_base = _gathered(turns, id_col, turn_col, role_col, text_col).groupBy("base").agg(F.collect_list(F.struct("id", "turns")).alias("all"))
    base = F.get(F.filter("all", lambda c: c["id"] == F.col("base")), F.lit(0))["turns"]
    each = of_base.select(base.alias("head"), F.explode("all").alias("c")).select("head", "c.id", "c.turns").withColumn("h", head_turns(F.col("id")))
    none = F.slice("turns", 1, 0)
    return each.select("id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


# --- runs ---


def _shared(a: bytes, b: bytes, known: int) -> int:
    """How many turns two keys share, of which `known` are known to be equal: doubling steps, then halving ones."""
    most = min(len(a), len(b)) // DIGEST
    step, at = 1, known
    while at < most and a[at * DIGEST : (at + step) * DIGEST] == b[at * DIGEST : (at + step) * DIGEST]:
        at = min(most, at + step)
        step *= 2
    while step > 1:
        step //= 2
        if at + step <= most and a[at * DIGEST : (at + step) * DIGEST] == b[at * DIGEST : (at + step) * DIGEST]:
            at += step
    return at


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes]]:
    """(id, key, bytes of each turn) of rows (id, turns)."""
    for batch in batches:
        turns = batch.column(1)
        n = np.asarray(turns.value_lengths().fill_null(0)).astype(np.int64)
        flat = turns.flatten()
        digests = b"".join(flat.field("digest").to_pylist())
        sizes = flat.field("bytes").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
        at = 0
        for ident, k in zip(batch.column(0).to_pylist(), n.tolist(), strict=True):
            yield ident, digests[at * DIGEST : (at + k) * DIGEST], sizes[at * 8 : (at + k) * 8]
            at += k


def _runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs; equal keys of a run are one row with their number and least id."""
    run = TaskContext.get().partitionId()
    held: dict[bytes, list] = {}
    size = place = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size, place
        rows, last = [], b""
        for key in sorted(held):
            rows.append((key, *held[key], run, place, _shared(last, key, 0)))
            last, place = key, place + 1
        for lo in range(0, len(rows), BATCH):
            yield _table(rows[lo : lo + BATCH], _RUN)
        held.clear()
        size = 0

    for ident, key, sizes in _keys(batches):
        have = held.get(key)
        if have is None:
            held[key] = [sizes, 1, ident]
            size += len(key) + len(sizes) + 200
        else:
            have[1] += 1
            have[2] = min(have[2], ident)
        if size >= run_bytes:
            yield from flush()
            place += 1 << 40  # another run of the same task
    yield from flush()


_ARROW = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    return pa.record_batch([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


# --- merging ---


class LoserTree:
    """Merges sorted streams of (key, shared, payload), where shared counts the turns a key has in common with the one
    before it in its stream, into one such stream.

    Each waiting head knows what it shares with the key that last came out of its match, so two heads whose counts differ
    are told apart by these alone: the one that shares more is less. Only heads with equal counts are compared, from
    there on, and the loser then knows what it shares with the winner.
    """

    def __init__(self, streams: list[Iterator[tuple[bytes, int, object]]]):
        self.streams = streams
        self.heads: list = [next(s, None) for s in streams]
        self.shared = [0] * len(streams)  # what each head shares with the last key that passed it
        self.width = 1
        while self.width < len(streams):
            self.width *= 2
        self.losers = [-1] * self.width
        self.compared = 0
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.width:
            leaf = node - self.width
            return leaf if leaf < len(self.streams) else -1
        winner, loser = self._match(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = loser
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); a stream at its end loses."""
        if a < 0 or self.heads[a] is None:
            return b, a
        if b < 0 or self.heads[b] is None:
            return a, b
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        x, y = self.heads[a][0], self.heads[b][0]
        self.compared += 1
        both = _shared(x, y, self.shared[a])
        if x[both * DIGEST :] > y[both * DIGEST :]:
            a, b = b, a
        self.shared[b] = both
        return a, b

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        while self.top >= 0 and self.heads[self.top] is not None:
            s = self.top
            key, _, payload = self.heads[s]
            yield key, self.shared[s], payload
            self.heads[s] = next(self.streams[s], None)
            if self.heads[s] is not None:
                self.shared[s] = self.heads[s][1]
            winner, node = s, (self.width + s) // 2
            while node:
                winner, self.losers[node] = self._match(winner, self.losers[node])
                node //= 2
            self.top = winner


# --- the open path ---


class _Open:
    """A node on the open path, with what is known of it; `held` are finished children that wait for its least member."""

    __slots__ = ("id", "parent", "depth", "size", "ends", "n", "least", "children", "leaves", "saved", "first", "held")

    def __init__(self, id: bytes, parent: bytes, depth: int, size: int, first: bool):
        self.id, self.parent, self.depth, self.size, self.first = id, parent, depth, size, first
        self.ends = self.n = self.children = self.leaves = self.saved = 0
        self.least, self.held = None, []

    def row(self) -> tuple:
        return (self.id, self.parent, self.depth, self.size, self.ends, self.n, self.least, self.children, self.leaves, self.saved)

    def add(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)


class OpenPath:
    """The stack. `first` nodes are those on the path of the stream's first key; these, and those open at its end, can
    have members in the neighbouring streams, so they are partial unless this stream is the `only` one."""

    def __init__(self, spot: int, only: bool):
        self.spot, self.only, self.stack, self.out, self.place, self.began = spot, only, [], [], 0, False

    def push(self, id: bytes, size: int) -> _Open:
        parent = self.stack[-1].id if self.stack else ROOT
        node = _Open(id, parent, len(self.stack), size, not self.began)
        self.stack.append(node)
        return node

    def emit(self, finished: bool, row: tuple, parent_least: int | None) -> None:
        self.out.append((finished, self.spot, self.place, *row, parent_least))
        self.place += 1

    def cut(self, depth: int, last: bool = False) -> None:
        """Close what is open below `depth`."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            partial = (node.first or last) and not self.only
            for child in node.held:  # a partial node's least member isn't known yet
                self.emit(True, child, None if partial else node.least)
            if partial:
                self.emit(False, node.row(), None)
                continue
            node.leaves += node.children == 0
            node.saved += (node.n - 1) * node.size
            above = self.stack[-1] if self.stack else None
            if above is None:
                self.emit(True, node.row(), None)
                continue
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.add(node.n, node.least)
            if above.first and not self.only:
                self.emit(True, node.row(), None)
            else:
                above.held.append(node.row())

    def batches(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        while len(self.out) >= BATCH or (all_ and self.out):
            yield _table(self.out[:BATCH], _STREAMED)
            del self.out[:BATCH]


def child_id(parent: bytes, digest: bytes) -> bytes:
    return hashlib.md5(parent + digest).digest()


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range. Its rows come by run and place."""
    streams, last = [], None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for key, sizes, n, least, run, place, shared in zip(*columns, strict=True):
            mine = (run, place >> 40)
            if mine != last:
                streams.append([])
                shared = 0  # nothing comes before a slice
                last = mine
            streams[-1].append((key, shared, (sizes, n, least)))
    if not streams:
        return
    path = OpenPath(TaskContext.get().partitionId(), only=False)
    root = path.push(ROOT, 0)
    for key, shared, (sizes, n, least) in LoserTree([iter(s) for s in streams]):
        path.cut(shared + 1)
        size_of = np.frombuffer(sizes, np.int64)
        for d in range(shared, len(key) // DIGEST):
            path.push(child_id(path.stack[-1].id, key[d * DIGEST : (d + 1) * DIGEST]), int(size_of[d]))
        path.began = True
        end = path.stack[-1]
        end.ends += n
        end.add(n, least)
        yield from path.batches()
    assert path.stack[0] is root
    path.cut(0, last=True)
    yield from path.batches(all_=True)


def _merge_partials(only: bool):
    """The nodes of a group of neighbouring ranges, from their partial nodes. Those of one spot are the paths of its first
    and last keys, so a group gathers twice a conversation's depth for each of its GROUP spots."""

    def run(key, table):
        path = OpenPath(key[0].as_py(), only)
        names = [x.split()[0] for x in _NODE.split(", ")]
        rows = zip(*(table.column(c).to_pylist() for c in ("spot", "place", *names)), strict=True)
        spots: dict[int, list] = {}
        for spot, place, *node in rows:
            spots.setdefault(spot, []).append((place, node))
        for spot in sorted(spots):
            for id_, _, depth, size, ends, n, least, children, leaves, saved in _in_order([x for _, x in sorted(spots[spot])]):
                if depth < len(path.stack) and path.stack[depth].id == id_:
                    top = path.stack[depth]  # what is open below it may go on in the next nodes
                else:
                    path.began |= depth < len(path.stack)
                    path.cut(depth)
                    top = path.push(id_, size)
                top.ends += ends
                top.add(n, least)
                top.children += children
                top.leaves += leaves
                top.saved += saved
            path.began = True
        path.cut(0, last=True)
        return pa.Table.from_batches([*path.batches(all_=True)])

    return run


def _in_order(rows: list) -> list:
    """Partial nodes of one spot, parents before children and these in key order. They come as they were closed, children
    first and siblings in key order."""
    by_parent: dict[bytes, list] = {}
    top = None
    for row in rows:
        if row[2] == 0:
            top = row
        else:
            by_parent.setdefault(row[1], []).append(row)
    out, todo = [], [top]
    while todo:
        row = todo.pop()
        out.append(row)
        todo += reversed(by_parent.get(row[0], []))
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node at which each conversation ends."""
    rows = []
    for ident, key, _ in _keys(batches):
        node = ROOT
        for d in range(0, len(key), DIGEST):
            node = child_id(node, key[d : d + DIGEST])
        rows.append((node, ident))
        if len(rows) >= BATCH:
            yield _table(rows, "node binary, member long")
            rows = []
    if rows:
        yield _table(rows, "node binary, member long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's members, joined by commas; they come by node and id, and one state is held at a time."""
    now, sha, rows = None, None, []
    for batch in batches:
        for node, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    rows.append((now, sha.hexdigest()))
                now, sha = node, hashlib.sha256(b"%d" % member)
            else:
                sha.update(b",%d" % member)
        if len(rows) >= BATCH:
            yield _table(rows, "node binary, ends_sha256 string")
            rows = []
    if now is not None:
        yield _table([*rows, (now, sha.hexdigest())], "node binary, ends_sha256 string")


def ends_digests(sequences: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where a conversation ends. A hash over ids in order can't be split: the members of
    one node stream through one task, sorted by Spark, in constant memory."""
    ends = X.arrow(sequences, _ends, "node binary, member long")
    return X.arrow(ends.repartition(X.reducers(sequences), "node").sortWithinPartitions("node", "member"), _digests, "node binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """sequences(id, turns) -> a row for each node: id, parent (16-byte digests of the path; null above the root), depth,
    least (smallest member), parent_least, n (members), children, leaves, saved.

    `turns` are structs of digest (16 bytes) and bytes, as `turn_sequences` gives them. A null list is an empty one; ids must
    not be null; sequences that are equal, or have the same id, are members each; a long conversation is one key in memory; no
    sequences give no nodes. Turns are told apart by their 128-bit digests.
    """
    runs = X.keep(X.arrow(sequences.select("id", "turns"), lambda batches: _runs(batches, run_bytes), _RUN), "runs")
    ranges = X.reducers(runs, 2 * run_bytes)
    ordered = runs.repartitionByRange(ranges, "key").sortWithinPartitions("run", "place")
    rounds = [X.keep(X.arrow(ordered, _merge_range, _STREAMED), "nodes")]
    spots = ranges
    while True:  # each round has a GROUP-th of the spots; the last has one group
        partial = rounds[-1].where("NOT finished")
        top = rounds[-1].agg(F.max("spot")).first()[0]
        if top is None:
            break
        spots = top // GROUP + 1
        group = F.floor(F.col("spot") / GROUP).cast("int").alias("group")
        rounds.append(X.keep(partial.groupBy(group).applyInArrow(_merge_partials(spots == 1), _STREAMED), "nodes"))
        if spots == 1:
            break
    node = ["id", "parent", "depth", "n", "least", "children", "leaves", "saved"]
    each = [frame.withColumn("round", F.lit(i)) for i, frame in enumerate(rounds)]
    every = each[0]
    for frame in each[1:]:
        every = every.unionByName(frame)
    merged = every.where("finished AND round > 0").select("id", F.col("least").alias("late_least"))
    # children that were finished under a partial node get its least member by round and spot, so none of its keys is hot
    late = every.where("NOT finished").select("round", "spot", "id").join(merged, "id").withColumnRenamed("id", "parent")
    done = every.where("finished").join(late, ["round", "spot", "parent"], "left")
    root = F.col("depth") == 0
    parent_least = F.when(~root, F.coalesce("parent_least", "late_least"))
    return done.withColumn("parent", F.when(~root, F.col("parent"))).select(*node, parent_least.alias("parent_least"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations' trie; nulls, ties, repeats, long texts and empty tables as in
    `turn_sequences` and `prefix_trie`."""
    sequences = X.keep(rebuilt_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "sequences")
    nodes = prefix_trie(sequences).join(ends_digests(sequences).withColumnRenamed("node", "id"), "id", "left")
    names = {"least": "conv_id", "depth": "depth", "parent_least": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    return nodes.select(*[F.col(a).cast("long").alias(b) for a, b in names.items()], F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
             CAST(strlen(coalesce(text, '')) AS BIGINT) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'k': k, 'b': b} ORDER BY turn NULLS FIRST, k) AS l FROM t GROUP BY c),
h AS (SELECT c, l, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
                     lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda y: y::UBIGINT)),
                       lambda z, y: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384::UBIGINT) ELSE z >> 1 END)), 4294967295::UBIGINT) % 9 AS BIGINT) AS h FROM o),
r AS MATERIALIZED (SELECT h.c, list_concat(coalesce(o.l, h.l[1:0])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN o ON o.c = h.c - h.c % 5),
p AS MATERIALIZED (SELECT c, len(l) AS n, d, list_aggregate(list_transform(l[1:d], lambda x: x.k), 'string_agg', '') AS path, coalesce(l[d].b, 0) AS b
      FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
g AS MATERIALIZED (SELECT coalesce(path, '') AS path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
k AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k USING (path)),
s AS (SELECT left(path, 32 * e) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n_convs - 1) * b) AS saved
      FROM (SELECT path, n_children, n_convs, b, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path) LEFT JOIN f AS u ON f.d > 0 AND u.path = left(f.path, 32 * (f.d - 1))
"""
