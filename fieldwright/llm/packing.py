"""Best-fit packing of token pieces into sequences, with lower bounds that certify it and exchange where there is a gap.

Documents are tokenised once; ids longer than a sequence are cut. Pieces are dealt at random into buckets of bounded
size, and each bucket is packed by best-fit decreasing. Dual-feasible functions give each bucket a lower bound on its
sequences: no packing can have fewer than the sum of the pieces' weights. Where a bucket has a gap to its bound, its
loosest sequences are opened; where it meets the bound, only what is short of the weights, less than one sequence
together. What is opened is exchanged among fewer buckets and packed again, until the whole packing meets the bound of
all pieces or an exchange saves too little. Only numbers travel, never ids or texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import tokens

SEQUENCE = 2048
END_ID = 0
#: Pieces in a bucket, on average: what one task packs at a time.
BUCKET_PIECES = 32_768
#: An exchange that saves a smaller part of the sequences it opened is the last.
LEAST_GAIN = 1e-3
#: The loosest sequences of a bucket, with this part of its room, are opened for an exchange.
OPENED_ROOM = 0.9
#: Fekete and Schepers' functions are tried up to this k.
LARGEST_K = 50

_PIECES = "part int, number long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, sequence_id long, offset long, open boolean"


def best_fit_decreasing(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece and the number of sequences; lengths are from 1 to size.

    Longest first, each piece goes where the least room is left behind it. The rooms that occur are bits of one integer,
    so the best one is its lowest bit at or above the length.
    """
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0
    for i in np.argsort(-length, kind="stable").tolist():
        need = int(length[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, at, n = size, n, n + 1
        sequence[i], offset[i] = at, size - room
        if room > need:
            with_room[room - need].append(at)
            rooms |= 1 << (room - need)
    return sequence, offset, n


def dual_feasible(lengths: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """(weights of the lengths, weight of a full sequence) by each function of two families.

    A function is dual feasible if lengths that fit in a sequence together never weigh more than a full one. The first
    family takes lengths over size - t as full and those under t as nothing, for each t up to half the size (t = 0 is the
    length itself); the second rounds (k + 1) times the share down to whole k-ths.
    """
    for t in range(size // 2 + 1):
        yield np.where(lengths > size - t, size, np.where(lengths < t, 0, lengths)), size
    for k in range(1, LARGEST_K + 1):
        exact = lengths * (k + 1) % size == 0
        yield np.where(exact, lengths * k, lengths * (k + 1) // size * size), k * size


def lower_bound(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[int, np.ndarray, int]:
    """(the least number of sequences that these lengths can need by any function, its weights, its full weight)."""
    best = (0, np.zeros(len(lengths), np.int64), 1)
    most = -1.0
    for weights, full in dual_feasible(lengths, size):
        total = int((weights * counts).sum())
        if total / full > most:
            most = total / full
            best = (-(-total // full), weights, full)
    return best


def _cut(tokenizer: str, end_id: int | None, size: int, with_ids: bool):
    encode = tokens._encode(tokenizer, end_id)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in encode(batches):
            ids, total = batch.column(1), np.asarray(batch.column(1).value_lengths()).astype(np.int64)
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            first = np.cumsum(total) - total
            pieces = -(-total // size)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, total[row] - start)
            lo = first[row] + start
            data = memoryview(flat).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            columns = [
                pa.array(np.full(len(row), part, np.int32)), pa.array(np.arange(number, number + len(row))), batch.column(0).take(pa.array(row)),
                pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
            ]
            names = ["part", "number", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:  # pieces follow one another without a gap
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(lo, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("ids")
            number += len(row)
            yield pa.record_batch(columns, names=names)

    return run


def _pack(size: int, round_: int):
    def run(key, table):
        length = table.column("length").to_numpy()
        sequence, offset, n = best_fit_decreasing(length, size)
        distinct, which, counts = np.unique(length, return_inverse=True, return_counts=True)
        bound, weights, full = lower_bound(distinct, counts, size)
        if n == bound:  # certified: what is short of the weights is less than one sequence together
            short = full - np.bincount(sequence, weights=weights[which], minlength=n)
        else:
            short = size - np.bincount(sequence, weights=length, minlength=n)
        short = np.maximum(short, 0)
        loosest = np.argsort(-short, kind="stable")
        opened = loosest[: np.searchsorted(np.cumsum(short[loosest]), OPENED_ROOM * short.sum()) + 1]
        stays = short == 0
        stays[np.setdiff1d(np.arange(n), opened)] = True
        names = [x.split()[0] for x in _PIECES.split(", ")]
        first = (round_ << 56) + (key[0].as_py() << 24)
        placed = [pa.array(first + sequence), pa.array(offset), pa.array(~stays[sequence])]
        return pa.table([*[table.column(x) for x in names], *placed], names=[*names, "sequence_id", "offset", "open"])

    return run


def _sequences(frame: DataFrame) -> tuple[int, int, int]:
    """(sequences that stay, open sequences, open pieces) of placed pieces."""
    first = F.col("offset") == 0
    row = frame.agg(F.count_if(first & ~F.col("open")), F.count_if(first & F.col("open")), F.count_if("open")).first()
    return row[0], row[1], row[2]


def _pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int | None, size: int, with_ids: bool) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ddl = f"{_PIECES}, ids array<int>" if with_ids else _PIECES
    return X.keep(X.arrow(rows, _cut(tokenizer, end_id, size, with_ids), ddl), "pieces")


def place_pieces(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """pieces(part, number, ..., length) -> the same with sequence_id and offset; (part, number) tells pieces apart.

    Lengths must be from 1 to size. The counts by length, at most `size` of them, give the bound of all pieces. A piece of
    full length is a sequence by itself. The frame must be a table that reads alike each time, as `keep` gives it.
    """
    names = [x.split()[0] for x in _PIECES.split(", ")]
    pieces = pieces.select(*names)
    by_length = pieces.groupBy("length").count().collect()
    lengths, counts = (np.array([r[i] for r in by_length], np.int64) for i in (0, 1))
    bound, _, _ = lower_bound(lengths, counts, size)
    alone = -(F.col("part").cast("long") * (1 << 40) + F.col("number")) - 1
    out = [pieces.where(F.col("length") == size).select(*names, alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    settled = int(counts[lengths == size].sum())
    to_pack, n_pieces, before, last = pieces.where(F.col("length") < size), int(counts[lengths < size].sum()), None, None
    round_ = 0
    while n_pieces:
        round_ += 1
        buckets = math.ceil(n_pieces / BUCKET_PIECES)
        dealt = to_pack.select(*names, F.pmod(F.xxhash64("part", "number", F.lit(round_)), F.lit(buckets)).alias("bucket"))
        packed = X.keep(dealt.groupBy("bucket").applyInArrow(_pack(size, round_), _PLACED), "packed")
        stay, opened, n_pieces = _sequences(packed)
        if before is not None and before - (stay + opened) < max(1, LEAST_GAIN * before):
            X.discard(packed)
            break
        settled += stay
        out.append(packed.where("NOT open").select(*names, "sequence_id", "offset"))
        last = packed.where("open").select(*names, "sequence_id", "offset")
        to_pack, before = last, opened
        if settled + opened == bound:
            break
    if last is not None:
        out.append(last)
    whole = out[0]
    for frame in out[1:]:
        whole = whole.unionByName(frame)
    return whole


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, size: int = SEQUENCE
) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The id column must be a whole number. Null and empty texts are a document of the end id alone (without an end id they
    have no piece). Rows with equal or null ids, and repeated rows, are documents of their own. Very long texts are cut
    into pieces of `size`; ties in length go by the order in which pieces were dealt. An empty table gives no rows; other
    columns of `docs`, whatever their names, are ignored.
    """
    pieces = _pieces(docs, id_col, text_col, tokenizer, end_id, size, with_ids=False)
    return place_pieces(pieces, size).drop("part", "number")


def packed_sequences(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, size: int = SEQUENCE
) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and parts (doc_id, piece, offset, length) in their order.

    Nulls, repeats, ties, long texts and empty tables are as in `pack_documents`. A sequence gathers at most `size` ids.
    """
    pieces = _pieces(docs, id_col, text_col, tokenizer, end_id, size, with_ids=True)
    placed = place_pieces(pieces, size).join(pieces.select("part", "number", "ids"), ["part", "number"])
    part: Column = F.struct("offset", "doc_id", "piece", "length", "ids")
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("parts"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and places; nulls, repeats, ties and empty tables as in `pack_documents`."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.tokenizer_path())
