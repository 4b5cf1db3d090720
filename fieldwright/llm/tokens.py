"""Token ids in ORC: tokenising whole texts, writing ids in document order, reading them back.

ORC stores the ids with integer run-length encoding and keeps a row index (least
and greatest values by stripe and row group) and a Bloom filter on the document
id, so that a reader takes stripes in parallel and skips those that can't hold a
document it asks for.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwright.llm import exchange as X
from fieldwright.llm import text as T

END_ID = 1
#: Words a worker keeps ids for; beyond it the store starts anew.
STORE_WORDS = 1_500_000
#: Bytes of text that are encoded at once (a longer text is alone).
SLICE_BYTES = 1 << 20
_stores: dict = {}


class _Store:
    """Token ids by word hash. Texts are encoded a white-space word at a time: white space is dropped by this kind of
    tokenizer and nothing in it reaches across, which `splits_at_space` checks. Words are found through two tables of
    slots; a word that lost both of its slots to others is encoded again."""

    SLOT_BITS = 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_space(self.tokenizer)
        self.letters = self._plain_letters()
        self.clear()

    def clear(self) -> None:
        self.slots = np.full((2, 1 << self.SLOT_BITS), -1, np.int32)
        self.n, self.used = 0, 0
        self.hashes = np.empty(1 << 16, np.uint64)
        self.at = np.empty(1 << 16, np.int64)
        self.length = np.empty(1 << 16, np.int32)
        self.ids = np.empty(1 << 18, np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_letters(self) -> dict[int, str]:
        """Latin letters and what the tokenizer makes of each before its merges: one piece, case apart."""
        out = {}
        pre, norm = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if pre is None or norm is None:
            return out
        for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]:
            got = pre.pre_tokenize_str(norm.normalize_str(chr(c)))
            if len(got) == 1:
                out[c] = got[0][0]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of words. A word of Latin letters, with or without marks behind, is one piece (or two) to
        the tokenizer, so its model is asked directly; other words go through the whole tokenizer. A few of
        the former are encoded both ways each time, and if they ever differ the short way is given up."""
        out: list = [None] * len(words)
        rest = range(len(words))
        if self.letters:
            model, letters = self.tokenizer.model.tokenize, self.letters
            marks: dict[str, list[int]] = {"": []}
            rest = []
            quick = []
            for i, w in enumerate(words):
                m = _PLAIN.fullmatch(w)
                if m is None:
                    rest.append(i)
                    continue
                ids = [t.id for t in model(m[1].translate(letters))]
                if m[2] not in marks:
                    marks[m[2]] = [t.id for t in model(m[2])]
                out[i] = ids + marks[m[2]]
                quick.append(i)
            trial = quick[:: max(1, len(quick) // 16)]
            if [out[i] for i in trial] != self.encode([words[i] for i in trial]):
                self.letters = {}
                rest = range(len(words))
        if rest:
            for i, ids in zip(rest, self.encode([words[i] for i in rest]), strict=True):
                out[i] = ids
        n = np.fromiter(map(len, out), np.int64, len(out))
        return n, np.fromiter((x for ids in out for x in ids), np.int32, int(n.sum()))

    def _slots_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.uint64(64 - self.SLOT_BITS)
        return (h >> top).astype(np.int64), ((h << np.uint64(self.SLOT_BITS)) >> top).astype(np.int64)

    def look_up(self, h: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each word's ids in self.ids; spell(i) gives the text of word i, for those not known."""
        one, two = self._slots_of(h)
        e = self.slots[0][one]
        bad = (e < 0) | (self.hashes[np.maximum(e, 0)] != h)
        f = self.slots[1][two[bad]]
        e[bad] = np.where((f >= 0) & (self.hashes[np.maximum(f, 0)] == h[bad]), f, -1)
        miss = np.flatnonzero(e < 0)
        if len(miss):
            if self.n + len(miss) > STORE_WORDS and self.n:
                self.clear()
                return self.look_up(h, spell)
            u, first = np.unique(h[miss], return_index=True)
            short = bool(self.letters)
            length, ids = self.encode_words([spell(i) for i in miss[first].tolist()])
            if short and not self.letters:  # the short way failed a trial: nothing that it gave is kept
                self.clear()
                return self.look_up(h, spell)
            base = self.n
            self.n += len(u)
            self.hashes, self.at, self.length = (_grown(x, self.n) for x in (self.hashes, self.at, self.length))
            self.ids = _grown(self.ids, self.used + len(ids))
            self.hashes[base : self.n] = u
            self.at[base : self.n] = self.used + np.cumsum(length) - length
            self.length[base : self.n] = length
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            one, two = self._slots_of(u)
            own = np.arange(base, self.n, dtype=np.int32)
            lost = self.slots[0][one] >= 0  # its first slot is another word's: take the second
            self.slots[0][one[~lost]] = own[~lost]
            self.slots[1][two[lost]] = own[lost]
            e[miss] = base + np.searchsorted(u, h[miss])
        return self.at[e], self.length[e].astype(np.int64)


_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.empty(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


def splits_at_space(tokenizer) -> bool:
    """Whether ids of a text are those of its white-space words, by trial on awkward texts."""
    trials = ["a b", "it 's don't  x\ty\n", "é ́x ‍ y", "1 2 34 %% ##", " lead and trail ", "A\x0bB\x0cC\rD", "x <|endoftext|> y"]
    for t in trials:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        apart = [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids]
        if tokenizer.encode(t, add_special_tokens=False).ids != apart:
            return False
    return True


def _encode(path: str, end_id: int | None):
    extra = [] if end_id is None else [end_id]

    def run(batches):
        if path not in _stores:
            _stores[path] = _Store(path)
        store = _stores[path]
        for batch in batches:
            buf, starts, ends = T.text_bytes(batch.column(1))
            for lo, hi in T.slices(starts, ends, SLICE_BYTES):
                a, b = int(starts[lo]), int(ends[hi - 1])
                piece = buf[a:b]
                if store.by_word:
                    ws, we, h, own = T.word_table(piece, starts[lo:hi] - a, ends[lo:hi] - a)
                    raw = piece.tobytes()
                    at, n = store.look_up(h, lambda i, raw=raw, ws=ws, we=we: raw[ws[i] : we[i]].decode()) if len(h) else (np.empty(0, np.int64),) * 2
                    upto = np.concatenate([[0], np.cumsum(n)])
                    ids = store.ids[np.repeat(at, n) + np.arange(upto[-1]) - np.repeat(upto[:-1], n)] if len(h) else np.empty(0, np.int32)
                    offsets = upto[own]
                else:
                    parts = store.encode([x.as_py() or "" for x in batch.column(1).slice(lo, hi - lo)])
                    ids = np.array([x for p in parts for x in p], np.int32)
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                if extra:
                    ids = np.insert(ids, offsets[1:], extra[0])
                    offsets = offsets + np.arange(hi - lo + 1)
                column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), column], names=["doc_id", "ids"])
            batch = buf = piece = raw = None  # not held while the next batch is read

    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> None:
    """Write (part, doc_id, ids) as ORC under `path`, documents in ascending id over the files (null ids first).

    The id column must be a whole number. Each document's ids end with end_id, unless that is None. Null texts are empty.
    Rows with equal ids each keep their own ids, those with the least text first. Other columns are ignored.
    """
    ident = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(ident.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n = X.reducers(rows)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    coded = X.arrow(ordered, _encode(tokenizer, end_id), "doc_id long, ids array<int>")
    placed = coded.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "doc_id", "ids")
    placed.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", 2000).option("orc.stripe.size", 16 << 20).orc(path)


_CRC_DDL = "part int, place long, doc_id long, n_tokens long, ids_crc32 long"


def _crc(batches):
    for batch in batches:
        ids = batch.column(3)
        data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        n = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(n)]) * 4
        crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(crc, pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, place, doc_id, ids) of the files; filters on doc_id reach ORC's row index and Bloom filters."""
    return spark.read.schema("part int, place long, doc_id long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    start is a running sum within each file part plus the sum of the parts before it, so no task sees all documents. Rows with
    equal or null ids have a row each, in file order; no files, or empty ones, give no rows.
    """
    rows = X.arrow(read_token_files(spark, path), _crc, _CRC_DDL)
    rows = X.keep(rows, "token-index")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("words"))
    parts = parts.select("part", (F.sum("words").over(Window.orderBy("part")) - F.col("words")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(parts, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids in token files; nulls, repeats and ties as in `write_token_files`, an empty table gives no rows."""
    path = X.new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return token_index(spark, path)
