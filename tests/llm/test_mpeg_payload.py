"""Payloads that look like tags come back whole, and a stream that lacks frames is an error."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldwright.llm import mpeg_audio as M


@pytest.mark.parametrize("units", [1, 2, 5])
def test_letters_of_a_tag_anywhere_in_the_last_unit(units):
    for at in range(M.UNIT - 2):
        data = b"x" * ((units - 1) * M.UNIT + at) + b"TAG" + b"y" * (M.UNIT - 3 - at)
        b = M.write_stream(data)
        s = M.read_stream(b)
        assert M.payload_of(b, s) == data and s.table_frames == len(s.offsets) == units and "TIT2" not in s.tags, at


def test_a_tag_behind_the_frames_is_still_read():
    data = b"TAG" * 500
    b = M.write_stream(data) + b"TAG" + b"title".ljust(125, b"\0")
    s = M.read_stream(b)
    assert s.tags["TIT2"] == "title" and M.whole_payload(b, s) == M.pad_payload(data) and s.skipped == 0


def test_missing_frames_raise():
    b = M.write_stream(b"x" * 3000)
    cut = b[: -M._FRAME]
    with pytest.raises(ValueError, match="5 of 6 frames"):
        M.whole_payload(cut, M.read_stream(cut))


def test_query_keeps_a_text_with_a_tag(spark, tmp_path):
    text = "s" * 521 + "TAG" + "e" * 52
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = M.op2_mpeg_audio(spark, str(tmp_path)).withColumn("want", F.sha2(F.lit(text), 256)).first()
    assert r["payload_bytes"] == r["n_bytes"] == 576 and r["payload_sha256"] == r["want"]


def test_durations_and_seek_offsets_are_stored(spark):
    texts = [(1, "a" * 2000), (2, None), (2, "b"), (None, "TAG" * 700)]
    stored = M.encode_audio(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = stored.collect()
    assert len(rows) == 4
    for r in rows:
        s = M.read_stream(bytes(r["media"]))
        assert r["offsets"] == s.offsets.tolist() and r["samples"] == s.samples == M.SAMPLES * len(s.offsets) and r["hertz"] == s.hertz
        assert all(bytes(r["media"])[o] == 0xFF for o in r["offsets"])
    at = lambda seconds: M.seek(F.col("offsets"), F.col("hertz"), F.lit(seconds))
    one = stored.where("doc_id = 1").select("offsets", "hertz", at(0.0).alias("a"), at(1.5 * M.SAMPLES / rows[0]["hertz"]).alias("b"), at(-1.0).alias("c"), at(1e6).alias("d")).first()
    assert (one["a"], one["b"], one["c"], one["d"]) == (one["offsets"][0], one["offsets"][1], None, None)
