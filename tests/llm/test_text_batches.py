"""Whole texts go to workers in batches of bounded bytes, and what is kept of them leaves in pieces."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from fieldwright.llm import exchange as X
from fieldwright.llm import language_id as L

TEXT = "the quick brown fox jumps over the lazy dog " * 600


def _largest(spark, rows):
    def sizes(batches):
        yield from (pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"]) for b in batches)

    return X.arrow(rows, sizes, "n long")


def test_a_pipeline_stage_sends_small_batches(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, TEXT) for i in range(2000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda spark, docs, sf_dir: _largest(spark, docs))])
    before = spark.conf.get(X._BATCH)
    sizes = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(sizes) > 2000 * len(TEXT) > 4 * X.TEXT_BATCH
    assert max(sizes) < 2 * X.TEXT_BATCH
    assert spark.conf.get(X._BATCH) == before


def test_kept_rows_leave_in_pieces(spark, monkeypatch):
    models = L.fit_models([("en", TEXT)] * 5)
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else TEXT, f"s{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    taken = {}
    monkeypatch.setattr(X, "arrow", lambda frame, run, schema: taken.setdefault("run", run) and frame)
    L.keep_identified(docs, models)
    whole = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "text", "source"), r, strict=True)) for r in rows])
    parts = list(taken["run"](iter([whole])))
    assert len(parts) > 1
    assert [(r["doc_id"], r["source"]) for p in parts for r in p.to_pylist()] == [(i, s) for i, t, s in rows if t]
