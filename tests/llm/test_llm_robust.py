"""Odd inputs of the pipeline's operators: clashing names, short and long items, cut archives, unset folders."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pytest

from fieldwright.llm import decontaminate, exchange, jaccard, language_id, mixing, mpeg_audio, url_filter, warc


def test_columns_keep_their_names_and_values(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "a", text, 7, 9, 1), (2, "b", text, 8, 9, 2), (3, None, None, 9, 9, 3)], "doc_id long, source string, text string, _key int, _stays int, mix_x int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["_key"]) for r in kept.collect()) == [(1, 7), (3, 9)]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r["mix_x"] for r in mixed.collect()} == {1, 2}
    assert "mix_x" in mixing.mix_sources(docs).columns


def test_mix_is_cut_at_the_budget(spark):
    r = random.Random(3)
    rows = [(i if i % 17 else None, r.choice("abc") if i % 11 else None, " ".join(["w"] * r.choice([0, 1, 5, 400]))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 300 and all(0 <= x["mix_taken"] <= 2 * x["mix_size"] for x in got)
    for source in ("a", "b", "c", None):
        own = [x for x in got if x["source"] == source]
        assert sum(x["mix_taken"] for x in own) == int(own[0]["mix_target"])
    assert mixing.mix_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize("item", ["alone", "one two", "one two three four"])
def test_short_benchmark_items_are_found(spark, item):
    docs = spark.createDataFrame([(1, f"before {item} behind"), (2, "nothing of it")], "doc_id long, text string")
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item), (2, ""), (3, None)], "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {1: [1], 2: []}


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, "aa", "der hund und die katze") for i in range(40)] + [(100 + i, "bb", "le chien et le chat " * 1500) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language_id.identify_language(docs, language_id.learn(docs))
    assert {r["lang_pred"] for r in got.where("doc_id >= 100").collect()} == {"bb"}


def test_a_cut_archive_raises():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    whole = gzip.compress(record) + gzip.compress(record)
    assert len(list(warc.records(whole))) == 2
    with pytest.raises(ValueError):
        list(warc.records(whole[:-8]))


def test_archives_are_the_same_again(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "x"), (1, "http://a.b/", "x"), (2, "http://a.b/c", "x"), (None, None, None), (None, None, None)], "page_id long, url string, html string")
    ids = []
    for k in range(2):
        warc.write_warc(pages, str(tmp_path / str(k)))
        found = warc.assemble_transactions(warc.read_warc(spark, str(tmp_path / str(k)))).collect()
        assert sorted((str(r["page_id"]), r["record_type"]) for r in found) == [("1", "response"), ("1", "response"), ("2", "revisit"), ("None", "response"), ("None", "response")]
        ids.append(sorted(r["capture_id"] for r in found))
    assert ids[0] == ids[1] and len(set(ids[0])) == 5


def test_long_rule_lists_judge_alike(spark, monkeypatch):
    urls = ["http://www.example.com/en/a", "http://x.com/xxx/", "http://b.net/es/q", "nothing", None, "http://spam.org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    one = sorted(map(tuple, url_filter.filter_urls(pages).collect()), key=str)
    monkeypatch.setattr(url_filter, "PLAN_RULES", 0)
    assert sorted(map(tuple, url_filter.filter_urls(pages).select("page_id", "url", *url_filter._ADDED).collect()), key=str) == one


def test_audio_query_by_brute_force(spark, tmp_path):
    texts = [None, "", "a", "TAG" * 400, "word " * 5000, "a", "é" * 575, "x" * 576, "x" * 577]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in mpeg_audio.op2_mpeg_audio(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2]["media_sha256"] == got[5]["media_sha256"] and got[2]["feature"] == got[5]["feature"]


def test_bucket_keys_reach_their_partition(spark):
    keys = exchange.bucket_keys(37)
    rows = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "k int, i int")
    assert rows.selectExpr("count_if(pmod(hash(k), 37) <> i) AS n").first()["n"] == 0


def test_archives_of_any_name_and_several_concurrent_ids(spark, tmp_path):
    def record(kind, ident, more, block):
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{ident}>\r\n{more}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    near = "WARC-Concurrent-To: <urn:a>\r\nWARC-Concurrent-To: <urn:b>\r\n"
    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    data = b"".join([record("response", "a", "", http), record("response", "b", "", http), record("request", "q", near, b"GET /\r\n\r\n"), record("metadata", "m", "WARC-Concurrent-To: <urn:b>\r\n", b"page-id: 7\r\n")])
    (tmp_path / "CC-MAIN-0.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "other.warc").write_bytes(record("response", "c", "", http))
    got = {r["capture_id"]: (r["page_id"], r["request"] and r["request"]["record_id"]) for r in warc.assemble_transactions(warc.read_warc(spark, str(tmp_path))).collect()}
    assert got == {"<urn:a>": (None, "<urn:q>"), "<urn:b>": (7, "<urn:q>"), "<urn:c>": (None, None)}
    assert warc.read_warc(spark, str(tmp_path), "other*").count() == 1


@pytest.mark.parametrize("budget", [1, 500, 3001, 10**9])
def test_a_smaller_budget_is_cut_by_the_sort(spark, budget):
    r = random.Random(8)
    rows = [(i, r.choice("abc"), " ".join(["w"] * r.choice([1, 5, 30, 90]))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, budget=budget).collect()
    whole = sum(int(t) for t in {x["source"]: x["mix_target"] for x in got}.values())
    assert sum(x["mix_taken"] for x in got) == min(budget, whole) and all(0 <= x["mix_taken"] <= 2 * x["mix_size"] for x in got)
    if budget == 3001:  # every source has given the same part of its target, but for one document
        parts = {s: sum(x["mix_taken"] for x in got if x["source"] == s) for s in "abc"}
        targets = {x["source"]: x["mix_target"] for x in got}
        time = 3001 / sum(targets.values())
        assert all(abs(parts[s] - time * targets[s]) <= 100 for s in "abc")


def test_pattern_rules_by_words_and_offers(spark):
    urls = {
        "http://best-casino.example.org/": "block", "http://casinos.example.org/": "allow", "http://a.org/x/Porn/y": "block", "http://cheap-pills.example.net/": "block", "http://pills.example.net/": "allow",
        "http://a.org/buy-followers/": "block", "http://a.org/buy-followers-now/": "allow", "http://poker.com/": "allow", "http://a.org/?q=/xxx/": "allow", "https://a.org/replica-watches": "block",
    }
    got = {r["url"]: r["url_verdict"] for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got == urls
