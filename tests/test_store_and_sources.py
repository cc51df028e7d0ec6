import json
import os
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.config import Config
from tarn.operators import browse
from tarn.operators.components import connected_components
from tarn.operators.embedding import embed, hashing_model
from tarn.plans.ingest import ingest, ingest_new
from tarn.sources import rest
from tarn.sources.evalset import read_eval_set
from tarn.sources.store import ChunkStore, last_writes, upsert
from tarn.storage import broadcast_if_small, materialize, release, scratch, shared_dir
from tarn.streaming.ingest import question_load, upsert_stream

RECORD = "document_url string, document_title string, chunk_index int, text string, embedding array<float>"
DOCUMENT = "url string, title string, text string"
SMALL = Config(chunk_size_words=3, chunk_overlap_words=0, embedding_dim=8)
LOAD = partial(hashing_model, 8)


def test_store_upserts_by_key(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s")
    assert store.count() == 0
    store.create()
    store.insert(spark.createDataFrame([("u", "A", 0, "v1", [1.0]), ("u", "A", 1, "b", None)], RECORD))
    store.insert(spark.createDataFrame([("u", "A2", 0, "v2", [2.0]), ("w", "W", 0, "c", None)], RECORD))
    store.insert(spark.createDataFrame([], RECORD))
    assert {(r["chunk_id"], r["text"]) for r in store.read().collect()} == {("u::0", "v2"), ("u::1", "b"), ("w::0", "c")}
    store.insert(spark.createDataFrame([("u", "A3", 0, "v3", None)], RECORD), replace_documents=True)
    assert {(r["chunk_id"], r["text"]) for r in store.read().collect()} == {("u::0", "v3"), ("w::0", "c")}
    store.create()
    assert store.count() == 2
    store.clear()
    assert store.count() == 0


def test_inserts_touch_their_buckets_only(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s", buckets=8)
    store.insert(spark.createDataFrame([(f"u{i}", "A", 0, "v1", None) for i in range(60)], RECORD))
    before = store._manifest()["folders"]
    begun = store.read()  # its files outlive one write
    store.insert(spark.createDataFrame([("u7", "A", 0, "v2", None), ("u7", "A", 0, "v3", None), ("u7", "A", 1, "x", None)], RECORD))
    after = store._manifest()["folders"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert {r["text"] for r in begun.collect()} == {"v1"}
    assert {(r["chunk_id"], r["text"]) for r in store.read().filter("document_url = 'u7'").collect()} == {("u7::0", "v3"), ("u7::1", "x")}  # the last of two
    assert store.count() == 61
    store.insert(spark.createDataFrame([("u8", "A", 0, "b", None), ("u8", "A", 0, "a", None)], RECORD).selectExpr("*", "ascii(text) AS n"), order=("n",))
    assert [r["text"] for r in store.read().filter("document_url = 'u8'").collect()] == ["b"]
    assert len(list((tmp_path / "s").glob("manifest-*"))) == 2
    held = {p.parent.name for p in (tmp_path / "s").glob("data-*/b=*") if any(p.iterdir())}
    assert len(held) <= 3


def test_log_writes_are_merged_and_compacted(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s", buckets=2)
    for n in (3, 1, 5, 2, 4, 6):
        row = f"cast({n} as long) chunk_no, timestamp'2024-01-01' + make_interval(0, 0, 0, {n}) ingested_at, concat('u', id % 4, '::0') chunk_id, concat('u', id % 4) document_url, 't' document_title, 0 chunk_index, 'v{n}' text, array(1f) embedding"
        store.insert_log(spark.sql(f"SELECT {row} FROM range(4)"))
        assert all(len(f) <= 5 for f in store._manifest()["folders"].values())
        assert store.count() == 4
    assert {r["text"] for r in store.read().collect()} == {"v6"}
    assert any(len(f) < 3 for f in store._manifest()["folders"].values())  # written anew on the way


def test_last_writes_and_upsert(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 9, 4), ("b", None, 5)], "chunk_id string, ingested_at int, chunk_no int")
    assert {tuple(r) for r in last_writes(log).collect()} == {("a", 2, 3), ("b", None, 5)}
    assert "WindowGroupLimit" in last_writes(log)._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    two = spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")
    assert {tuple(r) for r in upsert(one, two).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_ingest_full_and_new(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/s")
    docs = spark.createDataFrame([("u1", "A", "a b c d e f g h i"), ("u2", "B", "x y z"), ("u3", "C", " ")], DOCUMENT)
    assert ingest(store, docs, config=SMALL, load=LOAD) == {"documents": 3, "chunks": 4}
    assert {(r["title"], r["url"]) for r in browse.list_documents(store.read()).collect()} == {("A", "u1"), ("B", "u2")}
    more = docs.unionByName(spark.createDataFrame([("u4", "D", "n")], DOCUMENT))
    assert ingest_new(store, more, SMALL, LOAD) == {"documents": 2, "chunks": 1}  # a document without chunks stays new
    assert ingest_new(store, docs.filter("url <> 'u3'"), SMALL, LOAD) == {"documents": 0, "chunks": 0}
    ingest(store, docs.filter("url = 'u1'").withColumn("text", F.lit("short")), False, SMALL, LOAD)
    assert store.read().filter("document_url = 'u1'").count() == 3  # the old tail stays


def test_ingest_tells_of_its_progress(spark, tmp_path):
    lines = []
    docs = spark.createDataFrame([("u1", "A", "a b c d"), ("u1", "A again", "x y z"), ("u3", None, " ")], DOCUMENT)
    store = ChunkStore(spark, f"{tmp_path}/s")
    ingest(store, docs, config=SMALL, load=LOAD, out=lines.append)
    assert lines == ["3 documents to chunk", "  A: 2 chunks", "  A again: 1 chunks", "  u3: 0 chunks", "3 chunks of 3 documents written"]
    assert {(r["chunk_id"], r["document_title"]) for r in store.read().collect()} == {("u1::0", "A again"), ("u1::1", "A")}  # the page fetched last wins


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "i int, text string")
    got = {r["i"]: r["embedding"] for r in embed(df, load=LOAD).collect()}
    assert got[2] is None and got[3] == [0.0] * 8 and got[1] == got[4]
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6

    def never():
        raise AssertionError("loaded")

    assert embed(df.limit(0), load=never).count() == 0


class _Api(BaseHTTPRequestHandler):
    total = 0

    def do_GET(self):
        query = {k: int(v[0]) for k, v in parse_qs(urlsplit(self.path).query).items()}
        items = [{"url": f"u{i}", "title": "t", "text": "x", "source": None} for i in range(query["offset"], min(self.total, query["offset"] + query["limit"]))]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"items": items}).encode())

    def log_message(self, *args):
        pass


def test_rest_pages(spark):
    server = HTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    for total, size in ((101, 100), (0, 10), (20, 10), (7, 10)):
        _Api.total = total
        assert rest.read_documents(spark, url, size).select("url").distinct().count() == total
        assert rest.read_documents(spark, url, size, total=total).select("url").distinct().count() == total
    server.shutdown()
    calls = []

    def fetch(address, timeout):
        calls.append(address)
        return json.dumps({"items": [{}] * (100 if len(calls) < 3 else 0)}).encode()

    assert len(list(rest.pages("http://x/", 100, 30, fetch))) == 200 and len(calls) == 3  # an exact multiple costs an empty page


def test_eval_set(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps([{"id": 1, "question": "q", "expect_article_ids": ["u"], "must_contain": [], "type": "single"}]))
    assert read_eval_set(spark, str(path)).first().asDict() == {"id": 1, "question": "q", "expect_article_ids": ["u"], "must_contain": [], "type": "single"}


def test_browser(spark):
    docs = spark.createDataFrame([("Tiger moth", "https://a.example/1"), (None, "https://a.example/2"), ("Kale", "https://b.example/3")], "title string, url string")
    assert browse.filter_titles(docs, "TIGER").count() == 1 and browse.filter_titles(docs, "").count() == 3
    assert [tuple(r) for r in browse.by_host(docs).collect()] == [
        ("a.example", 2, "Tiger moth", "https://a.example/1"), ("a.example", 2, None, "https://a.example/2"), ("b.example", 1, "Kale", "https://b.example/3"),
    ]
    assert [tuple(browse.shown_counts(docs, search).first())[:2] for search in ("TIGER", "", None, "no such")] == [(1, 3), (3, 3), (3, 3), (0, 3)]
    assert browse.shown_counts(docs.limit(0), "x").first()["caption"] == "0 of 0 documents" and browse.banner(spark.range(12345)).first()["caption"] == "12,345 chunks"


def test_evidence(spark):
    rows = [(1, "related", 2, 0.33999, None, "abcdef"), (1, "accepted", 1, 0.7005, "T", None)]
    df = spark.createDataFrame(rows, "question_id long, tier string, rank int, similarity double, document_title string, text string")
    assert [tuple(r) for r in browse.evidence(df, 3).collect()] == [(1, "accepted", 1, "0.701", "T", None), (1, "related", 2, "0.340", None, "abc...")]


def test_stream_upserts(spark, tmp_path):
    schema = "chunk_no long, ingested_at timestamp, chunk_id string, " + RECORD
    for n, text in enumerate(("old", "new")):
        rows = spark.sql(f"SELECT {n} chunk_no, timestamp'2024-01-0{n + 1}' ingested_at, 'u::0' chunk_id, 'u' document_url, 't' document_title, 0 chunk_index, '{text}' text, array(1f) embedding")
        rows.selectExpr("cast(chunk_no as long) chunk_no", *[c for c in rows.columns if c != "chunk_no"]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = ChunkStore(spark, f"{tmp_path}/store")
    frame = spark.createDataFrame([], schema)
    for _ in range(2):  # the second run finds nothing new
        upsert_stream(spark, f"{tmp_path}/in", frame.schema, store, f"{tmp_path}/check", "*.parquet")
        assert [r["text"] for r in store.read().collect()] == ["new"]


def test_streamed_late_writes_replace_nothing_newer(spark, tmp_path):
    stamps = [("timestamp'2024-01-02'", 5, "new"), ("timestamp'2024-01-01'", 9, "older"), ("null", 10, "undated"), ("timestamp'2024-01-02'", 4, "same day, before")]
    for n, (stamp, number, text) in enumerate(stamps):
        row = f"cast({number} as long) chunk_no, cast({stamp} as timestamp) ingested_at, 'u::0' chunk_id, 'u' document_url, 't' document_title, 0 chunk_index, '{text}' text, array(1f) embedding"
        spark.sql(f"SELECT {row}").coalesce(1).write.parquet(f"{tmp_path}/one{n}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        (part,) = (tmp_path / f"one{n}").glob("*.parquet")
        os.utime(part.rename(tmp_path / "in" / f"{n}.parquet"), (1_700_000_000 + n, 1_700_000_000 + n))
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    for files in (1, 2, 100):
        store = ChunkStore(spark, f"{tmp_path}/store{files}")
        upsert_stream(spark, f"{tmp_path}/in", schema, store, f"{tmp_path}/check{files}", files_per_batch=files)
        assert [r["text"] for r in store.read().collect()] == ["new"] and store.read().columns == ["chunk_id", "document_url", "document_title", "chunk_index", "text", "embedding"]
    store.insert(spark.createDataFrame([("u", "A", 0, "by hand", None), ("w", "W", 0, "c", None)], RECORD))
    assert {r["text"] for r in store.read().collect()} == {"by hand", "c"}
    store.insert_log(spark.read.parquet(f"{tmp_path}/in"))
    assert {r["text"] for r in store.read().collect()} == {"new", "c"}
    store.replace(store.read())  # nothing that a log's order is known of
    store.insert_log(spark.read.parquet(f"{tmp_path}/in/1.parquet"))
    assert {r["text"] for r in store.read().collect()} == {"older", "c"}


def test_question_load_counts_once(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, 5, 1, timestamp'2024-01-01 10:00:00'), (1L, 5, 1, timestamp'2024-01-01 10:00:00'), (1L, 5, 2, timestamp'2024-01-01 10:00:00'), (2L, 5, 1, timestamp'2024-01-01 11:00:00') t(run_id, question_id, rank_no, asked_at)")
    rows.write.parquet(f"{tmp_path}/in")
    query = question_load(spark, f"{tmp_path}/in", rows.schema).writeStream.outputMode("update").format("memory").queryName("load").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["question_id"], r["runs"]) for r in spark.table("load").collect()] == [(5, 2)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 1)] + [(500, 600 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == got[100] == 100 and got[200] == 200 and got[649] == 500
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_are_deleted(spark):
    with scratch() as keep:
        gone = materialize(spark.range(5), "x")
        with scratch() as inner:
            inner_gone, stays = materialize(spark.range(5), "x"), inner(materialize(spark.range(6), "y"))
        kept = keep(materialize(stays, "z"))
    for table in (gone, inner_gone, stays):
        with pytest.raises(Exception):
            spark.read.parquet(table._tarn_path)
    assert kept.count() == 6
    assert "broadcast" in broadcast_if_small(kept).join(kept, "id")._jdf.queryExecution().analyzed().toString().lower()


def test_materialized_tables(spark):
    table = materialize(spark.range(5), "x")
    assert table.count() == 5 and shared_dir(spark)
    release(table)
    with pytest.raises(Exception):
        spark.read.parquet(table._tarn_path)
