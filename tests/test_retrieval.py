import math

import numpy as np
import pytest

from tarn.config import Config
from tarn.operators import bm25, retrieval, vector_index, vector_search

CORPUS = "chunk_no long, document_url string, document_title string, chunk_index int, text string, embedding array<float>"
R = math.sqrt(0.5)


def corpus(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", f"t{i}", 0, text, vector) for i, (text, vector) in enumerate(rows)], CORPUS)


def ask(spark, text="q", vector=(1.0, 0.0)):
    return spark.createDataFrame([(1, text, list(vector))], "question_id long, question string, embedding array<float>")


def hits(df):
    return [r["document_url"] for r in df.orderBy("rank").collect()]


def test_bm25_ranks_and_scores(spark):
    texts = ["tigers are found in Nepal and India", "the weather today is sunny and warm", "raised bed gardening improves soil drainage"]
    docs = corpus(spark, [(t, [1.0, 0.0]) for t in texts])
    found = bm25.search(docs, ask(spark, "tigers Nepal tigers"), ["document_url"]).collect()
    assert [r["document_url"] for r in found] == ["u0"]
    n, mean = 7, 20 / 3
    expected = 2 * math.log(2.5 / 1.5 + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * n / mean))
    assert abs(found[0]["bm25"] - expected) < 2e-6
    assert bm25.search(docs, ask(spark, "submarine spaceship"), ["document_url"]).count() == 0
    assert bm25.search(docs.limit(0), ask(spark, "tigers"), ["document_url"]).count() == 0


def test_bm25_ties_and_k(spark):
    docs = corpus(spark, [("tiger tiger tiger number", None)] * 5 + [(None, None), ("", None)])
    assert hits(bm25.search(docs, ask(spark, "Tiger"), ["document_url"], 2)) == ["u0", "u1"]
    stats = bm25.statistics(bm25.lengths(docs, ["document_url"])).first()
    assert (stats["n_docs"], stats["mean_length"]) == (7, 20 / 7)


def test_vector_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(500, 8)), rng.normal(size=(7, 8))
    x[3] = x[9]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 8)], "id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, embedding array<double>")
    got = vector_search.top_k(docs, asked, "id", "q", 6, 8).orderBy("query_id", "rank").collect()
    s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
    expected = [(a, int(b)) for a in range(7) for b in sorted(range(500), key=lambda j: (-s[a, j], j))[:6]]
    assert [(r["query_id"], r["id"]) for r in got] == expected
    assert vector_search.top_k(docs.limit(0), asked, "id", "q", 6, 8).count() == 0


def test_queries_in_several_turns(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))], "q long, embedding array<double>").repartition(6)
    whole = sorted(map(tuple, vector_search.top_k(docs, asked, "id", "q", 3, 8).collect()))
    monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 2000)
    assert sorted(map(tuple, vector_search.top_k(docs, asked, "id", "q", 3, 8).collect())) == whole and len(whole) == 120


def test_vector_index(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [1.0]), (2002, [0.0] * 8)], "chunk_no long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 8)))], "q long, embedding array<double>")
    want = sorted(tuple(r)[:4] for r in vector_search.top_k(docs, asked, "chunk_no", "q", 4, 8).collect())
    index = vector_index.build(docs, "chunk_no", 8)
    assert index.lists.selectExpr("sum(size(ids))").first()[0] == 901 and len(index.centres) == 30
    assert sorted(tuple(r)[:4] for r in vector_index.top_k(index, asked, "q", 4, probes=30).collect()) == want  # all lists: exact
    near = {tuple(r)[:2] for r in vector_index.top_k(index, asked, "q", 4, probes=12).collect()}
    assert len(near & {w[:2] for w in want}) >= 0.9 * len(want)
    empty = vector_index.build(docs.limit(0), "chunk_no", 8)
    assert vector_index.top_k(empty, asked, "q", 4).count() == 0 and vector_index.top_k(index, asked.limit(0), "q", 4).count() == 0


def test_index_ranked(spark):
    docs = retrieval.corpus_table(corpus(spark, [("tiger", [1.0, 0.0]), ("kale", [0.0, 1.0])]))
    index = vector_index.build(docs, "chunk_no", 2)
    assert hits(retrieval.index_ranked(index, docs, ask(spark), 1)) == ["u0"]


def test_kept_postings_give_the_same(spark, monkeypatch):
    docs = corpus(spark, [(" ".join(f"w{(i * j) % 17}" for j in range(1, 9)), None) for i in range(50)])
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w16 nothing"), (3, "")], "question_id long, question string")
    want = sorted(map(tuple, bm25.search(docs, asked, ["document_url"]).collect()))
    index = bm25.build(docs, ["document_url"])
    for most in (bm25.FILTER_TERMS, 1):
        monkeypatch.setattr(bm25, "FILTER_TERMS", most)
        assert sorted(map(tuple, bm25.search(index, asked, ["document_url"]).collect())) == want and want


def test_a_corpus_is_read_once(spark):
    docs = retrieval.corpus_table(corpus(spark, [("tiger", [1.0, 0.0])]))
    assert retrieval.corpus_table(docs) is docs
    plan = retrieval.hybrid_ranked(docs, ask(spark), 5, dim=2)._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.split("\n") if "Relation" in line and "tokens#" in line]
    assert 1 <= len(reads) <= 4 and "regexp_extract_all" not in plan  # of the written table: vectors, keys for either ranking, and the rows of the few found


def test_tiers(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.4), (4, 0.05), (5, 0.35), (6, None)], "rank int, similarity double")
    got = {r["rank"]: r["tier"] for r in retrieval.tiers(rows, 0.35, 0.15).collect()}
    assert got == {1: "accepted", 2: "related", 3: "accepted", 5: "accepted"}
    assert retrieval.tiers(rows.filter("rank = 4"), 0.35, 0.2).count() == 0


def test_modes(spark):
    docs = corpus(spark, [("other words", [0.0, 1.0]), ("tiger", [R, R]), ("tiger tiger", [0.0, 1.0])])
    open_ = Config(similarity_threshold=-1.0, related_similarity_threshold=-1.0)
    question = ask(spark, "tiger")
    assert hits(retrieval.retrieve(docs, question, open_, "vector", 2, 2)) == ["u1", "u0"]
    keyword = retrieval.retrieve(docs, question, open_, "keyword", 5, 2).orderBy("rank").collect()
    assert [(r["document_url"], r["similarity"]) for r in keyword] == [("u2", 0.0), ("u1", 0.707107)]  # ranked by words, judged by cosine
    assert hits(retrieval.retrieve(docs, question, open_, "hybrid", 3, 2)) == ["u1", "u2", "u0"]
    with pytest.raises(ValueError, match="bogus"):
        retrieval.retrieve(docs, question, open_, "bogus")


def test_fusion(spark):
    schema = "question_id long, document_url string, chunk_index int, rank int"
    vector = spark.createDataFrame([(1, "both", 0, 1), (1, "vec", 0, 2)], schema)
    keyword = spark.createDataFrame([(1, "both", 0, 1), (1, "kw", 0, 2)], schema)
    got = retrieval.reciprocal_rank_fusion(vector, keyword, 5).orderBy("rank").collect()
    assert [r["document_url"] for r in got] == ["both", "vec", "kw"]
    assert [r["rrf"] for r in got] == [round(2 / 61, 12), round(1 / 62, 12), round(1 / 62, 12)]


def test_fusion_pool_is_capped(spark):
    docs = corpus(spark, [("tiger " * (i + 1), [1.0, i / 100]) for i in range(40)])
    got = retrieval.hybrid_ranked(docs, ask(spark, "tiger"), 100, dim=2)
    assert got.count() <= 30


def test_first_documents(spark):
    rows = [(1, u, i + 1) for i, u in enumerate("aabacdefg")]
    got = retrieval.first_documents(spark.createDataFrame(rows, "question_id long, document_url string, rank int"), 3).orderBy("place").collect()
    assert [r["document_url"] for r in got] == ["a", "b", "c"]


def test_top_k_is_cut_before_the_shuffle(spark):
    docs = corpus(spark, [("x", [1.0, 0.0])])
    plan = retrieval.vector_ranked(docs, ask(spark), 5, dim=2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in bm25.search(docs, ask(spark), ["document_url"])._jdf.queryExecution().executedPlan().toString()
