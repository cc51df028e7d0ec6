"""Ranking stored chunks for questions by vector, keyword or both, and sorting them into evidence tiers.

A corpus has ``(chunk_no, document_url, document_title, chunk_index, text, embedding)``, questions have
``(question_id, question, embedding)``. Whatever ranks the chunks, tiers go by cosine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.config import DEFAULTS, Config
from tarn.functions.vector import cosine
from tarn.operators import bm25, vector_index, vector_search
from tarn.storage import materialize

KEYS = ["document_url", "chunk_index"]
RANKED = ["question_id", *KEYS, "document_title", "text", "similarity", "rank"]


def corpus_table(corpus: DataFrame) -> DataFrame:
    """``corpus`` written once with its keyword tokens and their number, to be read by any number of searches, each only the columns it needs.

    One that has been written so is taken as it is.
    """
    if getattr(corpus, "_tarn_path", None) and {"tokens", "length"} <= set(corpus.columns):
        return corpus
    columns = ["chunk_no", *KEYS, "document_title", "text", "embedding"]
    return materialize(bm25.lengths(corpus.drop("tokens", "length"), columns), "corpus")


def vector_ranked(corpus: DataFrame, questions: DataFrame, k: int, config: Config = DEFAULTS, dim: int = 64) -> DataFrame:
    """The ``k`` chunks most similar to each question by cosine. ``corpus`` is read twice: a store as it is, or what ``corpus_table`` wrote."""
    return _nearest(corpus, questions, k, dim, ["document_title", "text"]).select(*RANKED)


def index_ranked(index: vector_index.VectorIndex, corpus: DataFrame, questions: DataFrame, k: int, probes: int = vector_index.PROBES) -> DataFrame:
    """The same from an index that is kept for many searches, of the lists nearest to each question."""
    rows = corpus.select("chunk_no", *KEYS, "document_title", "text")
    found = vector_index.top_k(index, questions, "question_id", k, probes=probes, key="chunk_no", rows=rows, order=KEYS)
    return found.withColumnRenamed("query_id", "question_id").select(*RANKED)


def _nearest(corpus: DataFrame, questions: DataFrame, k: int, dim: int, columns: list[str]) -> DataFrame:
    found = vector_search.top_k(corpus, questions, "chunk_no", "question_id", k, dim, rows=corpus.select("chunk_no", *KEYS, *columns), order=KEYS)
    return found.withColumnRenamed("query_id", "question_id")


def _with_cosine(ranked: DataFrame, corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """Ranked keys with the chunk's columns and its cosine to the question; only these few pairs are compared."""
    rows = ranked.join(corpus.select(*KEYS, "document_title", "text", F.col("embedding").alias("__e")), KEYS)
    rows = rows.join(questions.select("question_id", F.col("embedding").alias("__q")), "question_id")
    return rows.withColumn("similarity", F.round(cosine(F.col("__q"), F.col("__e")), vector_search.DECIMALS)).select(*RANKED)


def keyword_ranked(corpus: DataFrame, questions: DataFrame, k: int, config: Config = DEFAULTS, dim: int = 64) -> DataFrame:
    """The ``k`` best chunks of each question by BM25, with their cosine as similarity."""
    corpus = corpus_table(corpus)
    return _with_cosine(best_by_words(corpus, questions, k, config), corpus, questions)


def best_by_words(corpus: DataFrame | bm25.Index, questions: DataFrame, k: int, config: Config = DEFAULTS, keys: DataFrame | None = None) -> DataFrame:
    """``(question_id, chunk_no, bm25, *KEYS, rank)``: the ``k`` best chunks of each question by BM25, from a corpus or from the index of one and its ``keys``."""
    keys = corpus.select("chunk_no", *KEYS) if keys is None else keys
    return bm25.search(corpus, questions, ["chunk_no"], k, k1=config.bm25_k1, b=config.bm25_b, rows=keys, order=KEYS)


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """``(question_id, *KEYS, rrf, rank)`` of two tables ``(question_id, *KEYS, rank)``: a rank r adds ``1 / (rrf_k + r)``.

    Equal scores are frequent; they go by the rank among vectors (none last), then by key.
    """
    join = ["question_id", *KEYS]
    both = vector.select(*join, F.col("rank").alias("vector_rank")).join(keyword.select(*join, F.col("rank").alias("keyword_rank")), join, "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(part("vector_rank") + part("keyword_rank"), 12))
    best = W.partitionBy("question_id").orderBy(F.desc("rrf"), F.asc_nulls_last("vector_rank"), *KEYS)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hybrid_ranked(corpus: DataFrame, questions: DataFrame, k: int, config: Config = DEFAULTS, dim: int = 64) -> DataFrame:
    """The best ``k`` of both rankers' pools, fused by reciprocal ranks."""
    corpus, pool = corpus_table(corpus), config.fusion_pool
    vector = _nearest(corpus, questions, pool, dim, [])
    keyword = best_by_words(corpus, questions, pool, config)
    return _with_cosine(reciprocal_rank_fusion(vector, keyword, k, config.rrf_k), corpus, questions)


RANKERS: dict[str, Callable[..., DataFrame]] = {"vector": vector_ranked, "keyword": keyword_ranked, "hybrid": hybrid_ranked}


def tiers(ranked: DataFrame, accepted: float = DEFAULTS.similarity_threshold, related: float = DEFAULTS.related_similarity_threshold) -> DataFrame:
    """``ranked`` with ``tier``: accepted at ``accepted`` similarity or more, related from ``related`` up to there; the rest is left out, ranks stay."""
    s = F.col("similarity")
    return ranked.withColumn("tier", F.when(s >= accepted, "accepted").when((s >= related) & (s < accepted), "related")).filter(F.col("tier").isNotNull())


def retrieve(corpus: DataFrame, questions: DataFrame, config: Config = DEFAULTS, mode: str | None = None, k: int | None = None, dim: int = 64) -> DataFrame:
    """The tiered evidence of every question. Tiers are cut after the ``k`` best are chosen."""
    mode = mode or config.retrieval_mode
    if mode not in RANKERS:
        raise ValueError(f"unknown retrieval mode {mode!r}; modes are {', '.join(sorted(RANKERS))}")
    ranked = RANKERS[mode](corpus, questions, k or config.top_k, config, dim)
    return tiers(ranked, config.similarity_threshold, config.related_similarity_threshold)


def first_documents(ranked: DataFrame, limit: int = 5) -> DataFrame:
    """``(question_id, document_url, place)``: the first ``limit`` different documents of each question, by their best rank."""
    firsts = ranked.groupBy("question_id", "document_url").agg(F.min("rank").alias("rank"))
    order = W.partitionBy("question_id").orderBy("rank", "document_url")
    return firsts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("question_id", "document_url", "place")
