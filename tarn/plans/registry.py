"""Queries by name over the whole test tables, and the DuckDB SQL that each is compared with.

The chunk store is the last write of every chunk key in ``chunks``. Questions are those of ``eval_set``;
as no text model is at hand, a question's vector is the row of ``embeddings`` with its number.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import Config
from tarn.functions import text as fn
from tarn.functions.vector import cosine
from tarn.operators import answering, bm25, browse, chunking, evaluation, retrieval, vector_index, vector_search
from tarn.operators.embedding import embed, hashing_model
from tarn.plans import oracle, stand_ins
from tarn.plans.ingest import ingest, ingest_new, new_documents
from tarn.sources.evalset import read_eval_set
from tarn.sources.rest import read_documents
from tarn.sources.store import ChunkStore, last_writes, upsert, without_stale
from tarn.storage import shared_dir
from tarn.streaming.ingest import upsert_stream

Query = Callable[[SparkSession, str], DataFrame]

DIM = 64
KEYS = retrieval.KEYS


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def store(spark: SparkSession, sf: str) -> DataFrame:
    return last_writes(read(spark, sf, "chunks"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The current store, written once for a query that reads it several times."""
    return retrieval.corpus_table(store(spark, sf))


def _new_store(spark: SparkSession) -> ChunkStore:
    return ChunkStore(spark, f"{shared_dir(spark)}/store-{os.urandom(8).hex()}")


def documents_api(spark: SparkSession, sf: str) -> DataFrame:
    """All documents by way of a paginated endpoint."""
    url = stand_ins.documents_endpoint(spark, f"{sf}/documents.parquet")
    return read_documents(spark, url).select("url", "title", F.md5("text").alias("text_md5"), "source")


def eval_set_read(spark: SparkSession, sf: str) -> DataFrame:
    """The question set written as one JSON array and read in its schema."""
    path = f"{shared_dir(spark)}/eval-set-{os.urandom(8).hex()}"
    whole = read(spark, sf, "eval_set").orderBy("id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "question", "expect_article_ids", "must_contain", "type")))).alias("value"))  # one table of questions
    whole.coalesce(1).write.text(path)
    found = read_eval_set(spark, path)
    return found.select(*_long("id"), "question", F.array_join("expect_article_ids", " ").alias("urls"), F.size("must_contain").cast("long").alias("phrases"), "type")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    return read(spark, sf, "eval_set").withColumn("question_id", F.col("id").cast("long")).join(vectors, "question_id", "left")


def logged(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieval log, a row that was logged twice once."""
    return last_writes(read(spark, sf, "retrieved").withColumn("key", F.concat_ws("/", "run_id", "rank_no")), "key", ("logged_at",)).drop("key")


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- store and browser -------------------------------------------------------------------------------


def store_current(spark: SparkSession, sf: str) -> DataFrame:
    return store(spark, sf).select("chunk_id", "chunk_no", "document_url", *_long("chunk_index"), F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n_chars"))


def store_count(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "chunks").agg(F.countDistinct("chunk_id").alias("n"))


def store_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of odd numbers written into a store of those of even numbers."""
    log = read(spark, sf, "chunks")
    even, odd = (last_writes(log.filter(F.col("chunk_no") % 2 == r)) for r in (0, 1))
    return upsert(even, odd).select("chunk_id", "chunk_no")


def store_without_stale(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of even numbers whose documents no chunk of an odd number writes again."""
    log = read(spark, sf, "chunks")
    return without_stale(last_writes(log.filter("chunk_no % 2 = 0")), log.filter("chunk_no % 2 = 1")).select("chunk_id", "chunk_no")


def documents_listed(spark: SparkSession, sf: str) -> DataFrame:
    return browse.list_documents(store(spark, sf))


def documents_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return browse.filter_titles(browse.list_documents(store(spark, sf)), "Moth")


def documents_by_host(spark: SparkSession, sf: str) -> DataFrame:
    return browse.by_host(browse.list_documents(store(spark, sf)))


def documents_shown(spark: SparkSession, sf: str) -> DataFrame:
    return browse.shown_counts(browse.list_documents(store(spark, sf)), "Moth")


def store_banner(spark: SparkSession, sf: str) -> DataFrame:
    return browse.banner(store(spark, sf))


def url_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy(fn.netloc(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def text_previews(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", fn.preview(F.col("text")).alias("preview"), fn.thousands(F.length("text")).alias("n_chars"))


# --- ingest ------------------------------------------------------------------------------------------


def text_units(spark: SparkSession, sf: str) -> DataFrame:
    units = read(spark, sf, "documents").select("doc_id", F.posexplode_outer(chunking.units(F.col("text"))).alias("unit_no", "unit")).filter("unit_no IS NOT NULL")
    return units.select("doc_id", *_long("unit_no"), F.size(fn.words(F.col("unit"))).cast("long").alias("n_words"), F.md5("unit").alias("unit_md5"))


def text_windows(spark: SparkSession, sf: str) -> DataFrame:
    cut = read(spark, sf, "documents").select("doc_id", F.posexplode_outer(chunking.windows(fn.words(F.col("text")), 200, 40)).alias("window_no", "w")).filter("window_no IS NOT NULL")
    return cut.select("doc_id", *_long("window_no"), F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("text"))


def packed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(read(spark, sf, "documents"), carry=("doc_id",)).select("doc_id", *_long("chunk_index"), "chunk_id", "text")


def packed_small_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(read(spark, sf, "documents"), 40, 8, carry=("doc_id",)).select("doc_id", *_long("chunk_index"), "text")


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_counts(read(spark, sf, "documents")).agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("chunks"))


def documents_new(spark: SparkSession, sf: str) -> DataFrame:
    return new_documents(read(spark, sf, "documents"), read(spark, sf, "chunks")).select("doc_id", "url")


def _small_config() -> Config:
    return Config(embedding_dim=DIM)


def ingest_full(spark: SparkSession, sf: str) -> DataFrame:
    """All documents chunked, embedded and stored; of a page fetched twice the later one is kept."""
    target = _new_store(spark)
    ingest(target, read(spark, sf, "documents"), config=_small_config(), load=lambda: hashing_model(DIM), order="doc_id")
    return target.read().select("chunk_id", *_long("chunk_index"), "document_title", F.md5("text").alias("text_md5"))


def ingest_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk log stored, then the documents that it doesn't have."""
    target = _new_store(spark)
    target.insert_log(read(spark, sf, "chunks"))
    ingest_new(target, read(spark, sf, "documents"), _small_config(), lambda: hashing_model(DIM), order="doc_id")
    return target.read().select("chunk_id", *_long("chunk_index"), F.md5("text").alias("text_md5"))


def embedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors that the default model gives stored texts, a row a value that isn't zero."""
    vectors = embed(store(spark, sf).select("chunk_no", "text"), output="v", load=lambda: hashing_model(DIM))
    return vectors.select("chunk_no", F.posexplode("v").alias("place", "value")).filter("value <> 0").select("chunk_no", *_long("place"), F.col("value").cast("double").alias("value"))


def store_inserts(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk log written in three inserts, by the remainders of its numbers."""
    target, log = _new_store(spark), read(spark, sf, "chunks")
    for rest in range(3):
        target.insert(log.filter(F.col("chunk_no") % 3 == rest), order=("ingested_at", "chunk_no"))
    return target.read().select("chunk_id", "document_title", F.md5("text").alias("text_md5"))


def store_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of even numbers stored, the store cleared and made again, those of odd numbers stored."""
    target, log = _new_store(spark), read(spark, sf, "chunks")
    target.insert(log.filter("chunk_no % 2 = 0"), order=("ingested_at", "chunk_no"))
    target.clear()
    target.create()
    target.insert(log.filter("chunk_no % 2 = 1"), order=("ingested_at", "chunk_no"))
    return target.read().select("chunk_id", F.md5("text").alias("text_md5"))


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk log streamed into a store from its files."""
    path, schema = f"{sf}/chunks.parquet", read(spark, sf, "chunks").schema
    folder, pattern = (path, "*.parquet") if os.path.isdir(path) else (sf, "chunks.parquet")
    base = f"{shared_dir(spark)}/stream-{os.urandom(8).hex()}"
    target = ChunkStore(spark, f"{base}/store")
    upsert_stream(spark, folder, schema, target, f"{base}/checkpoint", pattern)
    return target.read().select("chunk_id", *_long("chunk_index"), F.md5("text").alias("text_md5"))


# --- keyword search ----------------------------------------------------------------------------------


def corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.statistics(bm25.lengths(store(spark, sf), ["chunk_no"])).select("n_docs", F.round("mean_length", 6).alias("mean_length"))


def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    posted = bm25.postings(bm25.lengths(store(spark, sf), ["chunk_no"]), ["chunk_no"])
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def term_idf(spark: SparkSession, sf: str) -> DataFrame:
    sized = bm25.lengths(store(spark, sf), ["chunk_no"])
    weighted = bm25.document_frequencies(bm25.postings(sized, ["chunk_no"])).crossJoin(F.broadcast(bm25.statistics(sized)))  # one row
    return weighted.select("term", F.round(bm25.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.best_by_words(store(spark, sf), questions(spark, sf), 5).select("question_id", "document_url", *_long("chunk_index"), "bm25", *_long("rank"))


def keyword_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same from postings that are kept for many searches."""
    rows = corpus(spark, sf)
    index = bm25.build(rows, ["chunk_no"])
    return retrieval.best_by_words(index, questions(spark, sf), 5, keys=rows.select("chunk_no", *KEYS)).select("question_id", "document_url", *_long("chunk_index"), "bm25", *_long("rank"))


# --- vector search and retrieval ---------------------------------------------------------------------


def adjacent_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """How similar each stored chunk is to the next one of its document."""
    rows = store(spark, sf).filter(F.size("embedding") == DIM).select("document_url", "chunk_index", "chunk_no", "embedding")
    after = rows.select("document_url", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("chunk_no").alias("next_no"), F.col("embedding").alias("next"))
    return rows.join(after, KEYS).select("chunk_no", "next_no", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    ranked = retrieval.vector_ranked(store(spark, sf), questions(spark, sf), 5, dim=DIM)
    return ranked.select("question_id", "document_url", *_long("chunk_index"), "similarity", *_long("rank"))


def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The five chunks most similar to every twentieth one, itself included."""
    rows = store(spark, sf)
    found = vector_search.top_k(rows, rows.filter("chunk_no % 20 = 0"), "chunk_no", "chunk_no", 5, DIM)
    return found.select(F.col("query_id").alias("chunk_no"), F.col("id").alias("neighbour_no"), "similarity", *_long("rank"))


def embedded_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks most similar to each question where both are embedded by the default model."""
    load = lambda: hashing_model(DIM)
    rows = embed(store(spark, sf).drop("embedding"), load=load)
    asked = embed(read(spark, sf, "eval_set").select(F.col("id").cast("long").alias("question_id"), "question"), "question", load=load)
    ranked = retrieval.vector_ranked(rows, asked, 5, dim=DIM)
    return ranked.select("question_id", "document_url", *_long("chunk_index"), "similarity", *_long("rank"))


def vector_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an index of lists finds nine tenths of the five chunks most similar to every twentieth one, and all of them with all lists probed."""
    rows = corpus(spark, sf)
    asked, index = rows.filter("chunk_no % 20 = 0"), vector_index.build(rows, "chunk_no", DIM)
    exact = vector_search.top_k(rows, asked, "chunk_no", "chunk_no", 5, DIM).select("query_id", "id")
    found = [vector_index.top_k(index, asked, "chunk_no", 5, probes=n).select("query_id", "id", F.lit(1).alias(f"in{n}")) for n in (vector_index.PROBES, len(index.centres))]
    joined = exact.join(found[0].withColumnRenamed(f"in{vector_index.PROBES}", "near"), ["query_id", "id"], "left").join(found[1].withColumnRenamed(f"in{len(index.centres)}", "every"), ["query_id", "id"], "left")
    return joined.agg(F.countDistinct("query_id").alias("queries"), (F.count("near") >= 0.9 * F.count("*")).alias("most_found"), (F.count("every") == F.count("*")).alias("all_found"))


def _tiered(mode: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = retrieval.retrieve((store if mode == "vector" else corpus)(spark, sf), questions(spark, sf), mode=mode, dim=DIM)
        return found.select("question_id", "document_url", *_long("chunk_index"), "similarity", *_long("rank"), "tier")

    return query


def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunks by keyword, with the cosine that decides their tier."""
    ranked = retrieval.keyword_ranked(corpus(spark, sf), questions(spark, sf), 5, dim=DIM)
    return ranked.select("question_id", "document_url", *_long("chunk_index"), F.coalesce("similarity", F.lit(-2.0)).alias("similarity"), *_long("rank"))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows, asked = corpus(spark, sf), questions(spark, sf)
    fused = retrieval.reciprocal_rank_fusion(retrieval.vector_ranked(rows, asked, 15, dim=DIM), retrieval.best_by_words(rows, asked, 15), 30)
    return fused.select("question_id", "document_url", *_long("chunk_index"), *[F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in ("vector_rank", "keyword_rank")], F.round("rrf", 9).alias("rrf"), *_long("rank"))


def first_documents(spark: SparkSession, sf: str) -> DataFrame:
    ranked = retrieval.vector_ranked(store(spark, sf), questions(spark, sf), 15, dim=DIM)
    return retrieval.first_documents(ranked).select("question_id", "document_url", *_long("place"))


def vector_hits(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf)
    firsts = retrieval.first_documents(retrieval.vector_ranked(store(spark, sf), asked, 15, dim=DIM))
    return evaluation.retrieval_hits(firsts, asked).select("question_id", "top1", "top5")


def evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    """What every question's answer rests on, as a reader is shown it."""
    return browse.evidence(retrieval.retrieve(store(spark, sf), questions(spark, sf), mode="vector", dim=DIM)).withColumn("rank", F.col("rank").cast("long"))


# --- answers -----------------------------------------------------------------------------------------


def logged_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """How much evidence of each tier the runs of each mode had."""
    return retrieval.tiers(logged(spark, sf)).groupBy("retrieval_mode", "tier").agg(F.count("*").alias("chunks"), F.countDistinct("run_id").alias("runs"))


def _run_prompts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = logged(spark, sf).drop("document_title").join(store(spark, sf).select(*KEYS, "document_title", "text"), KEYS)
    tiered = retrieval.tiers(rows.withColumnRenamed("rank_no", "rank")).withColumn("question_id", F.col("run_id"))
    asked = read(spark, sf, "eval_set").select(F.col("id").alias("q"), "question")
    runs = read(spark, sf, "answers").select(F.col("run_id").alias("question_id"), F.col("question_id").alias("q")).join(asked, "q")
    return tiered, runs


def run_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompted = answering.prompts(*_run_prompts(spark, sf))
    return prompted.select(F.col("question_id").alias("run_id"), "tier", F.size("chunks").cast("long").alias("chunks"), F.md5(F.concat("system", F.lit("\n"), "prompt")).alias("prompt_md5"))


def ask_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every run answered anew from its logged evidence, by the stand-in model."""
    answered = answering.ask(*_run_prompts(spark, sf))
    urls = F.array_join(F.transform("citations", lambda c: c["url"]), " ")
    return answered.select(
        F.col("question_id").alias("run_id"), "answer", urls.alias("cited_urls"), F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"), "outcome"
    )


def citation_indices(spark: SparkSession, sf: str) -> DataFrame:
    sizes = logged(spark, sf).groupBy("run_id").agg(F.count("*").cast("int").alias("n"))
    cited = fn.cited_indices(F.col("answer"), F.col("n"))
    return read(spark, sf, "answers").join(sizes, "run_id").select("run_id", F.array_join(cited.cast("array<string>"), ",").alias("cited"))


def citation_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    once = answering.first_of_each(F.col("citations"), "url")
    return read(spark, sf, "answers").filter("citations IS NOT NULL").select("run_id", F.size(once).cast("long").alias("n"), F.array_join(F.transform(once, lambda c: c["url"]), " ").alias("urls"))


def response_parsed(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("answer").alias("content")).alias("message"))).alias("choices"), F.col("token_usage").alias("usage")))
    r = read(spark, sf, "answers").select("run_id", answering.parse_response(body).alias("r"))
    return r.select("run_id", F.md5("r.content").alias("content_md5"), F.col("r.usage.prompt_tokens").alias("prompt_tokens"), F.col("r.usage.completion_tokens").alias("completion_tokens"))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    asked = read(spark, sf, "eval_set").withColumnRenamed("id", "question_id")
    return evaluation.grades(read(spark, sf, "answers"), asked)


def answer_grades(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf).select("run_id", "type", "refused", "correct")


def phrases_normalized(spark: SparkSession, sf: str) -> DataFrame:
    phrases = read(spark, sf, "eval_set").select(F.col("id").cast("long").alias("question_id"), F.posexplode("must_contain").alias("phrase_no", "phrase"))
    return phrases.select("question_id", *_long("phrase_no"), fn.normalize_punctuation(F.col("phrase")).alias("phrase"))


def run_costs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.answer_metrics(_graded(spark, sf), ["question_id"]).select(*_long("question_id", "prompt_tokens", "completion_tokens"), "cost_usd")


def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row a retrieval mode: answers, refusals, cost, and how the logged retrieval did."""
    log = logged(spark, sf)
    modes = log.groupBy("run_id").agg(F.max("retrieval_mode").alias("retrieval_mode"))
    answers = evaluation.answer_metrics(_graded(spark, sf).join(modes, "run_id"), ["retrieval_mode"])
    asked = read(spark, sf, "eval_set").withColumnRenamed("id", "question_id")
    firsts = log.groupBy("run_id", "retrieval_mode", "question_id", "document_url").agg(F.min("rank_no").alias("rank"))
    places = firsts.withColumn("place", F.row_number().over(retrieval.W.partitionBy("run_id").orderBy("rank", "document_url")))
    hits = evaluation.retrieval_hits(places, asked, ["run_id", "retrieval_mode"]).groupBy("retrieval_mode").agg(
        F.count("*").alias("retrieval_graded"), F.sum(F.col("top1").cast("long")).alias("top1_hits"), F.sum(F.col("top5").cast("long")).alias("top5_hits")
    )
    return answers.join(hits, "retrieval_mode", "left").select(
        "retrieval_mode", "total", "answer_hits", fn.percent(F.col("answer_hits"), F.col("total")).alias("answer_percent"), "refusal_hits", "unanswerable_total",
        "retrieval_graded", "top1_hits", fn.percent(F.col("top1_hits"), F.col("retrieval_graded")).alias("top1_percent"), "top5_hits", "cost_usd",
    )


def _evaluated(mode: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        """The question set answered from the store by the stand-in model, and measured."""
        return evaluation.evaluate(store(spark, sf), questions(spark, sf), mode=mode, dim=DIM).drop("avg_seconds_per_query")

    return query


def evaluate_over_http(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a model behind an endpoint that first refuses some calls."""
    config = Config(llm_url=stand_ins.model_endpoint(spark), llm_model="stand-in", llm_key="none", rate_limit_backoff_seconds=0.1)
    return evaluation.evaluate(store(spark, sf), questions(spark, sf), config, "vector", lambda: answering.http_client(config), DIM).drop("avg_seconds_per_query")


def queries() -> dict[str, Query]:
    plain = [
        store_current, store_count, store_upsert, store_without_stale, documents_listed, documents_filtered, documents_by_host, documents_shown, store_banner, store_inserts, store_cleared, url_hosts, text_previews,
        text_units, text_windows, packed_chunks, packed_small_chunks, ingest_report, documents_new, stream_upsert, ingest_full, ingest_incremental, embedded_chunks, eval_set_read, documents_api,
        corpus_statistics, term_statistics, term_idf, bm25_topk, keyword_index_topk, keyword_topk, adjacent_cosine, vector_topk, vector_topk_batch, vector_index_recall, embedded_topk, rrf_fusion, first_documents, vector_hits, evidence_table,
        logged_tiers, run_prompts, ask_runs, citation_indices, citation_dedupe, response_parsed, answer_grades, phrases_normalized, run_costs, evaluation_report, evaluate_over_http,
    ]
    return {f.__name__: f for f in plain} | {f"{mode}_topk_tiers": _tiered(mode) for mode in ("vector", "hybrid")} | {f"evaluate_{mode}": _evaluated(mode) for mode in ("vector", "hybrid")}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
