"""What a reader of the corpus sees: the documents by host and title, how many there are, and the evidence behind an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import decimals, netloc, preview, thousands


def list_documents(store: DataFrame) -> DataFrame:
    """``(title, url)`` of every stored document; the title of its last chunk."""
    return store.groupBy("document_url").agg(F.max_by("document_title", "chunk_index").alias("title")).select("title", F.col("document_url").alias("url"))


def filter_titles(documents: DataFrame, search: str | None) -> DataFrame:
    """Documents whose title contains ``search``, case ignored; all of them for nothing."""
    return documents.filter(F.contains(F.lower("title"), F.lower(F.lit(search)))) if search else documents


def shown_counts(documents: DataFrame, search: str | None) -> DataFrame:
    """One row, ``(shown, total, caption)``: how many documents a title filter leaves of all."""
    hit = F.coalesce(F.contains(F.lower("title"), F.lower(F.lit(search))), F.lit(False)) if search else F.lit(True)
    counts = documents.agg(F.count_if(hit).alias("shown"), F.count("*").alias("total"))
    return counts.withColumn("caption", F.concat(thousands(F.col("shown")), F.lit(" of "), thousands(F.col("total")), F.lit(" documents")))


def banner(store: DataFrame) -> DataFrame:
    """One row, ``(chunks, caption)``: how many chunks there are, with the thousands set apart."""
    return store.agg(F.count("*").alias("chunks")).withColumn("caption", F.concat(thousands(F.col("chunks")), F.lit(" chunks")))


def by_host(documents: DataFrame) -> DataFrame:
    """``(host, documents, title, url)``: a row a document with the number of its host's documents, in the order of hosts and titles, untitled ones last.

    Counts are aggregated before they meet the rows and the order is one of ranges, so a host of very many documents is no task of its own.
    """
    placed = documents.select(netloc(F.col("url")).alias("host"), "title", "url")
    counts = placed.groupBy("host").agg(F.count("*").alias("documents"))
    return placed.join(counts, "host").select("host", "documents", "title", "url").orderBy("host", F.asc_nulls_last("title"), "url")


def evidence(tiered: DataFrame, characters: int = 300) -> DataFrame:
    """``(question_id, tier, rank, similarity, title, preview)``: why an answer is what it is, accepted chunks before related ones, similarities to three places."""
    return tiered.select(
        "question_id", "tier", "rank", decimals(F.col("similarity"), 3).alias("similarity"), F.col("document_title").alias("title"), preview(F.col("text"), characters).alias("preview")
    ).orderBy("question_id", "tier", "rank")
