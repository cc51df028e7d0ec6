"""The queries of the training-data operators, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import canon, encode, knn, lines, mix, neardup, reading, split
from tarn.storage import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document that its site repeats."""
    return lines.find_repeated_lines(_read(spark, sf, "documents"))


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text without the lines that its site repeats."""
    return lines.remove_repeated_lines(_read(spark, sf, "documents")).select("doc_id", "clean_text")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks of a cosine of 0.90 or more of which one is among the five most similar of the other."""
    pairs = knn.similar_pairs(_read(spark, sf, "chunks"), "chunk_no", "embedding")
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five chunks most similar to every twentieth chunk, of all chunks, however far they are."""
    found = knn.nearest(_read(spark, sf, "chunks"), "chunk_no", "embedding", factor=knn.FAR_FACTOR, queries=lambda key: key % 20 == 0)
    return found.select(F.col("query").alias("chunk_no"), F.col("neighbour").alias("neighbour_no"), F.round("cosine", 4).alias("cosine"), F.col("rank").cast("long").alias("rank_no"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents in one group of near-duplicates."""
    return neardup.pairs_in_groups(materialize(neardup.groups(_read(spark, sf, "documents")), "groups"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the smallest number of its group of near-duplicates, -1 if it takes no part."""
    return neardup.groups(_read(spark, sf, "documents")).select("doc_id", F.coalesce("group", F.lit(-1)).alias("group_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every paragraph of a document and every stored chunk that exceeds the limit."""
    return split.oversized_units(_read(spark, sf, "documents"), _read(spark, sf, "chunks"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut into chunks."""
    pieces = split.split_items(_read(spark, sf, "documents"), ["doc_id"])
    return pieces.select("doc_id", "chunk_index", "n_pieces", "start_word", "n_words", F.col("piece").alias("text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each phrase that answers must contain with each document that shows it."""
    phrases = _read(spark, sf, "eval_set").select(F.col("id").cast("long").alias("question_id"), F.posexplode("must_contain").alias("phrase_no", "phrase"))
    return canon.find_phrases(phrases.withColumn("phrase_no", F.col("phrase_no").cast("long")), _read(spark, sf, "documents"))


def p5_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text in the one form."""
    return canon.canonicalize(_read(spark, sf, "documents")).select("doc_id", "canonical")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's token ids by byte_bpe_50k."""
    return encode.encode(_read(spark, sf, "documents"), keep=["doc_id"])


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return mix.sized(_read(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Listed sources that cannot reach their share of a mix as large as all documents together, from that mix."""
    sizes, targets = materialize(_sizes(spark, sf), "sizes"), _read(spark, sf, "mix_targets")
    mixed = materialize(mix.mix(sizes, targets), "mix")  # written whole: of a plan that goes on, the shuffle of shards would be pruned
    return mix.short(mixed, sizes, targets).select("source")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix: which document stands where in which shard."""
    return mix.mix(materialize(_sizes(spark, sf), "sizes"), _read(spark, sf, "mix_targets"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the mix reaches."""
    targets = _read(spark, sf, "mix_targets")
    return mix.shares(mix.mix(materialize(_sizes(spark, sf), "sizes"), targets), targets)


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(_read(spark, sf, "documents"), _read(spark, sf, "reading_labels"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """English documents of at least 100 words that are of the most demanding level."""
    return _levels(spark, sf).filter("english AND n_words >= 100 AND reading_level = 4").select("doc_id")


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's reading level and what it comes from."""
    return _levels(spark, sf)


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """What every document's reading level comes from, before grades weigh it."""
    found = reading.reading_features(_read(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "english", F.round("unfamiliar_2", 6).alias("unfamiliar_share"), F.round("sentence_length", 6).alias("sentence_length"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_nearest, p3_found, p3_groups, p4_found, p4_pieces, p5_found, p5_canonical, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_levels, p8_profile)}
