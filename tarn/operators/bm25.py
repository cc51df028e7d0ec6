"""Okapi BM25 over a corpus, for a whole table of questions at once.

A corpus that is searched once is tokenized once: tokens are filtered by the questions' terms right where
they are split, so what is shuffled grows with the matches and not with the corpus. For one that is
searched again and again ``build`` keeps its postings, ordered by term, so a search reads those of its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.text import keyword_tokens
from tarn.storage import BROADCAST_MEMORY, EXPANSION, materialize, size_bytes

#: Terms of a set of questions up to which they are a filter of the scan of kept postings; more of them are joined.
FILTER_TERMS = 2000
#: Decimals that scores are compared to; beyond them the order of summation shows.
DECIMALS = 6


def idf(documents: Column, containing: Column) -> Column:
    """Inverse document frequency, positive even for a term of every document."""
    return F.log((documents - containing + F.lit(0.5)) / (containing + F.lit(0.5)) + F.lit(1.0))


def term_score(tf: Column, length: Column, mean_length: Column, weight: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / mean_length)
    return weight * tf * F.lit(k1 + 1.0) / norm


def lengths(corpus: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with ``tokens`` and their number ``length``; a null text has none. Those that ``corpus`` has already are taken."""
    if "tokens" in corpus.columns and "length" in corpus.columns:
        return corpus.select(*keys, "tokens", "length")
    tokens = F.coalesce(keyword_tokens(F.col(text)), F.array().cast("array<string>"))
    return corpus.select(*keys, tokens.alias("tokens")).withColumn("length", F.size("tokens"))


def statistics(sized: DataFrame) -> DataFrame:
    """One row: ``n_docs`` and ``mean_length`` over all documents, those without tokens included; 0 of none."""
    return sized.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length"))


def postings(sized: DataFrame, keys: list[str], terms: DataFrame | None = None) -> DataFrame:
    """``keys``, ``length``, ``term``, ``tf``; only of the ``terms`` given, if any are."""
    # an inner explode would have the planner filter by the number of tokens first, for which it splits all texts twice
    each = sized.select(*keys, "length", F.explode_outer("tokens").alias("term")).filter("term IS NOT NULL")
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.groupBy(*keys, "length", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """``term``, ``df``: in how many documents a term stands; postings have it once a document."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """Kept postings ``(*keys, length, term, tf)``, ordered by term, the terms' ``(term, df)``, and the row of ``statistics``."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build(corpus: DataFrame, keys: list[str], text: str = "text") -> Index:
    """The index of a corpus; its tables are written to the shared folder and used by any number of searches."""
    sized = lengths(corpus, keys, text)
    kept = materialize(postings(sized, keys).repartitionByRange("term").sortWithinPartitions("term"), "postings")
    return Index(kept, materialize(document_frequencies(kept), "term-frequencies"), materialize(statistics(sized), "corpus-statistics"))


def _asked(questions: DataFrame, question: str, question_id: str) -> DataFrame:
    return questions.select(question_id, F.explode(F.array_distinct(keyword_tokens(F.col(question)))).alias("term"))


def search(
    corpus: DataFrame | Index, questions: DataFrame, keys: list[str], k: int = 5, question: str = "question", question_id: str = "question_id", text: str = "text", k1: float = 1.5, b: float = 0.75,
    rows: DataFrame | None = None, order: list[str] | None = None,
) -> DataFrame:
    """``(question_id, *keys, bm25, rank)`` and the columns of ``rows``: up to ``k`` documents a question that share a term with it, best first.

    A term counts once however often the question repeats it. Scores equal to six decimals go by the columns
    ``order`` of ``rows`` (a row a document, joined once to the few that are left of each question), then by
    ``keys``. Postings are dealt by document: its scores for all questions are summed up and cut to
    the best where they lie, so what is shuffled after that is ``k`` rows a question and task.
    """
    asked = materialize(_asked(questions, question, question_id), "asked-terms")
    small = size_bytes(asked) * EXPANSION <= BROADCAST_MEMORY
    terms = asked.select("term").distinct()
    if isinstance(corpus, Index):
        few = [r["term"] for r in terms.limit(FILTER_TERMS + 1).collect()]
        within = (lambda df: df.filter(F.col("term").isin(few))) if len(few) <= FILTER_TERMS else (lambda df: df.join(terms, "term", "left_semi"))
        posted, frequent, stats = within(corpus.postings), within(corpus.terms), corpus.stats
    else:
        # one pass over the corpus: each document also has a posting of no term, which carries its length
        marked = lengths(corpus, keys, text).withColumn("tokens", F.concat(F.array(F.lit("")), "tokens"))
        wanted = terms.unionByName(corpus.sparkSession.range(1).select(F.lit("").alias("term")))
        held = materialize(postings(marked, keys, F.broadcast(wanted) if small else wanted), "asked-postings")
        posted, stats = held.filter("term <> ''"), statistics(held.filter("term = ''"))
        frequent = document_frequencies(posted)
    weights = frequent.crossJoin(F.broadcast(stats)).select("term", "mean_length", idf(F.col("n_docs"), F.col("df")).alias("idf"))  # one row
    weighted = asked.join(weights, "term")
    scored = posted.repartition(*keys).join(F.broadcast(weighted) if small else weighted, "term")
    scored = scored.withColumn("score", term_score(F.col("tf"), F.col("length"), F.col("mean_length"), F.col("idf"), k1, b))
    sums = scored.groupBy(question_id, *keys).agg(F.round(F.sum("score"), DECIMALS).alias("bm25"))
    near = W.partitionBy(question_id).orderBy(F.desc("bm25"))
    best = sums.withColumn("__r", F.rank().over(near)).filter(F.col("__r") <= k).drop("__r")
    if rows is not None:
        best = best.join(rows, keys)
    final = W.partitionBy(question_id).orderBy(F.desc("bm25"), *(order or []), *keys)
    return best.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
