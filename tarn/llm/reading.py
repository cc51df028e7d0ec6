"""Problem 8: the reading level of each document.

A familiar-word formula: the share of a document's words outside high-frequency lists, which come from
the corpus's own document frequencies, and the average sentence length. Graded documents weigh the two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.canon import apply_sql, as_type
from tarn.llm.duck import connect, map_text
from tarn.llm.sampling import bounded_sample
from tarn.storage import broadcast_if_small, materialize, scratch

#: A word is on list i if at least this share of the documents that have words use it.
SHARES = (0.40, 0.15, 0.10, 0.05)
#: Labelled rows, chosen by their hashes, that the weights are fitted on at most.
MAX_LABELS = 20_000
#: Strength of the ridge that holds the weights where few documents are graded.
RIDGE = 0.5
LEVELS = 4

# Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are with as by at from this be or not have had which their its when has you we my an after our more than",
    "es": "de la que el en y los se del las un por con una su para es al lo como más o pero sus le este cada entre sobre según cerca",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie",
}

_WORD = r"\p{L}[\p{L}\p{M}]*(?:[''-][\p{L}\p{M}]+)*"
_SENTENCE = r"[.!?。！？]+[\"'')\]»]*(?:[ \n]+|$)|\n[ ]*\n|\n[ ]*(?:[-*•#>]+[ ]|\d|\p{Lu})"
_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7a3}]"

_PROFILE = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_sentences", T.LongType()),
    T.StructField("n_cjk", T.LongType()),
    T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("counts", T.ArrayType(T.LongType())),
]


def profile(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` with what the formula needs of each text.

    ``n_words`` counts what lies between white space; ``words`` are the distinct words as runs of
    letters, in the one form and lower case, with their ``counts``. Null texts have null everywhere,
    empty ones 0 and empty arrays.
    """
    expressions = (
        "len(list_filter(string_split(replace(x, chr(10), ' '), ' '), lambda w: w <> ''))",
        rf"CASE WHEN x IS NOT NULL THEN greatest(1, len(list_filter(regexp_split_to_array(x, '{_SENTENCE}'), lambda s: regexp_matches(s, '\p{{L}}')))) END",
        f"len(regexp_extract_all(x, '{_CJK}'))",
        f"regexp_extract_all(lower(x), '{_WORD}')",
    )

    def compute():
        db = connect()

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            n_words, sentences, cjk, words = apply_sql(db, batch, text, *expressions)
            db.register("w", pa.table({"k": pa.array(range(len(words)), pa.int32()), "words": words}))
            counted = db.sql(
                """SELECT w.k, w.words IS NULL AS missing, v.words, v.counts FROM w LEFT JOIN (
                     SELECT k, list(word) AS words, list(n) AS counts FROM (
                       SELECT k, word, count(*) AS n FROM (SELECT k, unnest(words) AS word FROM w) GROUP BY k, word) GROUP BY k) v ON w.k = v.k ORDER BY w.k"""
            ).to_arrow_table()
            db.unregister("w")
            missing = counted.column("missing").to_pylist()
            lists = []
            for name, kind in (("words", pa.string()), ("counts", pa.int64())):
                column = as_type(counted.column(name), pa.list_(kind))
                empty = pa.array([None if m else [] for m in missing], pa.list_(kind))
                lists.append(pa.compute.coalesce(column, empty))
            return [as_type(a, pa.int64()) for a in (n_words, sentences, cjk)] + lists

        return step

    return map_text(df, text, _PROFILE, compute, keep=keep)


def document_frequencies(profiled: DataFrame) -> DataFrame:
    """``(word, docs)`` over all documents; counted before the shuffle."""
    return profiled.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("docs"))


def familiar_words(profiled: DataFrame) -> DataFrame:
    """``(word, band)``: band i holds the words on list i but on no list before it."""
    total = profiled.filter(F.size("words") > 0).count()
    band = F.lit(None).cast("int")
    for i, share in reversed(list(enumerate(SHARES))):
        band = F.when(F.col("docs") >= share * max(total, 1), F.lit(i)).otherwise(band)
    return document_frequencies(profiled).select("word", band.alias("band")).filter("band IS NOT NULL")


def _occurrences(language: str) -> Column:
    """How often the language's function words stand in a document, over its rows ``(word, n)``."""
    return F.sum(F.when(F.col("word").isin(*FUNCTION_WORDS[language].split()), F.col("n")).otherwise(0)).alias(f"of_{language}")


def features(profiled: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document: ``keys``, ``n_words``, ``english``, ``unfamiliar_<i>`` (share of words outside list i), ``sentence_length``.

    A document is English if English function words occur in it more often than Spanish and than German
    ones, each occurrence counted, and letters of Chinese, Japanese or Korean are fewer than its words.
    So a page of another language doesn't become English by an English notice; a tie is not English.
    """
    side = broadcast_if_small(materialize(familiar_words(profiled), "familiar-words"))  # a list has at most 1 / share times as many words as a document has distinct ones on average
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    rows = profiled.select(*keys, "__row", "n_words", "n_sentences", "n_cjk", total.alias("total"), "words", "counts")
    fixed = [*keys, "n_words", "n_sentences", "n_cjk", "total"]
    each = rows.select("__row", *fixed, F.explode_outer(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("w"))
    joined = each.select("__row", *fixed, F.col("w.word").alias("word"), F.col("w.n").alias("n")).join(side, "word", "left")
    sums = joined.groupBy("__row").agg(
        *[F.first(c).alias(c) for c in fixed],
        *[F.sum(F.when(F.col("band") <= i, F.col("n")).otherwise(0)).alias(f"known_{i}") for i in range(len(SHARES))],
        *[_occurrences(language) for language in FUNCTION_WORDS],
    )
    english = (F.col("of_en") > F.greatest("of_es", "of_de")) & (F.col("n_cjk") < F.col("n_words"))
    share = [F.when(F.col("total") > 0, 1 - F.col(f"known_{i}") / F.col("total")).alias(f"unfamiliar_{i}") for i in range(len(SHARES))]
    return sums.select(*keys, "n_words", english.alias("english"), *share, F.when(F.col("total") > 0, F.col("total") / F.greatest(F.col("n_sentences"), F.lit(1))).alias("sentence_length"))


@dataclass
class Formula:
    """Weights of the log odds of the shares and the log of the sentence length, one row a boundary between levels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self) -> list[Column]:
        shares = [F.col(f"unfamiliar_{i}") for i in range(len(SHARES))]
        values = [F.log((s + 0.01) / (1.01 - s)) for s in shares] + [F.log(F.greatest(F.col("sentence_length"), F.lit(1.0)))]
        out = []
        for row in self.weights:
            total = F.lit(float(row[-1]))
            for value, mean, scale, weight in zip(values, self.mean, self.scale, row):
                total = total + (value - float(mean)) * float(weight / scale)
            out.append(total)
        return out


def fit(x: np.ndarray, levels: np.ndarray) -> Formula:
    """Ridge logistic regressions of "this level or more", by Newton's method. Without grades every document has level 1."""
    k = x.shape[1]
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(k), np.ones(k))
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.diag([RIDGE] * k + [1e-3])
    weights = []
    for level in range(2, LEVELS + 1):
        y, w = (levels >= level).astype(float), np.zeros(k + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        weights.append(w if len(x) else np.array([0.0] * k + [-1.0]))
    return Formula(mean, scale, np.array(weights))


def fit_labels(featured: DataFrame, labels: DataFrame, key: str = "doc_id", level: str = "reading_level", max_labels: int = MAX_LABELS) -> Formula:
    """The formula's weights from graded English documents; every rater's grade counts by itself, null grades don't.

    At most ``max_labels`` grades, and of documents that share a graded key as many rows, are fitted on.
    """
    graded = labels.filter(F.col(level).isNotNull() & F.col(key).isNotNull()).select(key, F.col(level).alias("__level"))
    sample = bounded_sample(graded, [key], max_labels)
    columns = [*[f"unfamiliar_{i}" for i in range(len(SHARES))], "sentence_length"]
    known = featured.filter("english AND sentence_length IS NOT NULL")
    rows = bounded_sample(known.join(F.broadcast(sample), key).select(*columns, "__level"), columns, max_labels).collect()
    data = np.array([[float(v) for v in r] for r in rows]).reshape(-1, len(columns) + 1)
    shares = data[:, : len(SHARES)]
    x = np.column_stack([np.log((shares + 0.01) / (1.01 - shares)), np.log(np.maximum(data[:, -2], 1.0))])
    return fit(x, data[:, -1])


def reading_features(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``features`` of every document, one row each, written out; null texts are not English and have null numbers."""
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    with scratch() as keep:
        profiled = materialize(profile(rows, "__text", keep=[key, "__row"]), "reading-profile")
        found = features(profiled, [key])
        return keep(materialize(found.withColumn("english", F.coalesce("english", F.lit(False))), "reading-features"))


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, english, unfamiliar_share, sentence_length, reading_level)``, one row a document.

    ``unfamiliar_share`` is the share of words outside the list of words that a tenth of the documents
    use. Documents without a word have no level (null); null texts have null counts, too. Repeated rows
    are documents of their own. Levels of documents in other languages are computed by the same formula;
    filter on ``english`` where that matters. Other columns are ignored; an empty table gives none.
    """
    featured = reading_features(documents, key, text)
    level = F.lit(1)
    for logit in fit_labels(featured, labels, key).logits():
        level = level + F.when(logit > 0, 1).otherwise(0)
    return featured.select(
        key, "n_words", "english", F.col("unfamiliar_2").alias("unfamiliar_share"), "sentence_length",
        F.when(F.col("sentence_length").isNotNull(), level).alias("reading_level"),
    )
