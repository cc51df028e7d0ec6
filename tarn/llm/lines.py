"""Problem 1: lines that one site's documents repeat.

Normalized lines are hashed inside Arrow partitions, distinct documents are counted per site and hash
(pre-aggregated before the shuffle), the hashes over the threshold are joined back, and documents are
rebuilt without their lines.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.canon import apply_sql, as_type
from tarn.llm.duck import connect, map_text
from tarn.storage import broadcast_if_small, materialize

#: A line is repeated if it stands in so many documents of its site, and in so large a share of them.
MIN_DOCS = 5
MIN_SHARE_TENTHS = 1

# Names of months and days in dates, English, Spanish and German, with their short forms.
MONTHS = (
    "jan(?:uary|uar)?|feb(?:ruary|ruar)?|mar(?:ch)?|märz?|apr(?:il)?|may|mai|june?|juni|july?|juli|aug(?:ust)?|sept?(?:ember)?|"
    "o[ck]t(?:ober)?|nov(?:ember)?|de[cz](?:ember)?|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
)
DAYS = "(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?"

_GAP = r"[ .,/-]*"
#: Dates that hold a month's name; the digits of all others go with the numbers.
DATES = (
    rf"\b(?:{DAYS}\b{_GAP})?(?:"
    rf"\d{{1,2}}(?:st|nd|rd|th)?{_GAP}(?:of |de )?(?:{MONTHS})\b(?:{_GAP}(?:de )?\d{{4}}|{_GAP}\d{{2}}\b)?"
    rf"|\d{{4}}{_GAP}(?:{MONTHS})\b(?:{_GAP}\d{{1,2}}(?:st|nd|rd|th)?\b)?"
    rf"|(?:{MONTHS})\b{_GAP}\d{{1,4}}(?:st|nd|rd|th)?\b(?:{_GAP}\d{{4}})?)"
)


def site(source: Column, url: Column) -> Column:
    """The site of a row: the host of its url, or of its source where the url names none; lower case, no leading ``www.``, no port or user."""
    host = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    named = F.when(F.length(host) > 0, host).otherwise(F.trim(source))
    return F.regexp_replace(F.lower(named), r"^www\.", "")


#: A text's lines as the letters that remain of them.
LETTERS = rf"regexp_replace(regexp_replace(regexp_replace(lower(x), '{DATES}', '', 'g'), '\d+(?:st|nd|rd|th)\b', '', 'g'), '[^\p{{L}}\p{{M}}\n]+', '', 'g')"


def line_keys(df: DataFrame, text: str = "text", output: str = "line_keys") -> DataFrame:
    """``df`` with an array of 64-bit hashes in ``output``, one for each line of ``text``, null for blank lines.

    Two lines have one hash if they differ only in letter case, white space, punctuation, symbols,
    numbers, dates, or characters that look alike or cannot be seen. Lines come from splitting at
    ``\\n``. A line of nothing but punctuation, symbols or numbers has the hash of no letters. Null text
    gives a null array.
    """
    keys = rf"""list_transform(list_zip(string_split(x, chr(10)), string_split({LETTERS}, chr(10))),
        lambda p: CASE WHEN trim(p[1]) = '' THEN NULL ELSE (hash(p[2]) >> 1)::BIGINT END)"""

    def compute():
        db = connect()
        return lambda batch: [as_type(apply_sql(db, batch, text, keys)[0], pa.list_(pa.int64()))]

    return map_text(df, text, [T.StructField(output, T.ArrayType(T.LongType()))], compute, keep=[c for c in df.columns if c != text])


def repeated_lines(keyed: DataFrame, min_docs: int = MIN_DOCS, share_tenths: float = MIN_SHARE_TENTHS) -> DataFrame:
    """``(site, key, docs)`` of the lines that stand in at least ``min_docs`` documents and ``share_tenths`` tenths of all documents of their site.

    ``keyed``: ``site`` and ``line_keys``, one row a document. Each document counts once for a line.
    Rows without a site form no site and have no repeated lines.
    """
    known = keyed.filter(F.col("site").isNotNull())
    sizes = known.groupBy("site").agg(F.count("*").alias("site_docs"))
    counts = (
        known.select("site", F.explode(F.array_distinct(F.array_compact("line_keys"))).alias("key"))
        .groupBy("site", "key")
        .agg(F.count("*").alias("docs"))
        .filter(F.col("docs") >= min_docs)
    )
    return counts.join(sizes, "site").filter(F.col("docs") * 10 >= F.col("site_docs") * share_tenths).select("site", "key", "docs")


def _keyed(df: DataFrame, text: str, source: str, url: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (as ``__k0`` and so on) with ``site`` and ``line_keys``, written once and read twice."""
    rows = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], site(F.col(source), F.col(url)).alias("site"), F.col(text).alias("__text"))
    return materialize(line_keys(rows, "__text"), "line-keys")


def _side(frequent: DataFrame) -> DataFrame:
    """``frequent`` written; broadcast if its measured size allows, else left to a sort-merge join that AQE splits where it is skewed."""
    return broadcast_if_small(materialize(frequent, "repeated-lines"))


def find_repeated_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", url: str = "url", min_docs: int = MIN_DOCS, share_tenths: float = MIN_SHARE_TENTHS
) -> DataFrame:
    """``(key, line_no)`` of every line of a document that its site repeats; lines are numbered from 0, blank ones counted.

    Null or empty texts have no lines to report. Repeated rows count as documents of their own and are
    reported each. Ties do not arise: thresholds are inclusive. Other columns are ignored whatever
    their names; an empty table gives an empty result.
    """
    keyed = _keyed(df, text, source, url, [key])
    found = _side(repeated_lines(keyed, min_docs, share_tenths).select("site", "key"))
    lines = keyed.select(F.col("__k0").alias(key), "site", F.posexplode("line_keys").alias("line_no", "key")).filter(F.col("key").isNotNull())
    return lines.join(found, ["site", "key"]).select(key, F.col("line_no").cast("long").alias("line_no"))


def remove_repeated_lines(
    df: DataFrame, text: str = "text", source: str = "source", url: str = "url", output: str = "clean_text", min_docs: int = MIN_DOCS, share_tenths: float = MIN_SHARE_TENTHS
) -> DataFrame:
    """``df`` with ``output``: each text without the lines that its site repeats, other lines as they were.

    The texts themselves are never shuffled: the keys of each site's repeated lines, at most
    ``10 / share_tenths`` times the mean number of a document's lines, come to the documents. Lines are
    normalized once: texts are written beside their lines' keys. Null text gives null; a text of nothing but
    repeated lines gives ''. An existing column ``output`` is replaced.
    """
    columns = [c for c in df.columns if c != output]
    held = columns if text in columns else [*columns, text]
    keyed = _keyed(df, text, source, url, held)
    # one row a site: its list is bounded by the share, whatever the site's size
    lists = repeated_lines(keyed, min_docs, share_tenths).groupBy("site").agg(F.collect_list("key").alias("__repeated"))
    joined = keyed.join(_side(lists), "site", "left")
    own = F.col(f"__k{held.index(text)}")
    kept = F.filter(F.split(own, "\n", -1), lambda line, i: F.coalesce(~F.array_contains(F.col("__repeated"), F.get("line_keys", i)), F.lit(True)))
    return joined.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)], F.when(F.col("__repeated").isNull(), own).otherwise(F.array_join(kept, "\n")).alias(output))
