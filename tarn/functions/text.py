"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.split and str.strip take as white space, for Java's regular expressions.
SPACE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The same characters, to be trimmed.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Characters besides which white space is what Java's ``\\s`` takes, which it splits at three times as fast.
_BEYOND_ASCII = r"[^\x00-\x1b\x20-\x7e]"

# Punctuation that grading takes as equal. Fractions become several characters.
DASHES = "‐‑‒–—"
QUOTES = "‘’“”"
SPACES = "\u00a0\u202f"
FRACTIONS = {
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3",
    "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
}

# Answers that refuse, without their final full stops.
REFUSALS = ("i don't know", "i do not know")


def words(text: Column) -> Column:
    """What lies between white space, as an array; null for null."""
    split = F.when(F.regexp_like(text, F.lit(_BEYOND_ASCII)), F.split(text, f"[{SPACE}]+", -1)).otherwise(F.split(text, r"\s+", -1))
    return F.filter(split, lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def keyword_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_punctuation(text: Column) -> Column:
    """Lower case, with dashes, quotes, fractions and fixed spaces in their plain forms."""
    plain = F.translate(text, DASHES + QUOTES + SPACES, "-" * len(DASHES) + "''\"\"" + " " * len(SPACES))
    for fraction, spelled in FRACTIONS.items():
        plain = F.replace(plain, F.lit(fraction), F.lit(spelled))
    return F.lower(plain)


def is_refusal(answer: Column) -> Column:
    """Whether an answer says nothing but that it doesn't know; only the straight apostrophe counts."""
    bare = F.lower(F.regexp_replace(strip(answer), r"\.+$", ""))
    return F.coalesce(bare.isin(*REFUSALS), F.lit(False))


def contains_all(answer: Column, phrases: Column) -> Column:
    """Whether every phrase stands in the answer, punctuation and case normalized; true of no phrases."""
    plain = normalize_punctuation(F.coalesce(answer, F.lit("")))
    return F.coalesce(F.forall(phrases, lambda p: F.contains(plain, normalize_punctuation(p))), F.lit(True))


def answer_is_correct(kind: Column, answer: Column, phrases: Column) -> Column:
    """An unanswerable question is answered by a refusal, any other by all its phrases."""
    return F.when(kind == "unanswerable", is_refusal(answer)).otherwise(contains_all(answer, phrases))


# Fixed value: citation marks, a number within square or lenticular brackets, with what may follow a dagger.
CITATION = "[\\[【][" + SPACE + "]*([0-9]+)[" + SPACE + "]*(?:†[^\\]】]*)?[\\]】]"


def cited_indices(answer: Column, n: Column) -> Column:
    """Numbers from 1 to ``n`` that citation marks like ``[1]`` and ``【1†...】`` name, ascending; all of them if no mark names one."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), F.lit(1)), lambda m: m.try_cast("int"))
    valid = F.array_sort(F.array_distinct(F.filter(numbers, lambda i: (i >= 1) & (i <= n))))
    every = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(valid) > 0, valid).otherwise(every)


def netloc(url: Column) -> Column:
    """The part of a url between ``//`` and the path, with user and port; empty where there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def preview(text: Column, characters: int = 300) -> Column:
    """The first characters, followed by dots if there are more."""
    return F.concat(F.substring(text, 1, characters), F.when(F.length(text) > characters, "...").otherwise(""))


def thousands(n: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(n, 0)


def decimals(x: Column, places: int) -> Column:
    """A number with so many places, halves of its decimal form away from zero."""
    return F.format_string(f"%.{places}f", x.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``(34%)``, halves rounded to even; ``(n/a)`` of nothing."""
    share = F.bround(F.lit(100.0) * part / F.when(whole != 0, whole), 0).cast("int")
    return F.coalesce(F.concat(F.lit("("), share.cast("string"), F.lit("%)")), F.lit("(n/a)"))


def cost_usd(prompt_tokens: Column, completion_tokens: Column, prompt_price: float = 0.15, completion_price: float = 0.60) -> Column:
    """Dollars for tokens priced by the million."""
    return prompt_tokens / F.lit(1e6) * F.lit(prompt_price) + completion_tokens / F.lit(1e6) * F.lit(completion_price)


def chunk_id(url: Column, index: Column) -> Column:
    """The key of a stored chunk: ``url::index``."""
    return F.concat_ws("::", url, index.cast("string"))
