"""Problem 5: one form for visually identical text.

DuckDB runs inside each Arrow partition. The mapping of compatibility forms, invisible characters
and look-alikes is embedded in its SQL as ``translate`` arguments and regular expressions, accents
are composed by ``nfc_normalize``. Tables of more than a few entries come from the Unicode database
by rule; only the look-alikes, which no rule gives, are listed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.duck import connect, map_text, slices, text_table
from tarn.storage import materialize

# Letters of other scripts that are drawn like Latin letters.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ё": "ë", "ї": "ï", "ӓ": "ä", "ӧ": "ö",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y", "Ԁ": "D",
    "Ӏ": "I", "Ё": "Ë", "Ї": "Ï", "Ӓ": "Ä", "Ӧ": "Ö",
    # Greek
    "ο": "o", "ν": "v", "ρ": "p", "ό": "ó",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin extensions
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S", "ı": "i", "ɑ": "a", "ɡ": "g",
}

# Dashes and quotes taken as equal when answers are graded, and others drawn the same way.
DASHES = "‐‑‒–—―−﹘﹣"
SINGLE_QUOTES = "‘’‛ʼ"
DOUBLE_QUOTES = "“”‟"

#: Characters that show nothing: format controls, fillers, variation selectors, other controls.
INVISIBLE = (
    r"[\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}"
    r"\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}"
    r"\x{1bca0}-\x{1bca3}\x{1d173}-\x{1d17a}\x{e0000}-\x{e0fff}]+"
)
#: White space other than the line end, as Python's ``str.split`` takes it.
SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u2800\u3000"


#: Characters that stand for several and are not rare.
OFTEN = "…№½¼¾⅓⅔⅛⅜⅝⅞ﬀﬁﬂﬃﬄ™"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars) -> str:
    """A regular expression's class of these characters, neighbours as ranges."""
    points = sorted(map(ord, chars))
    ends = [i for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    starts = [0, *(i + 1 for i in ends[:-1])]
    return "[" + "".join(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else "") for i, j in zip(starts, ends)) + "]"


def _tidy(text: str) -> str:
    """A compatibility expansion with its own characters in the one form too."""
    for old, new in (("⁄", "/"), (DASHES, "-"), (SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"')):
        for c in old:
            text = text.replace(c, new)
    return "".join(" " if c in SPACES else c for c in text)


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Mappings ``(common, rare, longer)``: one character to one, often seen; seldom seen; one to several.

    By rule: every character whose compatibility form (NFKC) differs from itself, except those that
    only NFC changes (they are composed by ``nfc_normalize``).
    """
    common, rare, longer = {}, {}, {}
    for point in range(0x80, 0x30000):
        char = chr(point)
        if 0xD800 <= point < 0xE000 or char in SPACES:
            continue
        form = unicodedata.normalize("NFKC", char)
        if form == char or unicodedata.normalize("NFC", char) == form and len(form) > 1:
            continue
        form = _tidy(form)
        if len(form) != 1:
            longer[char] = form
        elif 0xFF00 <= point < 0xFF5F or point < 0x300:
            common[char] = form
        else:
            rare[char] = form
    common |= dict.fromkeys(SPACES, " ")
    for chars, to in ((DASHES, "-"), (SINGLE_QUOTES, "'"), (DOUBLE_QUOTES, '"')):
        common |= dict.fromkeys(chars, to)
    for char in common:
        rare.pop(char, None)
    return common, rare, longer


def _real_words() -> str:
    """A regular expression that finds words of a script with look-alikes that a reader sees as such: of its letters alone, some of them not drawn like Latin ones."""
    own = _class(chr(p) for p in range(0x370, 0x590) if unicodedata.category(chr(p)).startswith("L") and chr(p) not in LOOK_ALIKES)
    script = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{M}]"
    return rf"(?:^|[^\p{{L}}\p{{M}}])(?:{script}+{own}|{own}{script}){script}*(?:$|[^\p{{L}}\p{{M}}])"


@lru_cache(maxsize=1)
def steps() -> tuple[list[str], str]:
    """The embedded SQL, a projection of ``x`` a step, and an aggregate that tells whether the second step has anything to do."""
    common, rare, longer = tables()
    often = [c for c in OFTEN if c in longer]
    seldom = [c for c in longer if c not in OFTEN]
    expand = "x"
    for c in often:
        expand = f"replace({expand}, {_quote(c)}, {_quote(longer[c])})"
    rare_map = f"translate(x, {_quote(''.join(rare))}, {_quote(''.join(rare.values()))})"
    entries = "MAP { " + ", ".join(f"{_quote(c)}: {_quote(longer[c])}" for c in seldom) + " }"
    any_seldom = _class(seldom)
    each = f"list_transform(regexp_extract_all(x, '{any_seldom}|[^{any_seldom[1:]}+'), lambda c: coalesce(list_extract(map_extract({entries}, c), 1), c))"
    alike, drawn = _quote("".join(LOOK_ALIKES)), _quote("".join(LOOK_ALIKES.values()))
    in_words = rf"list_transform(regexp_extract_all(x, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), lambda w: CASE WHEN regexp_matches(w, '\p{{Latin}}') THEN translate(w, {alike}, {drawn}) ELSE w END)"
    look_alikes = f"WHEN regexp_matches(x, '{_real_words()}') THEN array_to_string({in_words}, '') ELSE translate(x, {alike}, {drawn}) END"
    steps = [
        f"SELECT * REPLACE (CASE WHEN u AND regexp_matches(x, '{_class(often)}') THEN {expand} ELSE x END AS x)",
        f"SELECT * REPLACE (CASE WHEN u AND regexp_matches(x, '{any_seldom}') THEN array_to_string({each}, '') ELSE x END AS x)",
        f"SELECT * REPLACE (CASE WHEN u AND regexp_matches(x, '{_class(rare)}') THEN {rare_map} ELSE x END AS x)",
        f"SELECT * REPLACE (CASE WHEN u THEN translate(replace(x, chr(13) || chr(10), chr(10)), {_quote(''.join(common))}, {_quote(''.join(common.values()))}) ELSE replace(x, chr(9), ' ') END AS x)",
        f"SELECT * REPLACE (CASE WHEN u THEN regexp_replace(x, '{INVISIBLE}', '', 'g') ELSE x END AS x)",
        f"SELECT * REPLACE (CASE WHEN NOT u OR NOT regexp_matches(x, '{_class(LOOK_ALIKES)}') THEN x {look_alikes} AS x)",
        r"SELECT * REPLACE (CASE WHEN u AND regexp_matches(x, '[\p{M}\x{1100}-\x{11ff}]') THEN nfc_normalize(x) ELSE x END AS x)",
    ]
    return steps, f"bool_or(regexp_matches(x, '{any_seldom}'))"


#: The form in which texts are compared: case folded, white space runs one space.
MATCH_FORM = r"trim(regexp_replace(lower(x), '[ \n]+', ' ', 'g'))"


def canonical_sql(table: str, seldom: bool = True) -> str:
    """SQL whose rows are those of ``table`` with the text column ``x`` in the one form.

    One subquery a step, as a step written into the next one's CASE would be evaluated twice. ``u``
    tells whether a text has any character that the steps could change. The step for seldom characters
    that stand for several is long to parse; without ``seldom`` it is left out.
    """
    sql = rf"SELECT *, regexp_matches(x, '[^\x{{09}}\x{{0a}}\x{{20}}-\x{{7e}}]') AS u FROM {table}"
    for step in steps()[0] if seldom else steps()[0][:1] + steps()[0][2:]:
        sql = f"{step} FROM ({sql})"
    return f"SELECT * EXCLUDE (u) FROM ({sql})"


def apply_sql(db, batch: pa.RecordBatch, column: str, *expressions: str) -> list[pa.Array]:
    """The values of SQL expressions over ``x``, a batch's texts in the one form, row for row."""
    db.register("t", text_table(batch, column))
    try:
        seldom = bool(db.execute(f"SELECT {steps()[1]} FROM t").fetchall()[0][0])
        table = db.sql("SELECT k, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(expressions)) + f" FROM ({canonical_sql('t', seldom)}) ORDER BY k").to_arrow_table()
    finally:
        db.unregister("t")
    return [table.column(i + 1).combine_chunks() for i in range(len(expressions))]


def as_type(array: pa.Array | pa.ChunkedArray, to: pa.DataType) -> pa.Array:
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return array if array.type == to else pc.cast(array, to)


def canonicalize(df: DataFrame, column: str = "text", output: str = "canonical", matching: bool = False) -> DataFrame:
    """``df`` with the one form of ``column`` in ``output``.

    The form maps full-width and other compatibility characters, spaces, dashes, quotes, fractions and
    letters drawn like Latin ones, drops characters that show nothing and composes accents. Line ends
    stay, so line numbers hold. With ``matching`` case is folded and white space runs become one space.
    In a text that has words of another script (of two letters or more, one of them not drawn like a Latin
    one) letters are mapped only in words that also hold Latin letters, so such words stay as they are.

    Null gives null, empty gives empty; texts of any length are handled (a very long one is a batch of
    its own). Repeated rows give repeated rows. An existing column named ``output`` is replaced, all
    other columns are kept whatever their names. An empty table gives an empty table.
    """
    expression = MATCH_FORM if matching else "x"

    def compute():
        db = connect()
        return lambda batch: [as_type(apply_sql(db, batch, column, expression)[0], pa.string())]

    return map_text(df, column, [T.StructField(output, T.StringType())], compute)


#: Phrases that one automaton holds, and bytes of them that are broadcast at once; a larger set is searched in several blocks.
PHRASE_BLOCK, PHRASE_BYTES = 20_000, 16 << 20


def find_phrases(phrases: DataFrame, documents: DataFrame, phrase: str = "phrase", text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row of ``phrases`` with each document whose text shows that phrase, case ignored.

    Both sides are brought to the matching form, each once. The phrase set is the stated query side: it is
    read in blocks of ``PHRASE_BLOCK`` phrases and ``PHRASE_BYTES``, each block is broadcast as one automaton
    that every partition runs over its documents, so no pair of phrase and document is formed unless it
    matches. Result: the columns of ``phrases`` except the phrase (64-bit integers), then ``keys``.

    Null phrases and phrases that show nothing match no document; null texts contain nothing. Repeated
    phrases and repeated documents give one row per pair of rows.
    """
    ids = [c for c in phrases.columns if c != phrase]
    shown = canonicalize(phrases.filter(F.col(phrase).isNotNull()), phrase, "__form", matching=True).filter("__form <> ''")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ids] + [documents.schema[k] for k in keys])
    rows = documents.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(text).alias("__text"))
    blocks: list[dict[str, list]] = [{}]
    size = count = 0
    out = None
    for row in shown.select(*ids, "__form").toLocalIterator():  # a block at a time on the driver
        size, count = size + len(row["__form"].encode()), count + 1
        if count > PHRASE_BLOCK or size > PHRASE_BYTES and count > 1:
            if out is None:  # a second block: the documents' forms are kept for all of them
                rows = materialize(canonicalize(rows, "__text", "__form", matching=True).drop("__text"), "matching-forms")
            part = _search(rows, blocks.pop(), ids, schema)
            out = part if out is None else out.unionByName(part)
            blocks, size, count = [{}], len(row["__form"].encode()), 1
        blocks[-1].setdefault(row["__form"], []).append(tuple(row[c] for c in ids))
    part = _search(rows, blocks.pop(), ids, schema)
    return part if out is None else out.unionByName(part)


def _search(rows: DataFrame, block: dict[str, list], ids: list[str], schema: T.StructType) -> DataFrame:
    """The hits of one block of phrases in ``rows``: the keys, numbered, and ``__text`` or its matching form ``__form``."""
    done = "__form" in rows.columns
    column = "__form" if done else "__text"
    shipped = rows.sparkSession.sparkContext.broadcast(block)  # PHRASE_BYTES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = shipped.value
        if not found:
            return
        automaton = ahocorasick.Automaton()
        for form in found:
            automaton.add_word(form, form)
        automaton.make_automaton()
        db = None if done else connect()
        for batch in slices(batches, column):
            forms = batch.column(column) if done else apply_sql(db, batch, column, MATCH_FORM)[0]
            taken, hits = [], []
            for row, form in enumerate(forms.to_pylist()):
                if form:
                    for hit in {value for _, value in automaton.iter(form)}:
                        for key in found[hit]:
                            taken.append(row)
                            hits.append(key)
            if taken:
                kept = batch.take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[i] for h in hits], pa.int64()) for i in range(len(ids))] + [kept.column(c) for c in kept.schema.names if c != column], names=schema.names
                )

    return rows.mapInArrow(run, schema)
