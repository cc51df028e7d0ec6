"""Problem 4: cutting oversized items at natural boundaries.

Balanced targets: the smallest number of pieces is computed, equal-length targets are placed, each is
moved to the strongest boundary near it that keeps the limit, and a piece is added where none does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.duck import slices

LIMIT = 200
OVERLAP = 40

# What Python's str.split takes as white space, for Java's regular expressions, with and without the line end.
_BLANK = r"\t\x0B\x0C\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"\n" + _BLANK

#: Boundary strengths, weakest first: after a sentence, at a line, at a paragraph, at a heading.
SENTENCE, LINE, PARAGRAPH, HEADING = 1, 2, 3, 4

_HEADING = re.compile(r"#{1,6}\s")
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’)\]»]*(?=\s)")
_LINE_GAP = re.compile(r"\n\s*")
_IS_SPACE = np.array([chr(point).isspace() for point in range(0x3001)])  # there is no white space beyond


def word_count(text: Column) -> Column:
    """Words of a text: what lies between white space. Null for null."""
    return F.regexp_count(text, F.lit(f"[^{_SPACE}]+"))


def paragraphs(text: Column) -> Column:
    """The longest runs of lines (split at ``\\n``) that are not all white space, in order. Null for null."""
    return F.filter(F.split(text, rf"\n(?:[{_BLANK}]*\n)+", -1), lambda p: F.regexp_like(p, F.lit(f"[^{_SPACE}]")))


def strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How natural a cut before each word is; 0 where it is not."""
    out = np.zeros(len(starts) + 1, dtype=np.int8)
    sentences = np.array([m.end() for m in _SENTENCE_END.finditer(text)], dtype=np.int64)
    out[np.searchsorted(ends, sentences) + 1] = SENTENCE
    for gap in _LINE_GAP.finditer(text):
        i = int(np.searchsorted(starts, gap.end()))
        out[i] = HEADING if _HEADING.match(text, gap.end()) else PARAGRAPH if gap.group().count("\n") > 1 else LINE
    out[0] = 0
    return out[: len(starts)]


def cuts(n: int, strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``n`` words, the last one ``n``; each next piece starts ``overlap`` words before the end of the one before.

    Starts from the smallest number of pieces. The words that are left are shared out equally among the
    pieces that are left; each target moves to the strongest boundary within a quarter of a stride, or else
    within half of one (the nearest of equals, the earlier of equally near). Only ends are taken that keep
    the piece within the limit and leave no more than the other pieces can hold. Where there is no such
    boundary, an earlier one is taken and one piece added, and where there is none either the target itself.
    """
    if n <= limit:
        return [n]
    room = limit - overlap
    left = -(-(n - overlap) // room)
    at = np.flatnonzero(strength)
    ends, start = [], 0
    while left > 1:
        stride = (n - start - overlap) / left
        target = start + overlap + stride
        least, most = max(n - (left - 1) * room, start + overlap + 1), start + limit
        found = None
        for low, high in ((least, most), (start + overlap + 1, min(least - 1, most))):
            for reach in (stride / 4, stride / 2):
                i, j = np.searchsorted(at, (max(low, target - reach), min(high, target + reach) + 1))
                near = at[i:j][at[i:j] <= target + reach]
                if len(near):
                    found = int(near[np.lexsort((near, np.abs(near - target), -strength[near]))[0]])
                    break
            if found is not None:
                break
        end = min(max(int(round(target)), least), most) if found is None else found
        left -= end >= least
        ends.append(end)
        start = end - overlap
    return [*ends, n]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, firsts)`` of the words of several texts: places within their own text, and where each text's words begin and end."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 1, dtype=np.int8)
    inside[1:] = ~_IS_SPACE[np.minimum(points, 0x3000)] | (points > 0x3000)
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    firsts = np.searchsorted(starts, begins)
    shift = np.repeat(begins[:-1], np.diff(firsts))
    return starts - shift, ends - shift, firsts


def _cut(text: str, starts: np.ndarray, ends: np.ndarray, limit: int, overlap: int) -> list[tuple[str, int, int]]:
    n = len(starts)
    out, start = [], 0
    for end in cuts(n, strengths(text, starts, ends), limit, overlap) if n > limit else [n] * (n > 0):
        out.append((text[starts[start] : ends[end - 1]], start, end - start))
        start = end - overlap
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """The pieces of one text: ``(text, first word, number of words)``; none of a text without words."""
    starts, ends, _ = word_spans([text])
    return _cut(text, starts, ends, limit, overlap)


PIECE = [
    T.StructField("chunk_index", T.LongType()),
    T.StructField("n_pieces", T.LongType()),
    T.StructField("start_word", T.LongType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("piece", T.StringType()),
]


def _check(limit: int, overlap: int) -> None:
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"overlap ({overlap}) must be at least 0 and smaller than limit ({limit}), which must be positive")


def split_items(items: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False) -> DataFrame:
    """The pieces of every item: ``keys``, ``chunk_index`` from 0, ``n_pieces``, ``start_word``, ``n_words``, ``piece``.

    No piece exceeds ``limit`` words; consecutive pieces share exactly ``overlap`` words; dropping the
    first ``overlap`` words of every piece but the first gives the item's words again. A piece is the
    stretch of the text from its first word to its last, line ends included. Items within the limit are
    one piece; with ``oversized_only`` they are left out.

    Null texts and texts without words give no piece. Each of several equal rows gives its own pieces.
    Texts of any length are cut; one long "word" counts as one. Only ``keys`` are carried along, so other
    columns may have any names; keys must not be named like the columns added. An empty table gives none.
    """
    _check(limit, overlap)
    clash = {f.name for f in PIECE} & set(keys)
    if clash:
        raise ValueError(f"key columns are named like columns of the result: {sorted(clash)}")
    rows = items.select(*[F.col(f"`{k}`") for k in keys], F.col(text).alias("__text"))
    # a text of fewer than 2 * limit + 1 characters has at most limit words and never leaves the JVM
    long = F.length("__text") > 2 * limit
    schema = T.StructType([rows.schema[k] for k in keys] + PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            taken, pieces = [], []
            texts = batch.column("__text").to_pylist()
            starts, ends, firsts = word_spans(texts)
            for row in np.flatnonzero(np.diff(firsts) > (limit if oversized_only else 0)):
                own = slice(firsts[row], firsts[row + 1])
                cut = _cut(texts[row], starts[own], ends[own], limit, overlap)
                taken += [row] * len(cut)
                pieces += [(i, len(cut), start, n, piece) for i, (piece, start, n) in enumerate(cut)]
            columns = list(zip(*pieces)) if pieces else [[]] * len(PIECE)
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(taken, pa.int64())) for k in keys] + [pa.array(c, t) for c, t in zip(columns, types)], names=[*keys, *[f.name for f in PIECE]]
            )

    out = rows.filter(long).mapInArrow(run, schema)
    if oversized_only:
        return out
    ends = rf"^[{_SPACE}]+|[{_SPACE}]+$"
    within = rows.filter(~long).withColumn("__n", word_count(F.col("__text")).cast("long")).filter("__n > 0")
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    whole = within.select(
        *keys, zero.alias("chunk_index"), one.alias("n_pieces"), zero.alias("start_word"), F.col("__n").alias("n_words"), F.regexp_replace("__text", ends, "").alias("piece")
    )
    return whole.unionByName(out)


def oversized_units(documents: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(item_kind, item_key, unit_no)`` of the paragraphs and the stored chunks that had to be cut.

    Both kinds go through ``split_items``: what comes out in more than one piece exceeded the limit.
    """
    units = documents.select(F.col("doc_id").alias("item_key"), F.posexplode(paragraphs(F.col("text"))).alias("unit_no", "text"))
    stored = chunks.select(F.col("chunk_no").alias("item_key"), F.lit(0).alias("unit_no"), "text")
    items = units.select(F.lit("document").alias("item_kind"), "*").unionByName(stored.select(F.lit("chunk").alias("item_kind"), "*"))
    pieces = split_items(items, ["item_kind", "item_key", "unit_no"], "text", limit, overlap, oversized_only=True)
    return pieces.filter("n_pieces > 1 AND chunk_index = 0").select("item_kind", "item_key", F.col("unit_no").cast("long").alias("unit_no"))
