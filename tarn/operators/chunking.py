"""Cutting texts into overlapping chunks along paragraphs and headings.

A text's units are its sections if it has Markdown headings, else its paragraphs. Units are packed into
chunks of at most ``size`` words; a unit that alone exceeds it is cut into a sliding window. A chunk is a
stretch of a text's words, so only the sizes of its units are folded (in an Arrow function, linear in
their number); words are split and chunks are cut out of them in the JVM. Chunking is a narrow stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import SPACE, chunk_id, strip, words

_STRINGS = "array<string>"


def units(text: Column) -> Column:
    """The paragraphs of a text, or its sections if any line starts with one to six ``#`` and white space; blank ones dropped."""
    paragraphs = F.split(text, rf"\n[{SPACE}]*\n+", -1)
    sections = F.split(text, rf"\n(?=#{{1,6}}(?:[{SPACE}&&[^\n]]))", -1)
    headed = F.regexp_like(text, F.lit(rf"(?:^|\n)#{{1,6}}[{SPACE}]"))
    return F.filter(F.transform(F.when(headed, sections).otherwise(paragraphs), strip), lambda u: u != "")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Arrays of ``size`` words, each starting ``size - overlap`` after the one before, until one reaches the end."""
    step = size - overlap
    n = F.size(tokens)
    last = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, F.lit(size)))).otherwise(F.array().cast(f"array<{_STRINGS}>"))


def stretches(sizes: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """``(first word, number of words)`` of the chunks of units of these sizes.

    A chunk ends before the unit that would exceed ``size``; its last ``overlap`` words start the next one
    if the unit still fits behind them. After a unit cut by the window nothing is carried over.
    """
    out, begin, end = [], 0, 0  # the open chunk
    for n in sizes:
        if end > begin and end - begin + n > size:
            out.append((begin, end - begin))
            carried = min(overlap, end - begin)
            begin = end - carried if carried + n <= size else end
        if n > size:
            last = max(0, -(-(n - size) // (size - overlap)))
            out += [(end + i * (size - overlap), min(size, n - i * (size - overlap))) for i in range(last + 1)]
            begin = end + n
        end += n
    return [*out, (begin, end - begin)] if end > begin else out


def _stretches(sizes: Column, size: int, overlap: int) -> Column:
    @F.arrow_udf("array<struct<start:int,n:int>>")
    def fold(column: pa.Array) -> pa.Array:
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        found = [stretches(s.tolist(), size, overlap) for s in np.split(flat, ends[:-1])] if len(ends) else []
        numbers = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
        chunks = pa.StructArray.from_arrays([pa.array(numbers[:, 0]), pa.array(numbers[:, 1])], names=["start", "n"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), chunks)

    return fold(sizes)


def pack(df: DataFrame, text: str = "text", output: str = "chunks", size: int = 200, overlap: int = 40) -> DataFrame:
    """``df`` with the chunks of ``text`` in ``output``, words joined by single spaces; an empty array for null and blank texts. See ``stretches``."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"overlap ({overlap}) must be at least 0 and smaller than size ({size}), which must be positive")
    worded = df.withColumn("__units", F.transform(units(F.coalesce(F.col(text), F.lit(""))), words))
    placed = worded.withColumn("__words", F.flatten("__units")).withColumn("__stretches", _stretches(F.transform("__units", F.size), size, overlap))
    cut = F.transform("__stretches", lambda s: F.array_join(F.slice("__words", s["start"] + 1, s["n"]), " "))
    # read twice, the words stay a column of their own; read once, they would be put together anew for every chunk
    return placed.withColumn(output, F.when(F.size("__words") > 0, cut).otherwise(F.array().cast(_STRINGS))).drop("__units", "__stretches", "__words")


def chunk_counts(df: DataFrame, text: str = "text", output: str = "n", size: int = 200, overlap: int = 40) -> DataFrame:
    """``df`` with the number of chunks of ``text`` in ``output``, without cutting them."""
    sizes = F.transform(units(F.coalesce(F.col(text), F.lit(""))), lambda u: F.size(words(u)))
    return df.withColumn(output, F.size(_stretches(sizes, size, overlap)))


def chunk_documents(documents: DataFrame, size: int = 200, overlap: int = 40, url: str = "url", title: str = "title", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(document_url, document_title, chunk_index, text, chunk_id)`` and the columns ``carry``; documents without words have no rows."""
    rows = documents.select(F.col(url).alias("document_url"), F.col(title).alias("document_title"), *carry, F.col(text).alias("__text"))
    packed = pack(rows, "__text", "__chunks", size, overlap)
    # an inner explode would have the planner filter by the size of the chunks first, for which it cuts all of them twice
    cut = packed.select("document_url", "document_title", *carry, F.posexplode_outer("__chunks").alias("chunk_index", "text")).filter("chunk_index IS NOT NULL")
    return cut.withColumn("chunk_id", chunk_id(F.col("document_url"), F.col("chunk_index")))
