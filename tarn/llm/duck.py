"""DuckDB inside Arrow partitions: connections, batch cutting and output assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text bytes that one DuckDB statement handles at a time; one longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def connect():
    """An in-memory database of one thread: Spark's tasks are the parallelism."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "preserve_insertion_order": True, "temp_directory": ""})
    db.execute("SET TimeZone = 'UTC'; SET enable_progress_bar = false")
    return db


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``limit`` bytes or are one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(pc.cast(batch.column(column), pa.large_string())), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        yield batch.slice(start)


def text_table(batch: pa.RecordBatch, column: str) -> pa.Table:
    """``(k, x)``: row number within the batch and text, for DuckDB to scan."""
    text = pc.cast(batch.column(column), pa.large_string())
    return pa.table({"k": pa.array(range(batch.num_rows), pa.int32()), "x": text})


def map_text(
    df: DataFrame,
    column: str,
    added: list[T.StructField],
    compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: list[str] | None = None,
    limit: int = BATCH_BYTES,
) -> DataFrame:
    """``df`` with the columns ``added``, computed from texts partition by partition.

    ``compute()`` runs once per task and returns the function that turns a batch into the arrays of
    the added columns, row for row. ``keep`` names the columns to carry along (all by default); a
    column of ``df`` that has an added column's name gives way to it.
    """
    new = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    carried = [df.schema[c] for c in kept]
    schema = T.StructType(carried + added)
    source = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, column])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = compute()
        for batch in slices(batches, column, limit):
            arrays = [batch.column(c) for c in kept] + step(batch)
            yield pa.RecordBatch.from_arrays(arrays, names=kept + [f.name for f in added])

    return source.mapInArrow(run, schema)
