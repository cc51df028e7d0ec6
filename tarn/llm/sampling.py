"""Bounded samples that the same rows always give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = 1 << 40


def bounded_sample(df: DataFrame, on: list[str], rows: int, total: int | None = None) -> DataFrame:
    """All rows of ``df``, or, if it has more than ``rows``, about nine tenths of so many, by a hash of the columns ``on``.

    Rows are chosen where they lie: what reaches the driver is the sample, however many partitions there are.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(97), *on), F.lit(_CELLS)) < int(0.9 * rows / total * _CELLS)).limit(rows)
