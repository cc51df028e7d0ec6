"""Exact nearest neighbours by cosine, for a stated set of queries against all rows.

Both sides are packed into blocks of vectors; each pair of blocks is one matrix product in an Arrow
batch, of which every query keeps its k best before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.storage import materialize, size_bytes

#: Bytes of query blocks that are broadcast at a time; vectors hardly compress, so files are about as large as memory.
BROADCAST_BYTES = 64 << 20
#: Vectors of a block.
BLOCK = 4096
#: Decimals that similarities are compared to.
DECIMALS = 6

_BLOCKS = "ids array<long>, vectors binary"


def blocks(df: DataFrame, key: str, vector: str, dim: int, unit: bool = True) -> DataFrame:
    """The rows' keys and vectors, packed; at length one if ``unit``. Rows of another dimension, null or not finite are left out; zero vectors stay zero."""
    usable = df.filter(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                ok = np.isfinite(x).all(axis=1)
                x, ids = x[ok], part.column("id").to_numpy()[ok]
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0) if unit else x
                yield pa.RecordBatch.from_arrays([pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], names=["ids", "vectors"])

    return usable.mapInArrow(pack, _BLOCKS)


def top_k(
    corpus: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, dim: int, vector: str = "embedding", query_vector: str = "embedding",
    rows: DataFrame | None = None, order: list[str] | None = None,
) -> DataFrame:
    """``(query_id, id, similarity, rank)`` and the columns of ``rows``: the ``k`` rows of ``corpus`` most similar to each query, similarities rounded to six decimals.

    Keys are 64-bit integers. ``rows`` has a row a corpus key; it is joined once, to the few candidates that
    are left of each query. Ties go by its columns ``order``, then by key. A query of length zero is 0
    similar to everything.

    Every block of queries meets every block of the corpus: that is what exact search costs. The queries are
    broadcast, as many at a time as ``BROADCAST_BYTES`` holds, so the corpus is never shuffled.
    """
    left = blocks(corpus, key, vector, dim)
    right = materialize(blocks(queries, query_key, query_vector, dim).select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), "query-blocks")
    turns = max(1, -(-size_bytes(right) // BROADCAST_BYTES))
    if turns > 1:
        left = materialize(left, "corpus-blocks")

    pairs = None
    for turn in range(turns):
        some = right if turns == 1 else right.filter(F.pmod(F.xxhash64("query_ids"), F.lit(turns)) == turn)
        met = compared(left.crossJoin(F.broadcast(some)), k, dim)  # the measured queries, in blocks
        pairs = met if pairs is None else pairs.unionByName(met)
    return best_of(pairs, key, k, rows, order)


def compared(met: DataFrame, k: int, dim: int) -> DataFrame:
    """``(query_id, id, similarity)`` of blocks of vectors that blocks of queries have met: of each pair of blocks every query's ``k`` best, and all that rounding may make equal."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, query_ids = (np.array(batch.column(c)[row].as_py(), np.int64) for c in ("ids", "query_ids"))
                x, q = (np.frombuffer(batch.column(c)[row].as_py(), np.float64).reshape(-1, dim) for c in ("vectors", "query_vectors"))
                if not len(ids):
                    continue
                for start in range(0, len(q), 512):
                    s = q[start : start + 512] @ x.T
                    last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else s.min(axis=1)
                    i, j = np.nonzero(s >= last[:, None] - 2 * 10.0**-DECIMALS)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[start + i]), pa.array(ids[j]), pa.array(s[i, j])], names=["query_id", "id", "similarity"])

    return met.mapInArrow(compare, "query_id long, id long, similarity double")


def best_of(pairs: DataFrame, key: str, k: int, rows: DataFrame | None, order: list[str] | None) -> DataFrame:
    """The ``k`` best of each query's pairs; see ``top_k``."""
    pairs = pairs.withColumn("similarity", F.round("similarity", DECIMALS))
    # bring the candidates down to a few per query before the other columns are joined
    near = W.partitionBy("query_id").orderBy(F.desc("similarity"))
    pairs = pairs.withColumn("__r", F.rank().over(near)).filter(F.col("__r") <= k).drop("__r")
    more = [c for c in rows.columns if c != key] if rows is not None else []
    if rows is not None:
        pairs = pairs.join(rows.withColumnRenamed(key, "id"), "id")
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), *(order or []), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank", *more)
