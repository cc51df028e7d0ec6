"""An index of vectors by lists: built once, searched in the few lists that are nearest to a query.

Centres are fitted on a bounded sample; every vector is written to the list of its nearest centre, so none is
left out. A query meets the lists of its ``probes`` nearest centres as blocks of vectors and of queries, and
as many probes as there are lists give the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.vector_search import BLOCK, best_of, blocks, compared
from tarn.storage import materialize

#: Vectors that the centres are fitted on at most, and lists at most.
SAMPLE, MAX_LISTS = 32_768, 4096
#: Lists that a query enters.
PROBES = 16
_ROUNDS = 12


@dataclass
class VectorIndex:
    """Centres, one a row, and the written table ``(list, ids, vectors)``, in which a row holds up to ``BLOCK`` vectors of a list."""

    centres: np.ndarray
    lists: DataFrame
    dim: int


def fit_centres(sample: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means; centres that lose all their vectors are put on some of the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(_ROUNDS):
        nearest = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), sample[rng.integers(0, len(sample), len(centres))])
    return centres


def build(corpus: DataFrame, key: str, dim: int, vector: str = "embedding", lists: int | None = None) -> VectorIndex:
    """The index of a corpus; its lists are written to the shared folder and used by any number of searches.

    Rows whose vector is null, of another length or not finite are not in it, as in exact search. Without
    ``lists`` there are about as many as the square root of the vectors, so that a list holds as many.
    """
    packed = materialize(blocks(corpus, key, vector, dim), "vector-blocks")
    total = packed.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    lists = max(1, min(MAX_LISTS, lists or int(np.sqrt(total))))
    share = min(1.0, 0.9 * SAMPLE / max(total, 1))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                x = np.frombuffer(raw, np.float64).reshape(-1, dim)
                kept = x[np.random.default_rng(abs(ids[0]) if ids else 0).random(len(x)) < share]
                yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], names=["vectors"])

    rows = packed.mapInArrow(some, "vectors binary").collect()  # about nine tenths of SAMPLE vectors at most
    sample = np.frombuffer(b"".join(r["vectors"] for r in rows), np.float64).reshape(-1, dim)
    centres = fit_centres(sample, lists) if len(sample) else np.zeros((1, dim))
    shipped = corpus.sparkSession.sparkContext.broadcast(centres)  # MAX_LISTS bounds it

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                x, ids = np.frombuffer(raw, np.float64).reshape(-1, dim), np.array(ids, np.int64)
                yield from _by_list((x @ shipped.value.T).argmax(axis=1), ids, x)

    placed = packed.mapInArrow(place, "list int, ids array<long>, vectors binary")
    # blocks of one list side by side; a list of very many vectors is many rows, which the join deals out
    kept = materialize(placed.repartitionByRange("list").sortWithinPartitions("list"), "vector-lists")
    return VectorIndex(centres, kept, dim)


def _by_list(lists: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(lists, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(lists[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    rows = [(int(lists[order[low]]), order[start : min(start + BLOCK, high)]) for low, high in zip(cut[:-1], cut[1:]) for start in range(low, high, BLOCK)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([ids[r[1]].tolist() for r in rows], pa.list_(pa.int64())), pa.array([x[r[1]].tobytes() for r in rows], pa.binary())],
        names=["list", "ids", "vectors"],
    )


def top_k(
    index: VectorIndex, queries: DataFrame, query_key: str, k: int, query_vector: str = "embedding", probes: int = PROBES, key: str = "id", rows: DataFrame | None = None, order: list[str] | None = None
) -> DataFrame:
    """As ``vector_search.top_k``, of the vectors in the ``probes`` lists nearest to each query."""
    dim = index.dim
    shipped = queries.sparkSession.sparkContext.broadcast(index.centres)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                q, ids = np.frombuffer(raw, np.float64).reshape(-1, dim), np.array(ids, np.int64)
                s = q @ shipped.value.T
                n = min(probes, s.shape[1])
                nearest = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(q), 1))
                row = np.repeat(np.arange(len(q)), n)
                yield from _by_list(nearest.ravel(), ids[row], q[row])

    asked = blocks(queries, query_key, query_vector, dim).mapInArrow(enter, "list int, ids array<long>, vectors binary")
    asked = asked.select("list", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    return best_of(compared(index.lists.join(asked, "list"), k, dim), key, k, rows, order)
