"""Problem 2: the most similar vectors of every vector.

Vectors of length one are compared by Euclidean distance, which orders like cosine and obeys the
triangle inequality. The upper levels of one vantage-point tree, fitted on a bounded sample, send every
vector to a shard; each shard builds the rest of its tree over all vectors it holds. A search enters a
subtree if the triangle inequality can't rule it out within ``radius / factor``: factor 1 restores exact
search, larger ones prune more.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.sampling import bounded_sample
from tarn.storage import materialize

DIM = 64
NEIGHBOURS = 5
#: Relaxation of the pruning; recall against brute force is in the README and in the tests.
FACTOR = 4.0
#: The same for searches that nothing but the neighbours met so far bounds.
FAR_FACTOR = 4.0
#: Fewest shards, most that the upper levels tell apart, and vectors a shard holds in between: many, since the shards that a search enters grow with their number.
MIN_SHARDS, MAX_SHARDS, SHARD_ROWS = 16, 4096, 196_608
#: Points and searches of one task. A shard of more is searched by several tasks, each with some of its points and some of the searches that enter it.
TASK_POINTS, TASK_SEARCHES = 262_144, 393_216
#: Bytes that tasks are sent at a time, or so many copies of the vectors if that is more: what is shuffled for some tasks is deleted before others are sent theirs.
ROUND_BYTES, ROUND_COPIES = 512 << 20, 3
#: Rows of the sample that the upper levels are fitted on, a shard and in all.
SAMPLE_PER_SHARD, MAX_SAMPLE = 256, 65_536
#: Sample rows whose distances bound a search from the start.
PIVOTS = 1024
LEAF = 256
#: Copies differ by less than this in every coordinate.
GRID = 1e-5


# --- vantage-point trees -----------------------------------------------------------------------------


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ point), 0.0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of some candidates the point from which distances spread most."""
    candidates = x[rng.choice(len(x), min(16, len(x)), replace=False)]
    probe = x[rng.choice(len(x), min(256, len(x)), replace=False)]
    spread = np.sqrt(np.maximum(2.0 - 2.0 * (probe @ candidates.T), 0.0)).std(axis=0)
    return candidates[int(spread.argmax())]


def top_levels(sample: np.ndarray, shards: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and medians of the upper levels, in heap order; ``shards`` is a power of two."""
    rng = np.random.default_rng(seed)
    points, medians = np.zeros((shards - 1, sample.shape[1]), np.float32), np.zeros(shards - 1, np.float32)
    held = {0: sample}
    for node in range(shards - 1):
        x = held.pop(node)
        x = x if len(x) else sample[:1]
        points[node] = _vantage(x, rng)
        d = _distances(x, points[node])
        medians[node] = np.median(d)
        held[2 * node + 1], held[2 * node + 2] = x[d < medians[node]], x[d >= medians[node]]
    return points, medians


def route(x: np.ndarray, points: np.ndarray, medians: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(home, rows, shards)``: each row's own shard, and the pairs of row and other shard that its search enters."""
    inner = len(medians)
    home = np.zeros(len(x), np.int64)
    if inner:
        d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ points.T), 0.0))
    for _ in range(int(np.log2(inner + 1))):
        home = 2 * home + 1 + (d[np.arange(len(x)), home] >= medians[home])
    rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(inner + 1))):
        gap = d[rows, nodes] - medians[nodes]
        low, high = gap <= reach[rows], gap >= -reach[rows]
        rows, nodes = np.concatenate([rows[low], rows[high]]), np.concatenate([2 * nodes[low] + 1, 2 * nodes[high] + 2])
    away = nodes != home[rows]
    return home - inner, rows[away], nodes[away] - inner


class Best:
    """The k best neighbours met so far of each row; equally similar ones by number."""

    def __init__(self, rows: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float32)
        self.similarity = np.full((rows, k), -2.0, np.float32)
        self.neighbour = np.full((rows, k), -1, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, row: np.ndarray, neighbour: np.ndarray, similarity: np.ndarray) -> None:
        self.waiting.append((row, neighbour, similarity))
        self.count += len(row)
        if self.count > 1_000_000:
            self.settle()

    def settle(self) -> None:
        """Merge what waits, keep k a row, and raise the similarity that a new neighbour must reach."""
        if not self.count:
            return
        row, neighbour, similarity = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.count = [], 0
        rows = np.unique(row)
        old = self.neighbour[rows] >= 0
        row = np.concatenate([row, np.repeat(rows, old.sum(axis=1))])
        neighbour = np.concatenate([neighbour, self.neighbour[rows][old]])
        similarity = np.concatenate([similarity, self.similarity[rows][old]])
        order = np.lexsort((neighbour, -similarity, row))
        row, neighbour, similarity = row[order], neighbour[order], similarity[order]
        new = np.ones(len(row), bool)
        # a pair met twice has one neighbour and nearly one similarity
        by = np.lexsort((neighbour, row))
        new[by[1:]] = (row[by[1:]] != row[by[:-1]]) | (neighbour[by[1:]] != neighbour[by[:-1]])
        row, neighbour, similarity = row[new], neighbour[new], similarity[new]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        kept = rank < self.k
        self.similarity[rows], self.neighbour[rows] = -2.0, -1
        self.similarity[row[kept], rank[kept]] = similarity[kept]
        self.neighbour[row[kept], rank[kept]] = neighbour[kept]
        self.floor[rows] = np.maximum(self.floor[rows], self.similarity[rows, -1])


def search(x: np.ndarray, points: np.ndarray, asking: np.ndarray, answering: np.ndarray, best: Best, factor: float, seed: int = 11) -> None:
    """Search the tree over ``x[points]`` for all rows ``asking``; found neighbours go to ``best``.

    Rows for which ``answering`` holds also learn of the rows that ask them, so a search enters a subtree
    as long as its own row or an answering row there may gain by it. The tree is built on the way down,
    so a subtree's points and the searches that enter it are in hand at the same time.
    """
    rng = np.random.default_rng(seed)
    stack = [(points, asking)]
    while stack:
        node, rows = stack.pop()
        if not len(node) or not len(rows):
            continue
        if len(node) <= LEAF:
            _leaf(x, node, rows, answering, best)
            continue
        vantage = _vantage(x[node], rng)
        d = _distances(x[node], vantage)
        median = np.median(d)
        inside = d < median
        if not inside.any():  # all equally far: the tree can't part them
            for start in range(0, len(node), LEAF):
                _leaf(x, node[start : start + LEAF], rows, answering, best)
            continue
        if best.count > 100_000:
            best.settle()
        from_vantage = _distances(x[rows], vantage)
        low, high = float(d[inside].max()), float(d[~inside].min())
        for part, gap in ((node[~inside], high - from_vantage), (node[inside], from_vantage - low)):
            learning = part[answering[part]]
            floor = best.floor[rows] if not len(learning) else np.minimum(best.floor[rows], best.floor[learning].min())
            reach = np.sqrt(np.maximum(2.0 - 2.0 * floor, 0.0)) / factor
            stack.append((part, rows[gap <= reach + 1e-6]))


def _leaf(x: np.ndarray, node: np.ndarray, rows: np.ndarray, answering: np.ndarray, best: Best) -> None:
    block = np.ascontiguousarray(x[node].T)
    floor_node = np.where(answering[node], best.floor[node], np.float32(9))
    for start in range(0, len(rows), 1024):
        part = rows[start : start + 1024]
        s = x[part] @ block
        i, j = np.nonzero(s >= best.floor[part][:, None])
        apart = part[i] != node[j]
        i, j = i[apart], j[apart]
        if len(i) > 4 * best.k * len(part):  # nothing bounds these rows yet: keep k each
            i, j = _most(s, part, node, best.k)
        if len(i):
            best.add(part[i], node[j], s[i, j])
            if best.count > 4 * best.k * len(best.floor):
                best.settle()
        if answering[node].any():
            i, j = np.nonzero(s >= floor_node)
            apart = part[i] != node[j]
            if apart.any():
                best.add(node[j[apart]], part[i[apart]], s[i[apart], j[apart]])


def _most(s: np.ndarray, part: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of each row with its k most similar columns, itself left out; all that tie with the last."""
    masked = np.where(part[:, None] == node[None, :], np.float32(-3), s)
    if s.shape[1] <= k:
        return np.nonzero(masked > -3)
    last = np.partition(masked, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return np.nonzero((masked >= last[:, None]) & (masked > -3))


# --- the operator ------------------------------------------------------------------------------------


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(id, copy, v)`` of the usable rows: the number, a hash that copies share, and the vector at length one as bytes.

    Rows whose key or vector is null, of another length than ``dim``, all zero or not finite take no part.
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("v", T.BinaryType())])
    rows = df.filter((F.size(vector) == dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            x = x[ok] / norm[ok, None]
            cells = np.round(x / GRID).astype(np.int32)
            copies = [xxhash.xxh3_64_intdigest(c.tobytes()) for c in cells]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").filter(pa.array(ok)),
                    pa.array(np.array(copies, np.uint64).view(np.int64)),
                    pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary()),
                ],
                names=["id", "copy", "v"],
            )

    return rows.mapInArrow(run, schema)


def _unpack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def nearest(
    df: DataFrame, key: str, vector: str, k: int = NEIGHBOURS, min_cosine: float = -1.0, factor: float = FACTOR, queries: Callable[[Column], Column] | None = None, dim: int = DIM
) -> DataFrame:
    """``(query, neighbour, cosine, rank)``: of every usable row (or those for which ``queries`` holds) the ``k`` most similar others.

    Only neighbours of at least ``min_cosine`` are looked for, which bounds every search. Ties go to the
    smaller key. Keys must be unique 64-bit integers. Rows of equal direction (copies) stand for each
    other in the index: at most ``k + 1`` of them enter it, and every other copy has the first ``k`` of
    its kind as its neighbours, so a vector that a third of all rows repeat costs no more than its rows.
    ``queries`` makes a condition of the key column.

    Rows whose vector is null, of another length than ``dim``, all zero or not finite take no part; a
    lone row has no neighbours; an empty table gives an empty result; other columns are ignored.
    """
    rows = unit_vectors(df, key, vector, dim)
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("copy").orderBy("id"))).filter(F.col("r") <= k + 1)
    kinds = materialize(first.groupBy("copy").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")), "vector-kinds")
    stats = kinds.agg(F.count("*").alias("kinds"), F.max(F.size("ids")).alias("most")).first()
    shards = MIN_SHARDS
    while shards < MAX_SHARDS and stats["kinds"] > shards * SHARD_ROWS:
        shards *= 2
    sampled = bounded_sample(kinds.select(F.col("ids")[0].alias("id"), "v"), ["id"], min(MAX_SAMPLE, SAMPLE_PER_SHARD * shards), stats["kinds"]).collect()
    own = F.lit(True) if queries is None else F.exists("ids", queries)
    found = _found(kinds.select("ids", "v", own.alias("asks")), sampled, k, min_cosine, factor, shards, dim, queries is None and min_cosine > -1.0)
    one = F.lit(1.0)
    # row by row: neighbours of other kinds, of the same kind, and of the copies beyond those indexed
    other = found.filter(F.size("q") <= k).select(F.explode("q").alias("query"), "p", "cosine").select("query", F.explode("p").alias("neighbour"), "cosine")
    same = kinds.filter(F.size("ids") > 1).select(F.explode("ids").alias("query"), "ids").select("query", F.explode("ids").alias("neighbour"), one.alias("cosine"))
    pairs = other.unionByName(same.filter("query <> neighbour"))
    if (stats["most"] or 0) > k:
        heavy = kinds.select("copy", "ids").filter(F.size("ids") > k)
        rest = rows.select("id", "copy").join(heavy, "copy").filter(~F.array_contains("ids", F.col("id")))
        pairs = pairs.unionByName(rest.select(F.col("id").alias("query"), F.explode(F.slice("ids", 1, k)).alias("neighbour"), one.alias("cosine")))
    if queries is not None:
        pairs = pairs.filter(queries(F.col("query")))
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.filter(F.col("rank") <= k)


def _found(kinds: DataFrame, sampled: list, k: int, min_cosine: float, factor: float, shards: int, dim: int, mutual: bool) -> DataFrame:
    """``(q, p, cosine)``: the keys of a kind of vector, those of one of its k most similar kinds, and their cosine; shard by shard.

    With ``mutual`` (every row asks, within one radius) of any two shards only the rows of one enter the
    other, and both rows learn of each pair. Which of them alternates, so visits are spread evenly.
    A shard beyond what one task holds is divided by ``_divisions``: every search meets every point once.
    A vector is sent to every shard that its search enters, many times the table in all, so tasks take
    turns (``_rounds``): at any size no more than some copies of the table are on disk at once.
    """
    sample = np.frombuffer(b"".join(r["v"] for r in sampled), np.float32).reshape(-1, dim)
    if len(sample):
        points, medians = top_levels(sample, shards)
    else:
        points, medians = np.zeros((0, dim), np.float32), np.zeros(0, np.float32)
    shipped = kinds.sparkSession.sparkContext.broadcast((points, medians, sample[:PIVOTS], np.array([r["id"] for r in sampled[:PIVOTS]], np.int64)))  # MAX_SHARDS and PIVOTS bound it

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """``(rows, keys, asking, floor, home, visiting rows, visited shards)`` of some rows at a time."""
        points, medians, pivots, pivot_ids = shipped.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = _unpack(part.column("v"), dim)
                ids = _firsts(part.column("ids"))
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                floor = np.full(len(x), min_cosine, np.float32)
                if min_cosine <= -1.0 and len(pivots) > k:  # the k-th nearest pivot is no nearer than the k-th neighbour
                    s = np.where(ids[:, None] == pivot_ids[None, :], np.float32(-3), x @ pivots.T)
                    floor = np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - np.float32(1e-6), np.float32(-1))
                reach = np.where(asks, np.sqrt(np.maximum(2.0 - 2.0 * floor, 0.0)) / factor + 1e-6, -9.0)
                home, away_rows, away = route(x, points, medians, reach)
                if mutual:
                    enters = (away > home[away_rows]) == ((away + home[away_rows]) % 2 == 0)
                    away_rows, away = away_rows[enters], away[enters]
                yield part, ids, asks, floor, home, away_rows, away

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, shards), np.int64)
        for _, _, _, _, home, _, away in routed(batches):
            held[0] += np.bincount(home, minlength=shards)
            held[1] += np.bincount(away, minlength=shards)
        some = np.flatnonzero(held.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[0][some]), pa.array(held[1][some])], names=["shard", "points", "visits"])

    sizes = kinds.mapInArrow(count, "shard int, points long, visits long").groupBy("shard").agg(F.sum("points").alias("points"), F.sum("visits").alias("visits"))
    held = [(r["shard"], r["points"], r["visits"]) for r in sizes.collect()]  # a row a shard
    divided = _divisions(held, shards)
    offsets = np.cumsum([0, *(divided[:, 0] * divided[:, 1])])
    sent = T.StructType(
        [T.StructField("task", T.IntegerType()), T.StructField("role", T.ByteType()), T.StructField("asks", T.BooleanType()), T.StructField("floor", T.FloatType())]
        + [kinds.schema["ids"], kinds.schema["v"]]
    )

    def send(low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, ids, asks, floor, home, away_rows, away in routed(batches):
                share = _shares(ids)
                row = np.concatenate([np.arange(len(ids)), away_rows])
                task, role, asking, taken = _deal(np.concatenate([home, away]), np.arange(len(row)) < len(ids), share[row], asks[row], divided, offsets)
                now = (task >= low) & (task < high)
                task, role, asking, row = task[now] - low, role[now], asking[now], row[taken[now]]
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task.astype(np.int32)), pa.array(role), pa.array(asking), pa.array(floor[row]), part.column("ids").take(index), part.column("v").take(index)], names=sent.names
                )

        return run

    result = T.StructType([T.StructField("q", kinds.schema["ids"].dataType), T.StructField("p", kinds.schema["ids"].dataType), T.StructField("cosine", T.DoubleType())])

    names = [c for c in sent.names if c != "v"]

    def search_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, blocks = [], []  # of one task: a partition holds no other
        for batch in batches:
            if batch.num_rows:
                blocks.append(_unpack(batch.column("v"), dim))
                rows.append(batch.select(names).take(pa.array(np.arange(batch.num_rows))))  # copied, so the batch's vectors don't stay
        if not rows:
            return
        # numbered by key, so that ties go to the smaller one
        table = pa.Table.from_batches(rows)
        order = np.argsort(np.concatenate([_firsts(b.column("ids")) for b in rows]), kind="stable")
        table, place = table.take(pa.array(order)), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        x, done = np.empty((len(order), dim), np.float32), 0
        for n in range(len(blocks)):
            block, blocks[n] = blocks[n], None
            x[place[done : done + len(block)]] = block
            done += len(block)
        role, asks = table.column("role").to_numpy(), table.column("asks").to_numpy().astype(bool)
        best = Best(len(x), k, table.column("floor").to_numpy())
        here, quiet = np.flatnonzero(role == POINT), np.zeros(len(x), bool)
        search(x, here, np.flatnonzero((role <= OWN) & asks), quiet, best, factor)
        best.settle()
        search(x, here, np.flatnonzero(role == VISITOR), role == POINT if mutual else quiet, best, factor)
        best.settle()
        row, rank = np.nonzero(best.neighbour >= 0)
        ids = table.column("ids").combine_chunks()
        exact = np.einsum("ij,ij->i", x[row].astype(np.float64), x[best.neighbour[row, rank]].astype(np.float64))
        kept = exact >= min_cosine - 1e-7
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[kept])), ids.take(pa.array(best.neighbour[row, rank][kept])), pa.array(np.clip(exact[kept], -1.0, 1.0))], names=result.names
        )

    rounds = _rounds(held, divided, offsets, max(ROUND_BYTES // (4 * dim), ROUND_COPIES * sum(points for _, points, _ in held)))
    found = [kinds.mapInArrow(send(low, high), sent).repartitionById(high - low, "task").mapInArrow(search_task, result) for low, high in rounds]
    return found[0] if len(found) == 1 else functools.reduce(DataFrame.union, [materialize(part, "neighbours") for part in found])


#: What a row is to a task: a point of its tree (which may ask, too), a search of the same shard, a search from another shard.
POINT, OWN, VISITOR = np.int8(0), np.int8(1), np.int8(2)


def _divisions(sizes: list[tuple[int, int, int]], shards: int) -> np.ndarray:
    """For each shard into how many groups its searches and its points are divided; every pair of groups is a task."""
    out = np.ones((shards, 2), np.int64)
    for shard, points, visits in sizes:
        out[shard] = max(1, -(-(points + visits) // TASK_SEARCHES)), max(1, -(-points // TASK_POINTS))
    return out


def _rounds(sizes: list[tuple[int, int, int]], divided: np.ndarray, offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of tasks, each as long as ``most`` rows or one task allow; together all tasks."""
    rows = np.zeros(int(offsets[-1]))
    for shard, points, visits in sizes:
        searches, groups = divided[shard]
        rows[offsets[shard] : offsets[shard + 1]] = points / groups + (visits + points * (groups > 1)) / searches
    out, low, sum_ = [], 0, 0.0
    for task, n in enumerate(rows):
        if task > low and sum_ + n > most:
            out.append((low, task))
            low, sum_ = task, 0.0
        sum_ += n
    return [*out, (low, len(rows))]


def _firsts(lists: pa.Array) -> np.ndarray:
    """The first element of each list; none is empty."""
    return lists.flatten().to_numpy()[np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1]]]


def _shares(ids: np.ndarray) -> np.ndarray:
    """A number a key, by which rows are dealt to groups."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)


def _deal(shard: np.ndarray, at_home: np.ndarray, share: np.ndarray, asks: np.ndarray, divided: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(task, role, asks, row)``: the tasks that each row goes to. A row's group of points is in the tasks of all groups of searches, and the other way round."""
    searches, points = divided[shard, 0], divided[shard, 1]
    as_search, as_point = share % searches, (share // 1009) % points
    counted = lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    home = np.flatnonzero(at_home)
    held, group = np.repeat(home, searches[home]), counted(searches[home])
    out = [(offsets[shard[held]] + group * points[held] + as_point[held], np.full(len(held), POINT), asks[held] & (group == as_search[held]), held)]
    asking = np.flatnonzero(~at_home | asks)
    sought, group = np.repeat(asking, points[asking]), counted(points[asking])
    other = ~at_home[sought] | (group != as_point[sought])  # among its own group a row asks as a point
    sought, group = sought[other], group[other]
    out.append((offsets[shard[sought]] + as_search[sought] * points[sought] + group, np.where(at_home[sought], OWN, VISITOR), np.ones(len(sought), bool), sought))
    return tuple(np.concatenate(c) for c in zip(*out))


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = NEIGHBOURS, min_cosine: float = 0.9, factor: float = FACTOR, dim: int = DIM) -> DataFrame:
    """``(a, b, cosine)``, a < b: pairs of at least ``min_cosine`` of which one is among the k most similar of the other."""
    found = nearest(df, key, vector, k, min_cosine, factor, dim=dim)
    ends = found.select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b"), "cosine")
    return ends.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).filter(F.col("cosine") >= min_cosine)
