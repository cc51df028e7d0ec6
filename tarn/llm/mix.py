"""Problem 7: mixing sources to target weights.

Documents of a source fall into blocks by a hash, and within a block into cells. Every round of a source
goes through its blocks in another order; its quota is so many whole rounds, blocks of one more, and cells
of the block after them. A splitting tree divides these quotas of cells among output shards: at every node
the left half of the shards draws from the sources by the multivariate hypergeometric distribution. Every
shard takes its own stretch of each source's cells, and its documents are shuffled locally.

The driver holds the sizes of a bounded number of blocks and the ends of the stretches. Which copies of a
document are taken, and by which shard, is worked out where the document lies.
"""

from __future__ import annotations

import ast
import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.duck import map_text
from tarn.llm.lines import site
from tarn.storage import materialize, scratch

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Blocks of one source at most, and of all sources (but 64 of each).
MAX_BLOCKS, ALL_BLOCKS = 4096, 65_536
#: Rows of the table of targets at most: one a source, planned on the driver.
MAX_SOURCES = 100_000
#: Cells that quotas are counted in: at most so many a block, and about so many in all.
CELLS, ALL_CELLS = 1024, 400_000_000
#: Ends of stretches that the driver plans at most, shards times sources; with more shards, each planned one is parted evenly where it lies.
STRETCHES = 4_000_000
#: Tokens of an output shard.
SHARD_TOKENS = 4_000_000
SEED = 20


def token_counts(df: DataFrame, text: str = "text", output: str = "tokens", tokenizers: str = TOKENIZERS, file: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the number of tokens of ``text`` in ``output``; 0 for null and empty texts."""
    with open(f"{tokenizers}/{file}", "rb") as source:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in source)}
    pattern = _pattern(tokenizers)
    shipped = df.sparkSession.sparkContext.broadcast((pattern, ranks))  # one vocabulary file, whatever the corpus

    def compute():
        import tiktoken

        pattern, ranks = shipped.value
        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda batch: [pa.array([len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(text).to_pylist()], pa.int64())]

    return map_text(df, text, [T.StructField(output, T.LongType())], compute, keep=keep)


def _pattern(tokenizers: str) -> str:
    """The word pattern that comes with the rank files."""
    with open(f"{tokenizers}/__init__.py", encoding="utf-8") as source:
        for line in source:
            if line.startswith("PATTERN ="):
                return ast.literal_eval(line.partition("=")[2].strip())
    raise ValueError(f"no pattern in {tokenizers}")


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", url: str = "url") -> DataFrame:
    """``(key, site, tokens)`` of every document."""
    rows = documents.select(F.col(key).alias("__key"), site(F.col(source), F.col(url)).alias("site"), F.col(text).alias("__text"))
    return token_counts(rows, "__text", keep=["__key", "site"]).withColumnRenamed("__key", key)


def reach(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """The rows of ``targets`` with what their sources have and need.

    ``(source, target_share, max_repeats, documents, available, wanted, quota, reachable)``: tokens of the
    source's documents, tokens that its share of a mix of ``total`` tokens takes (all documents together
    by default), and what of that it gives when no document is taken more than ``max_repeats`` times.

    A source without documents gives nothing; a null or negative number of repeats counts as 0, a null
    share as 0 (always reachable). Sizes are pre-aggregated, so a source that holds most documents is no
    burden. A source listed twice has two rows, each with the whole source.
    """
    known = materialize(sizes.groupBy("site").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available")), "site-sizes")  # a row a site, read twice
    wanted_total = F.lit(total) if total is not None else F.coalesce(F.col("mix_total"), F.lit(0))
    rows = targets.select("source", "target_share", "max_repeats").withColumn("__site", F.regexp_replace(F.lower(F.trim("source")), r"^www\.", ""))
    joined = rows.join(known, F.col("__site") == F.col("site"), "left").crossJoin(F.broadcast(known.agg(F.sum("available").alias("mix_total"))))  # one row
    available = F.coalesce(F.col("available"), F.lit(0))
    most = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)) * available
    wanted = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0)) * wanted_total
    return joined.select(
        "source", "__site", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), available.alias("available"),
        wanted.alias("wanted"), F.least(wanted, most.cast("double")).alias("quota"), (most >= wanted).alias("reachable"),
    )


def hypergeometric_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of cells, one column a source, divided exactly among ``shards`` rows of nearly equal sums."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        low, high, left = stack.pop()
        if high - low == 1:
            out[low] = left
            continue
        middle = (low + high) // 2
        drawn = _draw(left, int(left.sum()) * (middle - low) // (high - low), rng)
        stack += [(low, middle, drawn), (middle, high, left - drawn)]
    return out


def _draw(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` cells, drawn without replacement, are of each source."""
    out, rest = np.zeros_like(left), int(left.sum())
    for i, have in enumerate(left):
        rest -= int(have)
        out[i] = rng.hypergeometric(int(have), rest, take) if take and have else 0
        take -= int(out[i])
    return out


def _one_a_site(rows: list) -> list[dict]:
    """The rows of ``reach`` as one a site, in the order of sites, quotas added up as far as ``max_repeats`` goes."""
    out: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["__site"] or "", r["quota"])):
        held = out.setdefault(r["__site"], {"__site": r["__site"], "documents": r["documents"], "available": r["available"], "max_repeats": 0, "quota": 0.0})
        held["max_repeats"] = max(held["max_repeats"], r["max_repeats"] or 0)
        held["quota"] += r["quota"]
    return [row | {"quota": min(row["quota"], float(row["max_repeats"] * row["available"]))} for row in out.values()]


@dataclass
class Source:
    """One source's plan: ``rounds`` whole ones, ``extra`` blocks of one more, and of the next block the first ``cells``, which hold about ``rest`` tokens."""

    name: str
    blocks: int
    rounds: int
    extra: int
    rest: float
    cells: int = 0

    def units(self, cells: int) -> int:
        return (self.rounds * self.blocks + self.extra) * cells + self.cells


def turn(block: np.ndarray, blocks: np.ndarray | int, number: np.ndarray | int) -> np.ndarray:
    """The place of a block in a source's round ``number``; blocks are a power of two."""
    return ((2 * ((number * 40503 + 12345) % 32768) + 1) * block + number * 2654435 + 17) % blocks


def _planned(row: dict, blocks: int, numbers: np.ndarray, tokens: np.ndarray) -> Source:
    """The plan of one source from the sizes of its blocks, but for the cells."""
    have, quota = int(tokens.sum()), row["quota"]
    if not have:
        return Source(row["__site"], blocks, 0, 0, 0.0)
    rounds = min(int(quota // have), row["max_repeats"])
    if rounds == row["max_repeats"]:
        return Source(row["__site"], blocks, rounds, 0, 0.0)
    size = np.zeros(blocks, np.int64)
    size[turn(numbers.astype(np.int64), blocks, rounds)] = tokens
    ends, left = np.cumsum(size), quota - rounds * have
    extra = int(np.searchsorted(ends, left, side="right"))  # blocks that fit whole
    return Source(row["__site"], blocks, rounds, extra, left - (float(ends[extra - 1]) if extra else 0.0))


def _cell(key: str, copy: Column, seed: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), copy), F.lit(cells))


def _power(n: int) -> int:
    """The greatest power of two that isn't above ``n``."""
    return 1 << (max(int(n), 1).bit_length() - 1)


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(shard, position, key, source, copy, tokens)``: the mix, ``copy`` from 0 for a document taken again.

    Each listed source gives its share of ``total`` tokens (all documents together by default) or, where
    ``max_repeats`` doesn't allow it, all it can; the tokens it gives miss that quota by at most half a
    cell's, which is a document or a few. Sources that aren't listed give nothing. Equal seeds give equal
    mixes. Documents of no tokens are taken along with their cells. Duplicate rows are documents of their
    own. Empty tables give an empty mix.

    Rows of ``targets`` that name one site (listed twice, or as X and www.x) have their quotas added up,
    each of them bounded by its own ``max_repeats``, and no document is taken more often than the
    greatest of these allows.
    """
    spark = sizes.sparkSession
    with scratch():
        rows = reach(sizes, targets, total).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = _one_a_site(rows)
    most = _power(max(64, min(MAX_BLOCKS, ALL_BLOCKS // max(1, len(rows)))))
    blocks = {r["__site"]: min(2 * _power(2 * r["documents"]), most) for r in rows if r["__site"] is not None}
    counts = spark.createDataFrame(list(blocks.items()), "site string, blocks long")
    placed = sizes.join(F.broadcast(counts), "site").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.col("blocks")))
    sums = placed.groupBy("site", "block").agg(F.sum("tokens").alias("tokens")).toPandas()  # ALL_BLOCKS rows, or 64 a source
    known = {name: (g["block"].to_numpy(), g["tokens"].to_numpy()) for name, g in sums.groupby("site")}
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sources = [_planned(r, blocks[r["__site"]], *known.get(r["__site"], none)) for r in rows if r["__site"] is not None]
    cells = min(CELLS, _power(ALL_CELLS // max(1, sum((s.rounds + 1) * s.blocks for s in sources))))
    _cut_cells(placed, sources, key, seed, cells)

    shards = max(1, round(sum(r["quota"] for r in rows) / shard_tokens))
    planned = min(shards, max(1, STRETCHES // max(1, len(sources))))
    parts = -(-shards // planned)
    quotas = np.array([s.units(cells) for s in sources], np.int64)
    grain = max(1, -(-int(quotas.sum()) // ALL_CELLS))  # so many rounds that cells are drawn several at a time
    taken = hypergeometric_tree(quotas // grain, planned, np.random.default_rng(seed))
    ends = np.cumsum(taken, axis=0).T * grain
    if len(sources):
        ends[:, -1] = quotas
    shipped = spark.sparkContext.broadcast(({s.name: i for i, s in enumerate(sources)}, [(s.blocks, s.rounds) for s in sources], ends))  # STRETCHES bounds it

    schema = T.StructType([T.StructField("planned", T.LongType()), placed.schema[key], T.StructField("source", T.StringType()), T.StructField("copy", T.IntegerType()), T.StructField("tokens", T.LongType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rounds, ends = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array([index[name] for name in batch.column("site").to_pylist()])
            n, last, copy = np.array([rounds[i][0] for i in at]), np.array([rounds[i][1] for i in at]), batch.column("copy").to_numpy()
            unit = (copy * n + turn(batch.column("block").to_numpy(), n, copy)) * cells + batch.column("cell").to_numpy()
            row, shard = [], []
            for i in np.unique(at):
                own = np.flatnonzero(at == i)
                own = own[unit[own] < ends[i, -1]]
                row.append(own)
                shard.append(np.searchsorted(ends[i], unit[own], side="right"))
            row, shard = np.concatenate(row), np.concatenate(shard)
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int64()), kept.column(key), kept.column("site"), kept.column("copy").cast(pa.int32()), kept.column("tokens").cast(pa.int64())], names=schema.names
            )

    copies = spark.createDataFrame([(s.name, s.rounds + (1 if s.extra or s.cells else 0)) for s in sources], "site string, copies long")
    copied = placed.join(F.broadcast(copies), "site")  # a row a source
    copied = copied.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    copied = copied.select(key, "site", "tokens", "block", "copy", _cell(key, F.col("copy"), seed, cells).alias("cell"))
    mixed = copied.mapInArrow(take, schema)
    local = W.partitionBy("planned").orderBy(F.xxhash64(F.lit(seed + 2), F.col(key), F.col("copy")), F.col(key), F.col("copy"))
    ranked = mixed.withColumn("n", F.row_number().over(local) - 1)
    if parts > 1:  # a planned shard's permuted documents in even stretches
        size = F.count("*").over(W.partitionBy("planned"))
        ranked = ranked.withColumn("part", F.floor(F.col("n") * parts / size)).withColumn("n", F.row_number().over(W.partitionBy("planned", "part").orderBy("n")) - 1)
        ranked = ranked.withColumn("planned", F.col("planned") * parts + F.col("part"))
    return ranked.select(F.col("planned").cast("int").alias("shard"), F.col("n").alias("position"), key, "source", "copy", "tokens")


def _cut_cells(placed: DataFrame, sources: list[Source], key: str, seed: int, cells: int) -> None:
    """Set how many cells each source gives of the block that it doesn't give whole: so many as come nearest to the rest of its quota."""
    cut = [s for s in sources if s.rest > 0]
    if not cut:
        return
    inverse = {}
    for s in cut:
        inverse[s.name] = int(np.flatnonzero(turn(np.arange(s.blocks), s.blocks, s.rounds) == s.extra)[0])
    side = placed.sparkSession.createDataFrame([(s.name, inverse[s.name], s.rounds, s.rest) for s in cut], "site string, block long, copy long, rest double")
    inside = placed.join(F.broadcast(side), ["site", "block"])  # a row a source
    sums = inside.groupBy("site", "rest", _cell(key, F.col("copy"), seed, cells).alias("cell")).agg(F.sum("tokens").alias("tokens"))
    upto = sums.withColumn("upto", F.sum("tokens").over(W.partitionBy("site").orderBy("cell")))
    nearest = upto.groupBy("site", "rest").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("rest")).alias("miss"), (F.col("cell") + 1).alias("cells"))).alias("best"))
    found = {r["site"]: r["best"] for r in nearest.collect()}  # a row a source
    for s in cut:
        best = found.get(s.name)
        s.cells = int(best["cells"]) if best is not None and best["miss"] < s.rest else 0


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, tokens, share, documents, most_copies)``: what a mix came to, one row a listed site; its ``target_share`` is all that its rows add up to."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max(F.col("copy") + 1).alias("most_copies"))
    all_tokens = mixed.agg(F.sum("tokens").alias("all_tokens"))
    rows = targets.select(F.regexp_replace(F.lower(F.trim("source")), r"^www\.", "").alias("source"), "target_share")
    rows = rows.groupBy("source").agg(F.sum("target_share").alias("target_share"))
    return (
        rows.join(got, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
        .select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
                F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    )


def short(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """The rows of ``reach`` whose sources get less than their share in ``mixed``, the mix of these tables, and can't get it; ``given`` says how many tokens they get.

    A mix misses a quota by up to half a cell, so what falls short in it is checked exactly by ``reach``.
    A source that can't reach its share gives all its documents ``max_repeats`` times, so none is missed.
    Of a source listed twice the rows have one number of tokens between them, and ``reach`` alone decides.
    """
    sums = mixed.groupBy(F.col("source").alias("__site")).agg(F.sum("tokens").alias("given"))
    rows = reach(sizes, targets, total).withColumn("__listed", F.count("*").over(W.partitionBy("__site"))).join(sums, "__site", "left")
    rows = rows.withColumn("given", F.coalesce("given", F.lit(0)))
    return rows.filter(~F.col("reachable") & ((F.col("given") < F.col("wanted")) | (F.col("__listed") > 1))).drop("__listed")
