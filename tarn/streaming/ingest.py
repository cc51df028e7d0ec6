"""Keeping a chunk store up to date from a folder that files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.sources.store import ChunkStore


def upsert_stream(spark: SparkSession, folder: str, schema: StructType, store: ChunkStore, checkpoint: str, pattern: str = "*.parquet", files_per_batch: int = 100):
    """Read chunk records from Parquet files as they appear and upsert each batch; returns the query after all present files.

    The last write of a key by ``(ingested_at, chunk_no)`` wins, whatever files and batches the writes come
    in. A batch that is run again after a failure writes the same rows again, so the store ends up the same.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, _: int) -> None:
        store.insert_log(batch)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def question_load(spark: SparkSession, folder: str, schema: StructType, window: str = "1 day", late: str = "45 days", pattern: str = "*.parquet") -> DataFrame:
    """A stream of how many runs each question had in each window of ``asked_at``; a row logged twice counts once.

    Rows that arrive later than ``late`` after the latest are dropped, and so is the state behind them.
    """
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withWatermark("asked_at", late)
    once = rows.dropDuplicatesWithinWatermark(["run_id", "rank_no"])
    return once.filter("rank_no = 1").groupBy(F.window("asked_at", window).alias("w"), "question_id").agg(F.count("*").alias("runs"))
