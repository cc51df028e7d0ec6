"""The chunk store: one row a chunk key, the last write wins.

Chunks lie in Parquet, divided into buckets by a hash of their document's url. A manifest names the folders
of every bucket. A write makes new folders for the buckets it touches and then the next manifest, so readers
see either all of a write or nothing of it; what the manifest before named stays until the next write, so a
scan that has begun can end. Writes of a log are laid beside what a bucket has and merged when it is read,
until there are so many that the bucket is written anew. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.text import chunk_id
from tarn.storage import materialize, release

SCHEMA = "chunk_id string, document_url string, document_title string, chunk_index int, text string, embedding array<float>"
COLUMNS = ["chunk_id", "document_url", "document_title", "chunk_index", "text", "embedding"]
#: What orders the writes of a log; stored beside the chunks, null for writes that don't come from a log.
ORDER = {"ingested_at": "timestamp", "chunk_no": "long"}
#: Buckets of a new store, and folders of a bucket beyond which it is written anew.
BUCKETS, MAX_FOLDERS = 64, 4
STORED = ", ".join([SCHEMA, *(f"{name} {kind}" for name, kind in ORDER.items())])


def last_writes(log: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("ingested_at", "chunk_no")) -> DataFrame:
    """Of all writes of a key the last, by the columns ``order``. Nulls in ``order`` come first; rows without a key are left out.

    Only the winning row of each map task is shuffled, so a key written again and again is no hot spot.
    """
    ranked = W.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return log.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(ranked)).filter("__r = 1").drop("__r")


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``existing`` with its rows of keys in ``new`` replaced, and the others of ``new`` added. Keys are unique in either."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def without_stale(existing: DataFrame, new: DataFrame, url: str = "document_url") -> DataFrame:
    """``existing`` without the documents that ``new`` writes again, so a document that shrank keeps no old tail."""
    return existing.join(new.select(url).distinct(), url, "left_anti")


class ChunkStore:
    """A store in a folder that all executors share; ``buckets`` counts for a store that isn't there yet."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.new_buckets = spark, path.rstrip("/"), buckets

    # --- manifests ---

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs().exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path())]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _read_manifest(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"manifest-{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self) -> dict | None:
        numbers = self._numbers()
        return self._read_manifest(numbers[-1]) if numbers else None

    def _commit(self, manifest: dict) -> None:
        """Make ``manifest`` the current one, and delete what only the one before the last named."""
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 1
        stream = self._fs().create(self._path(f"next-{number:08d}"))
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        self._fs().rename(self._path(f"next-{number:08d}"), self._path(f"manifest-{number:08d}.json"))  # from here on readers see it
        named = lambda m: {f"{folder}/b={b}" for b, folders in m["folders"].items() for folder in folders}
        for old in numbers[:-1]:
            for stale in named(self._read_manifest(old)) - named(self._read_manifest(numbers[-1])) - named(manifest):
                self._fs().delete(self._path(stale), True)
            self._fs().delete(self._path(f"manifest-{old:08d}.json"), False)

    def _write(self, chunks: DataFrame) -> dict[str, list[str]]:
        """Write chunks, which have the column ``b``, by bucket; returns the folder of each bucket that has any."""
        folder = f"data-{uuid.uuid4().hex}"
        chunks.select(*COLUMNS, *ORDER, "b").repartition("b").write.partitionBy("b").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(folder))]
        return {n[2:]: [folder] for n in names if n.startswith("b=")}

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64("document_url"), F.lit(manifest["buckets"])).cast("int").alias("b")

    # --- reading ---

    def create(self) -> None:
        """Make an empty store where there is none; does nothing otherwise."""
        if self._manifest() is None:
            self.clear()

    def clear(self) -> None:
        self._commit({"buckets": (self._manifest() or {"buckets": self.new_buckets})["buckets"], "folders": {}})

    def read(self) -> DataFrame:
        """All stored chunks; only the columns that are used are read."""
        return self._stored().select(*COLUMNS)

    def _stored(self, buckets: set[str] | None = None) -> DataFrame:
        """The chunks of some buckets, or of all, with the columns ``ORDER``; null in files written without them."""
        folders = {b: f for b, f in (self._manifest() or {"folders": {}})["folders"].items() if buckets is None or b in buckets}
        load = lambda paths: self.spark.read.schema(STORED).parquet(*paths)
        whole = [f"{self.path}/{f[0]}/b={b}" for b, f in folders.items() if len(f) == 1]
        beside = [f"{self.path}/{folder}/b={b}" for b, f in folders.items() if len(f) > 1 for folder in f]
        parts = [load(whole)] if whole else []
        if beside:
            parts.append(last_writes(load(beside), order=(*ORDER, "text")))
        if not parts:
            return self.spark.createDataFrame([], STORED)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def count(self) -> int:
        return self.read().count()

    # --- writing ---

    def _new(self, records: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, dict, set[str]]:
        """The last write of each key in ``records``, written out, with the manifest and the buckets touched."""
        self.create()
        manifest = self._manifest()
        new = materialize(_last_of(records, order).withColumn("b", self._bucket(manifest)), "store-writes")
        return new, manifest, {str(r["b"]) for r in new.select("b").distinct().collect()}  # a row a bucket

    def insert(self, records: DataFrame, replace_documents: bool = False, order: tuple[str, ...] = ()) -> None:
        """Upsert chunk records by key; a table without rows touches nothing. Only the buckets of their documents are written.

        Of a key written twice in ``records`` the last row by the columns ``order`` is kept, or, without
        ``order``, the last in the order that the rows are in. Chunks of a document beyond its new end stay
        unless ``replace_documents``. Stored rows are replaced whenever they were written; the new ones
        have no place in a log, so any write of a log replaces them.
        """
        new, manifest, touched = self._new(records, order)
        if touched:
            existing = self._stored(touched)
            kept = without_stale(existing, new) if replace_documents else existing
            written = self._write(upsert(kept.withColumn("b", self._bucket(manifest)), new))
            self._commit({**manifest, "folders": {b: f for b, f in manifest["folders"].items() if b not in touched} | written})
        release(new)

    def insert_log(self, records: DataFrame) -> None:
        """Upsert records of a log, which have the columns ``chunk_id`` and ``ORDER`` too: a write replaces only a stored row that isn't later.

        So the store is the same however the log is divided into inserts. Nulls in ``ORDER`` come first; of
        writes that agree in it the one with the greatest text is kept. Records without a ``chunk_id`` are
        left out; a table without others touches nothing. Nothing stored is rewritten but buckets that have
        gathered more than ``MAX_FOLDERS`` writes.
        """
        self.create()
        manifest = self._manifest()
        rows = last_writes(_columns(records.filter("chunk_id IS NOT NULL"), in_order=True), order=(*ORDER, "text"))
        written = self._write(rows.withColumn("b", self._bucket(manifest)))
        if not written:
            return
        folders = {b: manifest["folders"].get(b, []) + written.get(b, []) for b in {*manifest["folders"], *written}}
        self._commit({**manifest, "folders": folders})
        full = {b for b, f in folders.items() if len(f) > MAX_FOLDERS}
        if full:
            merged = self._write(self._stored(full).withColumn("b", self._bucket(manifest)))
            self._commit({**manifest, "folders": {b: f for b, f in folders.items() if b not in full} | merged})

    def replace(self, records: DataFrame, order: tuple[str, ...] = ()) -> None:
        """Make ``records`` the whole store; keys written twice as ``insert`` has it."""
        new, manifest, _ = self._new(records, order)
        self._commit({**manifest, "folders": self._write(new)})
        release(new)


def _last_of(records: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The stored columns of the last row of each key, by ``order`` or by the rows' own order."""
    by = order or ("__row",)
    rows = records if order else records.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.withColumn("chunk_id", chunk_id(F.col("document_url"), F.col("chunk_index")))
    return _columns(last_writes(rows, order=by), in_order=False)


def _columns(records: DataFrame, in_order: bool) -> DataFrame:
    """The stored columns of ``records``; those of ``ORDER`` null unless ``in_order``."""
    order = [(F.col(name) if in_order else F.lit(None)).cast(kind).alias(name) for name, kind in ORDER.items()]
    return records.withColumn("chunk_id", chunk_id(F.col("document_url"), F.col("chunk_index"))).select(*COLUMNS, *order)
