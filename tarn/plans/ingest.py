"""Bringing documents into the chunk store, all of them or only new ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.config import DEFAULTS, Config
from tarn.operators.chunking import chunk_documents
from tarn.operators.embedding import Model, embed, hashing_model
from tarn.sources.store import ChunkStore
from tarn.storage import materialize, release


def new_documents(documents: DataFrame, stored: DataFrame, url: str = "url", stored_url: str = "document_url") -> DataFrame:
    """Documents whose url has no stored chunk, exactly as it is written; one without chunks stays new, one with changed text doesn't become new."""
    return documents.join(stored.select(F.col(stored_url).alias(url)).distinct(), url, "left_anti")


def chunk_records(documents: DataFrame, config: Config = DEFAULTS, load: Callable[[], Model] = hashing_model, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of documents with their vectors and the columns ``carry``: one narrow stage. Documents without words never reach the model."""
    return embed(chunk_documents(documents, config.chunk_size_words, config.chunk_overlap_words, carry=carry), load=load)


def ingest(
    store: ChunkStore, documents: DataFrame, full_rebuild: bool = True, config: Config = DEFAULTS, load: Callable[[], Model] = hashing_model,
    order: str | None = None, out: Callable[[str], None] | None = None,
) -> dict[str, int]:
    """Chunk, embed and store ``documents``; what was there is replaced, or, without ``full_rebuild``, kept and overwritten by key.

    A url that comes twice is written twice, the last row by the column ``order`` (or in the table's own
    order) last. Returns how many documents were fetched (those without chunks included) and how many
    chunks written; ``out`` gets lines that tell of it, one a document.
    """
    rows = documents.withColumn("__seq", F.col(order) if order else F.monotonically_increasing_id())
    records = materialize(chunk_records(rows, config, load, carry=("__seq",)), "chunk-records")
    counts = {"documents": documents.count(), "chunks": records.count()}
    for line in progress(rows, records, counts) if out else ():
        out(line)
    (store.replace if full_rebuild else store.insert)(records, order=("__seq",))
    release(records)
    return counts


def progress(documents: DataFrame, records: DataFrame, counts: dict[str, int]) -> Iterator[str]:
    """Lines of a run of ``ingest``, read from the cluster a partition at a time."""
    yield f"{counts['documents']:,} documents to chunk"
    sizes = records.groupBy("__seq").agg(F.count("*").alias("chunks"))
    for row in documents.select("__seq", "title", "url").join(sizes, "__seq", "left").orderBy("__seq").toLocalIterator():
        yield f"  {row['title'] or row['url']}: {row['chunks'] or 0} chunks"
    yield f"{counts['chunks']:,} chunks of {counts['documents']:,} documents written"


def ingest_new(
    store: ChunkStore, documents: DataFrame, config: Config = DEFAULTS, load: Callable[[], Model] = hashing_model, order: str | None = None, out: Callable[[str], None] | None = None
) -> dict[str, int]:
    """Ingest only the documents that the store doesn't have yet."""
    store.create()
    new = materialize(new_documents(documents, store.read()), "new-documents")
    counts = ingest(store, new, False, config, load, order, out)
    release(new)
    return counts
