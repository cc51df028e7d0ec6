"""A paginated documents endpoint as a Spark data source.

``GET {url}/documents?limit=n&offset=k`` answers ``{"items": [...]}``; the first page with fewer than n
items is the last. By default one task follows the pages; with ``total`` pages are read in parallel.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FIELDS = ("url", "title", "text", "source")


def over_http(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as response:  # raises for every status but 2xx
        return response.read()


def pages(base: str, size: int, timeout: float, fetch: Callable[[str, float], bytes] = over_http, start: int = 0, stop: int | None = None) -> Iterator[dict]:
    """The items from offset ``start`` on; up to ``stop`` or the first page that isn't full."""
    offset = start
    while stop is None or offset < stop:
        items = json.loads(fetch(f"{base.rstrip('/')}/documents?limit={size}&offset={offset}", timeout))["items"]
        yield from items
        if len(items) < size:
            return
        offset += size


class _Range(InputPartition):
    def __init__(self, start: int, stop: int | None):
        super().__init__(start)
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.size = options["url"], int(options.get("pagesize", 100))
        self.timeout = float(options.get("timeout", 30))
        self.total, self.per_task = options.get("total"), int(options.get("pagespertask", 10))

    def partitions(self) -> list[InputPartition]:
        if self.total is None:
            return [_Range(0, None)]
        step = self.size * self.per_task
        return [_Range(start, min(start + step, -(-int(self.total) // self.size) * self.size)) for start in range(0, max(int(self.total), 1), step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for item in pages(self.base, self.size, self.timeout, over_http, partition.start, partition.stop):
            yield tuple(item.get(name) for name in FIELDS)


class DocumentsSource(DataSource):
    """Format ``documents_api``; options ``url``, ``pageSize``, ``timeout``, ``total``, ``pagesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "documents_api"

    def schema(self) -> str:
        return "url string, title string, text string, source string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_documents(spark: SparkSession, url: str, page_size: int = 100, timeout: float = 30.0, total: int | None = None) -> DataFrame:
    spark.dataSource.register(DocumentsSource)
    reader = spark.read.format("documents_api").option("url", url).option("pageSize", page_size).option("timeout", timeout)
    return (reader if total is None else reader.option("total", total)).load()
