"""Question sets from JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id int, question string, expect_article_ids array<string>, must_contain array<string>, type string"


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a JSON file (one array of objects), in a fixed schema."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
