"""Ask a corpus from the shell: ``python -m tarn.cli STORE [question ...]``; without a question they are read line by line."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.config import Config
from tarn.operators import answering, retrieval
from tarn.operators.embedding import embed, hashing_model
from tarn.shipping import ship
from tarn.sources.store import ChunkStore

ENDINGS = frozenset({"exit", "quit"})


def answers(spark: SparkSession, corpus: DataFrame, questions: list[str], config: Config, client: Callable) -> DataFrame:
    """The answers to some questions, in one job; ``question_id`` is a question's place."""
    asked = spark.createDataFrame(list(enumerate(questions)), "question_id long, question string")
    asked = embed(asked, "question", load=lambda: hashing_model(config.embedding_dim))
    return answering.ask(retrieval.retrieve(corpus, asked, config, dim=config.embedding_dim), asked, client).orderBy("question_id")


def rendered(df: DataFrame) -> DataFrame:
    """``(question_id, text)``: each answer as it is shown, numbered documents below it."""
    cited = F.transform("citations", lambda c, i: F.concat(F.lit("\n"), F.lpad((i + 1).cast("string"), 3, " "), F.lit(". "), F.coalesce(c["title"], c["url"]), F.lit(" <"), c["url"], F.lit(">")))
    return df.select("question_id", F.concat(F.col("answer"), F.array_join(cited, "")).alias("text"))


def typed(lines: Iterable[str]) -> Iterator[str]:
    """The questions among some lines, up to one that ends the session; blank ones are none."""
    for line in map(str.strip, lines):
        if line.casefold() in ENDINGS:
            return
        if line:
            yield line


def prompted(read: Callable[[str], str] = input) -> Iterator[str]:
    """Lines as they are typed, until there are no more or the user breaks off."""
    try:
        while True:
            yield read("tarn> ")
    except (EOFError, KeyboardInterrupt):
        return


def main(argv: list[str] | None = None, out: Callable[[str], None] = print) -> None:
    parser = argparse.ArgumentParser(prog="tarn", description=__doc__)
    parser.add_argument("store", help="folder of a chunk store")
    parser.add_argument("question", nargs="*", help="one question; none for a session")
    given = parser.parse_args(sys.argv[1:] if argv is None else argv)
    spark, config = SparkSession.builder.appName("tarn").getOrCreate(), Config.from_env()
    ship(spark)
    corpus = retrieval.corpus_table(ChunkStore(spark, given.store).read().withColumn("chunk_no", F.monotonically_increasing_id()))
    client = (lambda: answering.http_client(config)) if config.llm_key else answering.first_excerpt_client
    for question in [" ".join(given.question)] if given.question else typed(prompted()):
        out(rendered(answers(spark, corpus, [question], config, client)).first()["text"])


if __name__ == "__main__":
    main()
