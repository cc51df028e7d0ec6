import pyarrow as pa
import pytest

#: Texts that every operator has to survive.
HARD = [None, "", " ", "\n\n", "​", "a", "word " * 30_000, "x" * 200_000, "日本語のテキスト。" * 50, "\x00\x01", "don't — “stop” ½ ﬁ", "same text", "same text"]


@pytest.fixture
def hard(spark):
    """Documents with hard texts, nulls in every column, and columns named like those of results."""
    rows = [(i, t, None if i % 3 else f"https://www.S.example/{i}", None if i % 2 else "S.example", None if i % 4 else "Title", i, "k", "c") for i, t in enumerate(HARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, url string, source string, title string, n long, kind string, canonical string")


@pytest.fixture
def batch():
    return lambda texts: pa.record_batch({"text": pa.array(texts, pa.string())})
