import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tarn.functions.text import words
from tarn.operators import chunking


def chunks(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    packed = chunking.chunk_counts(chunking.pack(df, "text", "c", size, overlap), "text", "n", size, overlap).orderBy("i").collect()
    assert [r["n"] for r in packed] == [len(r["c"]) for r in packed]
    return [r["c"] for r in packed]


def w(n, prefix="word"):
    return " ".join(f"{prefix}{i}" for i in range(n))


def span(a, b, prefix="word"):
    return " ".join(f"{prefix}{i}" for i in range(a, b))


CASES = [
    ("", 10, 2, []),
    ("   \n\t  ", 10, 2, []),
    (None, 10, 2, []),
    (w(5), 10, 2, [w(5)]),
    (w(10), 10, 2, [w(10)]),
    (w(25), 10, 2, [span(0, 10), span(8, 18), span(16, 25)]),
    (w(22), 10, 2, [span(0, 10), span(8, 18), span(16, 22)]),
    (w(20), 10, 0, [span(0, 10), span(10, 20)]),
    (w(8, "a") + "\n\n" + w(8, "b"), 10, 2, [w(8, "a"), "a6 a7 " + w(8, "b")]),
    (w(9, "a") + "\n\n" + w(9, "b"), 15, 3, [w(9, "a"), "a6 a7 a8 " + w(9, "b")]),
    (w(9, "a") + "\n\n" + w(9, "b"), 10, 3, [w(9, "a"), w(9, "b")]),
    ("first paragraph\n\n   \n\nsecond paragraph", 200, 10, ["first paragraph second paragraph"]),
    ("##\nfoo\n\nbar", 200, 10, ["## foo bar"]),
    (w(25) + "\n\n" + w(3, "b"), 10, 2, [span(0, 10), span(8, 18), span(16, 25), w(3, "b")]),
    ("p one\n\np two\n# h x", 5, 1, ["p one p two", "two # h x"]),
    ("# a b\nc\n\nd\n# e f", 5, 0, ["# a b c d", "# e f"]),
]


def test_vectors(spark):
    for size, overlap in sorted({c[1:3] for c in CASES}):
        some = [c for c in CASES if c[1:3] == (size, overlap)]
        assert chunks(spark, [c[0] for c in some], size, overlap) == [c[3] for c in some]


def test_bounds(spark):
    df = spark.createDataFrame([("x",)], "text string")
    for size, overlap in ((10, 10), (10, 15), (10, -1), (0, 0)):
        with pytest.raises(ValueError):
            chunking.pack(df, "text", "c", size, overlap)


def test_very_many_units_take_linear_time():
    times = []
    for n in (100_000, 1_000_000):
        began = time.perf_counter()
        assert len(chunking.stretches([37] * n, 200, 40)) > n // 5
        times.append(time.perf_counter() - began)
    assert times[1] < 30 * max(times[0], 0.02)


def plain(text, size, overlap):
    """The rules, spelled out."""
    if re.search(r"^#{1,6}\s", text, re.M):
        parts, held = [], []
        for line in text.split("\n"):
            if re.match(r"#{1,6}\s", line) and held:
                parts.append(held)
                held = []
            held.append(line)
        parts = ["\n".join(p) for p in [*parts, held]]
    else:
        parts = re.split(r"\n\s*\n+", text)
    out, held = [], []
    for part in parts:
        tokens = part.split()
        if not tokens:
            continue
        if held and len(held) + len(tokens) > size:
            out.append(held)
            tail = held[len(held) - min(overlap, len(held)) :]
            held = tail if len(tail) + len(tokens) <= size else []
        if len(tokens) > size:
            start = 0
            while True:
                out.append(tokens[start : start + size])
                if start + size >= len(tokens):
                    break
                start += size - overlap
            held = []
        else:
            held = held + tokens
    return [" ".join(c) for c in [*out, held] if c]


def test_against_plain_rules(spark):
    rng = random.Random(5)
    pieces = ["a", "bb", "# h", "## x y", "##", "#######  z", "\n", "\n\n", "\n \t\n", "\r\n", "\x1c", "\xa0", "　", "\x0b", "word", "c d e f g", "\r# no"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for size, overlap in ((5, 2), (8, 0), (3, 1), (200, 40)):
        got = chunks(spark, texts, size, overlap)
        for text, have in zip(texts, got):
            assert have == plain(text, size, overlap), (text, size, overlap)


def test_chunk_rows_and_words(spark):
    df = spark.createDataFrame([("u", "t", w(25), 7), ("v", None, " ", 8), ("x", "t", None, 9)], "url string, title string, text string, n int")
    rows = chunking.chunk_documents(df, 10, 2, carry=("n",)).orderBy("chunk_index").collect()
    assert [(r["chunk_id"], r["n"]) for r in rows] == [("u::0", 7), ("u::1", 7), ("u::2", 7)]
    assert df.select(words(F.lit("a\x1cb  c\n"))).first()[0] == ["a", "b", "c"]
    assert chunking.chunk_documents(df.limit(0)).count() == 0


def test_one_narrow_stage(spark):
    df = spark.createDataFrame([("u", "t", "a b")], "url string, title string, text string")
    plan = chunking.chunk_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan  # of a text only the sizes of its units go to Python
