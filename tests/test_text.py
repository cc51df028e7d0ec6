from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.functions.vector import cosine


def values(spark, expression, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_tokens(spark):
    assert values(spark, fn.keyword_tokens(F.col("x")), [("Paddle-Shaped Tail! 2024",), ("é",)], "x string") == [["paddle", "shaped", "tail", "2024"], []]


def test_normalized_punctuation(spark):
    cases = [("paddle‑shaped – —", "paddle-shaped - -"), ("‘a’ “B”", "'a' \"b\""), ("¼ cup of sugar", "1/4 cup of sugar"), ("½ and ¾", "1/2 and 3/4"), ("4 to 6", "4 to 6")]
    assert values(spark, fn.normalize_punctuation(F.col("x")), [(c[0],) for c in cases], "x string") == [c[1] for c in cases]


def test_refusals(spark):
    cases = [("I don't know", True), ("i don't know..", True), (" I DO NOT KNOW.\n", True), ("I don’t know.", False), ("I don't know that", False), (None, False), ("", False)]
    assert values(spark, fn.is_refusal(F.col("x")), [(c[0],) for c in cases], "x string") == [c[1] for c in cases]


def test_grading(spark):
    rows = [("unanswerable", "I don't know.", []), ("unanswerable", "42", []), ("single", "In 1939, remote  cameras", ["1939", "Remote  cameras"]), ("single", "1939", ["1939", "x"]), ("vague", None, []), ("vague", "a", None)]
    assert values(spark, fn.answer_is_correct(F.col("t"), F.col("a"), F.col("p")), rows, "t string, a string, p array<string>") == [True, False, True, False, True, True]


def test_citations(spark):
    cases = [
        ("X [1] and Y [2].", 2, [1, 2]), ("See [1] and [99].", 2, [1]), ("paddle-shaped【2】.", 3, [2]), ("【1†L1-L4】", 2, [1]), ("First [1], then 【2】.", 2, [1, 2]),
        ("none", 3, [1, 2, 3]), ("[99]", 2, [1, 2]), ("[99999999999] [ 2 ]", 2, [2]), ("[2][1][2]", 2, [1, 2]), ("[1】", 1, [1]), ("x", 0, []), (None, 1, [1]),
    ]
    assert values(spark, fn.cited_indices(F.col("a"), F.col("n")), [c[:2] for c in cases], "a string, n int") == [c[2] for c in cases]


def test_urls_previews_numbers(spark):
    assert values(spark, fn.netloc(F.col("x")), [("https://u@h.example:80/p?q",), ("//h/x",), ("nothing",), (None,)], "x string") == ["u@h.example:80", "h", "", None]
    assert values(spark, fn.preview(F.col("x"), 3), [("abc",), ("abcd",)], "x string") == ["abc", "abc..."]
    assert values(spark, fn.percent(F.col("a"), F.col("b")), [(1, 3), (1, 8), (3, 8), (1, 0)], "a int, b int") == ["(33%)", "(12%)", "(38%)", "(n/a)"]
    assert abs(values(spark, fn.cost_usd(F.col("a"), F.col("b")), [(1_000_000, 1_000_000)], "a long, b long")[0] - 0.75) < 1e-12
    assert values(spark, fn.chunk_id(F.col("u"), F.col("i2")), [("https://x/a", 1)], "u string, i2 int") == ["https://x/a::1"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0]), ([1.0, 1.0], [1.0, 0.0])]
    got = values(spark, cosine(F.col("a"), F.col("b")), rows, "a array<double>, b array<double>")
    assert [round(x, 6) for x in got] == [1.0, 0.0, 0.6, 0.707107]
