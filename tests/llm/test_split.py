import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import split


def check(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    words, again = text.split(), []
    for i, (piece, start, n) in enumerate(pieces):
        own = piece.split()
        assert len(own) == n <= limit and own == words[start : start + n] and piece in text
        assert i == 0 or start == pieces[i - 1][1] + pieces[i - 1][2] - overlap
        again += own[overlap if i else 0 :]
    assert again == words
    return pieces


def test_round_trips():
    rng = random.Random(2)
    parts = ["a", "b.", "# h", "\n", "\n\n", "\r\n", "\x1c", "　", "long", '"x."', "\t"]
    for _ in range(300):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        for limit, overlap in ((10, 2), (7, 0), (5, 4), (200, 40)):
            check(text, limit, overlap)


def test_balance_and_boundaries():
    text = " ".join(f"w{i}" for i in range(21))
    assert [p[2] for p in check(text, 10, 0)] == [7, 7, 7]  # not 10, 10, 1
    lines = " ".join(f"a{i}" for i in range(9)) + "\n\n# head\n" + " ".join(f"b{i}" for i in range(9))
    assert [p[2] for p in check(lines, 12, 0)] == [9, 11]
    sentences = "one two three. four five six seven eight nine ten eleven"
    assert check(sentences, 8, 0)[0][0] == "one two three."
    assert len(check(" ".join(f"w{i}" for i in range(500)), 200, 40)) == 3


@pytest.mark.parametrize("words", [1000, 5000, 20_000, 100_000])
def test_pieces_over_the_minimum(words):
    rng = random.Random(words)
    out = []
    while len(out) < words:
        sentence = [f"w{rng.randrange(999)}" for _ in range(rng.randint(5, 25))]
        sentence[-1] += "."
        out += sentence
        out[-1] += rng.choice([""] * 6 + ["\n\n", "\n\n# "])
    text = " ".join(out)
    pieces = check(text, 200, 40)
    least = -(-(len(text.split()) - 40) // 160)
    assert len(pieces) <= 1 + 1.15 * least
    ends = sum(piece.rstrip(" #\n").endswith(".") for piece, _, _ in pieces)
    assert ends == len(pieces)  # all cuts at a boundary


def test_without_boundaries_the_fewest_pieces():
    for n in (201, 360, 361, 10_000):
        assert len(check(" ".join(["w"] * n), 200, 40)) == -(-(n - 40) // 160)


def test_bounds(spark):
    for limit, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            split.split_items(spark.range(1).withColumn("text", F.lit("")), ["id"], limit=limit, overlap=overlap)
    with pytest.raises(ValueError):
        split.split_items(spark.createDataFrame([(1, "a")], "n_pieces int, text string"), ["n_pieces"])


def test_units(spark):
    text = "\n \none\ntwo\n\t\n# three\n\n\n  \nfour  \n"
    df = spark.createDataFrame([(text,), (None,), (" \n",)], "t string")
    assert [r[0] for r in df.select(F.transform(split.paragraphs(F.col("t")), F.trim)).collect()] == [["one\ntwo", "# three", "four  \n".strip(" ")], None, []]
    assert [r[0] for r in df.select(split.word_count(F.col("t"))).collect()] == [5, None, 0]


def test_items(spark, hard):
    got = split.split_items(hard, ["doc_id"]).orderBy("doc_id", "chunk_index").collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {i for i, r in enumerate(hard.orderBy("doc_id").collect()) if r["text"] and r["text"].split()}
    assert [r["chunk_index"] for r in pieces[6]] == list(range(188)) and all(r["n_words"] <= 200 for r in got)  # ceil((30000 - 40) / 160)
    assert pieces[7][0]["n_words"] == 1 and len(pieces[7][0]["piece"]) == 200_000 and pieces[5][0]["piece"] == "a"
    assert split.split_items(hard.limit(0), ["doc_id"]).count() == 0


def test_oversized(spark):
    over, within = "x " * 201, "x " * 200
    docs = spark.createDataFrame([(1, f"\n{within}\n\n{over}\n#h\n\n{over}"), (2, None), (3, within)], "doc_id long, text string")
    chunks = spark.createDataFrame([(8, over), (9, within), (10, None)], "chunk_no long, text string")
    assert sorted(tuple(r) for r in split.oversized_units(docs, chunks).collect()) == [("chunk", 8, 0), ("document", 1, 1), ("document", 1, 2)]
