import random

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import reading

EASY = "the cat sat on the mat and it was in the sun".split()
RARE = [f"{a}{b}ology" for a in ("bio", "geo", "eco", "cyto", "hydro") for b in ("morph", "therm", "graph", "strat", "syn", "chron")]


def document(rng, level):
    sentences = []
    for _ in range(12):
        words = [rng.choice(RARE) if rng.random() < 0.12 * (level - 1) else rng.choice(EASY) for _ in range(4 + 5 * level)]
        sentences.append(" ".join(words).capitalize() + ".")
    return " ".join(sentences)


def corpus(n=240):
    rng = random.Random(9)
    return [(i, document(rng, 1 + i % 4), 1 + i % 4) for i in range(n)]


def test_held_out_levels(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", level) for i, _, level in rows if i % 5 < 2] + [(0, "s", None), (None, "s", 4), (99999, "s", 1)], "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, labels).collect()}
    held = [(got[i], level) for i, _, level in rows if i % 5 >= 2]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_profile(spark, hard):
    got = {r["doc_id"]: r for r in reading.profile(hard, keep=["doc_id"]).collect()}
    assert got[0]["n_words"] is None and got[0]["words"] is None and got[1]["n_words"] == 0 and got[1]["words"] == []
    assert got[6]["n_words"] == 30_000 and got[6]["words"] == ["word"] and got[6]["counts"] == [30_000]
    df = spark.createDataFrame([(1, "One two. Thrее twо!\n\nFour's up")], "doc_id long, text string")
    row = reading.profile(df, keep=["doc_id"]).first()
    assert (row["n_words"], row["n_sentences"]) == (6, 3) and dict(zip(row["words"], row["counts"])) == {"one": 1, "two": 2, "three": 1, "four's": 1, "up": 1}


def test_languages(spark):
    rows = [(1, "The heron is in the reeds and it was not seen by us."), (2, "El pájaro anida cerca del río y vuelve en otoño con sus crías."), (3, "Die Reiher sind in dem Schilf und werden nicht gesehen."), (4, "庭の鳥は池のそばで休む。"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, reading_level int")
    got = {r["doc_id"]: (r["english"], r["reading_level"]) for r in reading.reading_levels(docs, labels).collect()}
    assert [got[i][0] for i in range(1, 6)] == [True, False, False, False, False] and got[1][1] == 1 and got[5][1] is None


def test_notices_of_another_language(spark):
    english = "Enjoyed this? Pass it on to your friends today, for we have more of it at our site, and it is not to be had from any other. "
    notice = "The content of this page is for you and not for sale, as it was with all that we had on our site. "
    german = "Die Reiher sind in dem Schilf und werden nicht gesehen, denn der Nebel liegt auf dem Wasser und von den Booten ist auch nichts zu hören. "
    spanish = "El pájaro anida cerca del río y vuelve en otoño con sus crías, pero los cazadores de la zona no lo ven por su color y por el silencio. "
    rows = [(1, (english + notice) + german * 4), (2, spanish * 4 + english + notice), (3, (english + notice) * 3 + german), (4, "the und"), (5, "the de la und")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["english"] for r in reading.reading_levels(docs, spark.createDataFrame([], "doc_id long, reading_level int")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False}  # ties are not English


def test_labels_of_a_repeated_key_stay_bounded(spark):
    rows = corpus(40)
    docs = spark.createDataFrame([(0, t) for _, t, _ in rows] + [(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, level) for i, _, level in rows], "doc_id long, reading_level int")
    featured = reading.features(reading.profile(docs.withColumn("__row", F.monotonically_increasing_id()), keep=["doc_id", "__row"]), ["doc_id"])
    assert reading.fit_labels(featured, labels, max_labels=20).weights.shape == (3, 6)


def test_hard_rows(spark, hard):
    labels = spark.createDataFrame([(5, 1), (6, 2)], "doc_id long, reading_level int")
    assert reading.reading_levels(hard, labels).count() == hard.count()
    assert reading.reading_levels(hard.limit(0), labels).count() == 0


def test_ties_at_the_list_threshold(spark):
    docs = spark.createDataFrame([(i, "common" if i < 4 else "other words") for i in range(10)], "doc_id long, text string")
    bands = {r["word"]: r["band"] for r in reading.familiar_words(reading.profile(docs, keep=["doc_id"])).collect()}
    assert bands == {"common": 0, "other": 0, "words": 0}  # two fifths are enough
