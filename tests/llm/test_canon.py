import time
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm import canon
from tarn.llm.duck import connect

DB = connect()


def forms(batch, texts, expression="x"):
    return canon.apply_sql(DB, batch(texts), "text", expression)[0].to_pylist()


def test_forms(batch):
    cases = [
        ("ｄｏｕｂｌｅ－ｄｕｇ　ｔｒｅｎｃｈ", "double-dug trench"), ("rеflесtіvе ѕnаrе", "reflective snare"), ("gl⁠as­s​﻿", "glass"),
        ("café ¼ ﬁsh … №", "café 1/4 fish ... No"), ("а́", "á"), ("“x” ‑ don’t", '"x" - don\'t'),
        ("a b c　d\te\r\nf\rg", "a b c d e\nf g"), ("㎏ ﾊﾟ \U0001d49c", "kg パ A"), ("Höhe Höhe", "Höhe Höhe"), ("plain", "plain"), (None, None), ("", ""),
    ]
    assert forms(batch, [c[0] for c in cases]) == [c[1] for c in cases]
    assert forms(batch, ["  A \n b "], canon.MATCH_FORM) == ["a b"]
    assert forms(batch, ["naïve", "naive"], canon.MATCH_FORM) == ["naïve", "naive"]  # accents are seen


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), max_size=5))
def test_forms_are_stable_and_composed(texts):
    import pyarrow as pa

    once = canon.apply_sql(DB, pa.record_batch({"text": pa.array(texts, pa.string())}), "text", "x")[0].to_pylist() if texts else []
    again = canon.apply_sql(DB, pa.record_batch({"text": pa.array(once, pa.string())}), "text", "x")[0].to_pylist() if texts else []
    assert again == once
    for text in once:
        assert text == unicodedata.normalize("NFC", text)


def test_words_of_other_scripts_stay(batch):
    russian, greek = "Москва стоит на реке, а она и её оса тоже", "Το σπίτι είναι νέο και ωραίο"
    mixed = "Мосkва"  # the k is Latin
    assert forms(batch, [russian, greek, f"{russian} {mixed}", "а саt аnd μ", "α υ χ"]) == [russian, greek, f"{russian} Mockвa", "a cat and μ", "α υ χ"]
    assert forms(batch, ["Моѕѕ Сору"], canon.MATCH_FORM) == ["moss copy"]  # all of a word's letters


def test_long_texts_of_seldom_characters_take_linear_time(batch):
    seldom = [c for c in canon.tables()[2] if c not in canon.OFTEN]
    times = []
    for size in (200_000, 2_000_000):
        text = "".join(seldom[i % len(seldom)] if i % 3 else "a" for i in range(size))
        began = time.perf_counter()
        assert len(forms(batch, [text])[0]) > size
        times.append(time.perf_counter() - began)
    assert times[1] < 30 * max(times[0], 0.2)


def test_table_keeps_rows_and_columns(spark, hard):
    got = canon.canonicalize(hard)
    assert got.columns == [c for c in hard.columns if c != "canonical"] + ["canonical"] and got.count() == hard.count()
    row = {r["doc_id"]: r["canonical"] for r in got.collect()}
    assert row[0] is None and row[1] == "" and len(row[7]) == 200_000 and row[10] == "don't - \"stop\" 1/2 fi"
    assert canon.canonicalize(hard.limit(0)).count() == 0


def test_phrases(spark, hard):
    docs = spark.createDataFrame(
        [(1, "The ＣＯＲＶÉ　bog\norchid."), (2, "corvе́ bog orchid"), (3, "corve bog orchid"), (4, None), (5, "¼ cup"), (1, "Corvé bog orchid")], "doc_id long, text string"
    )
    phrases = spark.createDataFrame([(7, 0, "Corvé bog orchid"), (7, 1, "1/4 CUP"), (8, 0, None), (8, 1, "​"), (9, 0, "corvé bog orchid")], "question_id long, phrase_no long, phrase string")
    got = sorted(tuple(r) for r in canon.find_phrases(phrases, docs).collect())
    assert got == sorted([(7, 0, 1), (7, 0, 1), (7, 0, 2), (9, 0, 1), (9, 0, 1), (9, 0, 2), (7, 1, 5)])
    assert canon.find_phrases(phrases.limit(0), docs).count() == 0 and canon.find_phrases(phrases, docs.limit(0)).count() == 0
    assert canon.find_phrases(phrases, hard).columns == ["question_id", "phrase_no", "doc_id"]
    for name, few in (("PHRASE_BLOCK", 2), ("PHRASE_BLOCK", 1), ("PHRASE_BYTES", 10)):  # several blocks give the same rows
        whole = getattr(canon, name)
        setattr(canon, name, few)
        try:
            assert sorted(tuple(r) for r in canon.find_phrases(phrases, docs).collect()) == got
        finally:
            setattr(canon, name, whole)
