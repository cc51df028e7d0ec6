import collections
import re
import unicodedata

from pyspark.sql import functions as F

from tarn.llm import lines


def docs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, url string, source string, text string")


def test_sites(spark):
    rows = [("https://www.A.example/x", None), ("HTTP://u@b.example:80", "C.example"), (None, "WWW.c.example"), ("nothing", " D.example"), (None, None)]
    df = spark.createDataFrame(rows, "u string, s string")
    assert [r[0] for r in df.select(lines.site(F.col("s"), F.col("u"))).collect()] == ["a.example", "b.example", "c.example", "d.example", None]


def test_lines_that_differ_only_in_small_things(spark):
    same = [
        "Updated 3 May 2020 by Ann", "UPDATED May 3, 2021 by ann!", "** updated 2020-05-03 by Ann **", "Upda​ted  03/05/2020 by Аnn", "Updated Monday, 3rd of March 2020 by Ann", "updated by Ann",
    ]
    other = ["Updated in May by Ann", "Updated by Anne"]
    df = docs(spark, [("https://a.example", None, t) for t in same + other])
    keys = [r["line_keys"][0] for r in lines.line_keys(df).orderBy("doc_id").collect()]
    assert len(set(keys[: len(same)])) == 1 and len(set(keys)) == 3


def test_thresholds(spark):
    notice = "All rights reserved"
    rows = [("https://a.example", None, f"own {chr(97 + i)}\n\n{notice if i < 5 else ''}\n{notice if i < 1 else ''}") for i in range(26)]
    rows += [("https://b.example", None, notice)] * 4  # too few
    rows += [("https://c.example", None, "share me" if i < 5 else None) for i in range(51)]  # under a tenth
    rows += [("https://www.D.example", None, "share me" if i < 5 else None) for i in range(50)]  # a tenth
    got = sorted(tuple(r) for r in lines.find_repeated_lines(docs(spark, rows)).collect())
    assert got == sorted([(i, 2) for i in range(5)] + [(0, 3)] + [(26 + 4 + 51 + i, 0) for i in range(5)])


def test_removal(spark):
    rows = [("https://a.example", None, f"N O T I C E\nkeep {chr(97 + i)}\n\nnotice {i}") for i in range(6)] + [("https://a.example", None, None), ("https://a.example", None, "notice"), (None, None, "notice")]
    df = docs(spark, rows).withColumn("clean_text", F.lit("old"))
    got = {r["doc_id"]: r["clean_text"] for r in lines.remove_repeated_lines(df).collect()}
    assert got == {**{i: f"keep {chr(97 + i)}\n" for i in range(6)}, 6: None, 7: "", 8: "notice"}


def test_hard_rows(spark, hard):
    df = hard.unionByName(hard).unionByName(hard)  # repeated rows are documents of their own
    assert lines.remove_repeated_lines(df).count() == 3 * hard.count()
    lines.find_repeated_lines(df).collect()
    assert lines.find_repeated_lines(hard.limit(0)).count() == 0 and lines.remove_repeated_lines(hard.limit(0)).count() == 0


def test_against_brute_force(spark, testdata):
    table = spark.read.parquet(f"{testdata}/documents.parquet")
    months = "january february march april may june july august september october november december".split()
    month = "|".join(m if len(m) < 5 else f"{m[:3]}(?:{m[3:]})?" for m in months) + "|sept"
    look = str.maketrans({**lines_look()})

    def key(line):
        text = unicodedata.normalize("NFKC", line.translate(look)).lower()
        text = "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) not in ("Cf", "Cc"))
        text = re.sub(rf"\b\d{{1,2}} (?:{month}) \d{{4}}|(?:{month}) \d{{1,2}}, \d{{4}}", "", re.sub(r"\s+", " ", text))
        return "".join(c for c in text if c.isalpha())

    count, size, found = collections.Counter(), collections.Counter(), []
    rows = table.select("doc_id", "url", "text").collect()
    for r in rows:
        host = re.sub(r"^www\.", "", r["url"].split("/")[2].lower())
        size[host] += 1
        keyed = [(n, key(line)) for n, line in enumerate((r["text"] or "").split("\n")) if line.strip()]
        count.update({(host, k) for _, k in keyed})
        found += [(r["doc_id"], n, host, k) for n, k in keyed]
    want = sorted((d, n) for d, n, host, k in found if count[host, k] >= 5 and count[host, k] * 10 >= size[host])
    assert sorted(tuple(r) for r in lines.find_repeated_lines(table).collect()) == want


def lines_look():
    from tarn.llm.canon import LOOK_ALIKES

    return LOOK_ALIKES
