import os

import numpy as np
import pytest

from tarn.llm import mix, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(mix.TOKENIZERS), reason="no vocabularies")

TARGET = "source string, target_share double, max_repeats int"


def sizes(spark, counts, tokens=10):
    rows = [(site, i) for site, n in counts.items() for i in range(n)]
    return spark.createDataFrame([(k, site, tokens) for k, (site, _) in enumerate(rows)], "doc_id long, site string, tokens long")


def test_reach(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("WWW.B", 0.3, 2), ("b", 0.7, 2), ("none", 0.1, 9), ("a", None, 1), ("a", 0.5, None), ("a", 0.0, -1)], TARGET)
    got = [(r["source"], r["reachable"]) for r in mix.reach(sizes(spark, {"a": 60, "b": 30, "c": 10}), targets).collect()]
    assert sorted(got) == sorted([("a", True), ("WWW.B", True), ("b", False), ("none", False), ("a", True), ("a", False), ("a", True)])
    assert mix.reach(sizes(spark, {"a": 60}), targets.limit(0)).count() == 0


def test_mix_meets_quotas(spark):
    table = sizes(spark, {"a": 300, "b": 40, "c": 160, "": 10})
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.2, 3), ("c", 0.3, 2), ("d", 0.1, 5)], TARGET)
    mixed = mix.mix(table, targets, shard_tokens=700)
    rows = mixed.collect()
    count = {s: sum(r["source"] == s for r in rows) for s in "abcd"}
    for source, wanted in {"a": 204, "b": 102, "c": 153, "d": 0}.items():  # of 510 documents
        assert abs(count[source] - wanted) <= 1  # half a cell, which is a document
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert max(r["copy"] for r in rows if r["source"] == "b") == 2 and all(r["copy"] == 0 for r in rows if r["source"] in "ac")
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["position"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert rows == mix.mix(table, targets, shard_tokens=700).collect() or sorted(rows) == sorted(mix.mix(table, targets, shard_tokens=700).collect())
    share = {r["source"]: r for r in mix.shares(mixed, targets).collect()}
    assert share["d"]["tokens"] == 0 and abs(share["a"]["share"] - count["a"] / len(rows)) < 1e-9 and share["b"]["most_copies"] == 3
    assert mix.mix(table.limit(0), targets).count() == 0 and mix.mix(table, targets.limit(0)).count() == 0


def test_rows_of_one_site_add_up(spark):
    table = sizes(spark, {"a": 300, "b": 40, "c": 160})
    targets = spark.createDataFrame([("a", 0.2, 1), (" WWW.a", 0.1, 1), ("a", 0.1, 1), ("b", 0.2, 3), ("www.b", 0.5, 1), ("B", 0.1, -1), ("c", 0.3, 1), ("C", 0.3, 1), (None, 0.1, 1)], TARGET)
    mixed = mix.mix(table, targets)
    rows = mixed.collect()
    count = {s: sum(r["source"] == s for r in rows) for s in "abc"}
    # b: 100 for the first row, all 40 once for the second, but none more than 3 times; c: no more than all 160 once
    for source, wanted in {"a": 200, "b": 120, "c": 160}.items():
        assert abs(count[source] - wanted) <= 1
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and max(r["copy"] for r in rows if r["source"] == "b") == 2
    assert all(r["copy"] == 0 for r in rows if r["source"] in "ac")
    got = {r["source"]: r for r in mix.shares(mixed, targets).collect()}
    assert mix.shares(mixed, targets).count() == len(got) == 4 and sum(r["tokens"] for r in got.values()) == 10 * len(rows)
    assert abs(got["a"]["target_share"] - 0.4) < 1e-9 and got["a"]["tokens"] == 10 * count["a"] and got[None]["tokens"] == 0


def test_found_comes_from_the_mix(spark, testdata, monkeypatch):
    divided, written = [], {}
    tree, keep = mix.hypergeometric_tree, queries.materialize
    monkeypatch.setattr(mix, "hypergeometric_tree", lambda *a: divided.append(tree(*a)) or divided[-1])
    monkeypatch.setattr(queries, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    got = sorted(r["source"] for r in queries.p7_found(spark, testdata).collect())
    assert len(divided) == 1 and divided[0].sum() > 0 and written["mix"].count() > 0 and "position" in written["mix"].columns
    targets = spark.read.parquet(f"{testdata}/mix_targets.parquet")
    assert got == sorted(r["source"] for r in mix.reach(written["sizes"], targets).filter("NOT reachable").collect())


def test_short_sources_are_those_out_of_reach(spark):
    table = sizes(spark, {"a": 60, "b": 30, "c": 10, "e": 7}, tokens=11)
    targets = spark.createDataFrame([("a", 0.401, 1), ("WWW.B", 0.3, 2), ("b", 0.7, 2), ("none", 0.1, 9), ("c", 0.2, -1), ("e", 0.07, None), (None, 0.1, 1), (None, None, 1), ("f", 0.0, -1)], TARGET)
    got = {(r["source"], r["target_share"], r["given"]) for r in mix.short(mix.mix(table, targets), table, targets).collect()}
    out = {(r["source"], r["target_share"]) for r in mix.reach(table, targets).filter("NOT reachable").collect()}
    assert {g[:2] for g in got} == out == {("b", 0.7), ("none", 0.1), ("c", 0.2), ("e", 0.07), (None, 0.1)}
    assert all(given == 0 for source, _, given in got if source != "b")
    assert mix.short(mix.mix(table.limit(0), targets), table.limit(0), targets).count() == 0


def test_many_repeats_take_no_more_of_the_driver(spark, monkeypatch):
    asked, shipped = [], []
    monkeypatch.setattr(mix, "hypergeometric_tree", lambda q, n, rng: asked.append((q, n)) or np.diff(np.linspace(0, q, n + 1).astype(np.int64), axis=0))
    table = sizes(spark, {"a": 40, "b": 3}, tokens=7)
    targets = spark.createDataFrame([("a", 0.5, 2_000_000_000), ("b", 0.5, 5)], TARGET)
    mixed = mix.mix(table, targets, total=10**9, shard_tokens=10**8)
    quotas, shards = asked[0]
    assert quotas.sum() <= mix.ALL_CELLS and shards == 5  # a plan of numbers, whatever the copies
    assert mixed.schema["copy"].dataType.simpleString() == "int"


def test_more_shards_than_are_planned(spark, monkeypatch):
    monkeypatch.setattr(mix, "STRETCHES", 6)
    table = sizes(spark, {"a": 300, "b": 100})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGET)
    rows = mix.mix(table, targets, shard_tokens=400).collect()  # ten shards, of which three are planned
    assert abs(len(rows) - 400) <= 2 and len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    found = {s: sorted(r["position"] for r in rows if r["shard"] == s) for s in {r["shard"] for r in rows}}
    assert len(found) == 12 and all(p == list(range(len(p))) for p in found.values()) and max(map(len, found.values())) <= 2 * min(map(len, found.values()))


@pytest.mark.parametrize("tokens", [1, 1000])
def test_quotas_are_met_within_a_document(spark, tokens):
    rng = np.random.default_rng(tokens)
    rows = [(i, "abc"[i % 3], int(rng.integers(0, tokens + 1))) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, site string, tokens long")
    targets = spark.createDataFrame([("a", 0.123, 2), ("b", 0.6, 7), ("c", 0.277, 1)], TARGET)
    wanted = {r["__site"]: r["quota"] for r in mix.reach(table, targets).collect()}
    got = {r["source"]: r["tokens"] for r in mix.shares(mix.mix(table, targets), targets).collect()}
    assert all(abs(got[s] - wanted[s]) <= 4 * tokens for s in "abc")


def test_turns_are_permutations():
    for number in (0, 1, 2, 77, 10**9):
        places = mix.turn(np.arange(256), 256, number)
        assert sorted(places) == list(range(256))
    assert (mix.turn(np.arange(256), 256, 1) != mix.turn(np.arange(256), 256, 2)).mean() > 0.9


def test_tree_divides_exactly():
    rng = np.random.default_rng(1)
    quotas = np.array([1000, 1, 0, 37])
    out = mix.hypergeometric_tree(quotas, 7, rng)
    assert (out.sum(axis=0) == quotas).all() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 3
    first = np.array([mix.hypergeometric_tree(np.array([60, 40]), 4, np.random.default_rng(s))[0, 0] for s in range(400)])
    assert abs(first.mean() - 15) < 0.5 and 0.5 < first.var() / (25 * 0.6 * 0.4 * 75 / 99) < 1.6  # as drawn without replacement


def test_token_counts(spark, hard):
    got = {r["doc_id"]: r["tokens"] for r in mix.sized(hard).collect()}
    assert got[0] == 0 and got[1] == 0 and got[5] == 1 and got[11] == got[12] == 2 and len(got) == hard.count()
    assert mix.sized(hard.limit(0)).count() == 0
