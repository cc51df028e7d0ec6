"""Every query over the small test tables, against its SQL where there is one."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry
from tarn.plans import registry

TABLES = "documents embeddings chunks retrieved answers eval_set mix_targets reading_labels".split()


@pytest.fixture(scope="module")
def duck(testdata):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{testdata}/{table}.parquet'")
    return db


def test_names():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, testdata, duck, name):
    got = registry.queries()[name](spark, testdata)
    columns = sorted(got.columns)
    have = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    relation = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in relation.fetchall())))
    assert have == want


def test_entry(spark, testdata):
    assert entry.entry(spark).columns == ["question_id", "document_url", "chunk_index", "similarity", "rank", "tier"]
