import duckdb
import pytest

from tarn.llm import oracle, queries

TABLES = "documents embeddings chunks retrieved answers eval_set mix_targets reading_labels".split()


def test_queries_run_over_the_tables(spark, testdata):
    columns = {
        "p1_found": ["doc_id", "line_no"], "p2_found": ["chunk_a", "chunk_b"], "p3_found": ["doc_a", "doc_b"], "p4_found": ["item_kind", "item_key", "unit_no"],
        "p5_found": ["question_id", "phrase_no", "doc_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["source"], "p8_found": ["doc_id"],
    }
    for name, query in queries.queries().items():
        if name in oracle.oracle_sql() and name not in columns:
            continue  # below
        got = query(spark, testdata)
        assert got.count() > 0, name
        assert name not in columns or got.columns == columns[name]
    assert set(oracle.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, testdata, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{testdata}/{table}.parquet'")
    got = queries.queries()[name](spark, testdata)
    columns = sorted(got.columns)
    relation = db.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in relation.fetchall())))
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == want and want
