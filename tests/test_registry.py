import os

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
SAMPLE = ("importance_scores", "global_edges", "combo_quality", "similar_pairs", "eval_summary", "chunk_rerank", "page_grouping", "phase_summary")


def test_every_oracle_has_a_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert len([q for q in queries if not q.startswith("op") and q != "pipeline"]) >= 108


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    got = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    expected = db.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()

    def plain(rows):
        return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)

    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(expected)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
