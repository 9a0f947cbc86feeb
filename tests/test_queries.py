import glob
import os

import duckdb
import pytest

from sparkrag.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(round(r[i], 9) + 0.0 if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = con.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_rows_do_not_depend_on_partitions(spark):
    names = ("rrf_hybrid", "rrf_ids_one_based", "thread_neighbours", "chat_sessions_gap_cap", "sender_alias", "answer_candidates")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append([sorted(map(str, QUERIES[x](spark, SF).collect())) for x in names])
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
