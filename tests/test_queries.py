"""Every query with SQL, on the smallest tables, against DuckDB."""

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: The graph of users has no edge on the smallest tables.
GRAPH = {"cooccurrence_graph", "label_propagation", "community_lines", "shortest_paths", "edge_betweenness", "betweenness_top", "betweenness_lines", "modularity"}
#: Streams run a job for every micro-batch; test_mining compares them with the batch forms, and reports with their text.
SLOW = {"stream_bloom", "stream_fm", "stream_reservoir", "son_frequent", "son_document"}


@pytest.fixture(scope="module")
def duck():
    out = {}
    for folder in (FOLDER, LARGER):
        out[folder] = duckdb.connect()
        for t in TABLES:
            out[folder].execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return out


def plain(rows, columns):
    def one(v):
        return None if v is None or v != v else float(v) if isinstance(v, (int, float)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    folder = LARGER if name in GRAPH else FOLDER
    df = __spark_entry__.queries()[name](spark, folder)
    want = duck[folder].execute(__spark_entry__.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
