"""SQL of the training-data operators gives what they give."""

from __future__ import annotations

import duckdb
import pytest

from rampart.llm import registry

SF = "/root/testdata/sf0.001"


def rows(columns, found) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found), key=str)


def test_every_oracle_is_text_of_a_query():
    assert all(isinstance(q, str) for q in registry.oracle_sql().values())
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_op1_sql_on_odd_texts(spark, tmp_path):
    texts = [None, "", " \t ", "One two", "one  TWO", "a b c d", "a b c d", "É b c", "é b c", "x " * 50, " ".join(map(str, range(40))), " ".join(map(str, range(41)))]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(folder + "/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df, rel = registry.queries()["op1_minhash"](spark, folder), con.sql(registry.oracle_sql()["op1_minhash"])
    got = rows(df.columns, df.collect())
    assert got == rows(rel.columns, rel.fetchall())
    assert sum(1 for r in got if r[2]) == 9
