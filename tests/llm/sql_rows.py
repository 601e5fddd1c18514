"""Rows of a query and of its SQL over the tables of sf0.01."""

import duckdb

from quillstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    got = out.select(*columns).collect()
    assert len(got) > 0 and sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in want)
