"""Side-by-side comparison of a registered query with its SQL on DuckDB."""

import glob
import os

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return value
    return int(value) if hasattr(value, "__index__") else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False))


def compare(spark, query, sql, sf_dir=SF):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert got == want
    return len(got[1])
