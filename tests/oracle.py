"""A query's result against its SQL in DuckDB."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda v: "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


def check(spark, run, sql, sf_dir=SMALL):
    df = run(spark, sf_dir)
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert _plain(df.collect(), df.columns) == _plain(got.fetchall(), names)
