"""Holds a Spark query against DuckDB SQL over the same Parquet files."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def same(spark, query, sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = query(spark, sf)
    asked = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in asked.description}
    assert kinds == {f.name: KINDS[f.dataType.simpleString()] for f in found.schema}
    names, places = sorted(kinds), {d[0]: i for i, d in enumerate(asked.description)}
    put = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    ours = sorted(tuple(put(r[n]) for n in names) for r in found.collect())
    theirs = sorted(tuple(put(r[places[n]]) for n in names) for r in asked.fetchall())
    assert ours == theirs
    return len(ours)
