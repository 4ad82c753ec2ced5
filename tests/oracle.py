"""Holds a query's rows against those of its SQL in DuckDB over the same tables."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def connect(folder):
    own = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if glob.glob(f"{path}/*.parquet") else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return own


def same_rows(frame, connection, sql):
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    assert sorted(map(str, map(tuple, frame.select(*names).collect()))) == sorted(map(str, found.fetchall()))
