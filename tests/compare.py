"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def database(folder):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=_key)


def rows_of_duckdb(db, sql):
    relation = db.sql(sql)
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    names = [relation.columns[i] for i in order]
    types = [str(relation.types[i]) for i in order]
    rows = (tuple(_plain(r[i]) for i in order) for r in relation.fetchall())
    return names, types, sorted(rows, key=_key)


SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def spark_types(df):
    return [SAME_TYPE[dict(df.dtypes)[c]] for c in sorted(df.columns)]
