"""Registered queries: each a function of a folder of tables, beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def long(c: Column | str, name: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


def rows(pairs: list[tuple], *names: str) -> str:
    """SQL of a small table of fixed values."""
    spell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::bigint" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(spell, p)) + ')' for p in pairs)}) v({', '.join(names)})"
