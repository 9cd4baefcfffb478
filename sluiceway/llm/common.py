"""Shared pieces of the training-data operators: tables, row locators, words and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of ASCII digits, ASCII letters and characters beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same words for Python's ``re``, on text whose A-Z are lower-cased.
PY_WORD = r"[0-9a-z\x80-\U0010ffff]+"
PY_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}

#: Columns that say where a row lies: a hash of its file's path, and its place in that file.
FILE, ROW = "__file", "__row"
LOCATOR = (FILE, ROW)
#: All columns of a located row.
WHOLE = "__whole"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where it is unset and everything runs in this process, as in tests, a folder of this machine is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluiceway-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def scratch_so_far() -> int:
    """How many scratch tables this process has written; a mark for ``drop_scratch``."""
    return len(_WRITTEN)


def drop_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what the operators have put in the shared folder since a mark, but for the last ``keep`` tables.

    Results not yet written out become unreadable.
    """
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Write a text file that the driver has made, by way of Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    finally:
        out.close()


def located(df: DataFrame, *columns: str, whole: bool = False) -> DataFrame:
    """The named columns of ``df`` with LOCATOR columns, the same at every evaluation; no other column can clash with them.

    A frame read from files uses the reader's own file path and row index; any
    other frame is stored first, so that it is read from files as well. With
    ``whole``, a struct WHOLE holds all columns of ``df``, whatever their names.
    """
    def add(x: DataFrame) -> DataFrame:
        meta = x.metadataColumn("_metadata")
        more = [F.struct("*").alias(WHOLE)] if whole else []
        return x.select(*[F.col(c) for c in columns], *more, F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].cast("long").alias(ROW))

    try:
        return add(df)
    except AnalysisException:
        return add(stored(df, "rows"))


def kept_columns(docs: DataFrame, *own: str) -> list[Column]:
    """The columns of ``docs`` out of WHOLE, but those that a result replaces."""
    return [F.col(WHOLE).getField(c).alias(c) for c in docs.columns if c not in own]


def words(text: Column) -> Column:
    """Array of the words of ``text`` with A-Z lower-cased; empty for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def first_row(*columns: str) -> Column:
    """Struct whose minimum is the row with the smallest values, nulls last."""
    keys: list[Column] = []
    for c in columns:
        keys += [F.col(c).isNull().alias(f"{c}_null"), F.col(c)]
    return F.struct(*keys)
