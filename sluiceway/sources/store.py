"""Small files and folders on Spark's own file systems, whichever store a path names."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def _of(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def key(name: str) -> str:
    """A name as one component of a path."""
    return quote(name, safe="") or "%"


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _of(spark, path)
    return fs.exists(where)


def write(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file as a whole: readers see the old text or the new one."""
    fs, where = _of(spark, path)
    fs.mkdirs(where.getParent())
    _, fresh = _of(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    hidden = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{fresh.getName()}")
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    if not fs.rename(hidden, where):
        fs.delete(where, False)
        fs.rename(hidden, where)


def read(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none."""
    fs, where = _of(spark, path)
    if not fs.exists(where):
        return None
    source = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def sha256(spark: SparkSession, path: str) -> str:
    """Digest of a file's bytes, read in pieces by the driver's JVM."""
    fs, where = _of(spark, path)
    source = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(source)
    finally:
        source.close()


def size(spark: SparkSession, path: str) -> int:
    fs, where = _of(spark, path)
    return fs.getFileStatus(where).getLen()


def claim(spark: SparkSession, path: str) -> bool:
    """Take a claim by making a file that didn't exist; one of several racing callers wins."""
    fs, where = _of(spark, path)
    fs.mkdirs(where.getParent())
    try:
        fs.create(where, False).close()
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(where):
            return False
        raise
    return True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share.

    Only where that is unset and everything runs in this process, as in tests, a folder of this machine is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sluiceway-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to scratch and read back: evaluated once, whatever runs later or is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
