"""Files under capabilities: what may be opened, how long it is, what kind it has, and its windows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.deploy import send_package
from sluiceway.functions import pdf
from sluiceway.functions import text as tx


class CapabilityDenied(PermissionError):
    """A path outside every granted root; paths that don't exist are denied alike."""


def permitted(path: str, roots: list[str] | tuple[str, ...]) -> str:
    """The real path, if it exists under a granted root once links are followed on both sides."""
    local = lambda p: os.path.realpath(re.sub("^file:(//)?(?=/)", "", p))
    real = local(path)
    for root in roots:
        base = local(root)
        if os.path.exists(real) and os.path.exists(base) and os.path.commonpath([real, base]) == base:
            return real
    raise CapabilityDenied(f"{path!r} lies under no granted root")


def kind_of(head: bytes) -> dict:
    """Kind and format of content by its first bytes, as ``functions.text.classify`` gives them for columns."""
    for magic, kind, fmt in tx.MAGIC:
        if head.startswith(bytes.fromhex(magic)):
            return {"kind": kind, "format": fmt}
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return {"kind": "image", "format": "webp"}
    head = head[: tx.SNIFF]
    try:
        head.decode()
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data" or e.start == 0:
            return {"kind": "binary", "format": None}
    return {"kind": "text", "format": None}


INSPECTED = "struct<pages: int, has_text_layer: boolean>"


def inspected(content: Column) -> Column:
    """INSPECTED of PDF content, null for null; a document that can't be read has 0 pages."""
    send_package(SparkSession.active())

    @F.pandas_udf(INSPECTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([pdf.inspect(x) if x is not None else (None, None) for x in batch], columns=["pages", "has_text_layer"])

    return run(content)


def page_texts(content: Column, page: Column) -> Column:
    """struct<text, error> of a PDF's page, counted from 0."""
    send_package(SparkSession.active())

    @F.pandas_udf("struct<text: string, error: string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, pages in batches:
            out = []
            for x, at in zip(contents, pages, strict=True):
                try:
                    out.append((pdf.page_text(x, int(at)), None) if x is not None else (None, None))
                except ValueError as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["text", "error"])

    return run(content, page)


def open_files(spark: SparkSession, paths: list[str], roots: list[str] | tuple[str, ...]) -> DataFrame:
    """(handle, path, length, kind, content); handles count from 0 in the order of ``paths``.

    Files without bytes, which the reader leaves out, are text of length 0. ``content`` is read
    only if a query uses it.
    """
    real = [permitted(p, roots) for p in paths]
    handles = spark.createDataFrame(list(enumerate(real)), "handle long, path string")
    read = spark.read.format("binaryFile").load(sorted(set(real)))
    read = read.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content")
    joined = handles.join(read, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    kind = tx.classify(F.col("content"))
    joined = joined.withColumn("found", kind).withColumn("pdf", inspected(F.when(F.col("found.kind") == "document", F.col("content"))))
    unread = F.coalesce(F.col("pdf.pages") == 0, F.lit(False))
    described = F.struct(
        F.when(unread, "binary").otherwise(F.col("found.kind")).alias("kind"), F.when(~unread, F.col("found.format")).alias("format"),
        F.when(~unread, F.col("pdf.pages")).alias("pages"), F.when(~unread, F.col("pdf.has_text_layer")).alias("has_text_layer"))
    return joined.select("handle", "path", F.length("content").cast("long").alias("length"), described.alias("kind"), "content")


def windows(files: DataFrame, size: int = 65_536) -> DataFrame:
    """(handle, offset, next_offset, text) of the windows of text files, without loss."""
    walked = files.select("handle", F.explode(tx.windows(F.col("content").cast("string"), size)).alias("w"))
    return walked.select("handle", "w.*")
