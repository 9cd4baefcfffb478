"""Manifests: JSONL files of work items, checked whole before any item runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.functions.text import strict_json
from sluiceway.sources import store


class ManifestError(ValueError):
    """A manifest that can't be used as a whole."""


def lines_to_items(files: DataFrame, text: str = "value", *keys: str) -> DataFrame:
    """Items (keys, item_index, line, raw, input) of rows that hold whole manifests; blank lines take no index."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), F.regexp_replace(x, "\r$", "").alias("raw")))
    items = files.select(*keys, F.posexplode(F.filter(lines, lambda x: F.trim(x["raw"]) != "")).alias("item_index", "x"))
    return items.select(*keys, F.col("item_index").cast("long").alias("item_index"), "x.line", "x.raw", strict_json(F.col("x.raw")).alias("input"))


def numbered(rows: DataFrame, group: str, within: str, *counted: str) -> DataFrame:
    """``rows`` with ``<c>_no`` for each Boolean column c: how many true ones there are up to each row, by group and ``within``.

    Numbers within a group come from one sort a group, and only the groups' sums are added up in one place.
    """
    inner = Window.partitionBy(group).orderBy(within).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(group).agg(*[F.count_if(F.col(c)).alias(c) for c in counted])
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in counted])
    each = rows.withColumns({f"{c}_no": F.count_if(F.col(c)).over(inner) for c in counted}).join(sums, group)
    return each.withColumns({f"{c}_no": F.col(f"{c}_no") + F.col(f"{c}_before") for c in counted}).drop(*[f"{c}_before" for c in counted])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line, item_index, raw, valid) of a text file of any size; item_index is null for blank lines, valid says whether a line is UTF-8.

    The file is read in blocks by many tasks; a line's number is its place within its block and the lines of the
    blocks before.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    start = read.metadataColumn("_metadata")["file_block_start"]
    raw = F.regexp_replace("value", "\r$", "")
    placed = read.select(start.alias("block"), F.monotonically_increasing_id().alias("at"), raw.alias("raw"), F.is_valid_utf8("value").alias("valid"))
    # places are drawn once: they are stored before they are used twice
    placed = store.stored(placed.withColumns({"every": F.lit(True), "item": F.trim("raw") != ""}), "manifest-lines")
    rows = numbered(placed, "block", "at", "every", "item")
    return rows.select(F.col("every_no").alias("line"), F.when(F.col("item"), F.col("item_no") - 1).alias("item_index"), "raw", "valid")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Items (item_index, input) of a manifest file, and the SHA-256 of its bytes.

    Refuses bytes that aren't UTF-8, a line that isn't JSON (named by its number) and a manifest without items.
    """
    if not store.exists(spark, path):
        raise ManifestError(f"manifest {path} doesn't exist")
    digest = store.sha256(spark, path)
    if not store.size(spark, path):
        raise ManifestError(f"manifest {path} is empty")
    items = store.stored(lines_of(spark, path).withColumn("input", strict_json(F.when(F.col("valid"), F.col("raw")))), "manifest-items")
    blank = F.col("item_index").isNull()
    found = items.agg(
        F.count_if(~F.col("valid")).alias("invalid"), F.min(F.when(~blank & F.col("input").isNull(), F.col("line"))).alias("bad"), F.count("item_index").alias("n"),
    ).first()
    if found["invalid"]:
        raise ManifestError(f"manifest {path} isn't UTF-8")
    if found["bad"] is not None:
        raise ManifestError(f"manifest {path}, line {found['bad']}: not JSON")
    if not found["n"]:
        raise ManifestError(f"manifest {path} is empty")
    return items.where(~blank).select("item_index", "input"), digest
