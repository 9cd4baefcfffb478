"""Line dedup: windows of three consecutive lines, found repeated anywhere, lose their later occurrences.

Lines are compared with white space collapsed and trimmed; blank lines take no part and always
stay. A text with fewer than three lines that aren't blank, but not none, is one window. The first
occurrence of a window, by doc_id and then position, stays; lines covered by any later occurrence go.

A window is known by two 64-bit hashes of its lines, so no line travels: only hashes and positions
are shuffled, and counts are combined within each task first. Joins are on hashes, whose hot ones
the adaptive skew join splits.

Defined results: null text has no lines and becomes the empty text; null ids come after every other
id; rows that repeat an id are ordered by their locator; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import LOCATOR, WHOLE, first_row, located, stored

SIZE = 3


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, LOCATOR, w, covers, h1, h2) for each window of located rows; covers are line numbers."""
    plain = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).alias("x")))
    kept = rows.select("doc_id", *LOCATOR, _lines(F.col("text")).alias("lines")).select(
        "doc_id", *LOCATOR, F.filter(plain, lambda s: s["x"] != "").alias("kept"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("kept") - size, F.lit(0)))

    def window(i):
        part = F.slice("kept", i + 1, size)
        lines = F.transform(part, lambda s: s["x"])
        return F.struct(
            i.alias("w"), F.transform(part, lambda s: s["i"]).alias("covers"),
            F.xxhash64(lines).alias("h1"), F.xxhash64(F.lit(size), lines).alias("h2"))

    each = kept.where(F.size("kept") > 0).select("doc_id", *LOCATOR, F.explode(F.transform(starts, window)).alias("v"))
    return each.select("doc_id", *LOCATOR, "v.*")


def covered_lines(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """(LOCATOR, __gone): the numbers of the lines that later occurrences cover, for rows that have any."""
    found = stored(windows(rows, size), "line-windows")
    key = first_row("doc_id", *LOCATOR, "w")
    repeated = found.groupBy("h1", "h2").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(repeated.drop("n"), ["h1", "h2"]).where(key != F.col("first"))
    each = later.select(*LOCATOR, F.explode("covers").alias("line")).distinct()
    return each.groupBy(*LOCATOR).agg(F.collect_list("line").alias("__gone"))


def dedup_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with text cleaned, and n_lines (not blank) and n_removed."""
    rows = located(docs, "doc_id", "text", whole=True)
    lines = _lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    cleaned = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    joined = rows.join(covered_lines(rows.drop(WHOLE), size), list(LOCATOR), "left")
    own = ("n_lines", "n_removed")  # columns of these names give way
    kept = [cleaned.alias("text") if c == "text" else F.col(WHOLE).getField(c).alias(c) for c in docs.columns if c not in own]
    n_removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    return joined.select(*kept, n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))
