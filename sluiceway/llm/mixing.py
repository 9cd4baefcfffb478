"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in a pseudo-random order that is the same in every run, are cut into blocks
of ``block_rows`` rows. In the fluid schedule every source that isn't used up progresses at its weight
over the sum of their weights, so a source's end scales the others up at once. A block may start at
the slot in which the fluid schedule begins it, and must be placed by the slot in which that ends it;
each slot takes the block with the earliest deadline among those released. Releases and deadlines
are computed from the exact weights in whole numbers. Every source thus stays less than one block
from its target at every slot, and every row is placed exactly once.

The schedule depends on the number of rows of each source only. It is a table of blocks, which the
driver writes piece by piece; it holds the sources' sizes and weights and one piece at a time. Blocks
grow with the corpus beyond ``MAX_BLOCKS`` blocks, so what the driver walks is bounded but for the
number of sources.

Defined results: null is a source of its own; a source without a weight, or with a weight that is
null or not above 0, gets the smallest weight given; repeated rows and null ids are placed row by row, ordered by hash, id
and locator; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate
from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import LOCATOR, WHOLE, kept_columns, located, scratch_path, stored, write_lines

BLOCK_ROWS = 64
BROADCAST_SOURCES = 300_000  # a table of up to so many sources is broadcast, a larger one shuffled
BUCKET_ROWS, MAX_BUCKETS = 2_000, 65_536
#: A block holds BLOCK_ROWS rows, or more where that would make more blocks than the driver should walk.
MAX_BLOCKS = 2_000_000
PIECE = 50_000  # blocks of the schedule that the driver holds at a time
_PLAN = "key string, mix_block long, mix_slot long, mix_release long, mix_deadline long, base_row long"


class Fluid:
    """The slots, from below and above, at which sources that share every slot by weight end their blocks."""

    def __init__(self, blocks: list[int], weights: list[float]):
        exact = [Fraction(w) for w in weights]
        scale = lcm(*(x.denominator for x in exact))
        self.weights = [x.numerator * (scale // x.denominator) for x in exact]
        # work per weight, with bits enough that different fractions stay apart
        self.bits = 2 * max(self.weights, default=1).bit_length() + 1
        ends = [self.work(n, i) for i, n in enumerate(blocks)]
        order = sorted(range(len(blocks)), key=ends.__getitem__)
        self.ends = [ends[i] for i in order]
        self.done = list(accumulate((blocks[i] for i in order), initial=0))
        self.left = list(accumulate((-self.weights[i] for i in order), initial=sum(self.weights)))

    def work(self, k: int, i: int) -> int:
        return (k << self.bits) // self.weights[i]

    def at(self, k: int, i: int) -> tuple[int, int]:
        """The slots around the time at which source i has done k blocks."""
        used_up = bisect_left(self.ends, self.work(k, i))
        q, r = divmod(k * self.left[used_up], self.weights[i])
        return self.done[used_up] + q, self.done[used_up] + q + (r > 0)


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) slot by slot, earliest deadline first among released blocks."""
    fluid = Fluid(blocks, weights)
    coming = [(0, i, 0) for i, n in enumerate(blocks) if n]  # each source's next block by release
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(sum(blocks)):
        while coming and coming[0][0] <= slot:
            release, i, k = coming[0]
            later, deadline = fluid.at(k + 1, i)
            heapq.heappush(ready, (deadline, i, k, release))
            if k + 1 < blocks[i]:
                heapq.heapreplace(coming, (later, i, k + 1))
            else:
                heapq.heappop(coming)
        deadline, i, k, release = heapq.heappop(ready)
        yield i, k, slot, release, deadline


def plan(spark: SparkSession, rows_of: dict[str, int], weights: dict[str, float], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The schedule as a table with _PLAN's columns; base_row is the place of a block's first row in the mixture."""
    path, piece, row, pieces = scratch_path(spark, "mix-slots"), [], 0, 0
    keys = sorted(rows_of)
    spelled = [json.dumps(key) for key in keys]
    for i, k, slot, release, deadline in schedule([-(-rows_of[key] // block_rows) for key in keys], [weights[key] for key in keys]):
        piece.append(f'{{"key":{spelled[i]},"mix_block":{k},"mix_slot":{slot},"mix_release":{release},"mix_deadline":{deadline},"base_row":{row}}}')
        row += min(block_rows, rows_of[keys[i]] - k * block_rows)
        if len(piece) == PIECE:
            write_lines(spark, f"{path}/piece-{pieces:06}.json", piece)
            piece, pieces = [], pieces + 1
    write_lines(spark, f"{path}/piece-{pieces:06}.json", piece)
    return spark.read.schema(_PLAN).json(path)


def tempered(rows_of: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights in proportion to a power of each source's rows: large sources count less than their size."""
    return {k: max(n, 1) ** power for k, n in rows_of.items()}


def _source_key(column: str):
    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int | None = None, power: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, mix_block, mix_slot, mix_release, mix_deadline, mix_position, LOCATOR."""
    return mix_located(located(docs, "doc_id", "source"), weights, block_rows, power)


def mix_located(rows: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int | None = None, power: float = 0.5) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.select("doc_id", "source", *LOCATOR, _source_key("source").alias("key"), F.xxhash64(F.lit(7), "doc_id").alias("h"))
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "mix-sources")
    rows_of = {r["key"]: r["n"] for r in sizes.toLocalIterator()}
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(rows_of.values()) // MAX_BLOCKS))
    wanted = tempered(rows_of, power)
    if weights is not None:
        given = {"" if k is None else f"={k}": w for k, w in weights.items() if w and w > 0}
        wanted = {k: given.get(k, min(given.values(), default=1.0)) for k in rows_of}

    # places within a source: buckets of hash ranges, so that a large source is many sort groups
    n_buckets = sizes.select("key", F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n") / BUCKET_ROWS)).cast("long").alias("k"))
    rows = rows.join(F.broadcast(n_buckets) if len(rows_of) <= BROADCAST_SOURCES else n_buckets, "key")
    rows = rows.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 33) * F.col("k"), 31)).drop("k")
    offsets = rows.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select("key", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id", *LOCATOR)) - 1
    placed = rows.withColumn("place", place).join(offsets, ["key", "bucket"]).withColumn("place", F.col("place") + F.col("before"))

    placed = placed.withColumn("mix_block", F.floor(F.col("place").cast("long") / block_rows))
    return placed.join(plan(spark, rows_of, wanted, block_rows), ["key", "mix_block"]).select(
        "doc_id", "source", "mix_block", "mix_slot", "mix_release", "mix_deadline",
        (F.col("base_row") + F.col("place") % block_rows).alias("mix_position"), *LOCATOR,
    )


def mixed_documents(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_position; sort by mix_position to write the mixture in order."""
    rows = located(docs, "doc_id", "source", whole=True)
    extra = ["mix_block", "mix_slot", "mix_position"]  # columns of these names give way
    order = mix_located(rows.drop(WHOLE), weights, **options).select(*LOCATOR, *extra)
    return rows.select(WHOLE, *LOCATOR).join(order, list(LOCATOR)).select(*kept_columns(docs, *extra), *extra)
