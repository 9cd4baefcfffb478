"""Fan-out: one block over every item of a manifest, each on its own, and the collection that later nodes read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ledger import Ledger, pending
from sluiceway.plans.blocks import ADDED, CODE, EVENT, EVENTS, MESSAGE, OUTPUT, TOKENS_IN, TOKENS_OUT, PyBlock


class FanoutFailed(Exception):
    """The node as a whole failed: no item succeeded, or its manifest changed."""


def run_items(items: DataFrame, block, host=None, partitions: int | None = None) -> DataFrame:
    """``items`` with output (JSON text), error, tokens_in, tokens_out and events.

    Bad input, the block's failure or bad output end that item only.
    """
    if isinstance(block, PyBlock) and partitions:
        items = items.repartition(partitions)  # opaque work is spread evenly
    rows = items.withColumns({"__given": F.col("input"), "__fits": block.signature.input.accepts_column(F.col("input"))})
    rows = block.run(rows.withColumn("input", F.when(F.col("__fits"), F.col("input"))), host)
    error = (
        F.when(~F.col("__fits"), F.lit(f"input is not {block.signature.input.describe()}"))
        .when(F.col(CODE).isNotNull(), F.col(MESSAGE))
        .when(~block.signature.output.accepts_column(F.col(OUTPUT)), F.lit(f"output is not {block.signature.output.describe()}"))
    )
    used = TOKENS_IN in rows.columns
    more = {
        "tokens_in": F.col(TOKENS_IN) if used else F.lit(0).cast("long"), "tokens_out": F.col(TOKENS_OUT) if used else F.lit(0).cast("long"),
        "events": F.col(EVENTS) if used else F.array().cast(f"array<{EVENT}>"),
    }
    rows = rows.withColumn("error", error).withColumns({"output": F.when(F.col("error").isNull(), F.to_json(OUTPUT)), **more})
    # nothing is pushed below this column of no meaning, and so no check or run is copied into a filter
    rows = rows.withColumn("__here", F.spark_partition_id() >= 0)
    kept = {c: F.when(F.col("__here"), F.col(c)) for c in ("output", "error", "tokens_in", "tokens_out", "events")}
    return rows.withColumns({"input": F.col("__given"), **kept}).drop("__given", "__fits", "__here", *ADDED)


def run_fanout(ledger: Ledger, job_id: str, node: str, items: DataFrame, digest: str, block, host=None, partitions: int | None = None) -> tuple[dict, dict]:
    """Run the items that haven't concluded and record them; the collection record, and the usage of the items run."""
    before = ledger.pin(job_id, node, digest)
    if before is not None and before != digest:
        raise FanoutFailed(f"node {node!r}: its manifest changed since the job began; put it back or start a new job")
    left = pending(items, ledger.concluded(job_id, node), "item_index")
    ledger.record(job_id, node, run_items(left, block, host, partitions))
    n = ledger.summary(job_id, node)
    if not n["succeeded"]:
        raise FanoutFailed(f"node {node!r}: every item failed; the first: {n['first_error']}")
    results, failures = ledger.project(job_id, node)
    record = {"results_path": results, "failures_path": failures, "succeeded": n["succeeded"], "failed": n["failed"]}
    return record, {"tokens_in": n["tokens_in"], "tokens_out": n["tokens_out"]}
