"""The checkpoint ledger: concluded work of jobs, nodes and items, in folders by job and node.

Items of a node are Parquet files of their own folder, to which every run appends: a job never reads
another's rows. What is one value, a job's record, a node's output or a manifest's pin, is one small file
that is replaced as a whole. Concluded items are never run again; items in flight when a run ends may be,
and of several rows of an item the latest holds.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.sources import store

SCHEMA = "item_index long, status string, output string, error string, tokens_in long, tokens_out long, completed_at timestamp"
JOBS = "job_id string, status string, fingerprint string, spec string, input string, envelope string, attempt long, updated_at string"


def latest(rows: DataFrame, keys: tuple[str, ...], at: str) -> DataFrame:
    """The latest row of each key, by ``at``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("v")).select(*keys, "v.*")


def pending(items: DataFrame, checkpoints: DataFrame, *keys: str) -> DataFrame:
    """Items without a concluded row."""
    return items.join(checkpoints.select(*keys), list(keys), "left_anti")


def reuse(items: DataFrame, checkpoints: DataFrame, *keys: str) -> DataFrame:
    """Items with the recorded output they are to be given instead of running."""
    return items.join(checkpoints, list(keys))


def counts(results: DataFrame, *keys: str) -> DataFrame:
    """succeeded and failed by key, and the first failure by index."""
    ok = F.col("error").isNull()
    return results.groupBy(*keys).agg(
        F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.min_by("error", F.when(~ok, F.col("item_index"))).alias("first_error"),
    )


class Ledger:
    """Folders jobs, outputs, manifests, items and results under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str) -> str:
        return "/".join([self.path, *(store.key(p) for p in parts)])

    # jobs

    def jobs(self) -> DataFrame:
        """The record of every job; one that can't be read is left out."""
        return self._records().where("job_id is not null")

    def unreadable(self) -> int:
        """How many job records can't be read."""
        return self._records().where("job_id is null").count()

    def _records(self) -> DataFrame:
        if not store.exists(self.spark, self._at("jobs")):
            return self.spark.createDataFrame([], JOBS)
        return self.spark.read.schema(JOBS).json(self._at("jobs"))

    def put_job(self, job_id: str, status: str, fingerprint: str, spec: str, value: str, envelope: dict | None = None, attempt: int = 0) -> None:
        row = {"job_id": job_id, "status": status, "fingerprint": fingerprint, "spec": spec, "input": value,
               "envelope": json.dumps(envelope) if envelope else None, "attempt": attempt, "updated_at": datetime.now(UTC).isoformat()}
        store.write(self.spark, self._at("jobs", f"{job_id}.json"), json.dumps(row))

    def job(self, job_id: str) -> dict | None:
        text = store.read(self.spark, self._at("jobs", f"{job_id}.json"))
        return json.loads(text) if text else None

    def claim(self, job_id: str, attempt: int) -> bool:
        """Take a job's next attempt; of several callers, in whatever process, one gets it."""
        return store.claim(self.spark, self._at("claims", f"{job_id}.{attempt}"))

    def mark(self, kind: str, job_id: str) -> None:
        store.write(self.spark, self._at(kind, job_id), "")

    def marked(self, kind: str, job_id: str) -> bool:
        return store.exists(self.spark, self._at(kind, job_id))

    # nodes

    def put_output(self, job_id: str, node: str, output: str, usage: dict | None = None) -> None:
        store.write(self.spark, self._at("outputs", job_id, f"{node}.json"), json.dumps({"output": output, "usage": usage or {}}))

    def node_output(self, job_id: str, node: str) -> dict | None:
        """{output, usage} of a node that has concluded."""
        text = store.read(self.spark, self._at("outputs", job_id, f"{node}.json"))
        return json.loads(text) if text else None

    def pin(self, job_id: str, node: str, digest: str) -> str | None:
        """Record a manifest's digest; returns the digest recorded before, if any."""
        path = self._at("manifests", job_id, node)
        before = store.read(self.spark, path)
        if before is None:
            store.write(self.spark, path, digest)
        return before

    # items

    def record(self, job_id: str, node: str, rows: DataFrame) -> None:
        """Append rows (item_index, output, error and, if they have them, tokens_in, tokens_out, events)."""
        status = F.when(F.col("error").isNull(), "completed").otherwise("failed")
        used = [c if c in rows.columns else F.lit(0).cast("long").alias(c) for c in ("tokens_in", "tokens_out")]
        events = ["events"] if "events" in rows.columns else []
        done = rows.select("item_index", status.alias("status"), "output", "error", *used, F.current_timestamp().alias("completed_at"), *events)
        done.write.mode("append").parquet(self._at("items", job_id, node))

    def concluded(self, job_id: str, node: str) -> DataFrame:
        """Items of a node that have ended, in no order."""
        path = self._at("items", job_id, node)
        if not store.exists(self.spark, path):
            return self.spark.createDataFrame([], SCHEMA)
        return latest(self.spark.read.schema(SCHEMA).parquet(path), ("item_index",), "completed_at")

    def item(self, job_id: str, node: str, index: int) -> DataFrame:
        """The row of one item, if it has concluded."""
        return self.concluded(job_id, node).where(F.col("item_index") == index)

    def events(self, job_id: str, node: str) -> DataFrame:
        """(item_index, at, type, payload) of what a node's items have said."""
        schema = f"{SCHEMA}, events array<struct<type: string, payload: string>>"
        rows = self.spark.read.schema(schema).parquet(self._at("items", job_id, node))
        return rows.select("item_index", F.posexplode("events").alias("at", "e")).select("item_index", "at", "e.*")

    def summary(self, job_id: str, node: str) -> dict:
        rows = self.concluded(job_id, node)
        usage = rows.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
        return counts(rows).crossJoin(usage).first().asDict()  # two tables of one row

    def project(self, job_id: str, node: str) -> tuple[str, str]:
        """Write the node's results and failures as folders of JSONL parts in the order of items; returns both paths."""
        rows = self.concluded(job_id, node)
        results = rows.where("error is null").select("item_index", F.concat(F.lit('{"item":'), "item_index", F.lit(',"result":'), "output", F.lit("}")).alias("value"))
        failures = rows.where("error is not null").select("item_index", F.to_json(F.struct(F.col("item_index").alias("item"), "error")).alias("value"))
        paths = []
        for name, part in (("results", results), ("failures", failures)):
            paths.append(path := f"{self.results(job_id)}/{store.key(node)}.{name}.jsonl")
            part.sort("item_index").select("value").write.mode("overwrite").text(path)
        return paths[0], paths[1]

    def results(self, job_id: str) -> str:
        return self._at("results", job_id)
