"""The event log of jobs: append, ordered replay, and live subscription by Structured Streaming."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.sources import store

SCHEMA = "job_id string, seq long, type string, payload string"


class EventLog:
    """A folder a job; the driver's events are small files, those of a node's items are written by their tasks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.last = spark, path, 0

    def _next(self) -> int:
        self.last = max(time.time_ns(), self.last + 1)
        return self.last

    def append(self, job_id: str, *events: tuple[str, str]) -> None:
        """Events (type, payload) of a job, numbered by time so that later appends sort later."""
        if not events:
            return
        seqs = [self._next() for _ in events]
        lines = [json.dumps({"job_id": job_id, "seq": s, "type": kind, "payload": payload}) for s, (kind, payload) in zip(seqs, events, strict=True)]
        store.write(self.spark, f"{self.path}/{store.key(job_id)}/{seqs[0]}.json", "\n".join(lines) + "\n")

    def append_rows(self, job_id: str, rows: DataFrame) -> None:
        """Events (item_index, at, type, payload) of a node's items, after all earlier events and in the order of items."""
        base = self._next()
        seq = F.lit(base) + F.col("item_index") * 1000 + F.col("at")
        out = rows.select(F.lit(job_id).alias("job_id"), seq.cast("long").alias("seq"), "type", "payload")
        out.write.json(f"{self.path}/{store.key(job_id)}/{base}.items")
        self.last = base + (rows.agg(F.max(F.col("item_index") * 1000 + F.col("at"))).first()[0] or 0) + 1

    def read(self, job_id: str | None = None) -> DataFrame:
        """The whole log so far, of one job in order or of all."""
        path = self.path if job_id is None else f"{self.path}/{store.key(job_id)}"
        if not store.exists(self.spark, path):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(path)
        return rows if job_id is None else rows.orderBy("seq")

    def follow(self, job_id: str | None = None) -> DataFrame:
        """Backlog and then live events: the stream starts from the first event, so a late subscriber sees all.

        A subscriber that falls behind goes on from its own checkpoint and loses nothing.
        """
        rows = self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").json(self.path)
        return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def replay(events: DataFrame, key: str, seq: str, text: str, between: str = "") -> DataFrame:
    """(key, text): each key's pieces joined in the order of ``seq``."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(text).alias("text"))))
    return events.groupBy(key).agg(pieces.alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["text"]), between).alias("text"))


def incremental_fanout(spark: SparkSession, source: str, checkpoint: str, run, schema: str = "value string") -> None:
    """Run ``run(batch)`` over the manifest files of a folder that earlier calls haven't seen."""
    stream = spark.readStream.schema(schema).option("wholetext", "true").text(source)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: run(batch)).start()
    query.awaitTermination()
