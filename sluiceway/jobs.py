"""The engine: submit jobs, follow, cancel and resume them.

A job is a row. ``submit`` takes one JSON value, ``submit_all`` a DataFrame (job_id, input) of many.
Graphs without fan-out compile to one plan for all jobs; a graph with fan-out runs node by node for
one job, and its items are the rows. A job's blocks may infer with its spec's model and open files
under its spec's roots and under its own results.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import ledger as lg
from sluiceway.operators.fanout import FanoutFailed, run_fanout
from sluiceway.operators.host import Host
from sluiceway.operators.infer import Registry
from sluiceway.plans.analyze import CheckedGraph, analyze
from sluiceway.plans.compile import compile_graph, envelopes, first_state, output_column, run_node
from sluiceway.plans.speclang import Spec, parse_spec
from sluiceway.sources import store
from sluiceway.sources.manifest import ManifestError, read_manifest
from sluiceway.streaming.events import EventLog

TERMINAL = ("completed", "failed", "cancelled")
BATCH = "job_id string, status string, result variant, error struct<code: string, message: string>, usage struct<tokens_in: long, tokens_out: long>"


class JobError(ValueError):
    """A request that can't be met; ``code`` is as for HTTP."""

    def __init__(self, message: str, code: int = 400):
        super().__init__(message)
        self.code = code


class Cancelled(Exception):
    """The job was cancelled while it ran."""


class Engine:
    def __init__(self, spark: SparkSession, path: str, blocks: dict[str, object], backends: Registry | None = None, audit: bool = False):
        self.spark, self.path, self.blocks, self.audit = spark, path.rstrip("/"), blocks, audit
        self.backends = backends or Registry()
        self.graphs: dict[str, CheckedGraph] = {}
        self.hosts: dict[str, Host] = {}
        self.ledger = lg.Ledger(spark, self.path)
        self.log = EventLog(spark, f"{self.path}/events")
        self.running: dict[str, threading.Thread] = {}
        self.closed = False
        # jobs that were running when the last engine ended are interrupted; none is resumed unasked
        if store.exists(spark, f"{self.path}/jobs"):
            if bad := self.ledger.unreadable():
                logging.getLogger(__name__).warning("%d job record(s) under %s can't be read and are left out", bad, self.path)
            for row in self.ledger.jobs().where("status = 'running'").toLocalIterator():
                self.ledger.put_job(row["job_id"], "interrupted", row["fingerprint"], row["spec"], row["input"], attempt=row["attempt"] or 0)

    # specs

    def load(self, source: str | Spec) -> CheckedGraph:
        spec = source if isinstance(source, Spec) else parse_spec(source)
        backend = self.backends.resolve(spec.provider, spec.model)
        graph = analyze(spec, self.blocks)
        self.graphs[spec.name] = graph
        self.hosts[spec.name] = Host(backend, tuple(spec.roots), self.audit)
        return graph

    def specs(self) -> list[dict]:
        return [{"name": g.spec.name, "description": g.spec.description, "data_policy": g.spec.data_policy} for _, g in sorted(self.graphs.items())]

    def graph(self, name: str) -> CheckedGraph:
        if name not in self.graphs:
            raise JobError(f"no spec {name!r}", 404)
        return self.graphs[name]

    # jobs

    def submit_all(self, name: str, jobs: DataFrame, batch: str | None = None) -> DataFrame:
        """Envelopes of many jobs (job_id, input VARIANT) of a graph without fan-out, in one plan.

        With a ``batch`` they are recorded under that name, and jobs that it has recorded aren't run again.
        """
        graph = self.graph(name)
        if batch is None:
            return envelopes(graph, compile_graph(graph, jobs, self.hosts[name]))
        path, pinned = f"{self.path}/batches/{store.key(batch)}", f"{self.path}/batches/{store.key(batch)}.spec"
        before = store.read(self.spark, pinned)
        if before not in (None, graph.fingerprint):
            raise JobError(f"the spec of batch {batch!r} changed since it began", 409)
        store.write(self.spark, pinned, graph.fingerprint)
        if store.exists(self.spark, path):
            jobs = lg.pending(jobs, self.spark.read.parquet(path), "job_id")
        envelopes(graph, compile_graph(graph, jobs, self.hosts[name])).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def submit(self, name: str, value, job_id: str | None = None) -> dict:
        """Run a job to its end; its envelope."""
        graph, job_id = self._begin(name, value, job_id)
        return self._run(graph, job_id, value)

    def start(self, name: str, value, job_id: str | None = None) -> str:
        """Start a job and return its id at once."""
        graph, job_id = self._begin(name, value, job_id)
        thread = threading.Thread(target=inheritable_thread_target(self.spark)(self._run), args=(graph, job_id, value), daemon=True)
        self.running[job_id] = thread
        thread.start()
        return job_id

    def wait(self, job_id: str, timeout: float | None = None) -> dict | None:
        """The envelope of a job once it has ended; null if it hasn't within ``timeout`` seconds."""
        if job_id in self.running:
            self.running[job_id].join(timeout)
        row = self._record(job_id)
        return {"job_id": job_id} | json.loads(row["envelope"]) if row["envelope"] else None

    def _begin(self, name: str, value, job_id: str | None) -> tuple[CheckedGraph, str]:
        if self.closed:
            raise JobError("the engine is shutting down", 503)
        graph = self.graph(name)
        job_id = job_id or uuid.uuid4().hex
        self.ledger.put_job(job_id, "running", graph.fingerprint, name, json.dumps(value))
        return graph, job_id

    def _state(self, job_id: str, value, outputs: dict[str, str | None]) -> DataFrame:
        """One row with the job's input and the state after the nodes that have run; None is a skipped node."""
        df = self.spark.createDataFrame([(job_id, json.dumps(value), list(outputs.values()))], "job_id string, j string, o array<string>")
        df = first_state(df.select("job_id", F.parse_json("j").alias("input"), "o"))
        for i, (name, output) in enumerate(outputs.items()):
            df = df.withColumns({output_column(name): F.parse_json(F.get("o", F.lit(i))), f"s_{name}": F.lit(output is None)})
        return df.drop("o")

    def _run(self, graph: CheckedGraph, job_id: str, value, attempt: int = 0) -> dict:
        began = time.time()
        usage = {"tokens_in": 0, "tokens_out": 0}

        def end(status: str, **more) -> dict:
            spent = usage | {"duration_ms": int(1000 * (time.time() - began)), "model": graph.spec.model}
            envelope = {"status": status, "usage": spent} | more
            self.ledger.put_job(job_id, status, graph.fingerprint, graph.spec.name, json.dumps(value), envelope, attempt)
            self.log.append(job_id, ("result", json.dumps(envelope)))
            return {"job_id": job_id} | envelope

        context, tag = self.spark.sparkContext, f"sluiceway-{store.key(job_id)}"
        context.addJobTag(tag)
        try:
            return self._nodes(graph, job_id, value, usage, end)
        except Cancelled:
            return end("cancelled", error={"code": "cancelled", "message": "the job was cancelled"})
        except Exception as e:
            if self.ledger.marked("cancel", job_id):  # its Spark jobs were stopped
                return end("cancelled", error={"code": "cancelled", "message": "the job was cancelled"})
            end("failed", error={"code": "internal", "message": f"{type(e).__name__}: {str(e)[:500]}"})
            raise
        finally:
            context.removeJobTag(tag)

    def _nodes(self, graph: CheckedGraph, job_id: str, value, usage: dict, end) -> dict:
        outputs: dict[str, str | None] = {}
        host = self.hosts[graph.spec.name].with_root(self.ledger.results(job_id))
        for place, checked in enumerate(graph.nodes, 1):
            node = checked.node
            if self.ledger.marked("cancel", job_id):
                raise Cancelled
            stage = {"stage": place, "of": len(graph.nodes), "node": node.name}
            if len(graph.nodes) > 1:
                self.log.append(job_id, ("progress", json.dumps(stage)))
            kept = self.ledger.node_output(job_id, node.name)
            if kept is None and node.over:
                try:
                    items, digest = read_manifest(self.spark, node.over)
                    record, spent = run_fanout(self.ledger, job_id, node.name, items, digest, checked.block, host)
                except (ManifestError, FanoutFailed) as e:
                    return end("failed", error={"code": "schema_validation_failed", "message": str(e)})
                said = self.ledger.events(job_id, node.name)
                if not said.isEmpty():
                    self.log.append_rows(job_id, said)
                n = record["succeeded"] + record["failed"]
                self.log.append(job_id, ("progress", json.dumps(stage | {"item": n, "items": n, "succeeded": record["succeeded"], "failed": record["failed"]})))
                kept = {"output": json.dumps(record), "usage": spent}
                self.ledger.put_output(job_id, node.name, **kept)
            if kept is None:
                row = run_node(self._state(job_id, value, outputs), graph, checked, place, host).select(
                    F.col(f"`s_{node.name}`").alias("skipped"), F.to_json(f"`{output_column(node.name)}`").alias("output"), "failure", "tokens_in", "tokens_out", "events").first()
                self.log.append(job_id, *[(e["type"], e["payload"]) for e in row["events"]])
                kept = {"output": None if row["skipped"] else row["output"], "usage": {"tokens_in": row["tokens_in"], "tokens_out": row["tokens_out"]}}
                if row["failure"] is None and kept["output"] is not None:
                    self.ledger.put_output(job_id, node.name, **kept)
                if row["failure"] is not None:
                    for k in usage:
                        usage[k] += kept["usage"][k]
                    return end("failed", error=row["failure"].asDict())
            for k in usage:
                usage[k] += kept["usage"].get(k, 0)
            outputs[node.name] = kept["output"]
        live = [o for o in outputs.values() if o is not None]
        if not live:
            return end("failed", error={"code": "schema_validation_failed", "message": "every node was skipped"})
        return end("completed", result=json.loads(live[-1]))

    def jobs(self) -> DataFrame:
        return self.ledger.jobs().select("job_id", "status", "spec", "envelope", "updated_at")

    def _record(self, job_id: str) -> dict:
        row = self.ledger.job(job_id)
        if row is None:
            raise JobError(f"no job {job_id}", 404)
        return row

    def status(self, job_id: str) -> str:
        return self._record(job_id)["status"]

    def events(self, job_id: str) -> DataFrame:
        return self.log.read(job_id)

    def cancel(self, job_id: str) -> str:
        """An interrupted job is cancelled at once; a running one has its Spark jobs stopped, whichever process asks."""
        row = self._record(job_id)
        if row["status"] == "interrupted":
            self.ledger.put_job(job_id, "cancelled", row["fingerprint"], row["spec"], row["input"], attempt=row["attempt"] or 0)
        elif row["status"] not in TERMINAL:
            self.ledger.mark("cancel", job_id)
            self.spark.sparkContext.cancelJobsWithTag(f"sluiceway-{store.key(job_id)}")
        return self.status(job_id)

    def resume(self, job_id: str) -> dict:
        """Run what an interrupted job hasn't concluded. Of several callers, in whatever process, one resumes it."""
        row = self._record(job_id)
        if row["status"] != "interrupted":
            raise JobError(f"job {job_id} is {row['status']}, not interrupted", 409)
        graph = self.graph(row["spec"])
        if graph.fingerprint != row["fingerprint"]:
            raise JobError(f"the spec of job {job_id} changed since it began", 409)
        attempt = (row["attempt"] or 0) + 1
        if not self.ledger.claim(job_id, attempt):
            raise JobError(f"job {job_id} is being resumed", 409)
        self.ledger.put_job(job_id, "running", row["fingerprint"], row["spec"], row["input"], attempt=attempt)
        return self._run(graph, job_id, json.loads(row["input"]), attempt)

    def stop(self, grace: float = 10.0) -> None:
        """Take no more jobs, give running ones ``grace`` seconds, then stop them; they can be resumed later."""
        self.closed = True
        until = time.time() + grace
        for job_id, thread in list(self.running.items()):
            thread.join(max(until - time.time(), 0))
            if thread.is_alive():
                self.spark.sparkContext.cancelJobsWithTag(f"sluiceway-{store.key(job_id)}")
                thread.join(grace)
                row = self._record(job_id)
                self.ledger.put_job(job_id, "interrupted", row["fingerprint"], row["spec"], row["input"], attempt=row["attempt"] or 0)
