"""Compile a checked graph to a DataFrame: one row is one job.

Each node is a few projections over plain columns: ``o_<node>`` is its output, ``s_<node>`` says whether it
was skipped, ``failure`` is the first failure so far, and tokens and events add up. A projection names what
the next ones use, so plans grow with the number of nodes and not with the number of paths; a column of no
meaning at the end keeps filters from being pushed, and so copied, into the nodes. Runs of SQL blocks are
compiled together; a Python block is an Arrow stage between two.

A node runs on a row if the row hasn't failed, its routes are taken and nothing it reads was
skipped; otherwise its input is null and its block, which does nothing on null, isn't run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.plans.analyze import CheckedGraph, CheckedNode
from sluiceway.operators.host import HOST_CODES
from sluiceway.plans.blocks import ADDED, CODE, EVENT, EVENTS, JSON_NULL, MESSAGE, OUTPUT, TOKENS_IN, TOKENS_OUT
from sluiceway.plans.speclang import FromNode, InputExpr, RecordExpr, references

FAILURE = "struct<code: string, message: string>"


def result_column(name: str) -> str:
    return f"n_{name}"


def output_column(name: str) -> str:
    return f"o_{name}"


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compose(expr: InputExpr | None, job_input: str = "__job") -> str:
    """SQL text of a node's input; an output that is absent composes as JSON null."""
    if expr is None:
        return job_input
    if isinstance(expr, FromNode):
        return f"coalesce(`{output_column(expr.node)}`, {JSON_NULL})"
    if isinstance(expr, RecordExpr):
        fields = ", ".join(f"{text(k)}, {compose(e, job_input)}" for k, e in expr.fields)
        return f"to_variant_object(named_struct({fields}))" if fields else "parse_json('{}')"
    return f"to_variant_object(array({', '.join(compose(e, job_input) for e in expr.items)}))"


def _label(output: str) -> str:
    """SQL text of a decision's route, null if it isn't text."""
    route = f"try_variant_get({output}, '$.route', 'variant')"
    return f"if(schema_of_variant({route}) = 'STRING', try_variant_get({output}, '$.route', 'string'), null)"


def _among(value: str, labels) -> str:
    return f"coalesce({value} in ({', '.join(map(text, sorted(labels)))}), false)" if labels else "false"


def first_state(jobs: DataFrame) -> DataFrame:
    """``jobs`` before any node; the input is taken for no constant, which would be copied into all that reads it."""
    return jobs.withColumns({"input": F.when(F.spark_partition_id() >= 0, F.col("input")), "failure": F.lit(None).cast(FAILURE), "tokens_in": F.lit(0).cast("long"), "tokens_out": F.lit(0).cast("long"), "events": F.array().cast(f"array<{EVENT}>")})


def run_node(df: DataFrame, graph: CheckedGraph, checked: CheckedNode, place: int, host=None) -> DataFrame:
    """``df`` with the state after one more node."""
    node, block = checked.node, checked.block
    taken = [_among(_label(f"`{output_column(d)}`"), labels) for d, labels in checked.gates.items()]
    read = [f"not `s_{r}`" for r in dict.fromkeys(references(node.input)) if r != node.name]
    live = " and ".join([*taken, *read]) or "true"
    source = compose(node.input) if node.name not in references(node.input) else JSON_NULL  # a loop on itself starts from null
    df = df.withColumns({"__live": F.expr(live), "__job": F.col("input")})
    df = block.run(df.withColumn("input", F.expr(f"if(__live and failure is null, {source}, null)")), host, node.repeat_until, node.max_iterations or 1)

    blame = text(f"block {place} of the pipeline: ") if place > 1 else "''"
    said = f"if({CODE} in ({', '.join(map(text, HOST_CODES))}), {MESSAGE}, concat({blame}, {MESSAGE}))"
    promised = text(f"node {node.name!r} promised {block.signature.output.describe()} and gave something else")
    cases = f"when input is null then null when {CODE} is not null then named_struct('code', {CODE}, 'message', {said}) "
    cases += f"when not {block.signature.output.accepts_sql(OUTPUT)} then named_struct('code', 'schema_validation_failed', 'message', {promised}) "
    if node.name in graph.spec.branches:
        labels = sorted({label for label, _ in graph.spec.branches[node.name]})
        bad = f"concat({text(f'decision {node.name!r} gave the route ')}, coalesce({_label(OUTPUT)}, 'none'), {text(f'; declared are {labels}')})"
        cases += f"when not {_among(_label(OUTPUT), labels)} then named_struct('code', 'schema_validation_failed', 'message', {bad}) "
    df = df.withColumn("__fail", F.expr(f"cast(case {cases} end as {FAILURE})"))
    state = {
        "input": F.col("__job"), "failure": F.coalesce("failure", "__fail"), f"s_{node.name}": ~F.col("__live"),
        output_column(node.name): F.when(F.col("__fail").isNull(), F.col(OUTPUT)),
    }
    if TOKENS_IN in df.columns:
        state |= {"tokens_in": F.col("tokens_in") + F.col(TOKENS_IN), "tokens_out": F.col("tokens_out") + F.col(TOKENS_OUT), "events": F.concat("events", EVENTS)}
    return df.withColumns(state).drop("__live", "__job", "__fail", *ADDED)


def compile_graph(graph: CheckedGraph, jobs: DataFrame, host=None) -> DataFrame:
    """``jobs`` (with input VARIANT) and ``failure``, tokens_in, tokens_out, events, and for each node ``n_<node>`` (struct<output>) and ``s_<node>``."""
    df = first_state(jobs)
    for place, checked in enumerate(graph.nodes, 1):
        if checked.node.over:
            raise ValueError(f"node {checked.node.name!r} is a fan-out: run it by jobs.Engine")
        df = run_node(df, graph, checked, place, host)
    df = df.withColumn("__here", F.spark_partition_id() >= 0)  # true; nothing deterministic can be pushed below it
    here = lambda c: F.when(F.col("__here"), c)
    names = [c.node.name for c in graph.nodes]
    out = {result_column(n): here(F.when(F.col(f"`{output_column(n)}`").isNotNull(), F.struct(F.col(f"`{output_column(n)}`").alias("output")))) for n in names}
    plain = [c for c in ("failure", "tokens_in", "tokens_out", "events", *[f"s_{n}" for n in names])]
    return df.select(*jobs.columns, *[here(F.col(f"`{c}`")).alias(c) for c in plain], *[v.alias(k) for k, v in out.items()])


def envelopes(graph: CheckedGraph, df: DataFrame) -> DataFrame:
    """(job_id, status, result, error, usage): the last node in order that wasn't skipped gives the result; no partial results."""
    last = F.lit(None).cast("variant")
    skipped = F.lit(True)
    for checked in graph.nodes:
        name = checked.node.name
        last = F.when(~F.col(f"s_{name}"), F.col(f"`{result_column(name)}`.output")).otherwise(last)
        skipped = skipped & F.col(f"s_{name}")
    none = F.struct(F.lit("schema_validation_failed").alias("code"), F.lit("every node was skipped").alias("message"))
    error = F.coalesce("failure", F.when(skipped, none))
    return df.select(
        "job_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"),
        F.when(error.isNull(), last).alias("result"), error.alias("error"), F.struct("tokens_in", "tokens_out").alias("usage"),
    )
