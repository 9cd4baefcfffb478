"""Blocks: the bodies of nodes. SQL blocks stay inside Catalyst plans; Python blocks run in Arrow batches.

A SQL block is an expression over the VARIANT ``input`` whose result is a VARIANT. A Python block is
``fn(value, host) -> value``; it ends its item by raising BlockFailed. What it asks of the host is a
function of its input and of the host's answers; audit mode checks that. Python blocks run with the
workers' rights; there is no sandbox, and roots bind what they open through the host.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantVal

from sluiceway.deploy import send_package
from sluiceway.operators.host import DIVERGED, HOST_CODES, Host, HostFailed, Recorded, Replayed
from sluiceway.plans.types import Signature, TypeSyntaxError, parse_signature

RESULT = "struct<output: variant, code: string, message: string>"
JSON_NULL = "parse_json('null')"
_HEADER = re.compile(r"^\s*(?:--|#)\s*signature:\s*(.*?)\s*$")
_HEADER_LINES = 10


class BlockFailed(Exception):
    """Ends an item with a code and a message."""

    def __init__(self, message: str, code: str = "script_error"):
        super().__init__(message)
        self.code, self.message = code, message


#: Columns that a block's run adds to rows.
OUTPUT, CODE, MESSAGE, TOKENS_IN, TOKENS_OUT, EVENTS = "__output", "__code", "__message", "__tokens_in", "__tokens_out", "__events"
ADDED = (OUTPUT, CODE, MESSAGE, TOKENS_IN, TOKENS_OUT, EVENTS)
EVENT = "struct<type: string, payload: string>"


def bound(expression: str, value: str) -> str:
    """SQL text of an expression whose ``input`` is the value of another, computed once."""
    return f"element_at(transform(array({value}), input -> {expression}), 1)"


@dataclass(frozen=True)
class SqlBlock:
    """Where the SQL text ``error`` isn't null, it is the failure's message."""

    expression: str
    signature: Signature = field(default_factory=Signature)
    error: str | None = None

    def source(self) -> str:
        return json.dumps([self.signature.describe(), self.expression, self.error])

    def once(self, value: str) -> str:
        """SQL text of RESULT for one run over a value that isn't null."""
        message = f"cast({self.error} as string)" if self.error else "cast(null as string)"
        body = f"element_at(transform(array({message}), message -> named_struct('output', if(message is null, coalesce({self.expression}, {JSON_NULL}), null), 'code', if(message is null, null, 'script_error'), 'message', message)), 1)"
        return bound(body, value)

    def apply(self, value: str) -> str:
        """SQL text of RESULT; null for null."""
        return f"if({value} is null, null, {self.once(value)})"

    def run(self, df: DataFrame, host=None, until: str | None = None, most: int = 1) -> DataFrame:
        """``df`` with the first three of ADDED: the block's run on the column ``input``; a null input runs nothing."""
        if until:
            looped = df.withColumn("__r", F.expr(self.loop("input", until, most)))
            return looped.withColumns({OUTPUT: F.col("__r.output"), CODE: F.col("__r.code"), MESSAGE: F.col("__r.message")}).drop("__r")
        # plain projections: each is compiled code, and names what the next one uses
        message = F.expr(f"if(input is null, null, cast({self.error} as string))") if self.error else F.lit(None).cast("string")
        output = F.expr(f"if(input is null or {MESSAGE} is not null, null, coalesce({self.expression}, {JSON_NULL}))")
        code = F.expr(f"if({MESSAGE} is null, cast(null as string), 'script_error')")
        return df.withColumn(MESSAGE, message).withColumns({OUTPUT: output, CODE: code})

    def loop(self, value: str, until: str, most: int) -> str:
        """SQL text: run on its own output until its field ``until`` is "done"; failing after ``most`` runs."""
        run = self.once("acc.r.output")
        done = f"(try_variant_get(r.output, '$.{until}', 'variant') is not null and schema_of_variant(try_variant_get(r.output, '$.{until}', 'variant')) = 'STRING' and try_variant_get(r.output, '$.{until}', 'string') = 'done')"
        step = f"element_at(transform(array({run}), r -> named_struct('r', r, 'stop', r.code is not null or coalesce({done}, false))), 1)"
        start = f"named_struct('r', cast(named_struct('output', {value}, 'code', cast(null as string), 'message', cast(null as string)) as {RESULT}), 'stop', false)"
        text = f"aggregate(sequence(1, {most}), {start}, (acc, i) -> if(acc.stop, acc, {step}))"
        gave_up = f"named_struct('output', cast(null as variant), 'code', 'schema_validation_failed', 'message', 'the loop ran {most} times without reaching done')"
        return f"if({value} is null, null, element_at(transform(array({text}), t -> if(t.stop, t.r, {gave_up})), 1))"


@dataclass(frozen=True)
class PyBlock:
    fn: Callable
    signature: Signature = field(default_factory=Signature)
    name: str = "block"
    text: str | None = None  # its source, where it came from one

    def source(self) -> str:
        if self.text is not None:
            return json.dumps([self.signature.describe(), self.name, self.text])
        code = getattr(self.fn, "__code__", None)
        return json.dumps([self.signature.describe(), self.name, code.co_code.hex() if code else "", repr(code.co_consts) if code else ""])

    def run(self, df: DataFrame, host: Host | None = None, until: str | None = None, most: int = 1) -> DataFrame:
        """``df`` with the columns ADDED: the block's run on the column ``input``; a null input runs nothing."""
        fn, name, host = self.fn, self.name, host or Host()
        send_package(df.sparkSession)

        @F.pandas_udf(f"struct<output: string, code: string, message: string, tokens_in: long, tokens_out: long, events: array<{EVENT}>>")
        def ran(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([run_python(fn, name, v, host, until, most) for v in batch], columns=["output", "code", "message", "tokens_in", "tokens_out", "events"])

        # evaluated once where it stands: a block may call a model
        df = df.withColumn("__raw", ran.asNondeterministic()(F.to_json("input")))
        parts = {OUTPUT: F.try_parse_json("__raw.output"), CODE: F.col("__raw.code"), MESSAGE: F.col("__raw.message"),
                 TOKENS_IN: F.col("__raw.tokens_in"), TOKENS_OUT: F.col("__raw.tokens_out"), EVENTS: F.col("__raw.events")}
        return df.withColumns(parts).drop("__raw")


def run_python(fn: Callable, name: str, text: str | None, host: Host, until: str | None = None, most: int = 1) -> tuple:
    """One run: output, code, message, tokens_in, tokens_out, events."""
    if text is None:
        return None, None, None, 0, 0, []
    session = host.session()
    asked = Recorded(session) if host.audit else session
    out = _run_once(fn, name, text, asked, until, most)
    if host.audit and (out[1] is None or out[1] in HOST_CODES or out[1] == "script_error"):
        again = Replayed(asked.log)
        second = _run_once(fn, name, text, again, until, most)
        if second != out or again.at != len(asked.log):
            why = second[2] if second[1] == DIVERGED else "the replay gave another result"
            out = None, DIVERGED, f"{name}: {why}"
    events = [{"type": kind, "payload": json.dumps(value, ensure_ascii=False)} for kind, value in session.events]
    return *out, session.tokens_in, session.tokens_out, events


def _run_once(fn: Callable, name: str, text: str, host, until: str | None, most: int) -> tuple:
    value = json.loads(text)
    try:
        for _ in range(most):
            value = fn(value, host)
            if isinstance(value, VariantVal):
                value = value.toPython()
            if until is None or (isinstance(value, dict) and value.get(until) == "done"):
                return json.dumps(value, ensure_ascii=False), None, None
        return None, "schema_validation_failed", f"the loop ran {most} times without reaching done"
    except (BlockFailed, HostFailed) as failed:
        return None, failed.code, failed.message
    except Exception as broken:  # an item's failure is a row, not the end of the stage
        return None, "block_trap", f"{name}: {type(broken).__name__}: {broken}"


def read_header(source: str) -> Signature:
    """The one ``-- signature: A -> B`` line among the first lines of a block's text."""
    found = [m[1] for line in source.splitlines()[:_HEADER_LINES] if (m := _HEADER.match(line))]
    if len(found) != 1:
        raise TypeSyntaxError(f"a block's first {_HEADER_LINES} lines hold one signature line; found {len(found)}")
    return parse_signature(found[0])


def sql_block(source: str) -> SqlBlock:
    """A SQL block from its text: a signature header, then one expression."""
    signature = read_header(source)
    body = "\n".join(line for line in source.splitlines() if not line.lstrip().startswith("--")).strip()
    if not body:
        raise TypeSyntaxError("the block has no expression")
    return SqlBlock(body, signature)


def py_block(fn: Callable, name: str | None = None) -> PyBlock:
    """A Python block whose docstring's first lines may hold ``signature: A -> B``; without one it takes and gives any JSON."""
    name = name or fn.__name__
    found = [m[1] for line in (fn.__doc__ or "").splitlines()[:_HEADER_LINES] if (m := re.match(r"\s*signature:\s*(.*?)\s*$", line))]
    if not found:
        warnings.warn(f"block {name!r} has no signature: it takes and gives any JSON", stacklevel=2)
        return PyBlock(fn, Signature(), name)
    return PyBlock(fn, parse_signature(found[0]), name)


def python_block(source: str, name: str = "block") -> PyBlock:
    """A Python block from its text: a module whose docstring or ``run`` has a signature, and ``run(value, host)``."""
    try:
        scope: dict = {"__name__": f"block_{re.sub('[^A-Za-z0-9]', '_', name)}"}
        exec(compile(source, name, "exec"), scope)
    except Exception as e:
        raise TypeSyntaxError(f"{name} doesn't compile: {type(e).__name__}: {e}") from None
    if not callable(scope.get("run")):
        raise TypeSyntaxError(f"{name} has no function run(value, host)")
    fn = scope["run"]
    fn.__doc__ = fn.__doc__ or scope.get("__doc__")
    block = py_block(fn, name)
    return PyBlock(block.fn, block.signature, name, source)


def check_sql(spark, block: SqlBlock) -> None:
    """Analyse a SQL block over an empty frame; raises if it doesn't compile."""
    spark.sql("SELECT parse_json('null') AS input LIMIT 0").select(F.expr(block.apply("input")))
