"""JSON Schema checks: type, required, properties, enum, items, const, bounds and lengths. Every violation is listed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluiceway.deploy import send_package

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}


def _is(value, name: str) -> bool:
    if isinstance(value, bool):
        return name == "boolean"
    if name == "integer":
        return isinstance(value, int) or (isinstance(value, float) and value.is_integer())
    return name in _TYPES and isinstance(value, _TYPES[name])


def violations(value, schema, path: str = "") -> list[str]:
    """Messages ``path: what`` for everything that doesn't hold."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{path or '/'}: nothing is allowed here"]
    out: list[str] = []
    say = lambda what: out.append(f"{path or '/'}: {what}")
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        say(f"{json.dumps(value)} is not of type {json.dumps(kinds)}")
    if "enum" in schema and value not in schema["enum"]:
        say(f"{json.dumps(value)} is not one of {json.dumps(schema['enum'])}")
    if "const" in schema and value != schema["const"]:
        say(f"{json.dumps(value)} is not {json.dumps(schema['const'])}")
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                say(f"{json.dumps(name)} is a required property")
        known = schema.get("properties", {})
        for name, inner in value.items():
            if name in known:
                out += violations(inner, known[name], f"{path}/{name}")
            elif "additionalProperties" in schema:
                out += violations(inner, schema["additionalProperties"], f"{path}/{name}")
    if isinstance(value, list):
        for at, inner in enumerate(value):
            out += violations(inner, schema.get("items", True), f"{path}/{at}")
        for key, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))):
            if bad:
                say(f"has {len(value)} items, against {key} {schema[key]}")
    if isinstance(value, str):
        for key, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))):
            if bad:
                say(f"has {len(value)} characters, against {key} {schema[key]}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            say(f"{json.dumps(value)} does not match {schema['pattern']}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for key, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))):
            if bad:
                say(f"{value} is against {key} {schema[key]}")
    return out


def violations_column(text, schema: dict):
    """array<string> of the violations of JSON text; text that isn't JSON is one violation."""
    send_package(SparkSession.active())

    def check(value: str | None) -> list[str]:
        try:
            return violations(json.loads(value), schema)
        except (TypeError, ValueError):
            return ["/: not JSON"]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(check)

    return run(text)
