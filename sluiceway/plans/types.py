"""The type algebra of block signatures, and its checks over VARIANT values.

Seven constructors: text, bytes, image, document, json, [T] and {field: T}. ``json`` is the top
type; records have width subtyping. Checks never go through implicit casts: a number is not text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOMS = ("text", "bytes", "image", "document", "json")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


class TypeSyntaxError(ValueError):
    """A type or a signature that can't be read."""


@dataclass(frozen=True)
class Ty:
    kind: str
    item: Ty | None = None
    fields: tuple[tuple[str, Ty], ...] = ()

    def describe(self) -> str:
        if self.kind == "list":
            return f"[{self.item.describe()}]"
        if self.kind == "record":
            return "{" + ", ".join(f"{k}: {t.describe()}" for k, t in self.fields) + "}"
        return self.kind

    def field(self, name: str) -> Ty | None:
        return dict(self.fields).get(name)

    def assignable_to(self, needed: Ty) -> bool:
        if needed.kind == "json":
            return True
        if self.kind != needed.kind:
            return False
        if self.kind == "list":
            return self.item.assignable_to(needed.item)
        if self.kind == "record":
            own = dict(self.fields)
            return all(k in own and own[k].assignable_to(t) for k, t in needed.fields)
        return True

    def accepts(self, value) -> bool:
        """The run-time check on a Python value; bytes, image, document and json accept anything."""
        if self.kind == "text":
            return isinstance(value, str)
        if self.kind == "list":
            return isinstance(value, list) and all(map(self.item.accepts, value))
        if self.kind == "record":
            return isinstance(value, dict) and all(k in value and t.accepts(value[k]) for k, t in self.fields)
        return True

    def accepts_column(self, value: Column) -> Column:
        """The same check as a Boolean expression over a VARIANT; never null."""
        if self.kind == "text":
            check = F.schema_of_variant(value) == "STRING"
        elif self.kind == "list":
            items = value.try_cast("array<variant>")
            check = F.forall(items, self.item.accepts_column)
        elif self.kind == "record":
            check = F.schema_of_variant(value).startswith("OBJECT")
            for name, ty in self.fields:
                part = F.try_variant_get(value, f"$['{name}']", "variant")
                check = check & part.isNotNull() & ty.accepts_column(part)
        else:
            check = value.isNotNull()
        return F.coalesce(check, F.lit(False))

    def accepts_sql(self, value: str, depth: int = 0) -> str:
        """The same check as SQL text over the text of a VARIANT; true or not, never null."""
        if self.kind == "text":
            check = f"schema_of_variant({value}) = 'STRING'"
        elif self.kind == "list":
            check = f"forall(try_cast({value} as array<variant>), e{depth} -> {self.item.accepts_sql(f'e{depth}', depth + 1)})"
        elif self.kind == "record":
            check = f"schema_of_variant({value}) like 'OBJECT%'"
            for name, ty in self.fields:
                part = f"try_variant_get({value}, '$.{name}', 'variant')"
                check += f" and {part} is not null and {ty.accepts_sql(part, depth + 1)}"
        else:
            check = f"{value} is not null"
        return f"coalesce({check}, false)"

    def to_spark(self) -> T.DataType:
        if self.kind == "text":
            return T.StringType()
        if self.kind == "bytes":
            return T.BinaryType()
        if self.kind == "image":
            return T.StructType([T.StructField("handle", T.LongType()), T.StructField("format", T.StringType()), T.StructField("content", T.BinaryType())])
        if self.kind == "document":
            parts = (("handle", T.LongType()), ("path", T.StringType()), ("pages", T.IntegerType()), ("has_text_layer", T.BooleanType()))
            return T.StructType([T.StructField(k, t) for k, t in parts])
        if self.kind == "list":
            return T.ArrayType(self.item.to_spark(), False)
        if self.kind == "record":
            return T.StructType([T.StructField(k, t.to_spark()) for k, t in self.fields])
        return T.VariantType()


TEXT, BYTES, IMAGE, DOCUMENT, JSON = (Ty(k) for k in ATOMS)
#: What a fan-out node shows to the nodes after it; counts are json, since there is no number type.
COLLECTION = Ty("record", fields=(("failed", JSON), ("failures_path", TEXT), ("results_path", TEXT), ("succeeded", JSON)))


def list_of(item: Ty) -> Ty:
    return Ty("list", item=item)


def record(fields: dict[str, Ty]) -> Ty:
    return Ty("record", fields=tuple(sorted(fields.items())))


def _split_top(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for at, char in enumerate(text):
        depth += (char in "[{") - (char in "]}")
        if depth < 0:
            raise TypeSyntaxError(f"unbalanced brackets in {text!r}")
        if char == "," and depth == 0:
            parts.append(text[start:at])
            start = at + 1
    if depth:
        raise TypeSyntaxError(f"unbalanced brackets in {text!r}")
    parts.append(text[start:])
    if parts and not parts[-1].strip():
        parts.pop()  # a trailing comma, or nothing at all
    return parts


def parse(text: str) -> Ty:
    """Read the compact form. A repeated field keeps its last type."""
    text = text.strip()
    if text in ATOMS:
        return Ty(text)
    if text.startswith("[") and text.endswith("]"):
        return list_of(parse(text[1:-1]))
    if text.startswith("{") and text.endswith("}"):
        fields = {}
        for part in _split_top(text[1:-1]):
            name, colon, rest = part.partition(":")
            if not colon or not _NAME.match(name.strip()):
                raise TypeSyntaxError(f"expected `name: type`, found {part.strip()!r}")
            fields[name.strip()] = parse(rest)
        return record(fields)
    raise TypeSyntaxError(f"unknown type {text!r}")


@dataclass(frozen=True)
class Signature:
    input: Ty = JSON
    output: Ty = JSON

    def describe(self) -> str:
        return f"{self.input.describe()} -> {self.output.describe()}"


def parse_signature(text: str) -> Signature:
    left, arrow, right = text.partition(" -> ")
    if not arrow:
        raise TypeSyntaxError(f"a signature is `input -> output`, found {text!r}")
    return Signature(parse(left), parse(right))
