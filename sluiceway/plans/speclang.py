"""The spec language: text to tokens to a Spec.

Stricter than a lenient reader would be: text after the spec, repeated fields, repeated node names
and ``max_iterations`` without ``repeat_until`` are errors.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t"}
_IDENT = re.compile(r"[^\W]|[_./]")
_PUNCT = "{}[]=;,"


class SpecError(ValueError):
    """A spec that can't be read, with the place where reading stopped."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"line {line}, column {column}: {message}" if line else message)
        self.line, self.column = line, column


@dataclass(frozen=True)
class Token:
    kind: str  # ident, string, punct, arrow, end
    text: str
    line: int
    column: int


def lex(source: str) -> list[Token]:
    tokens, at, line, start_of_line = [], 0, 1, 0

    def here() -> tuple[int, int]:
        return line, at - start_of_line + 1

    while at < len(source):
        char = source[at]
        if char == "\n":
            at, line, start_of_line = at + 1, line + 1, at + 1
        elif char.isspace():
            at += 1
        elif char == "#":
            while at < len(source) and source[at] != "\n":
                at += 1
        elif char == '"':
            place, out = here(), []
            at += 1
            while True:
                if at >= len(source):
                    raise SpecError("a string isn't closed", *place)
                char = source[at]
                if char == '"':
                    break
                if char == "\\":
                    if at + 1 >= len(source) or source[at + 1] not in _ESCAPES:
                        raise SpecError("unknown escape in a string", *here())
                    out.append(_ESCAPES[source[at + 1]])
                    at += 2
                    continue
                out.append(char)
                at += 1
                if char == "\n":
                    line, start_of_line = line + 1, at
            tokens.append(Token("string", "".join(out), *place))
            at += 1
        elif source.startswith("->", at):
            tokens.append(Token("arrow", "->", *here()))
            at += 2
        elif char in _PUNCT:
            tokens.append(Token("punct", char, *here()))
            at += 1
        elif _IDENT.match(char):
            start, place = at, here()
            while at < len(source) and (_IDENT.match(source[at]) or source[at] == ":" or (source[at] == "-" and not source.startswith("->", at))):
                at += 1
            tokens.append(Token("ident", source[start:at], *place))
        else:
            raise SpecError(f"unexpected character {char!r}", *here())
    tokens.append(Token("end", "end of file", *here()))
    return tokens


@dataclass(frozen=True)
class FromNode:
    node: str


@dataclass(frozen=True)
class RecordExpr:
    fields: tuple[tuple[str, InputExpr], ...]


@dataclass(frozen=True)
class ListExpr:
    items: tuple[InputExpr, ...]


InputExpr = FromNode | RecordExpr | ListExpr


def references(expr: InputExpr | None) -> list[str]:
    if isinstance(expr, FromNode):
        return [expr.node]
    if isinstance(expr, RecordExpr):
        return [r for _, e in expr.fields for r in references(e)]
    if isinstance(expr, ListExpr):
        return [r for e in expr.items for r in references(e)]
    return []


@dataclass(frozen=True)
class Node:
    name: str
    block: str
    input: InputExpr | None = None
    over: str | None = None
    repeat_until: str | None = None
    max_iterations: int | None = None


@dataclass(frozen=True)
class Spec:
    name: str
    description: str
    provider: str
    model: str
    data_policy: str
    roots: tuple[str, ...]
    nodes: tuple[Node, ...]
    branches: dict[str, tuple[tuple[str, str], ...]] = field(default_factory=dict)

    def node(self, name: str) -> Node | None:
        return next((n for n in self.nodes if n.name == name), None)

    def is_chain(self) -> bool:
        """Whether the whole graph is a chain of plain nodes: the first without input, each other reading the one before."""
        for before, node in zip((None, *self.nodes), self.nodes, strict=False):
            if node.over or node.repeat_until or self.branches:
                return False
            if node.input != (FromNode(before.name) if before else None):
                return False
        return True


class _Parser:
    def __init__(self, source: str):
        self.tokens, self.at = lex(source), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str, token: Token | None = None):
        token = token or self.now
        raise SpecError(message, token.line, token.column)

    def take(self, kind: str, text: str | None = None) -> str:
        token = self.now
        if token.kind != kind or (text is not None and token.text != text):
            self.fail(f"expected {text or kind}, found {token.text!r}")
        self.at += 1
        return token.text

    def maybe(self, text: str) -> bool:
        if self.now.kind in ("punct", "arrow") and self.now.text == text:
            self.at += 1
            return True
        return False

    def entries(self, what: str):
        """``{ name = value; ... }``: yields names, each once; the caller reads the value."""
        self.take("punct", "{")
        seen: set[str] = set()
        while not self.maybe("}"):
            token = self.now
            name = self.take("ident")
            if name in seen:
                self.fail(f"{what} {name!r} is given twice", token)
            seen.add(name)
            self.take("punct", "=")
            yield name, token
            self.maybe(";")

    def spec(self) -> Spec:
        self.take("ident", "spec")
        name = self.take("ident")
        self.take("punct", "=")
        got: dict = {}
        readers = {
            "description": lambda: self.take("string"), "model": self.model, "data_policy": self.policy,
            "capabilities": self.capabilities, "block": lambda: self.take("string"), "nodes": self.nodes, "branches": self.branches,
        }
        for key, token in self.entries("field"):
            if key not in readers:
                self.fail(f"unknown field {key!r}", token)
            got[key] = readers[key]()
        if self.now.kind != "end":
            self.fail("nothing may follow the spec")
        for key in ("description", "model", "data_policy", "capabilities"):
            if key not in got:
                self.fail(f"missing field {key!r}")
        if ("block" in got) == ("nodes" in got):
            self.fail("a spec needs either `block` or `nodes`")
        nodes = got.get("nodes") or (Node("main", got["block"]),)
        spec = Spec(name, got["description"], *got["model"], got["data_policy"], got["capabilities"], nodes, got.get("branches", {}))
        for node in nodes:
            if node.over and not any(is_under(node.over, root) for root in spec.roots):
                raise SpecError(f"node {node.name!r}: manifest {node.over!r} lies under none of the granted roots")
        return spec

    def model(self) -> tuple[str, str]:
        token = self.now
        provider = self.take("ident").lower()
        if not re.fullmatch(r"\w+", provider):
            self.fail(f"provider {provider!r} may have letters, digits and underscores", token)
        return provider, self.take("string")

    def policy(self) -> str:
        token = self.now
        policy = self.take("ident")
        if policy not in ("Local_only", "Any"):
            self.fail(f"data_policy is Local_only or Any, found {policy!r}", token)
        return policy

    def capabilities(self) -> tuple[str, ...]:
        self.take("punct", "[")
        roots = []
        while not self.maybe("]"):
            token = self.now
            if (kind := self.take("ident")) != "Read":
                self.fail(f"the only capability is Read, found {kind!r}", token)
            roots.append(self.take("string"))
            if not self.maybe(","):
                self.take("punct", "]")
                break
        return tuple(roots)

    def nodes(self) -> tuple[Node, ...]:
        start = self.now
        nodes = tuple(self.node(name) for name, _ in self.entries("node"))
        if not nodes:
            self.fail("`nodes` needs at least one node", start)
        return nodes

    def node(self, name: str) -> Node:
        start, got = self.now, {}
        for key, token in self.entries("node field"):
            if key in ("block", "over", "repeat_until"):
                got[key] = self.take("string")
            elif key == "in":
                got["input"] = self.expr()
            elif key == "max_iterations":
                number = self.take("ident")
                if not number.isdigit() or int(number) < 1:
                    self.fail("max_iterations is a whole number from 1", token)
                got[key] = int(number)
            else:
                self.fail(f"unknown node field {key!r}", token)
        if "block" not in got:
            self.fail(f"node {name!r} needs a block", start)
        if ("repeat_until" in got) != ("max_iterations" in got):
            self.fail(f"node {name!r}: repeat_until and max_iterations go together", start)
        if "over" in got and "repeat_until" in got:
            self.fail(f"node {name!r}: `over` and `repeat_until` exclude each other", start)
        return Node(name, **got)

    def expr(self) -> InputExpr:
        if self.now.text == "{" and self.now.kind == "punct":
            return RecordExpr(tuple((name, self.expr()) for name, _ in self.entries("record field")))
        if self.maybe("["):
            items = []
            while not self.maybe("]"):
                items.append(self.expr())
                if not self.maybe(","):
                    self.take("punct", "]")
                    break
            return ListExpr(tuple(items))
        token = self.now
        ident = self.take("ident")
        if not ident.endswith(".out") or "." in ident[:-4] or not ident[:-4]:
            self.fail(f"an input is a whole output, `node.out`, found {ident!r}", token)
        return FromNode(ident[:-4])

    def branches(self) -> dict[str, tuple[tuple[str, str], ...]]:
        out = {}
        for decision, _ in self.entries("decision"):
            self.take("punct", "{")
            routes = []
            while not self.maybe("}"):
                label = self.take("string")
                self.take("arrow")
                routes.append((label, self.take("ident")))
                self.maybe(";")
            out[decision] = tuple(routes)
        return out


def is_under(path: str, root: str) -> bool:
    """Whether a path lies at or under a root, by components; ``..`` never does."""
    parts, base = ([p for p in posixpath.normpath(x).split("/") if p != "."] for x in (path, root))
    return ".." not in path.split("/") and parts[: len(base)] == base


def parse_spec(source: str) -> Spec:
    return _Parser(source).spec()
