"""Bundles: a chain of blocks in one file, the same bytes for the same content."""

from __future__ import annotations

import base64
import json

from sluiceway.plans.analyze import CheckedGraph
from sluiceway.plans.blocks import SqlBlock

MAGIC = b"SWBD"


class BundleError(ValueError):
    """A bundle that can't be written or read."""


def build(graph: CheckedGraph) -> bytes:
    if not graph.spec.is_chain():
        raise BundleError("only a plain chain of nodes can be bundled")
    if any(isinstance(c.block, SqlBlock) for c in graph.nodes):
        raise BundleError("script blocks can't be bundled: keep them in the catalog")
    parts = [{"name": c.node.name, "block": c.node.block, "signature": c.block.signature.describe(), "source": base64.b64encode(c.block.source().encode()).decode()} for c in graph.nodes]
    body = json.dumps({"spec": graph.spec.name, "nodes": parts}, sort_keys=True, separators=(",", ":")).encode()
    return MAGIC + len(body).to_bytes(8, "little") + body


def read(content: bytes) -> dict:
    if content[: len(MAGIC)] != MAGIC:
        raise BundleError("not a bundle")
    size = int.from_bytes(content[4:12], "little")
    if len(content) < 12 or size != len(content) - 12:
        raise BundleError("the bundle is cut short")
    return json.loads(content[12:])
