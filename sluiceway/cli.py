"""Command line: run, specs, catalog, validate-json, block, build, models. ``run`` exits 0, 1 or 2."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

from sluiceway.functions.schema import violations
from sluiceway.plans.analyze import analyze
from sluiceway.plans.speclang import SpecError, parse_spec
from sluiceway.sources import bundle
from sluiceway.sources.catalog import Catalog, CatalogError, block_of

_BLOCK = re.compile(r"[A-Za-z][A-Za-z0-9_-]*\Z")
_STUB = {"sql": "-- signature: json -> json\ninput\n", "python": '"""A block.\n\nsignature: json -> json\n"""\n\n\ndef run(value, host):\n    return value\n'}


def blocks_of(spec, catalog: Catalog) -> dict[str, object]:
    """The blocks that a spec names: files by their paths, catalogued ones by name@version."""
    out = {}
    for node in spec.nodes:
        if node.block.endswith((".sql", ".py")):
            with open(node.block, "rb") as f:
                out[node.block] = block_of(f.read(), "sql" if node.block.endswith(".sql") else "python", node.block)
        elif os.path.isfile(node.block):
            raise bundle.BundleError(f"{node.block} can't be run: bundles are for keeping, name the blocks themselves")
        else:
            out[node.block] = catalog.block(catalog.resolve(node.block, durable=True))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluiceway")
    p.add_argument("--catalog", default="catalog")
    p.add_argument("--state", default="state")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, args in {
        "run": ["spec", "input"], "submit": ["spec", "input"], "resume": ["spec", "job_id"], "cancel": ["job_id"], "jobs": [], "specs": ["spec"],
        "validate-json": ["schema", "value"], "build": ["spec", "out"], "models": [],
    }.items():
        s = sub.add_parser(verb)
        for a in args:
            s.add_argument(a)
    cat = sub.add_parser("catalog").add_subparsers(dest="action", required=True)
    for action, args in {"add": ["name", "path"], "list": [], "show": ["name"], "rm": ["name"]}.items():
        s = cat.add_parser(action)
        for a in args:
            s.add_argument(a)
    new = sub.add_parser("block").add_subparsers(dest="action", required=True).add_parser("new")
    new.add_argument("name")
    new.add_argument("--lang", choices=sorted(_STUB), default="sql")
    return p


def text_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except (SpecError, CatalogError, bundle.BundleError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def run(args) -> int:
    catalog = Catalog(args.catalog)
    if args.verb == "validate-json":
        found = violations(json.loads(text_of(args.value)), json.loads(text_of(args.schema)))
        print(*found, sep="\n" if found else "", end="\n" if found else "")
        return int(bool(found))
    if args.verb == "catalog":
        if args.action == "add":
            with open(args.path, "rb") as f:
                catalog.add(args.name, f.read(), "sql" if args.path.endswith(".sql") else "python")
        elif args.action == "rm":
            catalog.remove(args.name)
        elif args.action == "show":
            print(json.dumps(catalog.show(args.name)))
        else:
            for key, entry in sorted(catalog.index()["entries"].items()):
                print(key, entry["kind"], entry["signature"], entry["created_at"])
        return 0
    if args.verb == "block":
        if not _BLOCK.match(os.path.basename(args.name)):
            raise ValueError(f"{args.name!r} isn't a block name")
        with open(f"{args.name}.{'sql' if args.lang == 'sql' else 'py'}", "x", encoding="utf-8") as f:
            f.write(_STUB[args.lang])
        return 0
    if args.verb == "models":
        from pyspark.sql import SparkSession

        from sluiceway.operators.infer import list_models, models

        models(SparkSession.builder.getOrCreate(), list_models()).show(1000, truncate=False)
        return 0
    spec = parse_spec(text_of(args.spec)) if hasattr(args, "spec") else None
    if args.verb == "specs":
        print(json.dumps({"name": spec.name, "description": spec.description, "data_policy": spec.data_policy}))
        return 0
    if args.verb == "build":
        with open(args.out, "wb") as f:
            f.write(bundle.build(analyze(spec, blocks_of(spec, catalog))))
        return 0
    from pyspark.sql import SparkSession

    from sluiceway.jobs import Engine

    spark = SparkSession.builder.getOrCreate()
    # Spark's own folder may be another one
    engine = Engine(spark, args.state if "://" in args.state else os.path.abspath(args.state), blocks_of(spec, catalog) if spec else {})
    if spec:
        engine.load(spec)
    if args.verb == "jobs":
        engine.jobs().show(truncate=False)
        return 0
    if args.verb == "cancel":
        print(engine.cancel(args.job_id))
        return 0
    envelope = engine.resume(args.job_id) if args.verb == "resume" else engine.submit(spec.name, json.loads(args.input))
    print(json.dumps(envelope))
    return 0 if envelope["status"] == "completed" else 1


if __name__ == "__main__":
    sys.exit(main())
