"""Queries that run whole jobs, files, ledgers, events and the driver's parts, each beside its SQL.

What a query writes goes to a scratch folder of its own.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.deploy import send_package
from sluiceway.functions import pdf, schema
from sluiceway.functions import text as tx
from sluiceway.jobs import Engine, JobError
from sluiceway.operators import ledger as lg
from sluiceway.operators.fanout import run_items
from sluiceway.operators.infer import Http, Registry, Stub, Unsupported, infer, models, read_stream
from sluiceway.plans import types as ty
from sluiceway.plans.analyze import analyze, framed_hash
from sluiceway.plans.blocks import BlockFailed, PyBlock, SqlBlock, py_block
from sluiceway.plans.compile import compile_graph, envelopes
from sluiceway.plans.speclang import SpecError, parse_spec, references
from sluiceway.plans.types import parse_signature
from sluiceway.registry import long, query, rows
from sluiceway.sources import bundle, files, store
from sluiceway.sources.catalog import Catalog, CatalogError
from sluiceway.sources.manifest import ManifestError, read_manifest
from sluiceway.streaming.events import EventLog, incremental_fanout, replay

HEAD = 'description = "d"; model = {} "{}"; data_policy = Any; capabilities = [{}]'


def spec_of(name: str, nodes: str, model: str = "", roots: tuple[str, ...] = (), provider: str = "stub", branches: str = "") -> str:
    body = f"; branches = {{ {branches} }}" if branches else ""
    return f"spec {name} = {{ {HEAD.format(provider, model, ', '.join(f'Read "{r}"' for r in roots))}; nodes = {{ {nodes} }}{body} }}"


def local(path: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", path)


def one_file(lines: DataFrame, order: str, folder: str) -> str:
    """Write (order, value) as one text file, in order; its path."""
    lines.coalesce(1).sortWithinPartitions(order).select("value").write.text(folder)
    return next(f"{folder}/{n}" for n in sorted(os.listdir(local(folder))) if n.startswith("part-"))


def facts(t, found: list[tuple], columns: str) -> DataFrame:
    return t.spark.createDataFrame(found, columns)


def refused(run, *errors) -> bool:
    try:
        run()
    except errors:
        return True
    return False


# manifests and campaigns: events as the items of one file; every tenth line is blank, some items are of the wrong kind

def event_line():
    """The line of an event; what is wrong with some of them goes by their ids."""
    return F.concat(
        F.when(F.col("event_id") % 10 == 0, "\n").otherwise(""),
        F.to_json(F.struct(
            F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 != 3, F.col("event_type")).alias("kind"),
            F.when(F.col("event_id") % 11 != 5, F.round("value", 2)).alias("value"))),
        F.when(F.col("event_id") % 4 == 0, "\r").otherwise(""))


#: What the lines come to, in SQL: the item's number, and its error if it has one.
ITEMS_SQL = """items AS (
  SELECT (row_number() OVER (ORDER BY event_id) - 1)::bigint AS item, event_id, event_type, round(value, 2)::decimal(18, 2) AS value,
    CASE WHEN event_id % 7 = 3 THEN 'input is not {kind: text}' WHEN event_type = 'error' THEN 'refused event ' || event_id
         WHEN event_id % 11 = 5 THEN 'output is not {cents: json}' END AS error FROM events)"""
CENTS = SqlBlock(
    "if(try_variant_get(input, '$.value', 'double') is null, parse_json('{}'), to_variant_object(named_struct('cents', cast(round(try_variant_get(input, '$.value', 'double') * 100) as bigint))))",
    parse_signature("{kind: text} -> {cents: json}"),
    error="if(try_variant_get(input, '$.kind', 'string') = 'error', concat('refused event ', try_variant_get(input, '$.id', 'string')), null)",
)


def add_up(value, host):
    """signature: {results_path: text, failures_path: text, succeeded: json, failed: json} -> {total: json, n: json, failed: json}"""
    file, at, rest, n, total = host.open(value["results_path"]), 0, "", 0, 0
    while at < file["len"]:
        window = host.slice(file["handle"], at, 1 << 16)
        *lines, rest = (rest + window["text"]).split("\n")
        n, total, at = n + len(lines), total + sum(json.loads(x)["result"]["cents"] for x in lines), window["next_offset"]
    return {"total": total, "n": n, "failed": value["failed"]}


BLOCKS = {"cents": CENTS, "add": py_block(add_up)}


def campaign(t, seed=None) -> tuple[Engine, str]:
    """An engine with the campaign over the events loaded, and its folder; ``seed`` may prepare its ledger."""
    folder = store.scratch(t.spark, "campaign")
    manifest = local(one_file(t("events").select("event_id", event_line().alias("value")), "event_id", f"{folder}/in"))
    source = spec_of("campaign", f'each = {{ block = "cents"; over = "{manifest}" }}; sum = {{ block = "add"; in = each.out }}', roots=(local(folder),))
    engine = Engine(t.spark, f"{folder}/state", BLOCKS)
    graph = engine.load(source)
    if seed is not None:
        seed(engine, graph, manifest)
        engine = Engine(t.spark, f"{folder}/state", BLOCKS)
        engine.load(source)
    return engine, f"{folder}/state"


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::bigint AS item_index, event_id, CASE WHEN event_id % 7 <> 3 THEN event_type END AS kind FROM events")
def q39_read_manifest(t):
    path = one_file(t("events").select("event_id", event_line().alias("value")), "event_id", store.scratch(t.spark, "manifest"))
    items, _ = read_manifest(t.spark, path)
    return items.select("item_index", F.try_variant_get("input", "$.id", "long").alias("event_id"), F.try_variant_get("input", "$.kind", "string").alias("kind"))


@query("WITH " + ITEMS_SQL + """ SELECT 'completed' AS status, sum(value * 100)::bigint AS total, count(*)::bigint AS n,
  (SELECT count(*) FROM items WHERE error IS NOT NULL)::bigint AS failed, 0::bigint AS tokens_in FROM items WHERE error IS NULL""")
def q40_campaign(t):
    engine, _ = campaign(t)
    got = engine.submit("campaign", {}, "a job")
    result = got["result"]
    return facts(t, [(got["status"], result["total"], result["n"], result["failed"], got["usage"]["tokens_in"])], "status string, total long, n long, failed long, tokens_in long")


@query("WITH " + ITEMS_SQL + " SELECT item, (value * 100)::bigint AS cents FROM items WHERE error IS NULL")
def q41_results_sink(t):
    engine, _ = campaign(t)
    engine.submit("campaign", {}, "j")
    return t.spark.read.schema("item long, result struct<cents: long>").json(engine.ledger.results("j") + "/each.results.jsonl").select("item", "result.cents")


@query("WITH " + ITEMS_SQL + " SELECT item, error FROM items WHERE error IS NOT NULL")
def q42_failures_sink(t):
    engine, _ = campaign(t)
    engine.submit("campaign", {}, "j")
    return t.spark.read.schema("item long, error string").json(engine.ledger.results("j") + "/each.failures.jsonl")


@query("WITH " + ITEMS_SQL + """, done AS (SELECT *, item % 3 = 0 AS before FROM items)
SELECT item, CASE WHEN before THEN -item ELSE (value * 100)::bigint END AS cents FROM done WHERE before OR error IS NULL""")
def q43_resume(t):
    def seed(engine, graph, manifest):
        items, digest = read_manifest(t.spark, manifest)
        engine.ledger.put_job("j", "running", graph.fingerprint, "campaign", "{}")
        engine.ledger.pin("j", "each", digest)
        known = items.where("item_index % 3 = 0").select("item_index", F.concat(F.lit('{"cents":'), -F.col("item_index"), F.lit("}")).alias("output"), F.lit(None).cast("string").alias("error"))
        engine.ledger.record("j", "each", known)

    engine, _ = campaign(t, seed)
    engine.resume("j")  # the new engine found it running, and so interrupted
    return t.spark.read.schema("item long, result struct<cents: long>").json(engine.ledger.results("j") + "/each.results.jsonl").select("item", "result.cents")


@query("WITH " + ITEMS_SQL + """ SELECT 'point' AS what, item AS n, error AS said FROM items WHERE item = 17 UNION ALL
SELECT 'range', count(*), NULL FROM items WHERE item >= 100 UNION ALL SELECT 'completed', count(*), NULL FROM items WHERE error IS NULL UNION ALL
SELECT 'first', NULL, arg_min(error, item) FROM items WHERE error IS NOT NULL UNION ALL SELECT 'absent', 0, NULL""")
def q44_ledger_reads(t):
    items = t("events").select(F.col("event_id").alias("item_index"), F.try_parse_json(F.regexp_replace(event_line(), "[\r\n]", "")).alias("input"))
    first = items.agg(F.min("item_index")).first()[0]
    ledger = lg.Ledger(t.spark, store.scratch(t.spark, "ledger"))
    ledger.record("j", "n", run_items(items.withColumn("item_index", F.col("item_index") - first), CENTS))
    ledger.record("other", "n", run_items(items, CENTS))  # never read for the first
    done, said = ledger.concluded("j", "n"), F.lit(None).cast("string").alias("said")
    summary = ledger.summary("j", "n")
    one = ledger.item("j", "n", 17).select(F.lit("point").alias("what"), F.col("item_index").alias("n"), F.col("error").alias("said"))
    many = [one] + [done.where(w).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("what"), "n", said) for k, w in (("range", "item_index >= 100"), ("completed", "status = 'completed'"))]
    many += [facts(t, [("first", None, summary["first_error"]), ("absent", ledger.item("j", "n", 10**9).count(), None)], "what string, n long, said string")]
    return many[0].union(many[1]).union(many[2]).union(many[3])


@query(rows([("empty", True), ("blank", True), ("line 3", True), ("not UTF-8", True), ("no such file", True), ("edited since", True), ("every item failed", True), ("good", False)], "manifest", "refused"))
def q45_manifests_refused(t):
    folder = store.scratch(t.spark, "manifests")
    os.makedirs(local(folder))
    contents = {"empty": b"", "blank": b"\n \r\n", "line 3": b"1\n\nnot json\n", "not UTF-8": b'"\xff"\n', "good": b'{"kind": "x", "value": 1}\n', "every item failed": b'{"kind": 1}\n'}
    found = []
    for name, content in contents.items():
        with open(f"{local(folder)}/{name}", "wb") as f:
            f.write(content)
    for name in ("empty", "blank", "line 3", "not UTF-8", "no such file"):
        said = ""
        try:
            read_manifest(t.spark, f"{folder}/{name}")
        except ManifestError as e:
            said = str(e)
        found.append((name, {"blank": "empty", "no such file": "exist"}.get(name, name) in said))
    engine = Engine(t.spark, f"{folder}/state", BLOCKS)
    for name, path in (("edited since", "good"), ("every item failed", "every item failed"), ("good", "good")):
        engine.load(spec_of("s", f'each = {{ block = "cents"; over = "{local(folder)}/{path}" }}', roots=(local(folder),)))
        if name == "edited since":
            engine.ledger.pin(name, "each", "another digest")
        found.append((name, engine.submit("s", {}, name)["status"] == "failed"))
    return facts(t, found, "manifest string, refused boolean")


# files, pages and inference through the host: a nation is a file that a block reads


def look(value, host):
    """Reads its file in windows of seven bytes, the pages of a document, and asks the model about what it found.

    signature: {path: text} -> {kind: text, len: json, text: text, head: text, said: text}
    """
    file = host.open(value["path"])
    host.emit({"opened": file["kind"]["kind"]})
    if file["kind"]["kind"] == "document":
        text = "|".join(host.page_text(file["handle"], i) for i in range(file["kind"]["pages"]))
    elif file["kind"]["kind"] == "text":
        text, at = "", 0
        while at < file["len"]:
            window = host.slice(file["handle"], at, 7)
            text, at = text + window["text"], window["next_offset"]
    else:
        raise BlockFailed(f"{file['kind']['kind']} of format {file['kind']['format']}")
    said, heard = "", []
    if text:
        said = host.infer(f"What of {text}", 4, on_token=lambda token: heard.append(token) or len(heard) < 3)["text"]
    return {"kind": file["kind"]["kind"], "len": file["len"], "text": text, "head": host.slice_bytes(file["handle"], -5, 3)["bytes_base64"], "said": said}


def nation_files(t) -> tuple[str, list]:
    """A folder with a file for each nation: text, a document of two pages, an image, nothing, or one that no root grants."""
    folder = local(store.scratch(t.spark, "nations"))
    os.makedirs(f"{folder}/open")
    os.makedirs(f"{folder}/open-not")
    found = []
    for r in sorted(t("nation").toLocalIterator(), key=lambda r: r["n_nationkey"]):
        k, name = r["n_nationkey"], r["n_name"] + " é日"
        path = f"{folder}/open{'-not' if k % 5 == 4 else ''}/{k}"
        content = {0: name.encode(), 1: pdf.make_pdf([r["n_name"], f"region {r['n_regionkey']}"], k % 2 == 0), 2: b"GIF89a" + name.encode(), 3: b"", 4: b"secret"}[k % 5]
        with open(path, "wb") as f:
            f.write(content)
        found.append((k, path))
    with open(f"{folder}/open/items.jsonl", "w") as f:
        f.write("".join(json.dumps({"path": p}) + "\n" for _, p in found))
    return folder, found


def nation_job(t) -> Engine:
    folder, _ = nation_files(t)
    engine = Engine(t.spark, f"{folder}/state", {"look": py_block(look)}, audit=True)
    engine.load(spec_of("s", f'each = {{ block = "look"; over = "{folder}/open/items.jsonl" }}', "it is far away", (f"{folder}/open",)))
    return engine


NATIONS_SQL = """f AS (SELECT n_nationkey AS item, n_nationkey % 5 AS k, n_regionkey, n_name, n_name || ' é日' AS name FROM nation)"""


@query("WITH " + NATIONS_SQL + """ SELECT item::bigint AS item, CASE k WHEN 1 THEN 'document' ELSE 'text' END AS kind,
  CASE k WHEN 0 THEN name WHEN 1 THEN n_name || '|region ' || n_regionkey ELSE '' END AS text,
  CASE k WHEN 0 THEN to_base64(encode(name)[1:3]) WHEN 1 THEN 'JVBE' ELSE '' END AS head, CASE k WHEN 3 THEN '' ELSE 'it is far' END AS said FROM f WHERE k IN (0, 1, 3)""")
def q46_blocks_use_files(t):
    engine = nation_job(t)
    engine.submit("s", {}, "j")
    read = t.spark.read.schema("item long, result struct<kind: string, text: string, head: string, said: string>").json(engine.ledger.results("j") + "/each.results.jsonl")
    return read.select("item", "result.*")


@query("WITH " + NATIONS_SQL + """ SELECT item::bigint AS item, CASE k WHEN 2 THEN 'image of format gif' ELSE 'read not permitted' END AS error FROM f WHERE k IN (2, 4)""")
def q47_denied_reads(t):
    engine = nation_job(t)
    engine.submit("s", {}, "j")
    read = t.spark.read.schema("item long, error string").json(engine.ledger.results("j") + "/each.failures.jsonl")
    return read.select("item", F.regexp_replace("error", ": .*", "").alias("error"))


@query("WITH " + NATIONS_SQL + """ SELECT 'completed' AS status, sum(CASE k WHEN 0 THEN 2 + len(string_split(name, ' ')) WHEN 1 THEN 2 + len(string_split(n_name || '|region ' || n_regionkey, ' ')) END)::bigint AS tokens_in,
  (3 * count(*) FILTER (k IN (0, 1)))::bigint AS tokens_out, (3 * count(*) FILTER (k IN (0, 1)))::bigint AS tokens,
  count(*) FILTER (k <> 4) + 1 AS progress, string_agg('it is far', ' ') FILTER (k IN (0, 1)) AS heard FROM f""")
def q48_usage_and_events(t):
    engine = nation_job(t)
    got = engine.submit("s", {}, "j")
    log = engine.events("j")
    heard = replay(log.where("type = 'token'").withColumn("token", F.try_variant_get(F.try_parse_json("payload"), "$", "string")), "job_id", "seq", "token", " ")
    n = log.groupBy("job_id").agg(F.count_if(F.col("type") == "token").alias("tokens"), F.count_if(F.col("type") == "progress").alias("progress"))
    usage = facts(t, [("j", got["status"], got["usage"]["tokens_in"], got["usage"]["tokens_out"])], "job_id string, status string, tokens_in long, tokens_out long")
    return usage.join(n, "job_id").join(heard.withColumnRenamed("text", "heard"), "job_id").drop("job_id")


@query("WITH " + NATIONS_SQL + """ SELECT item::bigint AS handle, ['text', 'document', 'image', 'text'][k + 1] AS kind, CASE k WHEN 1 THEN 2 END AS pages, CASE k WHEN 1 THEN true END AS has_text_layer,
  CASE k WHEN 0 THEN octet_length(encode(name)) WHEN 2 THEN 6 + octet_length(encode(name)) WHEN 3 THEN 0 END::bigint AS length,
  CASE k WHEN 1 THEN 'region ' || n_regionkey END AS second_page, CASE k WHEN 1 THEN 'page 2 is out of range: the document has 2' END AS third_page FROM f WHERE k < 4""")
def q49_open_files(t):
    folder, paths = nation_files(t)
    opened = files.open_files(t.spark, [p for k, p in paths if k % 5 < 4], [f"{folder}/open"])
    keys = t.spark.createDataFrame([(k, p) for k, p in paths], "key long, path string")
    document = F.when(F.col("kind.kind") == "document", F.col("content"))
    opened = opened.withColumns({"second": files.page_texts(document, F.lit(1)), "third": files.page_texts(document, F.lit(2))})
    size = F.when(F.col("kind.kind") != "document", F.col("length"))
    return opened.join(keys, "path").select(F.col("key").alias("handle"), "kind.kind", "kind.pages", "kind.has_text_layer", size.alias("length"), F.col("second.text").alias("second_page"), F.col("third.error").alias("third_page"))


@query("WITH " + NATIONS_SQL + " SELECT item::bigint AS item, k <> 4 AS allowed, false AS by_link, false AS absent FROM f")
def q50_capabilities(t):
    folder, paths = nation_files(t)
    os.symlink(f"{folder}/open-not", f"{folder}/open/link")
    allowed = lambda p: not refused(lambda: files.permitted(p, [f"{folder}/open"]), files.CapabilityDenied)
    return facts(t, [(k, allowed(p), allowed(f"{folder}/open/link/{k}"), allowed(f"{p}.none")) for k, p in paths], "item long, allowed boolean, by_link boolean, absent boolean")


# slices, prompts, parsing


@query("""
WITH d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text))::bigint AS n FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN n + 1 WHEN doc_id % 9 = 1 THEN n ELSE 0 END AS start FROM d),
e AS (SELECT *, least(start + 40 + doc_id % 5, n) AS stop FROM s),
c AS (SELECT *, CASE WHEN stop = n OR hex(b[stop + 1:stop + 1]) NOT BETWEEN '80' AND 'BF' THEN stop
  WHEN hex(b[stop:stop]) NOT BETWEEN '80' AND 'BF' THEN stop - 1 WHEN hex(b[stop - 1:stop - 1]) NOT BETWEEN '80' AND 'BF' THEN stop - 2 ELSE stop - 3 END AS cut FROM e)
SELECT doc_id, CASE WHEN start <= n THEN greatest(cut, start) END::bigint AS next_offset, CASE WHEN start <= n THEN decode(b[start + 1:greatest(cut, start)]) END AS text,
  CASE WHEN start > n THEN 'offset past the end' END AS error FROM c""")
def q51_slice(t):
    content, n = F.encode("text", "UTF-8"), F.octet_length("text")
    start = F.when(F.col("doc_id") % 9 == 0, n + 1).when(F.col("doc_id") % 9 == 1, n).otherwise(0)
    return t("documents").select("doc_id", tx.slice_text(content, start, 40 + F.col("doc_id") % 5).alias("w")).select("doc_id", "w.next_offset", "w.text", "w.error")


@query("SELECT event_id, event_id % 4 = 0 AS failed, CASE WHEN event_id % 4 = 0 THEN -1 ELSE json_extract(props, '$.k')::bigint END AS k FROM events")
def q52_parse_json_caught(t):
    broken = F.concat("props", F.when(F.col("event_id") % 4 == 0, "}").otherwise(""))
    got = t("events").select("event_id", tx.parsed(broken).alias("p"))
    return got.select("event_id", F.col("p.error").isNotNull().alias("failed"), F.coalesce(F.try_variant_get("p.value", "$.k", "long"), F.lit(-1)).alias("k"))


@query("SELECT doc_id, sha256('Sum up: ' || regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') || '.') AS hash FROM documents".replace("\\\\", "\\"))
def q53_prompt(t):
    return t("documents").select("doc_id", F.sha2(tx.prompt(F.col("text"), "Sum up: ", "."), 256).alias("hash"))


@query(rows([("(", True), ("a(?=b)", True), (r"(a)\1", True), ("[z-a]", True), ("a+", False), (r"\d{2}", False), ("(?i)é", False)], "pattern", "refused"))
def q54_patterns(t):
    patterns = ["(", "a(?=b)", r"(a)\1", "[z-a]", "a+", r"\d{2}", "(?i)é"]
    return facts(t, [(p, refused(lambda p=p: tx.dialect(p), tx.PatternError)) for p in patterns], "pattern string, refused boolean")


@query("""SELECT event_id, (1 + (json_extract(props, '$.k')::bigint > 50)::int + (event_id % 6 = 0)::int)::bigint AS n,
  CASE WHEN json_extract(props, '$.k')::bigint > 50 THEN '/k: ' || json_extract(props, '$.k') || ' is against maximum 50' END AS about_k FROM events""")
def q55_json_schema(t):
    wanted = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": "integer", "maximum": 50}, "e": {"enum": ["a", "b"]}}}
    made = F.when(F.col("event_id") % 6 == 0, F.regexp_replace("props", r"\}$", ', "e": "c"}')).otherwise(F.col("props"))
    got = t("events").select("event_id", schema.violations_column(made, wanted).alias("v"))
    return got.select("event_id", long(F.size("v"), "n"), F.get(F.filter("v", lambda x: x.startswith("/k:")), F.lit(0)).alias("about_k"))


@query("""
WITH v AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || '@1.0' WHEN 1 THEN n_name WHEN 2 THEN n_name || '@@' ELSE 'COM' || (n_nationkey % 10) END AS name FROM nation)
SELECT n_nationkey::bigint AS n_nationkey, regexp_matches(name, '^[A-Za-z0-9._-]+@[A-Za-z0-9._-]+$') AS catalogued, regexp_matches(name, '^[A-Za-z][A-Za-z0-9_-]*$') AND NOT regexp_matches(lower(name), '^com[1-9]$') AS block FROM v""")
def q56_identifiers(t):
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.concat("n_name", F.lit("@1.0"))).when(k % 4 == 1, F.col("n_name")).when(k % 4 == 2, F.concat("n_name", F.lit("@@"))).otherwise(F.concat(F.lit("COM"), k % 10))
    return t("nation").select(long(k, "n_nationkey"), tx.is_catalog_name(name).alias("catalogued"), tx.is_block_name(name).alias("block"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def q57_timestamps(t):
    return t("events").select("event_id", tx.rfc3339(F.col("ts")).alias("at"))


# inference


@query("SELECT lang, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')))::bigint AS tokens_in, (2 * count(*))::bigint AS tokens_out, count(*) AS n FROM documents GROUP BY 1".replace("\\\\", "\\"))
def q58_infer_in_jobs(t):
    jobs = t("documents").select(F.col("doc_id").alias("job_id"), F.expr("to_variant_object(named_struct('text', text))").alias("input"))
    engine = Engine(t.spark, store.scratch(t.spark, "infer"), {"ask": PyBlock(ask, parse_signature("json -> {answer: text}"), "ask")})
    engine.load(spec_of("s", 'a = { block = "ask" }', "short answers only"))
    done = engine.submit_all("s", jobs, "batch").where("status = 'completed' and try_variant_get(result, '$.answer', 'string') = 'short answers'")
    done = done.join(t("documents").select(F.col("doc_id").alias("job_id"), "lang"), "job_id")
    return done.groupBy("lang").agg(F.sum("usage.tokens_in").alias("tokens_in"), F.sum("usage.tokens_out").alias("tokens_out"), F.count(F.lit(1)).alias("n"))


def ask(value, host):
    return {"answer": host.infer(value["text"] or "", 2)["text"]}


def see(value, host):
    return host.infer("what is it", images=[host.register(b"GIF89a")["handle"]])["text"]


def render(value, host):
    return host.page_image(host.register(pdf.make_pdf(["x"]))["handle"], 0)


def no_handle(value, host):
    return host.slice(4, 0, 1)


def broken(value, host):
    raise ZeroDivisionError("no reason")


@query(rows([("blind", "unsupported", "1 image(s) "), ("fickle", "nondeterministic_replay", "fickle: cal"), ("no_handle", "capability_denied", "no such han"), ("render", "unsupported", "pages can't"), ("see", None, "[1 image(s)"), ("trap", "block_trap", "broken: Zer")], "block", "code", "said"))
def q59_host_refusals(t):
    registry = Registry()
    registry.register("Blind", lambda model: Stub(model, vision=False))
    blocks = {"see": PyBlock(see, name="see"), "blind": PyBlock(see, name="see"), "render": PyBlock(render, name="render"), "no_handle": PyBlock(no_handle, name="no_handle"), "trap": PyBlock(broken, name="broken"), "fickle": PyBlock(fickle, name="fickle")}
    engine = Engine(t.spark, store.scratch(t.spark, "refusals"), blocks, registry, audit=True)
    found = []
    for name in sorted(blocks):
        engine.load(spec_of("s", f'a = {{ block = "{name}" }}', provider="BLIND" if name == "blind" else "stub"))
        got = engine.submit("s", 1)
        found.append((name, got.get("error", {}).get("code"), (got["error"]["message"] if "error" in got else got["result"])[:11]))
    return facts(t, found, "block string, code string, said string")


_ASKED: list[int] = []


def fickle(value, host):
    _ASKED.append(1)
    return host.infer(f"question {len(_ASKED)}")["text"]


@query("SELECT p_partkey, 'the cat sat' AS stopped, 'the cat' AS most, 2::bigint AS tokens_in FROM part")
def q60_early_stop(t):
    backend = Stub("the cat sat on the mat")
    prompts = t("part").select("p_partkey", F.concat(F.regexp_replace("p_name", " .*", ""), F.lit(" x")).alias("prompt"))
    answered = infer(prompts, backend, max_tokens=2)
    return answered.select("p_partkey", backend.column(F.col("prompt"), 9, stop="sat")["text"].alias("stopped"), F.col("answer.text").alias("most"), F.col("answer.tokens_in").alias("tokens_in"))


@query("SELECT conv_id, turn, text, (3 + length(text) % 5)::bigint AS tokens_out FROM conversations")
def q61_stream_cut_anywhere(t):
    """The answer of an NDJSON stream that arrives in pieces of seven bytes is the same as whole; final counts hold."""
    send_package(t.spark)

    @F.pandas_udf("struct<text: string, tokens_out: long>")
    def through(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            lines = [{"response": text[:5]}, {"response": text[5:]}, {"done": True, "eval_count": 3 + len(text) % 5, "prompt_eval_count": 1}]
            raw = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode()
            got = read_stream(raw[i : i + 7] for i in range(0, len(raw), 7))
            out.append((got["text"], got["tokens_out"]))
        return pd.DataFrame(out, columns=["text", "tokens_out"])

    return t("conversations").select("conv_id", "turn", through("text").alias("a")).select("conv_id", "turn", "a.*")


@query(rows([("llamacpp", "unavailable"), ("OLLAMA", "Http"), ("none", "unknown"), ("Stub", "Stub")], "provider", "found"))
def q62_registry(t):
    found = []
    for provider in ("llamacpp", "OLLAMA", "none", "Stub"):
        try:
            found.append((provider, type(Registry().resolve(provider, "m")).__name__))
        except Unsupported as e:
            found.append((provider, "unavailable" if "native" in str(e) else "unknown"))
    assert isinstance(Registry().resolve("ollama", "m"), Http)
    return facts(t, found, "provider string, found string")


@query("SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'qwen3:' || p_size WHEN 1 THEN 'llama3:' || p_size ELSE 'own:' || p_size END AS name, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reasoning FROM part")
def q63_models(t):
    names = t("part").select(F.concat(F.when(F.col("p_size") % 3 == 0, "qwen3:").when(F.col("p_size") % 3 == 1, "llama3:").otherwise("own:"), "p_size").alias("n")).distinct()
    return models(t.spark, [r["n"] for r in names.toLocalIterator()])


# graphs


def region_graph(t) -> str:
    """A node for each region and, reading it, one for each nation; nations of even key lie on a decision's other route."""
    regions = sorted(t("region").toLocalIterator(), key=lambda r: r["r_regionkey"])
    nations = sorted(t("nation").toLocalIterator(), key=lambda r: r["n_nationkey"])
    nodes = [f'r{r["r_regionkey"]} = {{ block = "p" }}' for r in regions]
    nodes += [f'n{n["n_nationkey"]} = {{ block = "p"; in = r{n["n_regionkey"]}.out }}' for n in reversed(nations)]
    nodes += [f'z{n["n_nationkey"]} = {{ block = "p"; in = [n{n["n_nationkey"]}.out] }}' for n in nations]
    routes = "; ".join(f'r{r["r_regionkey"]} = {{ ' + "; ".join(f'"{"even" if n["n_nationkey"] % 2 == 0 else "odd"}" -> n{n["n_nationkey"]}' for n in nations if n["n_regionkey"] == r["r_regionkey"]) + " }" for r in regions)
    return spec_of("s", "; ".join(nodes), branches=routes)


@query("""
WITH n AS (SELECT 0 AS level, 'r' || r_regionkey AS node, NULL AS reads, NULL AS decision, NULL AS label FROM region
  UNION ALL SELECT 1, 'n' || n_nationkey, 'r' || n_regionkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END FROM nation
  UNION ALL SELECT 2, 'z' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END FROM nation)
SELECT (row_number() OVER (ORDER BY level, node) - 1)::bigint AS place, node, reads, decision, label,
  (SELECT count(*) FROM n m WHERE m.reads = n.node)::bigint AS readers FROM n""")
def q64_graph_order(t):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        graph = analyze(parse_spec(region_graph(t)), {"p": SqlBlock("input")})
    read = [r for c in graph.nodes for r in references(c.node.input)]
    found = []
    for place, c in enumerate(graph.nodes):
        [(decision, labels)] = c.gates.items() if c.gates else [(None, [None])]
        refs = references(c.node.input)
        found.append((place, c.node.name, refs[0] if refs else None, decision, *labels, read.count(c.node.name)))
    return facts(t, found, "place long, node string, reads string, decision string, label string, readers long")


BAD_SPECS = {
    "absent block": 'a = { block = "none" }', "absent node": 'a = { block = "p"; in = b.out }', "cycle": 'a = { block = "p"; in = b.out }; b = { block = "p"; in = a.out }',
    "field of an output": 'a = { block = "p" }; b = { block = "p"; in = a.out.x }', "itself": 'a = { block = "p"; in = a.out }', "loop without a bound": 'a = { block = "p"; repeat_until = "x" }',
    "manifest outside": 'a = { block = "p"; over = "/data-secret/m" }', "manifest up and out": 'a = { block = "p"; over = "/data/../m" }', "node twice": 'a = { block = "p" }; a = { block = "p" }',
    "type": 'a = { block = "t" }; b = { block = "p"; in = a.out }; c = { block = "t"; in = b.out }',
    "good": 'a = { block = "p" }; b = { block = "p"; in = { x = a.out; y = [a.out] } }', "manifest inside": 'a = { block = "p"; over = "/data/./m" }',
}


@query(rows([(k, k not in ("good", "manifest inside")) for k in BAD_SPECS] + [("mixed routes", True), ("bad decision", True)], "spec", "refused"))
def q65_specs_refused(t):
    blocks = {"p": SqlBlock("input"), "t": SqlBlock("input", parse_signature("{a: text} -> json"))}
    check = lambda source: refused(lambda: analyze(parse_spec(source), blocks), SpecError)
    found = [(k, check(spec_of("s", v, roots=("/data",)))) for k, v in BAD_SPECS.items()]
    nodes = 'd = { block = "p" }; x = { block = "p"; in = d.out }; y = { block = "p"; in = d.out }; z = { block = "p"; in = [x.out, y.out] }'
    found += [("mixed routes", check(spec_of("s", nodes, branches='d = { "a" -> x; "b" -> y }'))), ("bad decision", check(spec_of("s", nodes, branches='e = { "a" -> x }')))]
    return facts(t, found, "spec string, refused boolean")


TYPES = [("{b: [text], a: json}", "{a: json, b: [text]}"), ("[ {x: image} ]", "[{x: image}]"), ("document", "document"), ("{}", "{}"), ("{a: text, a: bytes}", "{a: bytes}")]
PAIRS = [("{a: text, b: text}", "{a: text}", True), ("{a: text}", "{a: text, b: text}", False), ("text", "json", True), ("json", "text", False), ("[{a: text, b: json}]", "[{a: json}]", True), ("image", "bytes", False)]


@query(rows([("parse", a, b, True) for a, b in TYPES] + [("assign", a, b, c) for a, b, c in PAIRS] + [("refuse", a, "", True) for a in ("number", "[text", "{a text}", "")], "what", "one", "other", "holds"))
def q66_types(t):
    found = [("parse", a, ty.parse(a).describe(), True) for a, _ in TYPES]
    found += [("assign", a, b, ty.parse(a).assignable_to(ty.parse(b))) for a, b, _ in PAIRS]
    found += [("refuse", a, "", refused(lambda a=a: ty.parse(a), ty.TypeSyntaxError)) for a in ("number", "[text", "{a text}", "")]
    return facts(t, found, "what string, one string, other string, holds boolean")


@query("SELECT n_nationkey::bigint AS n_nationkey, sha256(from_hex(printf('%02x', octet_length(encode(n_name))) || '00000000000000') || encode(n_name) || from_hex('0100000000000000') || encode((n_regionkey % 10)::varchar)) AS hash FROM nation")
def q67_framed_hash(t):
    return facts(t, [(r["n_nationkey"], framed_hash([r["n_name"], str(r["n_regionkey"] % 10)])) for r in t("nation").toLocalIterator()], "n_nationkey long, hash string")


# jobs in one plan: failures on their rows


@query("""
SELECT event_id, CASE WHEN event_id % 6 = 1 THEN 'block 2 of the pipeline: event ' || event_id || ' is odd' WHEN event_id % 6 = 4 THEN 'node ''b'' promised {n: text} and gave something else' END AS message,
  CASE WHEN event_id % 6 = 1 THEN 'script_error' WHEN event_id % 6 = 4 THEN 'schema_validation_failed' END AS code,
  CASE WHEN event_id % 6 NOT IN (1, 4) THEN event_id END AS result FROM events""")
def q68_failures_in_chains(t):
    jobs = t("events").select(F.col("event_id").alias("job_id"), F.expr("to_variant_object(named_struct('id', event_id))").alias("input"))
    b = SqlBlock("if(try_variant_get(input, '$.id', 'long') % 6 = 4, to_variant_object(named_struct('n', 5)), to_variant_object(named_struct('n', try_variant_get(input, '$.id', 'string'))))", parse_signature("json -> {n: text}"),
                 error="if(try_variant_get(input, '$.id', 'long') % 6 = 1, concat('event ', try_variant_get(input, '$.id', 'string'), ' is odd'), null)")
    graph = analyze(parse_spec(spec_of("s", 'a = { block = "p" }; b = { block = "b"; in = a.out }; c = { block = "c"; in = b.out }')), {"p": SqlBlock("input"), "b": b, "c": SqlBlock("try_variant_get(input, '$.n', 'variant')")})
    done = envelopes(graph, compile_graph(graph, jobs))
    return done.select(F.col("job_id").alias("event_id"), "error.message", "error.code", F.try_variant_get("result", "$", "string").cast("long").alias("result"))


@query("SELECT event_id, 'null' AS seen, event_id % 2 = 0 AS skipped FROM events")
def q69_missing_upstream(t):
    jobs = t("events").select(F.col("event_id").alias("job_id"), F.expr("to_variant_object(named_struct('route', if(event_id % 2 = 0, 'no', 'yes')))").alias("input"))
    note = SqlBlock("to_variant_object(named_struct('seen', to_json(input), 'state', 'done'))")
    nodes = 'd = { block = "p" }; x = { block = "p"; in = d.out }; y = { block = "p"; in = d.out }; l = { block = "note"; in = l.out; repeat_until = "state"; max_iterations = 2 }'
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        graph = analyze(parse_spec(spec_of("s", nodes, branches='d = { "yes" -> x; "no" -> y }')), {"p": SqlBlock("input", parse_signature("json -> json")), "note": note})
    done = compile_graph(graph, jobs)
    return done.select(F.col("job_id").alias("event_id"), F.try_variant_get("n_l.output", "$.seen", "string").alias("seen"), F.col("s_x").alias("skipped"))


@query("SELECT 'first' AS run, count(*) FILTER (event_id % 2 = 0) AS recorded, 0::bigint AS again FROM events UNION ALL SELECT 'second', count(*), count(*) FILTER (event_id % 2 = 0) FROM events")
def q70_batches(t):
    engine = Engine(t.spark, store.scratch(t.spark, "batch"), {"p": SqlBlock("to_variant_object(named_struct('at', cast(current_timestamp() as string)))")})
    engine.load(spec_of("s", 'a = { block = "p" }'))
    jobs = t("events").select(F.col("event_id").alias("job_id"), F.expr("to_variant_object(named_struct('id', event_id))").alias("input"))
    first = store.stored(engine.submit_all("s", jobs.where("job_id % 2 = 0"), "b").select("job_id", F.to_json("result").alias("r")), "first")
    second = engine.submit_all("s", jobs, "b").select("job_id", F.to_json("result").alias("r"))
    same = second.join(first, ["job_id", "r"], "left_semi").count()  # what was recorded wasn't run again
    return facts(t, [("first", first.count(), 0), ("second", second.count(), same)], "run string, recorded long, again long")


# jobs and their states


@query("""
SELECT CASE n_nationkey % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'interrupted' ELSE 'cancelled' END AS status, n_nationkey % 5 <> 3 AS terminal, count(*) AS n FROM nation GROUP BY 1, 2""")
def q37_job_states(t):
    """Jobs that end, fail, are cancelled before they run, were running when an engine ended, or were so and then cancelled."""
    folder = store.scratch(t.spark, "states")
    blocks = {"p": SqlBlock("input", error="if(try_variant_get(input, '$', 'int') % 5 = 1, 'refused', null)")}
    engine = Engine(t.spark, folder, blocks)
    graph = engine.load(spec_of("s", 'a = { block = "p" }'))
    keys = sorted(r["n_nationkey"] for r in t("nation").toLocalIterator())
    for k in keys:
        if k % 5 >= 3:
            engine.ledger.put_job(str(k), "running", graph.fingerprint, "s", str(k))
        else:
            if k % 5 == 2:
                engine.ledger.mark("cancel", str(k))
            engine.submit("s", k, str(k))
    again = Engine(t.spark, folder, blocks)
    for k in keys:
        if k % 5 == 4:
            again.cancel(str(k))
    listed = again.jobs()
    return listed.groupBy("status", F.col("status").isin("completed", "failed", "cancelled").alias("terminal")).agg(F.count(F.lit(1)).alias("n"))


@query(rows([("no such spec", 404), ("no such job", 404), ("resume a completed job", 409), ("resume with another spec", 409), ("resume twice", 409), ("start while stopping", 503), ("resume", 0)], "request", "code"))
def q71_requests_refused(t):
    engine = Engine(t.spark, store.scratch(t.spark, "requests"), {"p": SqlBlock("input")})
    graph = engine.load(spec_of("s", 'a = { block = "p" }'))
    engine.submit("s", 1, "done")
    for job, fingerprint in (("mine", graph.fingerprint), ("theirs", graph.fingerprint), ("old", "another")):
        engine.ledger.put_job(job, "interrupted", fingerprint, "s", "1")
    engine.ledger.claim("theirs", 1)  # another process resumes it

    def code(run) -> int:
        try:
            run()
        except JobError as e:
            return e.code
        return 0

    asked = [("no such spec", lambda: engine.submit("none", 1)), ("no such job", lambda: engine.status("none")), ("resume a completed job", lambda: engine.resume("done")),
             ("resume with another spec", lambda: engine.resume("old")), ("resume twice", lambda: engine.resume("theirs")), ("resume", lambda: engine.resume("mine"))]
    found = [(k, code(run)) for k, run in asked]
    engine.stop(0)
    return facts(t, found + [("start while stopping", code(lambda: engine.start("s", 1)))], "request string, code long")


@query("SELECT n_nationkey::bigint AS n_nationkey, n_name AS result, 'result' AS last_event, 1::bigint AS specs FROM nation WHERE n_regionkey = 1")
def q72_started_jobs(t):
    """Jobs started side by side; each is waited for, and its log read."""
    engine = Engine(t.spark, store.scratch(t.spark, "started"), {"p": SqlBlock("input")})
    engine.load(spec_of("s", 'a = { block = "p" }'))
    jobs = {r["n_nationkey"]: engine.start("s", r["n_name"]) for r in t("nation").where("n_regionkey = 1").toLocalIterator()}
    found = [(k, engine.wait(j)["result"], engine.events(j).collect()[-1]["type"], len(engine.specs())) for k, j in jobs.items()]
    return facts(t, found, "n_nationkey long, result string, last_event string, specs long")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def q73_event_log(t):
    """Conversations through the event log: its tasks write it, a late subscriber's stream reads it from the first event."""
    log = EventLog(t.spark, store.scratch(t.spark, "log"))
    log.append_rows("all", t("conversations").select(F.col("conv_id").alias("item_index"), F.dense_rank().over(_turns()).alias("at"), F.lit("token").alias("type"), F.to_json(F.struct("conv_id", "turn", "text")).alias("payload")))
    out = store.scratch(t.spark, "followed")
    query_ = log.follow("all").writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(f"{out}-rows", format="parquet")
    query_.awaitTermination()
    said = t.spark.read.parquet(f"{out}-rows").select("seq", F.from_json("payload", "conv_id long, turn long, text string").alias("p")).select("seq", "p.*")
    return replay(said, "conv_id", "turn", "text", " ")


def _turns():
    return Window.partitionBy("conv_id").orderBy("turn", "text")


@query(rows([("first", 2), ("second", 1)], "run", "n"))
def q74_incremental_fanout(t):
    folder = store.scratch(t.spark, "incremental")
    os.makedirs(local(f"{folder}/in"))
    found = []
    for run, names in (("first", "ab"), ("second", "c")):
        for name in names:
            with open(local(f"{folder}/in/{name}"), "w") as f:
                f.write('{"n": 1}\n')
        seen: list[int] = []
        incremental_fanout(t.spark, f"{folder}/in", f"{folder}/checkpoint", lambda batch: seen.append(batch.count()))
        found.append((run, sum(seen)))
    return facts(t, found, "run string, n long")


# catalog, bundles, command line


@query("""
WITH r AS (SELECT replace(r_name, ' ', '_') AS r_name, r_regionkey FROM region), b AS (SELECT r_name || '@' || v AS name_version, '-- signature: {x: text} -> json' || chr(10) || 'input' || chr(10) || '-- ' || r_name AS body, r_regionkey FROM r, (VALUES (1), (2)) w(v) WHERE NOT (v = 2 AND r_regionkey = 0))
SELECT name_version, sha256(body) AS hash, '{x: text} -> json' AS signature, (SELECT count(DISTINCT body) FROM b)::bigint AS blobs FROM b""")
def q75_catalog(t):
    path = local(store.scratch(t.spark, "catalog"))
    catalog = Catalog(path)
    for r in t("region").toLocalIterator():
        name = r["r_name"].replace(" ", "_")
        for version in (1, 2):
            catalog.add(f"{name}@{version}", f"-- signature: {{x: text}} -> json\ninput\n-- {name}".encode(), spark=t.spark)
        if r["r_regionkey"] == 0:
            catalog.remove(f"{name}@2")
    blobs = len(os.listdir(f"{path}/blobs"))
    return catalog.entries(t.spark).select("name_version", "hash", "signature", F.lit(blobs).cast("long").alias("blobs"))


CATALOG_ASKED = [("add again", True), ("add another body under a removed name", True), ("add the same body under a removed name", False), ("add a body that doesn't compile", True), ("add without a signature", True),
                 ("bad name", True), ("show in other case", True), ("show", False), ("blob of another name", True), ("bare name", False), ("bare name in a spec", True), ("corrupt index", True)]


@query(rows(CATALOG_ASKED, "request", "refused"))
def q76_catalog_refusals(t):
    catalog, body = Catalog(local(store.scratch(t.spark, "catalog"))), b"-- signature: json -> json\ninput"
    entry = catalog.add("one@1", body)
    catalog.add("two@1", body)
    catalog.remove("two@1")
    runs = [lambda: catalog.add("one@1", body), lambda: catalog.add("two@1", body + b" "), lambda: catalog.add("two@1", body), lambda: catalog.add("three@1", b"-- signature: json -> json\nno_such_fn(input)", spark=t.spark),
            lambda: catalog.add("three@1", b"input"), lambda: catalog.add("a@b@c", body), lambda: catalog.show("One@1"), lambda: catalog.show("one@1"), lambda: catalog.blob(entry | {"hash": "../index.json"}),
            lambda: catalog.resolve("one"), lambda: catalog.resolve("one", durable=True), lambda: open(f"{catalog.path}/index.json", "w").write("{") and catalog.index()]
    found = [(name, refused(run, CatalogError)) for (name, _), run in zip(CATALOG_ASKED, runs, strict=True)]
    return facts(t, found, "request string, refused boolean")


@query("SELECT 0::bigint AS place, 'a' AS name, 'json -> json' AS signature, true AS same UNION ALL SELECT 1, 'b', 'json -> {answer: text}', true")
def q77_bundles(t):
    blocks = {"one": PyBlock(no_handle, name="one"), "two": PyBlock(ask, parse_signature("json -> {answer: text}"), "two"), "sql": SqlBlock("input")}
    graph = analyze(parse_spec(spec_of("s", 'a = { block = "one" }; b = { block = "two"; in = a.out }')), blocks)
    path = store.scratch(t.spark, "bundle")
    content = bundle.build(graph)
    os.makedirs(os.path.dirname(local(path)), exist_ok=True)
    with open(local(path), "wb") as f:
        f.write(content)
    read = bundle.read(bytes(t.spark.read.format("binaryFile").load(path).first()["content"]))
    cut = all(refused(lambda x=x: bundle.read(x), bundle.BundleError) for x in (b"none", content[:-1], content[:6]))
    script = refused(lambda: bundle.build(analyze(parse_spec(spec_of("s", 'a = { block = "sql" }')), blocks)), bundle.BundleError)
    return facts(t, [(i, n["name"], n["signature"], content == bundle.build(graph) and cut and script) for i, n in enumerate(read["nodes"])], "place long, name string, signature string, same boolean")


CLI = [("validate-json schema.json bad.json", 1), ("validate-json schema.json good.json", 0), ("block new mine", 0), ("block new yours --lang python", 0), ("block new 1x", 2), ("catalog add mine@1 mine.sql", 0),
       ("catalog add yours@1 yours.py", 0), ("catalog add mine@1 mine.sql", 2), ("catalog list", 0), ("catalog show none@1", 2), ("specs good.spec", 0), ("build good.spec out", 2), ("run good.spec 5", 0), ("run fails.spec 5", 1),
       ("run none.spec 5", 2), ("run bundle.spec 5", 2), ("jobs", 0)]


@query(rows([(i, c, e) for i, (c, e) in enumerate(CLI)], "place", "command", "code"))
def q78_command_line(t):
    from sluiceway.cli import main

    folder = local(store.scratch(t.spark, "cli"))
    os.makedirs(folder)
    texts = {"schema.json": '{"type": "object", "required": ["a"]}', "bad.json": "{}", "good.json": '{"a": 1}', "fails.sql": "-- signature: json -> text\ninput", "some.bundle": "SWBD",
             "good.spec": spec_of("g", f'a = {{ block = "mine@1" }}; b = {{ block = "yours@1"; in = a.out }}; c = {{ block = "{folder}/yours.py"; in = b.out }}'),
             "fails.spec": spec_of("f", f'a = {{ block = "{folder}/fails.sql" }}'), "bundle.spec": spec_of("b", f'a = {{ block = "{folder}/some.bundle" }}')}
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    found = []
    for place, (command, _) in enumerate(CLI):
        args = [f"{folder}/{a}" if re.search(r"\.(json|spec|sql|py)$", a) or a == "out" else a for a in command.split()]
        if args[:2] == ["block", "new"]:
            args[2] = f"{folder}/{args[2]}"
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            found.append((place, command, main(["--catalog", f"{folder}/catalog", "--state", f"{folder}/state", *args])))
    return facts(t, found, "place long, command string, code long")
