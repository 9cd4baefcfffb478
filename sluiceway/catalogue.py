"""The engine's queries over the driver's tables, each beside the SQL that must give the same rows.

Those that run whole jobs, with files, ledgers and events, are in ``catalogue_jobs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions import text as tx
from sluiceway.operators import ledger as lg
from sluiceway.operators.fanout import run_items
from sluiceway.operators.infer import Stub, infer
from sluiceway.plans import types as ty
from sluiceway.plans.analyze import analyze
from sluiceway.plans.blocks import SqlBlock
from sluiceway.plans.compile import compile_graph, envelopes, result_column
from sluiceway.plans.speclang import parse_spec
from sluiceway.plans.types import parse_signature
from sluiceway.registry import ORACLE_SQL, QUERIES, long, query
from sluiceway.sources import catalog as cat
from sluiceway.sources import store
from sluiceway.sources.manifest import lines_to_items, numbered
from sluiceway.streaming.events import replay

# Events as job items: those with an even k of their props are retried ones, errors fail.
ITEM = "to_variant_object(named_struct('id', event_id, 'kind', event_type, 'value', value))"
WEIGH = SqlBlock(
    "to_variant_object(named_struct('twice', try_variant_get(input, '$.value', 'double') * 2, 'kind', try_variant_get(input, '$.kind', 'string')))",
    parse_signature("{kind: text, value: json} -> {twice: json, kind: text}"),
    error="if(try_variant_get(input, '$.kind', 'string') = 'error', concat('refused event ', try_variant_get(input, '$.id', 'string')), null)",
)


def fanned(t) -> DataFrame:
    items = t("events").select(F.col("event_id").alias("item_index"), F.expr(ITEM).alias("input"))
    return run_items(items, WEIGH)


@query("SELECT event_id, json_extract(props, '$.k')::bigint AS k FROM events")
def q01_manifest_scan(t):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"))


@query("""
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::bigint AS item_index, pos::bigint AS line, raw FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
WHERE trim(raw) <> ''""")
def q02_manifest_blank_lines(t):
    return lines_to_items(t("documents"), "text", "doc_id").select("doc_id", "item_index", "line", "raw")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::bigint AS item_index FROM orders")
def q03_item_index(t):
    orders = t("orders").select("o_orderkey")
    # order over the whole table by range partitions: local numbers, plus how many rows come before; the
    # partitions are written once, so that a row's partition is the same wherever it is read
    part = store.stored(orders.repartitionByRange("o_orderkey").withColumn("p", F.spark_partition_id()), "ranges").withColumn("one", F.lit(True))
    return numbered(part, "p", "o_orderkey", "one").select("o_orderkey", long(F.col("one_no") - 1, "item_index"))


@query("SELECT event_id, json_type(props, '$.k') = 'VARCHAR' AS k_is_text, json_type(props) = 'OBJECT' AS is_record FROM events")
def q04_type_check_record(t):
    v = F.try_parse_json("props")
    return t("events").select(
        "event_id", ty.parse("{k: text}").accepts_column(v).alias("k_is_text"), ty.parse("{k: json}").accepts_column(v).alias("is_record"))


@query("""
SELECT event_id, event_id % 3 <> 0 AS texts, event_id % 3 = 0 AND event_id % 2 = 0 AS in_record, event_id % 5 <> 0 AS lists FROM events""")
def q05_type_check_list(t):
    second = F.when(F.col("event_id") % 3 == 0, "7").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    texts = F.try_parse_json(F.concat(F.lit('["x",'), second, F.lit("]")))
    # a record that must hold a list of lists of records; the depth and the field's name vary
    inner = F.when(F.col("event_id") % 5 == 0, '{"k": 1}').otherwise(F.concat(F.lit("[["), "props", F.lit("], []]")))
    named = F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 2 == 0), '{"a": "b", "c": 1}').otherwise('{"a": 1}')
    accepts = lambda ty_text, v: ty.parse(ty_text).accepts_column(v)
    return t("events").select(
        "event_id", accepts("[text]", texts).alias("texts"), accepts("{a: text}", F.try_parse_json(named)).alias("in_record"),
        accepts("[[{k: json}]]", F.try_parse_json(inner)).alias("lists"))


@query("SELECT doc_id, octet_length(encode(text))::bigint AS len FROM documents")
def q06_byte_length(t):
    return t("documents").select("doc_id", tx.byte_length(F.col("text")).alias("len"))


@query("""
SELECT page_id, ['document', 'image', 'image', 'image', 'image', 'text', 'text', 'binary', 'binary'][(page_id % 9 + 1)::int] AS kind,
       ['pdf', 'png', 'jpeg', 'gif', 'webp', NULL, NULL, NULL, NULL][(page_id % 9 + 1)::int] AS format,
       page_id % 9 IN (5, 6) AS readable FROM pages""")
def q07_media_classify(t):
    html = F.encode("html", "UTF-8")
    # PDF, PNG by its first four bytes, JPEG, GIF, WebP, empty, text cut within a character, bytes that are no text, RIFF of another kind
    heads = ["255044462D", "89504E47FF", "FFD8FF", "4749463861", "524946460000000057454250", "", None, "FFFE00", "52494646FF000000FF"]
    made = None
    for i, head in enumerate(heads):
        content = F.lit(b"") if head == "" else F.concat(html, F.unhex(F.lit("E697"))) if head is None else F.concat(F.unhex(F.lit(head)), html)
        made = F.when(F.col("page_id") % len(heads) == i, content) if made is None else made.when(F.col("page_id") % len(heads) == i, content)
    kind = tx.classify(F.substring(F.col("content"), 1, 4096))
    short = t("pages").where("length(html) >= 0").select("page_id", made.alias("content"), (F.octet_length("html") <= 4000).alias("short"))
    # a text longer than what is looked at is cut there, which is no fault either
    return short.select("page_id", kind["kind"].alias("kind"), kind["format"].alias("format"), (kind["kind"] == "text").alias("readable"))


@query("""
WITH RECURSIVE d AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text))::bigint AS n FROM documents),
w AS (
  SELECT doc_id, b, n, 0::bigint AS start, 0::bigint AS stop FROM d
  UNION ALL SELECT doc_id, b, n, stop, CASE
    WHEN least(stop + 1024, n) = n OR hex(b[least(stop + 1024, n) + 1:least(stop + 1024, n) + 1]) NOT BETWEEN '80' AND 'BF' THEN least(stop + 1024, n)
    WHEN hex(b[least(stop + 1024, n):least(stop + 1024, n)]) NOT BETWEEN '80' AND 'BF' THEN least(stop + 1024, n) - 1
    WHEN hex(b[least(stop + 1024, n) - 1:least(stop + 1024, n) - 1]) NOT BETWEEN '80' AND 'BF' THEN least(stop + 1024, n) - 2
    ELSE least(stop + 1024, n) - 3 END
  FROM w WHERE stop < n
)
SELECT doc_id, start AS "offset", stop AS next_offset, sha256(b[start + 1:stop]) AS hash FROM w WHERE stop > 0 OR n = 0""")
def q08_window_walk(t):
    walked = t("documents").select("doc_id", F.explode(tx.windows(F.col("text"), 1024)).alias("w"))
    return walked.select("doc_id", "w.offset", "w.next_offset", F.sha2(F.encode("w.text", "UTF-8"), 256).alias("hash"))


@query("SELECT page_id, regexp_matches(html, '<a[^>]*href') AS has_link FROM pages")
def q09_regex_test(t):
    return t("pages").select("page_id", tx.regex_test(F.col("html"), "<a[^>]*href").alias("has_link"))


@query("""
SELECT page_id, m <> '' AS found, CASE WHEN m = '' THEN -1 ELSE octet_length(encode(split_part(html, m, 1))) END::bigint AS start_byte,
       CASE WHEN m = '' THEN -1 ELSE octet_length(encode(split_part(html, m, 1))) + octet_length(encode(m)) END::bigint AS end_byte, m AS hit
FROM (SELECT page_id, html, regexp_extract(html, '<p[^>]*>[^<]*') AS m FROM pages)""")
def q10_regex_find(t):
    hit = tx.regex_find(F.col("html"), "<p[^>]*>[^<]*")
    return t("pages").select("page_id", hit.alias("h")).select(
        "page_id", "h.found", F.col("h.start").alias("start_byte"), F.col("h.end").alias("end_byte"), F.col("h.text").alias("hit"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages")
def q11_regex_replace_all(t):
    return t("pages").select("page_id", tx.regex_replace_all(F.col("html"), "<[^>]*>", " ").alias("body"))


@query("SELECT doc_id, sha256(encode(text)[1:64]) AS head_hash, to_base64(encode(text)[1:64]) AS head_base64 FROM documents")
def q12_slice_bytes_hash(t):
    content = F.encode("text", "UTF-8")
    return t("documents").select("doc_id", F.sha2(F.substring(content, 1, 64), 256).alias("head_hash"), tx.slice_bytes(content, 0, 64).alias("head_base64"))


CHAIN = """spec chain = { description = "three steps"; model = stub ""; data_policy = Any; capabilities = [];
  nodes = { a_net = { block = "net" }; b_taxed = { block = "taxed"; in = a_net.out }; c_cents = { block = "cents"; in = b_taxed.out } } }"""
CHAIN_BLOCKS = {
    "net": SqlBlock("to_variant_object(named_struct('x', try_variant_get(input, '$.price', 'double') * (1 - try_variant_get(input, '$.discount', 'double')), 'tax', try_variant_get(input, '$.tax', 'double')))"),
    "taxed": SqlBlock("to_variant_object(named_struct('x', try_variant_get(input, '$.x', 'double') * (1 + try_variant_get(input, '$.tax', 'double'))))"),
    "cents": SqlBlock("to_variant_object(named_struct('cents', cast(floor(try_variant_get(input, '$.x', 'double') * 100) as bigint)))"),
}


@query("""
SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, floor((l_extendedprice * (1 - l_discount)) * (1 + l_tax) * 100)::bigint AS cents FROM lineitem""")
def q13_chain(t):
    jobs = t("lineitem").select("l_orderkey", "l_linenumber", F.expr(
        "to_variant_object(named_struct('price', l_extendedprice, 'discount', l_discount, 'tax', l_tax))").alias("input"))
    done = compile_graph(analyze(parse_spec(CHAIN), CHAIN_BLOCKS), jobs)
    cents = F.try_variant_get(F.col(f"{result_column('c_cents')}.output"), "$.cents", "long")
    return done.select("l_orderkey", long("l_linenumber", "l_linenumber"), cents.alias("cents"))


def compiled(spec_nodes: str, blocks: dict, jobs: DataFrame) -> DataFrame:
    """``jobs`` run through a spec of nodes."""
    spec = f'spec s = {{ description = "d"; model = stub ""; data_policy = Any; capabilities = []; nodes = {{ {spec_nodes} }} }}'
    return compile_graph(analyze(parse_spec(spec), blocks), jobs)


def given(node: str, path: str, kind: str):
    return F.try_variant_get(F.col(f"`{result_column(node)}`.output"), path, kind)


def taken(*fields: tuple[str, str, str]) -> SqlBlock:
    """A block that gives fields (name, path, type) of its input."""
    return SqlBlock(f"to_variant_object(named_struct({', '.join(f"'{n}', try_variant_get(input, '{p}', '{k}')" for n, p, k in fields)}))")


@query("""
SELECT o_orderkey, c_name, c_mktsegment, (o_totalprice > c_acctbal) AS covered FROM orders JOIN customer ON o_custkey = c_custkey""")
def q14_fan_in_record(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    jobs = joined.select("o_orderkey", F.expr("to_variant_object(named_struct('price', o_totalprice, 'name', c_name, 'part', c_mktsegment, 'balance', c_acctbal))").alias("input"))
    blocks = {"order": taken(("price", "$.price", "double")), "who": taken(("name", "$.name", "string"), ("part", "$.part", "string"), ("balance", "$.balance", "double")),
              "cover": SqlBlock("to_variant_object(named_struct('covered', try_variant_get(input, '$.o.price', 'double') > try_variant_get(input, '$.deep.c.balance', 'double'), "
                                "'name', try_variant_get(input, '$.deep.c.name', 'string'), 'part', try_variant_get(input, '$.deep.c.part', 'string')))")}  # fmt: skip
    done = compiled('a = { block = "order" }; b = { block = "who" }; c = { block = "cover"; in = { o = a.out; deep = { c = b.out } } }', blocks, jobs)
    return done.select("o_orderkey", given("c", "$.name", "string").alias("c_name"), given("c", "$.part", "string").alias("c_mktsegment"), given("c", "$.covered", "boolean").alias("covered"))


@query("SELECT p_partkey, p_name AS first_one, p_type AS last_one, 3::bigint AS n FROM part")
def q15_fan_in_list(t):
    jobs = t("part").select("p_partkey", F.expr("to_variant_object(named_struct('name', p_name, 'brand', p_brand, 'type', p_type))").alias("input"))
    pick = lambda f: SqlBlock(f"try_variant_get(input, '$.{f}', 'variant')")
    ends = SqlBlock("to_variant_object(named_struct('first', try_variant_get(input, '$[0]', 'string'), 'last', try_variant_get(input, '$[2]', 'string'), 'n', size(cast(input as array<variant>))))",
                    parse_signature("[json] -> json"))
    blocks = {"name": pick("name"), "brand": pick("brand"), "type": pick("type"), "ends": ends}
    done = compiled('x = { block = "name" }; y = { block = "brand" }; z = { block = "type" }; zz = { block = "ends"; in = [x.out, y.out, z.out] }', blocks, jobs)
    return done.select("p_partkey", given("zz", "$.first", "string").alias("first_one"), given("zz", "$.last", "string").alias("last_one"), given("zz", "$.n", "long").alias("n"))


@query("""
WITH x AS (SELECT l_orderkey, l_returnflag, (l_extendedprice * (1 - l_discount))::decimal(18, 4) AS net FROM lineitem)
SELECT l_orderkey, sum(net)::decimal(38, 4)::double AS total, count(*) FILTER (l_returnflag = 'R') AS returned FROM x GROUP BY 1""")
def q16_shared_upstream(t):
    jobs = t("lineitem").select("l_orderkey", F.expr(
        "to_variant_object(named_struct('price', l_extendedprice, 'discount', l_discount, 'flag', l_returnflag))").alias("input"))
    blocks = {"net": SqlBlock("to_variant_object(named_struct('net', try_variant_get(input, '$.price', 'double') * (1 - try_variant_get(input, '$.discount', 'double')), 'flag', try_variant_get(input, '$.flag', 'string')))"),
              "money": taken(("net", "$.net", "decimal(18,4)")), "back": SqlBlock("to_variant_object(named_struct('returned', try_variant_get(input, '$.flag', 'string') = 'R'))")}
    done = compiled('a = { block = "net" }; b = { block = "money"; in = a.out }; c = { block = "back"; in = a.out }', blocks, jobs)
    # both readers of the shared node need the same grouping: one shuffle serves them
    return done.groupBy("l_orderkey").agg(F.sum(given("b", "$.net", "decimal(18,4)")).cast("double").alias("total"), F.count_if(given("c", "$.returned", "boolean")).alias("returned"))


BRANCH = """spec branch = { description = "route by kind"; model = stub ""; data_policy = Any; capabilities = [];
  nodes = { decide = { block = "decide" }; on_error = { block = "flag"; in = decide.out }; on_other = { block = "pass"; in = decide.out };
            after_error = { block = "pass"; in = on_error.out } };
  branches = { decide = { "error" -> on_error; "other" -> on_other } } }"""
BRANCH_BLOCKS = {
    "decide": SqlBlock("to_variant_object(named_struct('route', try_variant_get(input, '$.route', 'string'), 'value', try_variant_get(input, '$.value', 'double')))",
                       parse_signature("json -> {route: text, value: json}")),
    "flag": SqlBlock("to_variant_object(named_struct('value', -1 * try_variant_get(input, '$.value', 'double')))"),
    "pass": SqlBlock("input"),
}


def branched(t, route: str) -> tuple:
    graph = analyze(parse_spec(BRANCH), BRANCH_BLOCKS)
    jobs = t("events").select(F.col("event_id").alias("job_id"), F.expr(f"to_variant_object(named_struct('route', {route}, 'value', value))").alias("input"))
    return graph, compile_graph(graph, jobs)


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'other' END AS route, count(*) AS n,
       sum((CASE WHEN event_type = 'error' THEN -value ELSE value END)::decimal(18, 4))::decimal(38, 4)::double AS total FROM events GROUP BY 1""")
def q17_branch_route(t):
    graph, done = branched(t, "if(event_type = 'error', 'error', 'other')")
    route = F.when(F.col("s_on_error"), "other").otherwise("error")
    value = F.coalesce(*[F.try_variant_get(F.col(f"{result_column(n)}.output"), "$.value", "double") for n in ("on_error", "on_other")])
    return done.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum(value.cast("decimal(18,4)")).cast("double").alias("total"))


@query("""
SELECT event_id, event_type <> 'error' AS error_skipped, event_type <> 'error' AS after_skipped, event_type = 'error' AS other_skipped FROM events""")
def q18_transitive_skip(t):
    _, done = branched(t, "if(event_type = 'error', 'error', 'other')")
    return done.select(F.col("job_id").alias("event_id"), F.col("s_on_error").alias("error_skipped"), F.col("s_after_error").alias("after_skipped"), F.col("s_on_other").alias("other_skipped"))


@query("SELECT event_type, count(*) AS n_failed FROM events WHERE event_type <> 'error' GROUP BY 1")
def q19_unmatched_route(t):
    _, done = branched(t, "event_type")
    failed = done.where(F.col("failure.code") == "schema_validation_failed")
    return failed.join(t("events").select(F.col("event_id").alias("job_id"), "event_type"), "job_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_failed"))


LOOP = """spec loop = {{ description = "halve until small"; model = stub ""; data_policy = Any; capabilities = [];
  nodes = {{ halve = {{ block = "halve"; repeat_until = "state"; max_iterations = {n} }} }} }}"""
HALVE = {"halve": SqlBlock(
    "to_variant_object(named_struct('x', try_variant_get(input, '$.x', 'bigint') div 2, 'n', coalesce(try_variant_get(input, '$.n', 'bigint'), 0) + 1, "
    "'state', if(try_variant_get(input, '$.x', 'bigint') div 2 < 2, 'done', 'more')))")}  # fmt: skip


def looped(t, n: int) -> DataFrame:
    graph = analyze(parse_spec(LOOP.format(n=n)), HALVE)
    jobs = t("events").select(F.col("event_id").alias("job_id"), F.expr("to_variant_object(named_struct('x', cast(floor(abs(value)) as bigint)))").alias("input"))
    return compile_graph(graph, jobs)


_HALVING = """
WITH RECURSIVE r AS (
  SELECT event_id, floor(abs(value))::bigint // 2 AS x, 1 AS n FROM events
  UNION ALL SELECT event_id, x // 2, n + 1 FROM r WHERE x >= 2 AND n < {most})
"""


@query(_HALVING.format(most=60) + "SELECT event_id, max(n)::bigint AS n, arg_max(x, n) AS x FROM r GROUP BY 1")
def q20_repeat_until(t):
    out = F.col(f"{result_column('halve')}.output")
    return looped(t, 60).select(F.col("job_id").alias("event_id"), F.try_variant_get(out, "$.n", "long").alias("n"), F.try_variant_get(out, "$.x", "long").alias("x"))


@query(_HALVING.format(most=3) + "SELECT event_id FROM r GROUP BY 1 HAVING arg_max(x, n) >= 2")
def q21_loop_exhaustion(t):
    return looped(t, 3).where(F.col("failure.code") == "schema_validation_failed").select(F.col("job_id").alias("event_id"))


@query("SELECT event_id, 'completed' AS status, (CASE WHEN event_type = 'error' THEN -value ELSE value END)::decimal(18, 4)::double AS result FROM events")
def q22_last_live_output(t):
    graph, done = branched(t, "if(event_type = 'error', 'error', 'other')")
    rows = envelopes(graph, done)
    return rows.select(F.col("job_id").alias("event_id"), "status", F.try_variant_get("result", "$.value", "double").cast("decimal(18,4)").cast("double").alias("result"))


@query("SELECT event_id AS item, (value * 2)::decimal(18, 4)::double AS twice FROM events WHERE event_type <> 'error'")
def q23_fanout_results(t):
    ok = fanned(t).where("error is null")
    return ok.select(F.col("item_index").alias("item"), F.get_json_object("output", "$.twice").cast("double").cast("decimal(18,4)").cast("double").alias("twice"))


@query("SELECT event_id AS item, 'refused event ' || event_id AS error FROM events WHERE event_type = 'error'")
def q24_fanout_failures(t):
    return fanned(t).where("error is not null").select(F.col("item_index").alias("item"), "error")


@query("SELECT count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events")
def q25_collection_counts(t):
    return lg.counts(fanned(t)).select("succeeded", "failed")


@query("SELECT arg_min('refused event ' || event_id, event_id) AS first_error FROM events WHERE event_type = 'error'")
def q26_first_failure(t):
    return lg.counts(fanned(t)).select("first_error")


@query("""
SELECT event_type, count(*) AS counted, sum((value * 2)::decimal(18, 2))::decimal(38, 2)::double AS twice FROM events WHERE event_type <> 'error' GROUP BY 1""")
def q27_reduce(t):
    ok = fanned(t).where("error is null").select(F.try_parse_json("output").alias("v"))
    kind, twice = F.try_variant_get("v", "$.kind", "string"), F.try_variant_get("v", "$.twice", "double").cast("decimal(18,2)")
    return ok.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("counted"), F.sum(twice).cast("double").alias("twice"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q28_resume_pending(t):
    return lg.pending(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("SELECT d.doc_id, d.lang, l.quality::bigint AS recorded FROM documents d JOIN labels l USING (doc_id)")
def q29_resume_reuse(t):
    kept = lg.reuse(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")
    return kept.select("doc_id", "lang", long("quality", "recorded"))


@query("SELECT event_type AS name, arg_max(event_id::varchar, strftime(ts, '%Y-%m-%d') || event_id::varchar) AS name_version FROM events GROUP BY 1")
def q30_latest_version(t):
    # versions of a day have the same time: the later key holds
    entries = t("events").select(F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("name_version"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"))
    return cat.newest_versions(entries)


@query("""
WITH e AS (SELECT p_brand AS name, p_brand || '@' || p_partkey AS name_version, (p_size // 20)::varchar AS created_at FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, name_version) AS r FROM e)
SELECT name_version, levenshtein(name, 'Brand#1')::bigint AS distance FROM n
WHERE r = 1 AND levenshtein(name, 'Brand#1') <= 2 ORDER BY levenshtein(name, 'Brand#1'), created_at, name LIMIT 5""")
def q31_did_you_mean(t):
    # three times only, so names have several newest versions: the smaller key holds
    entries = t("part").select(F.col("p_brand").alias("name"), F.concat_ws("@", "p_brand", F.col("p_partkey").cast("string")).alias("name_version"),
                               F.floor(F.col("p_size") / 20).cast("string").alias("created_at"))
    return cat.did_you_mean(entries, "Brand#1").select("name_version", long("distance", "distance"))


@query("SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1")
def q32_content_dedup(t):
    return cat.dedup_by_hash(t("documents"), "text")


@query("""
SELECT o_orderkey::varchar AS name_version FROM orders
WHERE NOT (o_orderstatus = 'F' AND sha256(o_orderpriority) <> sha256('1-URGENT'))""")
def q33_tombstone(t):
    orders = t("orders").select(F.col("o_orderkey").cast("string").alias("name_version"), "o_orderstatus", F.sha2("o_orderpriority", 256).alias("hash"))
    retired = orders.where("o_orderstatus = 'F'").select("name_version", F.sha2(F.lit("1-URGENT"), 256).alias("hash"))
    return cat.addable(orders, retired).select("name_version")


@query("""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')[1:5], ' ') AS reply,
       len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))::bigint AS tokens_in FROM documents""".replace("\\\\", "\\"))
def q34_stub_infer(t):
    return t("documents").select("doc_id", tx.stub_reply(F.col("text"), 5).alias("reply"), tx.word_count(F.col("text")).alias("tokens_in"))


@query("""
SELECT lang, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')))::bigint AS tokens_in, (3 * count(*))::bigint AS tokens_out
FROM documents GROUP BY 1""".replace("\\\\", "\\"))
def q35_usage_sum(t):
    answered = infer(t("documents").select("lang", F.col("text").alias("prompt")), Stub())
    return answered.groupBy("lang").agg(F.sum("answer.tokens_in").alias("tokens_in"), F.sum("answer.tokens_out").alias("tokens_out"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY 1")
def q36_event_replay(t):
    return replay(t("conversations"), "conv_id", "turn", "text", " ")


@query("""
WITH m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'qwen3:' WHEN 1 THEN 'Llama3.2:' WHEN 2 THEN 'nomic-embed:' ELSE '' END || lower(p_name) AS model FROM part)
SELECT p_partkey, CASE WHEN contains(model, 'embed') THEN NULL WHEN regexp_matches(lower(model), 'qwq|qwen3|magistral') THEN true
  WHEN regexp_matches(lower(model), 'llama3|llama2|gemma|mistral|phi3') THEN false END AS reasoning FROM m""")
def q38_reasoning_tag(t):
    n = F.col("p_partkey") % 5
    family = F.when(n == 0, "qwen3:").when(n == 1, "Llama3.2:").when(n == 2, "nomic-embed:").otherwise("")
    return t("part").select("p_partkey", tx.reasoning_tag(F.concat(family, F.lower("p_name"))).alias("reasoning"))


from sluiceway import catalogue_jobs as _jobs  # noqa: E402, F401  (registers the queries that run whole jobs)
