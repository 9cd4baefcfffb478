import pytest

from sluiceway.plans import types as ty
from sluiceway.plans.analyze import analyze, gates, order
from sluiceway.plans.blocks import PyBlock, SqlBlock, read_header, sql_block
from sluiceway.plans.speclang import FromNode, SpecError, parse_spec
from sluiceway.plans.types import parse, parse_signature


def spec(nodes, branches="", roots='Read "data"'):
    extra = f"branches = {{ {branches} }};" if branches else ""
    return parse_spec(f'spec s = {{ description = "d"; model = Stub "m"; data_policy = Any; capabilities = [{roots}]; nodes = {{ {nodes} }}; {extra} }}')


@pytest.mark.parametrize("text", ["text", "bytes", "image", "document", "json", "[text]", "[[bytes]]", "{}", "{a: [text], b: {c: json}}"])
def test_types_round_trip(text):
    assert parse(text).describe() == text
    assert parse(f"  {text} ") == parse(text)


@pytest.mark.parametrize("have, need, ok", [
    ("text", "json", True), ("json", "text", False), ("[text]", "[json]", True), ("{a: text, b: text}", "{a: text}", True),
    ("{a: text}", "{a: text, b: text}", False), ("text", "bytes", False), ("[json]", "[text]", False), ("{}", "json", True),
])
def test_assignability(have, need, ok):
    assert parse(have).assignable_to(parse(need)) is ok


def test_type_syntax():
    assert parse("{a: text, }").describe() == "{a: text}"
    assert parse("{a: text, a: json}").describe() == "{a: json}"
    for bad in ("number", "[text", "{a text}", "{1: text}"):
        with pytest.raises(ValueError):
            parse(bad)
    assert parse_signature("{path: text} -> json").describe() == "{path: text} -> json"
    with pytest.raises(ValueError):
        parse_signature("text")


def test_accepts_values_and_columns(spark):
    from pyspark.sql import functions as F

    want = parse("{s: text, l: [text]}")
    rows = ['{"s":"a","l":["b"],"x":1}', '{"s":1,"l":[]}', '{"s":"a"}', '{"s":"a","l":["b",2]}', '{"s":"a","l":"b"}', "[]", '"a"', "null", '{"s":"a","l":[]}']
    import json

    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = df.select("i", want.accepts_column(F.col("v")).alias("c"), F.expr(want.accepts_sql("v")).alias("q")).orderBy("i").collect()
    expected = [want.accepts(json.loads(r)) for r in rows]
    assert [r["c"] for r in got] == expected == [r["q"] for r in got]
    assert isinstance(ty.TEXT.to_spark().typeName(), str)


def test_spec_reads_all_fields():
    s = spec('a = { block = "x@1"; over = "data/m.jsonl" }; b = { block = "y"; in = { p = a.out; q = [a.out, a.out] } }')
    assert [n.name for n in s.nodes] == ["a", "b"] and s.provider == "stub" and s.roots == ("data",)
    assert s.nodes[0].over == "data/m.jsonl"
    one = parse_spec('spec s = { description = "a;b\\n"; model = x "y"; data_policy = Local_only; capabilities = []; block = "k" }')
    assert one.nodes[0].block == "k" and one.description == "a;b\n" and one.is_chain()


@pytest.mark.parametrize("nodes, branches", [
    ('a = { over = "data/x" }', ""), ('a = { block = "x"; repeat_until = "s" }', ""), ('a = { block = "x"; max_iterations = 3 }', ""),
    ('a = { block = "x"; over = "data/m"; repeat_until = "s"; max_iterations = 2 }', ""), ("", ""), ('a = { block = "x" } a = { block = "x" }', ""),
    ('a = { block = "x"; over = "elsewhere/m" }', ""), ('a = { block = "x"; over = "data/../m" }', ""), ('a = { block = "x"; in = b.out.c }', ""),
    ('a = { block = "x"; pipeline = "y" }', ""),
])
def test_specs_refused(nodes, branches):
    with pytest.raises(SpecError):
        spec(nodes, branches)


def test_spec_error_has_a_place():
    with pytest.raises(SpecError) as e:
        parse_spec('spec s = {\n  description = "d";\n  colour = "red"\n}')
    assert e.value.line == 3 and "colour" in str(e.value)
    for bad in ('spec s = { description = "d', "spec s = { - }", 'spec s = { description = "\\q" }'):
        with pytest.raises(SpecError):
            parse_spec(bad)
    with pytest.raises(SpecError):
        parse_spec('spec s = { description = "d"; model = x "y"; data_policy = Any; capabilities = []; block = "k" } more')


def test_order_is_topological_and_alphabetical():
    s = spec('z = { block = "x" }; b = { block = "x"; in = z.out }; a = { block = "x"; in = z.out }; c = { block = "x"; in = [a.out, b.out] }')
    assert order(s) == ["z", "a", "b", "c"]
    with pytest.raises(SpecError):
        order(spec('a = { block = "x"; in = b.out }; b = { block = "x"; in = a.out }'))
    with pytest.raises(SpecError):
        order(spec('a = { block = "x"; in = a.out }'))
    assert order(spec('a = { block = "x"; in = a.out; repeat_until = "s"; max_iterations = 2 }')) == ["a"]


def test_exclusive_routes():
    nodes = 'd = { block = "x" }; p = { block = "x"; in = d.out }; q = { block = "x"; in = d.out }; '
    with pytest.raises(SpecError):
        s = spec(nodes + 'm = { block = "x"; in = [p.out, q.out] }', 'd = { "p" -> p; "q" -> q }')
        gates(s, order(s))
    s = spec(nodes + 'm = { block = "x"; in = p.out }', 'd = { "p" -> p; "q" -> q; "r" -> p }')
    assert gates(s, order(s))["m"] == {"d": frozenset({"p", "r"})}
    with pytest.raises(SpecError):
        s = spec(nodes, 'd = { "p" -> nobody }')
        gates(s, order(s))


def test_analysis_checks_seams():
    text = SqlBlock("input", parse_signature("json -> text"))
    wants = SqlBlock("input", parse_signature("{segment: text, finding: text} -> json"))
    s = spec('a = { block = "t" }; b = { block = "w"; in = { segment = a.out } }')
    with pytest.raises(SpecError, match="needs"):
        analyze(s, {"t": text, "w": wants})
    gives = SqlBlock("input", parse_signature("json -> {segment: text, finding: text}"))
    s = spec('a = { block = "g" }; b = { block = "w"; in = { segment = a.out; finding = a.out } }')
    with pytest.raises(SpecError, match="a.out"):
        analyze(s, {"g": gives, "w": wants})
    ok = analyze(spec('a = { block = "g" }; b = { block = "w"; in = a.out }'), {"g": gives, "w": wants})
    other = analyze(spec('a = { block = "g" }; b = { block = "w"; in = a.out }'), {"g": gives, "w": SqlBlock("parse_json('1')", wants.signature)})
    assert ok.fingerprint != other.fingerprint and len(ok.fingerprint) == 64
    with pytest.raises(SpecError, match="no block"):
        analyze(s, {})


def test_fan_out_shows_a_collection():
    s = spec('a = { block = "t"; over = "data/m" }; b = { block = "r"; in = a.out }')
    reader = SqlBlock("input", parse_signature("{results_path: text, succeeded: json} -> json"))
    assert analyze(s, {"t": SqlBlock("input"), "r": reader}).named("a").output == ty.COLLECTION


def test_block_headers():
    assert read_header("-- signature: text -> json\ninput").input == ty.TEXT
    assert sql_block("-- signature: json -> json\n-- more\ninput\n").expression == "input"
    for bad in ("input", "-- signature: json -> json\n-- signature: json -> json\ninput", "-- signature: json -> json\n"):
        with pytest.raises(ValueError):
            sql_block(bad)
    assert PyBlock(len).source() != PyBlock(max, name="other").source()
    assert FromNode("a") == FromNode("a")
