import json

from pyspark.sql import functions as F

from sluiceway.plans.analyze import analyze
from sluiceway.plans.blocks import BlockFailed, PyBlock, SqlBlock
from sluiceway.plans.compile import compile_graph, envelopes
from sluiceway.plans.speclang import parse_spec
from sluiceway.plans.types import parse_signature

HEAD = 'spec s = {{ description = "d"; model = stub ""; data_policy = Any; capabilities = []; nodes = {{ {} }} {} }}'


def run(spark, nodes, blocks, inputs, branches=""):
    graph = analyze(parse_spec(HEAD.format(nodes, f"; branches = {{ {branches} }}" if branches else "")), blocks)
    jobs = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(inputs)], "job_id int, j string").select("job_id", F.parse_json("j").alias("input"))
    rows = envelopes(graph, compile_graph(graph, jobs)).select("job_id", "status", F.to_json("result").alias("r"), "error").orderBy("job_id").collect()
    return [(r["status"], json.loads(r["r"]) if r["r"] else None, r["error"] and r["error"]["message"]) for r in rows]


def decide(value, host):
    return {"route": value["route"], "v": value.get("v")}


def boom(value, host):
    raise AssertionError("must not run")


def test_fan_in_record_and_list(spark):
    blocks = {"a": SqlBlock("to_variant_object(named_struct('a', 'from-a'))"), "b": SqlBlock("to_variant_object(named_struct('b', 'from-b'))"), "p": SqlBlock("input")}
    got = run(spark, 'a = { block = "a" }; b = { block = "b" }; c = { block = "p"; in = { x = a.out; y = [a.out, b.out] } }', blocks, [1])
    assert got == [("completed", {"x": {"a": "from-a"}, "y": [{"a": "from-a"}, {"b": "from-b"}]}, None)]


def test_branches_skip_and_fail(spark):
    blocks = {"d": PyBlock(decide), "p": SqlBlock("input"), "n": SqlBlock("to_variant_object(named_struct('neg', -1 * try_variant_get(input, '$.v', 'int')))")}
    nodes = 'd = { block = "d" }; x = { block = "p"; in = d.out }; y = { block = "n"; in = d.out }; z = { block = "p"; in = y.out }'
    got = run(spark, nodes, blocks, [{"route": "x", "v": 1}, {"route": "y", "v": 2}, {"route": "w"}, {"route": 5}], 'd = { "x" -> x; "y" -> y }')
    assert got[0] == ("completed", {"route": "x", "v": 1}, None)
    assert got[1] == ("completed", {"neg": -2}, None)
    assert got[2][0] == got[3][0] == "failed" and "w" in got[2][2]


def test_python_blocks_on_other_routes_do_not_run(spark):
    blocks = {"d": PyBlock(decide), "boom": PyBlock(boom, name="boom"), "p": SqlBlock("input")}
    nodes = 'd = { block = "d" }; x = { block = "boom"; in = d.out }; y = { block = "p"; in = d.out }'
    got = run(spark, nodes, blocks, [{"route": "y"}, {"route": "x"}], 'd = { "x" -> x; "y" -> y }')
    assert got[0][0] == "completed" and got[1][0] == "failed" and "must not run" in got[1][2]


def count_up(value, host):
    n = value.get("n", 0) + 1
    return {"n": n, "state": "done" if n >= value.get("to", 3) else "not-yet", "to": value.get("to", 3)}


def test_loops(spark):
    sql = SqlBlock("to_variant_object(named_struct('n', coalesce(try_variant_get(input, '$.n', 'int'), 0) + 1, 'to', try_variant_get(input, '$.to', 'int'), "
                   "'state', if(coalesce(try_variant_get(input, '$.n', 'int'), 0) + 1 >= try_variant_get(input, '$.to', 'int'), 'done', 'not-yet')))")  # fmt: skip
    for block in (sql, PyBlock(count_up)):
        got = run(spark, 'l = { block = "b"; repeat_until = "state"; max_iterations = 3 }', {"b": block}, [{"to": 1}, {"to": 3}, {"to": 4}])
        assert [g[1] and g[1]["n"] for g in got] == [1, 3, None]
        assert got[2][0] == "failed" and "3 times" in got[2][2]


def picky(value, host):
    if value == 0:
        raise BlockFailed("bad chunk")
    return {"doubled": value * 2} if value != 9 else "nine"


def test_failures_stay_on_their_row(spark):
    blocks = {"k": PyBlock(picky, parse_signature("json -> {doubled: json}")), "p": SqlBlock("input")}
    got = run(spark, 'a = { block = "k" }; b = { block = "p"; in = a.out }', blocks, [1, 0, 9])
    assert got[0] == ("completed", {"doubled": 2}, None)
    assert got[1] == ("failed", None, "bad chunk")
    assert got[2][0] == "failed" and "promised" in got[2][2]


def test_later_stages_are_blamed_and_nothing_partial_is_returned(spark):
    bad = SqlBlock("input", error="if(try_variant_get(input, '$', 'int') = 7, 'no sevens', null)")
    got = run(spark, 'a = { block = "p" }; b = { block = "bad"; in = a.out }', {"p": SqlBlock("input"), "bad": bad}, [7, 8])
    assert got == [("failed", None, "block 2 of the pipeline: no sevens"), ("completed", 8, None)]


def test_filters_do_not_multiply_expressions(spark):
    nodes = '; '.join(['n0 = { block = "p" }'] + [f'n{i} = {{ block = "p"; in = [n{i - 1}.out, n{i - 1}.out] }}' for i in range(1, 6)])
    graph = analyze(parse_spec(HEAD.format(nodes, "")), {"p": SqlBlock("input")})
    jobs = spark.sql("SELECT 1 AS job_id, parse_json('1') AS input")
    df = compile_graph(graph, jobs).where("failure is null")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 200_000 and df.count() == 1
