import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from sluiceway.cli import main
from sluiceway.jobs import Engine, JobError
from sluiceway.operators.infer import Registry, Stub, Unsupported
from sluiceway.plans.blocks import BlockFailed, PyBlock, SqlBlock, py_block
from sluiceway.plans.types import parse_signature
from sluiceway.sources import bundle
from sluiceway.sources.catalog import Catalog, CatalogError, did_you_mean
from sluiceway.sources.manifest import ManifestError, read_manifest
from sluiceway.streaming.events import EventLog, incremental_fanout, replay


def price(value, host):
    if value["kg"] < 0:
        raise BlockFailed("no such weight")
    host.emit({"priced": value["kg"]})
    return {"fee": 3 + 2 * value["kg"]} if value["kg"] != 7 else {"gift": True}


def bill(value, host):
    """Adds up the fees of the file of results, window by window."""
    file, at, text = host.open(value["results_path"]), 0, ""
    while at < file["len"]:
        window = host.slice(file["handle"], at, 16)
        text, at = text + window["text"], window["next_offset"]
    return {"total": sum(json.loads(line)["result"]["fee"] for line in text.splitlines()), "refused": value["failed"]}


BLOCKS = {
    "price": PyBlock(price, parse_signature("{kg: json} -> {fee: json}"), "price"),
    "bill": PyBlock(bill, parse_signature("{results_path: text, failures_path: text, succeeded: json, failed: json} -> json"), "bill"),
}


def shipment(tmp_path, lines):
    path = tmp_path / "crates.jsonl"
    path.write_text(lines)
    return f"""spec shipment = {{ description = "price crates, then bill them"; model = stub ""; data_policy = Any; capabilities = [Read "{tmp_path}"];
      nodes = {{ priced = {{ block = "price"; over = "{path}" }}; total = {{ block = "bill"; in = priced.out }} }} }}"""


def one(block):
    return f'spec s = {{ description = "d"; model = stub ""; data_policy = Any; capabilities = []; block = "{block}" }}'


def lines_of(spark, path):
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()]


def test_fan_out_and_reduce(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"), BLOCKS)
    engine.load(shipment(tmp_path, '{"kg":1}\n\n{"kg":2}\r\n{"kg":-1}\n{"x":4}\n{"kg":7}\n{"kg":10}\n'))
    got = engine.submit("shipment", {}, "j/1")
    assert got["status"] == "completed" and got["result"] == {"total": 5 + 7 + 23, "refused": 3}
    base = engine.ledger.results("j/1")
    assert lines_of(spark, f"{base}/priced.results.jsonl") == [{"item": 0, "result": {"fee": 5}}, {"item": 1, "result": {"fee": 7}}, {"item": 5, "result": {"fee": 23}}]
    bad = lines_of(spark, f"{base}/priced.failures.jsonl")
    assert bad[0] == {"item": 2, "error": "no such weight"} and [b["item"] for b in bad] == [2, 3, 4] and "input" in bad[1]["error"] and "output" in bad[2]["error"]
    log = engine.events("j/1").collect()
    assert [r["type"] for r in log] == ["progress"] * 7 + ["result"]  # two stages, four crates that were priced, the end of the fan-out
    assert [json.loads(r["payload"])["priced"] for r in log[1:5]] == [1, 2, 7, 10] and json.loads(log[5]["payload"])["failed"] == 3
    assert engine.status("j/1") == "completed" and engine.wait("j/1")["result"]["total"] == 35
    with pytest.raises(JobError):
        engine.resume("j/1")
    with pytest.raises(JobError):
        engine.submit("other", {})


def test_manifests_that_fail(spark, tmp_path):
    for text, what in (("", "empty"), ("\n\n", "empty"), ('{"n":1}\n\nnot json\n', "line 3"), ('{"n":1}\n{"n":2} x\n', "line 2"), ("1\n2,3\n", "line 2"), ("1] [2\n", "line 1"), ('1} {"y":2\n', "line 1")):
        (tmp_path / "m").write_text(text)
        with pytest.raises(ManifestError, match=what):
            read_manifest(spark, str(tmp_path / "m"))
    (tmp_path / "m").write_bytes(b'"\xff"\n')
    with pytest.raises(ManifestError, match="UTF-8"):
        read_manifest(spark, str(tmp_path / "m"))
    with pytest.raises(ManifestError, match="exist"):
        read_manifest(spark, str(tmp_path / "none"))
    engine = Engine(spark, str(tmp_path / "state"), BLOCKS)
    engine.load(shipment(tmp_path, '{"kg":-1}\n{"kg":-2}\n'))
    got = engine.submit("shipment", {})
    assert got["status"] == "failed" and "no such weight" in got["error"]["message"]


def test_manifest_over_many_blocks(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "é" * (i % 50)}) if i % 7 else "" for i in range(3000)]
    (tmp_path / "m").write_text("\n".join(lines) + "\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        items, _ = read_manifest(spark, str(tmp_path / "m"))
        got = items.select("item_index", F.try_variant_get("input", "$.n", "int").alias("n")).orderBy("item_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == list(enumerate(i for i in range(3000) if i % 7))


def test_resume_keeps_what_concluded(spark, tmp_path):
    source, state = shipment(tmp_path, '{"kg":1}\n{"kg":2}\n{"kg":3}\n'), str(tmp_path / "state")
    engine = Engine(spark, state, BLOCKS)
    graph = engine.load(source)
    _, digest = read_manifest(spark, f"{tmp_path}/crates.jsonl")
    engine.ledger.put_job("j", "running", graph.fingerprint, "shipment", "{}")
    engine.ledger.pin("j", "priced", digest)
    engine.ledger.record("j", "priced", spark.createDataFrame([(0, '{"fee":1000}', None), (1, None, "failed before")], "item_index long, output string, error string"))
    (tmp_path / "state/jobs/broken.json").write_text("{not json")
    again = Engine(spark, state, BLOCKS)  # a record that can't be read doesn't stop it
    again.load(source)
    assert again.status("j") == "interrupted" and again.jobs().count() == 1
    assert again.resume("j")["result"] == {"total": 1009, "refused": 1}
    rows = lines_of(spark, f"{state}/results/j/priced.results.jsonl")
    assert rows[0]["result"] == {"fee": 1000} and rows[1]["item"] == 2
    assert again.ledger.item("j", "priced", 1).first()["error"] == "failed before" and again.ledger.item("j", "priced", 9).isEmpty()


def test_one_of_several_callers_resumes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"), {"echo": SqlBlock("input")})
    graph = engine.load(one("echo"))
    engine.ledger.put_job("j", "interrupted", graph.fingerprint, "s", "5")
    other = Engine(spark, str(tmp_path / "state"), {"echo": SqlBlock("input")})
    other.load(one("echo"))
    assert engine.ledger.claim("j", 1)  # another process was first
    with pytest.raises(JobError) as e:
        other.resume("j")
    assert e.value.code == 409


def test_edited_manifest_and_changed_spec_are_refused(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"), BLOCKS)
    graph = engine.load(shipment(tmp_path, '{"kg":1}\n'))
    engine.ledger.pin("j", "priced", "another digest")
    got = engine.submit("shipment", {}, "j")
    assert got["status"] == "failed" and "changed" in got["error"]["message"] and "priced" in got["error"]["message"]
    engine.ledger.put_job("k", "interrupted", "another" + graph.fingerprint, "shipment", "{}")
    with pytest.raises(JobError) as e:
        engine.resume("k")
    assert e.value.code == 409
    assert engine.cancel("k") == "cancelled"


def test_many_jobs_in_one_plan(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"), {"echo": SqlBlock("input")})
    engine.load(one("echo"))
    jobs = spark.sql("SELECT id AS job_id, to_variant_object(named_struct('id', id)) AS input FROM range(5)")
    assert engine.submit_all("s", jobs).where("status = 'completed'").count() == 5
    assert engine.submit_all("s", jobs.where("job_id < 3"), "b").count() == 3
    assert engine.submit_all("s", jobs, "b").count() == 5  # three were recorded, two ran
    assert engine.submit_all("s", jobs, "b").count() == 5
    assert [s["name"] for s in engine.specs()] == ["s"]
    engine.submit("s", 1, "one")
    assert engine.jobs().count() == 1


def ask(value, host):
    """signature: json -> {answer: text}"""
    heard = []
    answer = host.infer(value["question"], value["most"], on_token=lambda t: heard.append(t) or len(heard) < 3)
    return {"answer": answer["text"]}


def peek(value, host):
    return host.open(value)["kind"]["kind"]


def see(value, host):
    return host.infer("what is it", images=[host.register(b"GIF89a")["handle"]])["text"]


def read_handle(value, host):
    return host.slice(value, 0, 1)


def test_blocks_use_the_host(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("text")
    (tmp_path / "in-secret").write_text("no")
    (tmp_path / "in/link").symlink_to(tmp_path / "in-secret")
    blocks = {"ask": py_block(ask), "peek": PyBlock(peek, name="peek"), "see": PyBlock(see, name="see"), "pass": SqlBlock("input"), "handle": PyBlock(read_handle, name="h")}
    registry = Registry()
    registry.register("Blind", lambda model: Stub(model, vision=False))
    engine = Engine(spark, str(tmp_path / "state"), blocks, registry)
    spec = 'spec {} = {{ description = "d"; model = {} "the cat sat on the mat"; data_policy = Any; capabilities = [Read "{}"]; nodes = {{ a = {{ block = "pass" }}; b = {{ block = "{}"; in = a.out }} }} }}'
    for name, provider in (("ask", "stub"), ("peek", "stub"), ("see", "blind"), ("handle", "stub")):
        engine.load(spec.format(name, provider, tmp_path / "in", name))
    got = engine.submit("ask", {"question": "who sat where", "most": 9}, "j")
    assert got["result"] == {"answer": "the cat sat"} and got["usage"]["tokens_in"] == 3 and got["usage"]["tokens_out"] == 3 and got["usage"]["model"] == "the cat sat on the mat"
    tokens = engine.events("j").where("type = 'token'")
    assert replay(tokens.withColumn("t", F.get_json_object("payload", "$")), "job_id", "seq", "payload", " ").first()["text"] == '"the" "cat" "sat"'
    assert engine.submit("peek", f"{tmp_path}/in/a.txt")["result"] == "text"
    for path in (f"{tmp_path}/in-secret", f"{tmp_path}/in/link", f"{tmp_path}/in/none", f"{tmp_path}/in/../in-secret"):
        denied = engine.submit("peek", path)
        assert denied["status"] == "failed" and denied["error"]["code"] == "capability_denied" and not denied["error"]["message"].startswith("block 2")
    assert engine.submit("see", 1)["error"]["code"] == "unsupported" and engine.submit("handle", 3)["error"]["message"] == "no such handle: 3"
    with pytest.raises(Unsupported, match="llamacpp"):
        registry.resolve("other", "")
    with pytest.raises(Unsupported, match="native"):
        registry.resolve("llamacpp", "m")


COUNT = [0]


def fickle(value, host):
    COUNT[0] += 1
    return host.infer(f"{COUNT[0]}")["text"]


def steady(value, host):
    return [host.infer("x", on_token=lambda t: True)["text"], value]


def test_audit_finds_blocks_that_differ(spark, tmp_path):
    blocks = {"fickle": PyBlock(fickle, name="fickle"), "steady": PyBlock(steady, name="steady")}
    engine = Engine(spark, str(tmp_path / "state"), blocks, audit=True)
    engine.load(one("fickle"))
    assert engine.submit("s", 1)["error"]["code"] == "nondeterministic_replay"
    engine.load(one("steady"))
    got = engine.submit("s", 1)
    assert got["result"] == ["a stub summary", 1] and got["usage"]["tokens_out"] == 3  # the replay isn't charged


def slow(value, host):
    time.sleep(60)
    return value


def test_start_wait_cancel_and_stop(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"), {"slow": PyBlock(slow, name="slow"), "echo": SqlBlock("input")})
    engine.load(one("slow"))
    began = time.time()
    job = engine.start("s", 1)
    assert engine.wait(job, 0.1) is None and engine.status(job) == "running"
    threading.Timer(4, engine.cancel, [job]).start()
    assert engine.wait(job, 50)["status"] == "cancelled" and time.time() - began < 50
    engine.load(one("echo"))
    assert engine.wait(engine.start("s", 2))["result"] == 2
    engine.stop(0)
    with pytest.raises(JobError):
        engine.start("s", 3)


def test_events_follow_from_the_first(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "events"))
    log.append("a/b", ("token", '"x"'), ("token", '"y"'))
    log.append("c", ("token", '"z"'))
    query = log.follow("a/b").writeStream.format("memory").queryName("followed").start()
    try:
        query.processAllAvailable()
        log.append("a/b", ("token", '"w"'))
        query.processAllAvailable()
        assert [r["payload"] for r in spark.table("followed").orderBy("seq").collect()] == ['"x"', '"y"', '"w"']
    finally:
        query.stop()
    assert log.read().count() == 4 and log.read("none").count() == 0


def test_catalog(spark, tmp_path):
    c = Catalog(str(tmp_path / "c"))
    block = b"-- signature: json -> json\ninput"
    first = c.add("summarize@1", block)
    c.add("summarize@2", block)
    c.add("other@1", block + b"\n")
    assert len(list((tmp_path / "c/blobs").iterdir())) == 2 and c.blob(first) == block
    for bad in ("summarize@1", "echo-summarize", "a@b@c"):
        with pytest.raises(CatalogError):
            c.add(bad, block)
    for bad in (b"input", b"-- signature: json -> json\nno_such_function(input)", b"-- signature: json -> json\n(("):
        with pytest.raises(CatalogError):
            c.add("x@1", bad)
    for bad in (b"def run(", b"x = 1"):
        with pytest.raises(CatalogError):
            c.add("x@1", bad, "python")
    with pytest.warns(UserWarning, match="signature"):
        assert c.add("x@1", b"def run(value, host):\n    return value + 1\n", "python")["signature"] == "json -> json"
    assert c.block("x@1").fn(1, None) == 2
    c.remove("x@1")
    assert c.resolve("summarize") == "summarize@2"
    with pytest.raises(CatalogError):
        c.resolve("summarize", durable=True)
    with pytest.raises(CatalogError, match="summarize@1"):
        c.resolve("summarise@1")
    c.remove("summarize@2")
    with pytest.raises(CatalogError):
        c.add("summarize@2", b"-- signature: json -> text\ninput")
    c.add("summarize@2", block)
    with pytest.raises(CatalogError):
        c.blob({"hash": "../index.json"})
    assert [r["name_version"] for r in c.entries(spark).collect()] == ["other@1", "summarize@1", "summarize@2"]
    assert [r["distance"] for r in did_you_mean(c.entries(spark), "sumarize").collect()] == [1]
    (tmp_path / "c/index.json").write_text("{")
    with pytest.raises(CatalogError, match="corrupt"):
        c.index()


def test_bundles(tmp_path):
    from sluiceway.plans.analyze import analyze
    from sluiceway.plans.speclang import parse_spec

    graph = analyze(parse_spec(one("price")), BLOCKS)
    content = bundle.build(graph)
    assert content == bundle.build(graph) and bundle.read(content)["nodes"][0]["block"] == "price"
    for bad in (b"nope", content[:-1], content[:6]):
        with pytest.raises(bundle.BundleError):
            bundle.read(bad)
    with pytest.raises(bundle.BundleError):
        bundle.build(analyze(parse_spec(one("x")), {"x": SqlBlock("input")}))


def test_replay_and_incremental(spark, tmp_path):
    events = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "k string, s int, t string")
    assert sorted(tuple(r) for r in replay(events, "k", "s", "t").collect()) == [("a", "xy"), ("b", "z")]
    seen = []
    (tmp_path / "in").mkdir()
    for name in ("one", "two"):
        (tmp_path / f"in/{name}.jsonl").write_text('{"n":1}\n')
        incremental_fanout(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda batch: seen.append(batch.count()))
    assert seen == [1, 1]


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "schema.json").write_text('{"type":"object","required":["a","b"]}')
    (tmp_path / "v.json").write_text("{}")
    assert main(["validate-json", "schema.json", "v.json"]) == 1 and len(capsys.readouterr().out.splitlines()) == 2
    assert main(["block", "new", "mine"]) == 0 and main(["catalog", "add", "mine@1", "mine.sql"]) == 0 and main(["catalog", "show", "mine@1"]) == 0
    assert main(["block", "new", "yours", "--lang", "python"]) == 0 and main(["catalog", "add", "yours@1", "yours.py"]) == 0
    assert main(["catalog", "show", "none@1"]) == 2 and main(["block", "new", "1x"]) == 2
    (tmp_path / "s.spec").write_text('spec s = { description = "d"; model = stub ""; data_policy = Any; capabilities = []; nodes = { a = { block = "mine@1" }; b = { block = "yours@1"; in = a.out }; c = { block = "yours.py"; in = b.out } } }')
    assert main(["specs", "s.spec"]) == 0 and main(["build", "s.spec", "out"]) == 2
    capsys.readouterr()
    assert main(["run", "s.spec", '{"n": 1}']) == 0 and json.loads(capsys.readouterr().out)["result"] == {"n": 1}
    (tmp_path / "t.spec").write_text(one("out.bundle"))
    (tmp_path / "out.bundle").write_bytes(b"SWBD")
    assert main(["run", "t.spec", "1"]) == 2
