import base64
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from sluiceway.functions import pdf
from sluiceway.functions import text as tx
from sluiceway.functions.schema import violations, violations_column
from sluiceway.operators.host import Host
from sluiceway.operators.infer import Http, Registry, Stub, Unsupported, infer, read_stream
from sluiceway.sources import files as fs


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first()["v"]


def walk(text, size):
    raw, at, out = text.encode(), 0, []
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:
            return None
        out.append((at, end, raw[at:end].decode()))
        at = end
    return out


@pytest.mark.parametrize("text", ["hello world", "héllo wörld — ünicode ✓ 日本語", "aéb", "🙂🙂", "é" * 300])
@pytest.mark.parametrize("size", [4, 5, 7, 64])
def test_windows_are_lossless(spark, text, size):
    got = one(spark, tx.windows(F.col("t"), size), text)
    assert [tuple(w) for w in got] == walk(text, size)


def test_slices(spark):
    c = F.encode("t", "UTF-8")
    cut = lambda t, off, n: tuple(one(spark, tx.slice_text(c, off, n), t))
    assert cut("aéb", 0, 2) == ("a", 1, None) and cut("aéb", 1, 2) == ("é", 3, None)
    assert cut("hello", 0, 99) == ("hello", 5, None) and cut("hello", 5, 3) == ("", 5, None)
    assert cut("hello", 6, 1)[2] == "offset past the end" and cut("é", 0, 1)[2] == "window smaller than one character"
    assert one(spark, tx.slice_bytes(c, 1, 200), "a" * 300) == base64.b64encode(b"a" * 200).decode()
    assert one(spark, tx.windows(F.col("t"), 1), "é") is None


def test_regex(spark):
    t = "Item 1A. RI SK FACTORS é"
    hit = one(spark, tx.regex_find(F.col("t"), r"FACTORS \w"), t)
    raw = t.encode()
    assert (hit["found"], raw[hit["start"] : hit["end"]].decode()) == (True, "FACTORS é")
    assert tuple(one(spark, tx.regex_find(F.col("t"), "zzz"), t)) == (False, -1, -1, "")
    assert one(spark, tx.regex_test(F.col("t"), r"^\d$"), "٣") and one(spark, tx.regex_test(F.col("t"), "(?i)É"), t)
    assert one(spark, tx.regex_replace_all(F.col("t"), "(a)(b)", "$2$1"), "abab") == "baba"
    for bad in ("(", "(?=x)", r"(a)\1"):
        with pytest.raises(tx.PatternError):
            tx.dialect(bad)


@pytest.mark.parametrize("content, kind", [
    (b"", "text"), (b"plain", "text"), (b"%PDF-1.4", "document"), (bytes.fromhex("89504E470D0A1A0A"), "image"), (b"\xff\xd8\xff\xe0", "image"),
    (b"GIF89a", "image"), (b"RIFF0000WEBP", "image"), (b"\x00\xff\xfe\x01\x80\x7f", "binary"), ("é" * 3000).encode()[:4097] and (("é" * 3000).encode()[:4097], "text"),
    (b"a\xc3", "text"), (b"a\xe6\x97", "text"), (b"\xc3", "binary"), (b"a\xff", "binary"),
])
def test_kinds(spark, content, kind):
    df = spark.createDataFrame([(bytearray(content),)], "c binary")
    assert df.select(tx.classify(F.col("c"))["kind"]).first()[0] == kind


def test_names_and_tags(spark):
    assert one(spark, tx.is_catalog_name(F.col("t")), "a.b@1") and not one(spark, tx.is_catalog_name(F.col("t")), "a@b@c")
    assert one(spark, tx.is_block_name(F.col("t")), "my-block") and not one(spark, tx.is_block_name(F.col("t")), "COM1")
    tag = lambda n: one(spark, tx.reasoning_tag(F.col("t")), n)
    assert (tag("Qwen3:8b"), tag("llama3.2:1b"), tag("qwen3-embedding"), tag("unheard-of")) == (True, False, None, None)


def test_schema_lists_every_violation(spark):
    schema = {"type": "object", "required": ["verdict", "score"], "properties": {"verdict": {"enum": ["pass", "fail"]}, "score": {"type": "number", "maximum": 1}}}
    assert violations({"verdict": "pass", "score": 0.5}, schema) == []
    assert len(violations({"verdict": "maybe"}, schema)) == 2 and len(violations({"verdict": 1, "score": "x"}, schema)) == 2
    assert one(spark, violations_column(F.col("t"), schema), "not json") == ["/: not JSON"]


def test_capabilities(tmp_path):
    root = tmp_path / "data"
    (root / "sub").mkdir(parents=True)
    (tmp_path / "data-secret").mkdir()
    (root / "sub/a.txt").write_text("x")
    (tmp_path / "data-secret/b.txt").write_text("x")
    os.symlink(tmp_path / "data-secret/b.txt", root / "link")
    assert fs.permitted(str(root / "sub/../sub/a.txt"), [str(root)])
    for bad in (root / "link", tmp_path / "data-secret/b.txt", root / "../data-secret/b.txt", root / "none"):
        with pytest.raises(fs.CapabilityDenied):
            fs.permitted(str(bad), [str(root)])


PDF = b"%PDF-1.4\n1 0 obj<</Type /Page /Contents 2 0 R>>endobj\n2 0 obj<</Length 9>>\nstream\nBT (Hello \\(you\\)) Tj ET\nendstream\nendobj"


def test_files(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "d.txt").write_bytes(PDF)
    opened = fs.open_files(spark, [str(tmp_path / n) for n in ("empty.txt", "a.txt", "d.txt")], [str(tmp_path)])
    rows = opened.orderBy("handle").collect()
    assert [(r["handle"], r["length"], r["kind"]["kind"], r["kind"]["pages"]) for r in rows] == [(0, 0, "text", None), (1, 6, "text", None), (2, len(PDF), "document", 1)]
    assert "".join(r["text"] for r in fs.windows(opened.where("handle = 1"), 3).orderBy("offset").collect()) == "héllo"
    assert pdf.page_text(PDF, 0) == "Hello (you)" and pdf.inspect(PDF) == (1, True)
    with pytest.raises(ValueError):
        pdf.page_text(PDF, 1)
    for deflate in (True, False):
        made = pdf.make_pdf(["one", "", "thr\\e(e)"], deflate)
        assert pdf.inspect(made) == (3, True) and pdf.page_text(made, 2) == "thr\\e(e)"
        with pytest.raises(ValueError, match="no text"):
            pdf.page_text(made, 1)  # a page that shows nothing isn't an empty text
    assert pdf.inspect(pdf.make_pdf([""])) == (1, False) and pdf.inspect(b"%PDF-1.4 cut") == (0, False)
    texts = opened.select(fs.page_texts(F.when(F.col("kind.kind") == "document", F.col("content")), F.lit(0)).alias("t")).collect()
    assert [r["t"] and r["t"]["text"] for r in texts].count("Hello (you)") == 1
    for head in (b"", b"%PDF-1", b"\x89PNG\xff", b"RIFFxxxxWEBP", b"\xff", "é".encode()[:1], b"a" + "é".encode()[:1]):
        kind = spark.createDataFrame([(head,)], "b binary").select(tx.classify(F.col("b")).alias("k")).first()["k"]
        assert fs.kind_of(head) == kind.asDict()


def test_inference(spark):
    prompts = spark.createDataFrame([("one two  three",), (None,)], "prompt string")
    got = infer(prompts, Stub("a b c d"), max_tokens=2).collect()
    assert tuple(got[0]["answer"]) == ("a b", 3, 2, None)
    assert Stub("a b stop c").answer("p q", 9, on_token=lambda w: w != "stop") == {"text": "a b stop", "tokens_in": 2, "tokens_out": 3}
    lines = b'{"response":"he"}\n{"response":"llo"}\n{"done":true,"prompt_eval_count":4,"eval_count":2}\n'
    for size in (1, 3, 1000):
        assert read_stream([lines[i : i + size] for i in range(0, len(lines), size)]) == {"text": "hello", "tokens_in": 4, "tokens_out": 2}
    with pytest.raises(RuntimeError):
        read_stream([b'{"error":"no model"}\n'])
    with pytest.raises(Unsupported):
        infer(prompts, Http("m"), images=1)
    failed = infer(prompts.limit(1), Http("m", "http://127.0.0.1:9")).first()["answer"]
    assert failed["text"] is None and failed["error"].startswith("model_load_failed")
    registry = Registry()
    registry.register("Mine", lambda m: Stub(m))
    assert registry.resolve("MINE", "x") == Stub("x")
    with pytest.raises(Unsupported, match="native"):
        registry.resolve("llamacpp", "x")
    with pytest.raises(Unsupported, match="stub"):
        registry.resolve("none", "x")


class Model(http.server.BaseHTTPRequestHandler):
    """Answers with what it was asked, in pieces, as a stream of JSON lines."""

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = f"{asked['prompt']}|{asked['options']['num_predict']}|{','.join(asked.get('images', []))}"
        self.send_response(200)
        self.end_headers()
        for piece in said.split("|"):
            self.wfile.write(json.dumps({"response": piece + ";"}).encode() + b"\n")
            self.wfile.flush()
        self.wfile.write(b'{"done": true, "prompt_eval_count": 7, "eval_count": 3}\n')

    def log_message(self, *args):
        pass


def test_http_backend(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        backend = Http("m", f"http://127.0.0.1:{server.server_port}", vision=True)
        session = Host(backend).session()
        image = session.register(b"GIF89a")["handle"]
        heard = []
        assert session.infer("hi é", 5, [image], lambda t: heard.append(t) or True) == {"text": "hi é;5;R0lGODlh;", "tokens_out": 3}
        assert heard == ["hi é;", "5;", "R0lGODlh;"] and (session.tokens_in, session.tokens_out) == (7, 3)
        prompts = spark.createDataFrame([(f"p{i}",) for i in range(5)], "prompt string")
        assert sorted(r["answer"]["text"] for r in infer(prompts, backend, max_tokens=2).collect()) == [f"p{i};2;;" for i in range(5)]
    finally:
        server.shutdown()
