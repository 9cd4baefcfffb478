"""Inference as an operator: backends by provider name, a stub in plain SQL, and an HTTP backend in Arrow batches."""

from __future__ import annotations

import base64
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.deploy import send_package
from sluiceway.functions.text import reasoning_tag, stub_reply, word_count

ANSWER = "struct<text: string, tokens_in: long, tokens_out: long, error: string>"
STUB_REPLY = "a stub summary"


class Unsupported(Exception):
    """Something that a backend can't do."""


@dataclass(frozen=True)
class Stub:
    """Answers the first words of its canned reply; counts the prompt's words."""

    reply: str = STUB_REPLY
    vision: bool = True

    def column(self, prompt: Column, max_tokens: int, images: int = 0, stop: str | None = None) -> Column:
        prefix = f"[{images} image(s)] " if images else ""
        text = stub_reply(F.lit(prefix + (self.reply or STUB_REPLY)), max_tokens)
        if stop is not None:  # tokens before the first that asks to stop
            words = F.split(text, " ")
            at = F.array_position(words, stop)
            text = F.when(at > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(at.cast("int"), F.lit(1))), " ")).otherwise(text)
        return F.struct(text.alias("text"), word_count(prompt).alias("tokens_in"), word_count(text).alias("tokens_out"), F.lit(None).cast("string").alias("error"))

    def answer(self, prompt: str, max_tokens: int, images: list | None = None, on_token: Callable[[str], bool] | None = None) -> dict:
        words = ((f"[{len(images)} image(s)] " if images else "") + (self.reply or STUB_REPLY)).split()[:max_tokens]
        kept = []
        for w in words:
            kept.append(w)
            if on_token is not None and not on_token(w):
                break
        return {"text": " ".join(kept), "tokens_in": len(prompt.split()), "tokens_out": len(kept)}


def read_stream(chunks, on_token: Callable[[str], bool] | None = None) -> dict:
    """Answer of an NDJSON stream cut anywhere: pieces of text, then final counts; an error in the stream raises."""
    rest, pieces, final = b"", [], {}

    def take(line: bytes) -> bool:
        nonlocal final
        if not line.strip():
            return True
        row = json.loads(line)
        if "error" in row:
            raise RuntimeError(row["error"])
        if piece := row.get("response", ""):
            pieces.append(piece)
            if on_token is not None and not on_token(piece):
                return False
        if row.get("done"):
            final = row
        return True

    for chunk in chunks:
        *lines, rest = (rest + chunk).split(b"\n")
        if not all(take(line) for line in lines):
            rest = b""
            break
    if rest:
        take(rest)
    return {"text": "".join(pieces), "tokens_in": final.get("prompt_eval_count", 0), "tokens_out": final.get("eval_count", len(pieces))}


@dataclass(frozen=True)
class Http:
    """A model served over HTTP that streams NDJSON."""

    model: str
    url: str = "http://127.0.0.1:11434"
    timeout: float = 600.0
    vision: bool = False

    def answer(self, prompt: str, max_tokens: int, images: list | None = None, on_token=None) -> dict:
        body = {"model": self.model, "prompt": prompt, "stream": True, "options": {"num_predict": max_tokens}}
        if images:
            body["images"] = [base64.b64encode(x).decode() for x in images]
        request = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return read_stream(iter(lambda: reply.read1(8192), b""), on_token)


def _absent(model: str):
    raise Unsupported("embedded models need a native library, which this build is without; use another provider")


class Registry:
    """Backends by provider; a later registration replaces an earlier one. Embedded models are named, but unavailable."""

    def __init__(self):
        self.makers: dict[str, Callable[[str], object]] = {"stub": lambda model: Stub(model), "ollama": lambda model: Http(model), "llamacpp": _absent}

    def register(self, provider: str, maker: Callable[[str], object]) -> None:
        self.makers[provider.lower()] = maker

    def resolve(self, provider: str, model: str):
        if provider.lower() not in self.makers:
            raise Unsupported(f"no backend {provider!r}; there are {sorted(self.makers)}")
        return self.makers[provider.lower()](model)


def infer(prompts: DataFrame, backend, prompt: str = "prompt", max_tokens: int = 256, images: int = 0) -> DataFrame:
    """``prompts`` with ``answer`` (ANSWER). A failed call is an error on its row."""
    if images and not backend.vision:
        raise Unsupported(f"{type(backend).__name__} can't see images")
    send_package(prompts.sparkSession)
    if isinstance(backend, Stub):
        return prompts.withColumn("answer", backend.column(F.col(prompt), max_tokens, images))

    @F.pandas_udf(ANSWER)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                try:
                    out.append((*backend.answer(text, max_tokens).values(), None) if text is not None else (None, None, None, None))
                except Exception as e:
                    out.append((None, None, None, f"model_load_failed: {e}"))
            yield pd.DataFrame(out, columns=["text", "tokens_in", "tokens_out", "error"])

    return prompts.withColumn("answer", run.asNondeterministic()(F.col(prompt)))


def list_models(url: str = "http://127.0.0.1:11434") -> list[str]:
    with urllib.request.urlopen(f"{url}/api/tags", timeout=10) as reply:
        return [m["name"] for m in json.load(reply).get("models", [])]


def models(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, reasoning) of models, tagged by what is known of their families."""
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", reasoning_tag(F.col("name")).alias("reasoning"))
