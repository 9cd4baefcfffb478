"""Language ID: word-first backoff.

A word that the model knows scores by its log frequency in each language. An unseen word falls
back to its character 4-grams, then 3-, 2- and 1-grams: the longest length of which any gram is
known decides. Word scores are centred over the languages and added up.

The model is fitted on a bounded sample of the training rows: ``max_rows`` shared out evenly over the
languages, with ``LEAST_ROWS`` for each at least, so a rare language is learned from all its rows. It
holds every word and gram of the sample, which thus bounds what is broadcast.

Defined results: a text that is null or has no letter gives ``und`` with score 0, as does every
text when no row can be learned from; ties go to the first language by name; text of unknown
words alone goes by the languages' shares; ids, repeated rows and further columns have no
influence; an empty table gives an empty result.
"""

from __future__ import annotations


import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.deploy import send_package
from sluiceway.llm.common import stored

LETTERS = re.compile(r"[^\W\d_]+")
LENGTHS = (4, 3, 2, 1)
UNKNOWN = "und"
MAX_ROWS, LEAST_ROWS, CACHE, GROUP, HELD = 16_000, 250, 300_000, 64, 20_000
_SPAN = 1 << 30


def split_words(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """tables[0] holds words, tables[n] n-grams, each with rows of centred log frequencies for each language."""

    languages: list[str]
    prior: np.ndarray
    tables: dict[int, tuple[list[str], np.ndarray]]


_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each place of an array of code points."""
    h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ (codes[k : len(codes) - n + 1 + k] * _PLACES[k])) * _PLACES[0]
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


class WordRows:
    """Scores of words by row: known words first, and unseen ones as texts bring them, many at a time."""

    def __init__(self, model: Model, size: int = CACHE):
        self.n = len(model.languages)
        names, values = model.tables[0]
        self.known = {w: i for i, w in enumerate(names)}
        self.scores = np.concatenate([np.reshape(values, (len(names), self.n)), np.zeros((size, self.n))])
        self.rows = dict(self.known)
        self.grams = {}
        for n in LENGTHS:
            names, values = model.tables[n]
            h = _gram_hashes(_codes("".join(names)), n)[::n] if names else np.zeros(0, dtype=np.uint64)
            order = np.argsort(h)
            self.grams[n] = h[order], np.reshape(values, (len(names), self.n))[order]

    def back_off(self, unseen: list[str]) -> np.ndarray:
        """Scores of unseen words: the mean over the known grams of the longest length of which any is known."""
        codes = _codes("".join(f"^{w}$" for w in unseen))
        size = np.array([len(w) + 2 for w in unseen])
        owner = np.repeat(np.arange(len(unseen)), size)
        end = np.repeat(np.cumsum(size), size)
        out, open_ = np.zeros((len(unseen), self.n)), np.ones(len(unseen), dtype=bool)
        for n in LENGTHS:
            keys, values = self.grams[n]
            at = np.arange(max(len(codes) - n + 1, 0))
            good = (at + n <= end[at]) & open_[owner[at]]
            if n == 1:  # single characters without the word's edges
                good &= (at + 1 < end[at]) & (np.append(0, end[:-1])[at] == end[at])
            at = at[good]
            if not len(at) or not len(keys):
                continue
            h = _gram_hashes(codes, n)[at]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = keys[place] == h
            who, place = owner[at[found]], place[found]
            times = np.bincount(who, minlength=len(unseen))
            hit = times > 0
            for k in range(self.n):
                out[hit, k] = np.bincount(who, values[place, k], minlength=len(unseen))[hit] / times[hit]
            open_ &= ~hit
        return out

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Sum of the word scores of each text, none of which is empty."""
        words = set().union(*texts)
        if len(self.rows) + len(words) > len(self.scores):
            self.rows = dict(self.known)
        unseen = list(words.difference(self.rows))
        first = len(self.rows)
        if first + len(unseen) > len(self.scores):  # a few texts have more new words than there is room for
            self.scores = np.concatenate([self.scores[:first], np.zeros((2 * len(unseen), self.n))])
        if unseen:
            self.scores[first : first + len(unseen)] = self.back_off(unseen)
            self.rows.update(zip(unseen, range(first, first + len(unseen)), strict=True))
        sizes = [len(t) for t in texts]
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=sum(sizes))
        return np.add.reduceat(self.scores[rows], np.append(0, np.cumsum(sizes[:-1])).astype(np.int64), axis=0)


#: Word rows of this worker process by the call they were made for; a worker serves many tasks.
_ROWS: dict[str, WordRows] = {}


def worker_rows(key: str, shipped) -> WordRows:
    if key not in _ROWS:
        _ROWS.clear()
        _ROWS[key] = WordRows(shipped.value)
    return _ROWS[key]


def bounded_sample(rows: DataFrame, max_rows: int, *key: str) -> DataFrame:
    """About ``max_rows`` rows chosen by a hash of ``key``; all rows where there are no more."""
    n = rows.count()
    if n <= max_rows:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(_SPAN)) < int(_SPAN * max_rows / n))


def stratified_sample(rows: DataFrame, max_rows: int, least: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """The languages' sizes (lang, n), and rows (doc_id, text, lang), about ``max_rows`` shared out evenly over the languages and ``least`` for each, chosen by hash."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-sizes")
    quota = max(least, max_rows // max(sizes.count(), 1))
    share = sizes.select("lang", F.least(F.lit(_SPAN), F.ceil(F.lit(float(_SPAN * quota)) / F.col("n"))).cast("long").alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SPAN))
    return sizes, rows.join(F.broadcast(share), "lang").where(place < F.col("share")).drop("share").distinct()  # one row a language is broadcast


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a sample of the rows (doc_id, text, lang) with neither text nor lang null."""
    send_package(rows.sparkSession)
    sizes, sample = stratified_sample(rows, max_rows)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, Counter] = {}

        def frame() -> pd.DataFrame:
            out: Counter = Counter()
            for lang, seen in by.items():
                for word, k in seen.items():
                    out[lang, 0, word] += k
                    for n in LENGTHS:
                        for g in grams(word, n):
                            out[lang, n, g] += k
            return pd.DataFrame([(*key, k) for key, k in out.items()], columns=["lang", "n", "gram", "k"])

        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                by.setdefault(lang, Counter()).update(split_words(text))
                if sum(map(len, by.values())) > HELD:  # counts are added up later: a task holds only so many
                    yield frame()
                    by.clear()
        yield frame()

    partial = sample.select("text", "lang").mapInPandas(counted, "lang string, n int, gram string, k long")
    # the sample bounds what comes to the driver, and it comes as columns: an object for each count would take many times as much
    counts = partial.groupBy("lang", "n", "gram").agg(F.sum("k").alias("k")).toArrow()
    return fitted(counts, {r["lang"]: r["n"] for r in sizes.collect()})


def fitted(counts: pa.Table, sizes: dict[str, int]) -> Model:
    """The model of counts (lang, n, gram, k), n being 0 for words, of languages with so many rows each."""
    languages = sorted(sizes)
    tables: dict[int, tuple[list[str], np.ndarray]] = {}
    for n in (0, *LENGTHS):
        part = counts.filter(pc.equal(counts["n"], n))
        coded = pc.dictionary_encode(part["gram"].cast(pa.large_string()).combine_chunks())
        lang = pc.index_in(part["lang"], pa.array(languages, part["lang"].type))
        logs = np.zeros((len(coded.dictionary), len(languages)))
        logs[coded.indices.to_numpy(), lang.to_numpy()] = part["k"].to_numpy()
        total = logs.sum(axis=0) + 0.5 * max(1, len(logs))
        logs += 0.5
        logs /= total
        np.log(logs, out=logs)
        if languages:
            logs -= logs.mean(axis=1, keepdims=True)
        tables[n] = coded.dictionary.to_pylist(), logs
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float))
    return Model(languages, prior - prior.mean() if languages else prior, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at."""
    send_package(docs.sparkSession)
    key, shipped = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        known = worker_rows(key, shipped) if m.languages else None
        for texts in batches:
            names, scores = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            for start in range(0, len(texts) if m.languages else 0, GROUP):
                words = [split_words(t) for t in texts.iloc[start : start + GROUP]]
                some = [i for i, w in enumerate(words) if w]
                if some:
                    total = m.prior + known.totals([words[i] for i in some])
                    best = total.argmax(axis=1)
                    at = np.array(some) + start
                    names[at] = np.array(m.languages, dtype=object)[best]
                    scores[at] = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    both = docs.withColumn("__predicted", predicted(F.col("text").cast("string")))
    own = ("lang_pred", "score")  # columns of these names give way
    return both.select(*[c for c in docs.columns if c not in own], *[f"__predicted.{c}" for c in own])


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold that is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))
