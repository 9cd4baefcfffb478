"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of lexicon words and stems, their weights, how near they
stand to second-person words, capitals, punctuation and obfuscation rates. The lexicon is learned
from labelled rows: words and stems (prefixes) whose share of toxic texts stands out. Every
training row gets its features from a lexicon learned without its fold, so that the trees meet
lexicon hits as they occur on new texts. The trees' out-of-fold margins fit the calibration.

The classifier is fitted on a bounded sample (``max_rows``) of labelled rows, which also bounds the
words that its lexicon can hold; no entry that stands out is left out.

Defined results: null text is scored as the empty text; without labels of both kinds every score
is the share of label 1 among them, and 0 without any; ids and further columns have no influence
on a score; repeated rows are scored one by one and learned from once; a doc_id whose labels differ
isn't learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.deploy import send_package
from sluiceway.llm.common import WHOLE, kept_columns, stored
from sluiceway.llm.langid import bounded_sample

MAX_ROWS, CACHE, HELD = 20_000, 200_000, 50_000
FOLDS, MIN_SUPPORT, MIN_Z = 4, 4, 4.0
STEMS = range(3, 9)
WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
OBFUSCATED = re.compile(r"[^\W\d_](?:[@$!*]|[0134579])+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
CAPITALS = re.compile(r"\b[A-Z]{3,}\b")
RUNS = re.compile(r"[!?]{2,}")
PLAIN = str.maketrans("013457@$!*", "oieastasiu")
#: Second-person words (fixed values).
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
NEAR = 5
FEATURES = (
    "log_words", "hits", "hit_density", "distinct_hits", "stem_hits", "stem_density", "weight_sum", "weight_max",
    "weight_density", "near_second_person", "second_person_density", "capital_rate", "capital_words", "mark_rate",
    "mark_runs", "obfuscation_rate", "obfuscated_hits", "stretch_rate", "digit_rate",
)


def entries_of(words: set[str]) -> set[str]:
    """Lexicon entries that a set of words gives: the words, and their prefixes marked by a dash."""
    out = set(words)
    for w in words:
        out.update(w[:n] + "-" for n in STEMS if len(w) >= n)
    return out


class Scored(dict):
    """word -> (weight, is a whole word of the lexicon, obfuscated), or None; filled as words come."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) > CACHE:
            self.clear()
        out, plain = self.look_up(word), word.translate(PLAIN)
        if out is None and plain != word and not word.isdigit():
            found = self.look_up(plain)
            out = found and (*found[:2], True)
        if len(word) <= 64:
            self[word] = out
        return out

    def look_up(self, word: str):
        whole = self.lexicon.get(word)
        stems = [x for n in STEMS if len(word) >= n and (x := self.lexicon.get(word[:n] + "-")) is not None]
        if whole is None and not stems:
            return None
        return max([*stems, whole or -1.0]), whole is not None, False


def features(text: str | None, scored: Scored) -> list[float]:
    text = text or ""
    low = WORD.findall(text.lower())
    n = max(1, len(low))
    found = [(i, v) for i, v in enumerate(map(scored.__getitem__, low)) if v]
    near = sum(1 for i, _ in found if not SECOND_PERSON.isdisjoint(low[max(0, i - NEAR) : i + NEAR + 1]))
    weights = [v[0] for _, v in found]
    whole = [i for i, v in found if v[1]]
    size = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    chars = max(1, len(text))
    return [
        math.log1p(len(low)), len(whole), 100 * len(whole) / n, len({low[i] for i, _ in found}), len(found),
        100 * len(found) / n, sum(weights), max(weights, default=0.0), 100 * sum(weights) / n, near,
        100 * sum(w in SECOND_PERSON for w in low) / n, size[65:91].sum() / chars, 100 * len(CAPITALS.findall(text)) / n,
        100 * (size[33] + size[63]) / chars, len(RUNS.findall(text)), 100 * len(OBFUSCATED.findall(text)) / n,
        sum(1 for _, v in found if v[2]), 100 * len(STRETCHED.findall(text)) / n, size[48:58].sum() / chars,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth over binned features; a tree is (feature, bin) for each inner node, and leaves."""

    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with exact search over histogram bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Trees(edges, float(np.log(share / (1 - share))), depth)
    b, margin, width = model.binned(x), np.full(len(y), model.base), bins + 1
    cells = b + np.arange(x.shape[1]) * width
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, width, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            flat = ((node - first)[:, None] * (x.shape[1] * width) + cells).ravel()
            shape = (k, x.shape[1], width)
            g = np.bincount(flat, np.repeat(grad, x.shape[1]), k * x.shape[1] * width).reshape(shape).cumsum(2)
            h = np.bincount(flat, np.repeat(hess, x.shape[1]), k * x.shape[1] * width).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < 0.5) | (ht - h < 0.5)] = 0
            best = gain.reshape(k, -1).argmax(1)
            useful = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            feature[first : first + k] = np.where(useful, best // width, 0)
            cut[first : first + k] = np.where(useful, best % width, width)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + ridge)
        margin += leaf[at]
        model.trees.append((feature, cut, leaf))
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres of the pooled blocks and their shares of label 1, smoothed by half a row."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        if blocks and blocks[-1][2] / blocks[-1][1] == m:
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + 1, blocks[-1][2] + m]
        else:
            blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return (
        np.array([s / n for _, n, s in blocks]),
        np.array([min(max(v / n, 0.25 / n), 1 - 0.25 / n) for v, n, _ in blocks]),
    )


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def scores(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        scored = Scored(self.lexicon)
        return self.calibrated(np.array([features(t, scored) for t in texts], dtype=float).reshape(-1, len(FEATURES)))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), *self.knots)


def lexicon_from(pos: np.ndarray, neg: np.ndarray, names: np.ndarray, n_pos: float, n_neg: float) -> dict[str, float]:
    """Entries whose document share among label 1 exceeds that among label 0 by MIN_Z standard errors."""
    if not n_pos or not n_neg:
        return {}
    p, q = pos / n_pos, neg / n_neg
    both = (pos + neg) / (n_pos + n_neg)
    z = (p - q) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n_pos + 1 / n_neg))
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    good = np.flatnonzero((pos >= MIN_SUPPORT) & (z >= MIN_Z) & (odds > 0.7))
    good = good[np.argsort(names[good])]
    return {str(names[i]): float(odds[i]) for i in good}


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on about ``max_rows`` of the rows (doc_id, text, toxic) at most; a repeated row counts once."""
    spark = rows.sparkSession
    send_package(spark)
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    few = bounded_sample(rows.where("toxic in (0, 1)").select("doc_id", "text", "toxic").distinct(), max_rows, "doc_id", "text")
    sample = stored(few.select("text", F.col("toxic").cast("int").alias("toxic"), fold.alias("fold")), "toxicity-sample")
    sizes = sample.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).toPandas()
    n, n_pos = float(sizes["n"].sum()), float(sizes["p"].sum())
    if not n_pos or n_pos == n:
        return Model({}, None, (np.zeros(1), np.zeros(1)), n_pos / n if n else 0.0)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        frame = lambda: pd.DataFrame([(*key, k) for key, k in seen.items()], columns=["entry", "fold", "toxic", "k"])
        for batch in batches:
            for text, toxic, at in batch[["text", "toxic", "fold"]].itertuples(index=False):
                seen.update((e, at, toxic) for e in entries_of(set(WORD.findall((text or "").lower()))))
                if len(seen) > HELD:  # counts are added up later: a task holds only so many
                    yield frame()
                    seen.clear()
        yield frame()

    per_fold = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == v), F.col("k")).otherwise(0)).alias(f"k{f}_{v}") for f in range(FOLDS) for v in (0, 1)]
    seen = sample.mapInPandas(counted, "entry string, fold int, toxic int, k long").groupBy("entry").agg(*per_fold)
    # an entry of less support can enter no lexicon; the sample bounds how many entries there are
    top = seen.where(sum(F.col(f"k{f}_1") for f in range(FOLDS)) >= MIN_SUPPORT).toPandas()
    k = {v: np.stack([top[f"k{f}_{v}"].to_numpy(dtype=float) for f in range(FOLDS)]) for v in (0, 1)}
    names = top["entry"].to_numpy(dtype=object)
    in_fold = {int(f): (float(a), float(p)) for f, a, p in sizes.itertuples(index=False)}
    without = {}
    for f in range(FOLDS):
        a, p = in_fold.get(f, (0.0, 0.0))
        without[f] = lexicon_from(k[1].sum(0) - k[1][f], k[0].sum(0) - k[0][f], names, n_pos - p, n - n_pos - (a - p))
    lexicon = lexicon_from(k[1].sum(0), k[0].sum(0), names, n_pos, n - n_pos)
    shipped = spark.sparkContext.broadcast(without)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scored = {f: Scored(x) for f, x in shipped.value.items()}
        for batch in batches:
            yield pd.DataFrame([(int(f), int(v), features(t, scored[f])) for t, v, f in batch[["text", "toxic", "fold"]].itertuples(index=False)], columns=["fold", "toxic", "x"])

    # at most max_rows rows of FEATURES doubles come to the driver
    got = sample.mapInPandas(measured, "fold int, toxic int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float)
    order = np.lexsort((*x.T, got["toxic"], got["fold"]))  # the same whatever order rows come in
    x, y, at = x[order], got["toxic"].to_numpy(dtype=float)[order], got["fold"].to_numpy()[order]
    margin = np.zeros(len(y))
    for f in np.unique(at):
        rest = at != f
        if rest.any() and 0 < y[rest].sum() < rest.sum():
            margin[~rest] = boost(x[rest], y[rest]).margin(x[~rest])
    return Model(lexicon, boost(x, y), isotonic(margin, y), n_pos / n)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, toxic) for a bounded sample of the labels; a doc_id with labels that differ is left out."""
    ids = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    few = bounded_sample(ids.where("toxic = most").drop("most"), max_rows, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").distinct()  # bounded by max_rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted, in place of columns of these names."""
    send_package(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shipped.value.scores(texts), dtype="float64")

    return docs.withColumn("score", scores(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs`` that a model fitted on ``labels`` doesn't reject, with their columns."""
    model = train(labelled(docs, labels, max_rows), max_rows)
    kept = score(docs.select(F.struct("*").alias(WHOLE), "text"), model).where("predicted = 0")
    return kept.select(*kept_columns(docs))
