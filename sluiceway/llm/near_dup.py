"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification decides.

Texts are sets of hashed shingles of five words; a text of fewer words, but not none, is one
shingle. Equal sets are one representative with a number of copies, so copies are never expanded
into pairs. Each tree of the forest is a prefix trie over MinHash values. Matched prefixes are
shortened from ``max_depth`` until the chance that a pair at the threshold meets in at least one
tree reaches the target recall; every pair that would meet deeper also meets there, so the tries
are cut at that depth and each of their nodes with several members is verified.

A node's members are dealt into blocks of bounded size, and each pair of blocks is a task that
computes the intersections of its sets. A pair counts in the first tree in which it meets, and
nowhere else. Tasks return rows in proportion to their members: sums of links, and a spanning
forest of the links they found. Classes are the connected components of all links.

Defined results: texts that are null or without words are alone in their class, with no links;
a class's id is its smallest doc_id, null ids coming last; rows that repeat an id or a text are
members of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.deploy import send_package
from sluiceway.llm.common import FILE, LOCATOR, ROW, WHOLE, first_row, kept_columns, located, stored

SHINGLE, THRESHOLD = 5, Fraction(4, 5)
TREES, MAX_DEPTH, TARGET_RECALL = 20, 8, 0.9999
BLOCK_SETS, BLOCK_SHINGLES = 256, 1_000_000
RANGE_SHINGLES = 200_000  # what a worker sorts, or hands over, at once
BROADCAST_ROWS = 300_000
SALTS = 16  # parts of a hot key in joins
#: Bytes of words stand for themselves, A-Z for a-z, and all others for a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CACHE = 500_000


def depth_for(trees: int = TREES, max_depth: int = MAX_DEPTH, threshold: float = float(THRESHOLD), target: float = TARGET_RECALL) -> int:
    """The deepest prefixes with which a pair at the threshold still meets with the target probability."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def multipliers(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()
_PLACES = multipliers(SHINGLE, 11)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < SHINGLE:
        return _mixed((h * _PLACES[: len(h)]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h
    n = len(h) - SHINGLE + 1
    total = h[:n] * _PLACES[0]
    for k in range(1, SHINGLE):
        total += h[k : n + k] * _PLACES[k]
    return np.unique(_mixed(total))


def shingle_pieces(texts: pd.Series) -> Iterator[pd.Series]:
    """The shingles of texts in order, no more than a bounded number and a text's at once."""
    held: list[np.ndarray] = []
    total = 0
    for text in texts:
        held.append(shingles(text).view(np.int64))
        total += len(held[-1])
        if total >= RANGE_SHINGLES:
            yield pd.Series(held, dtype=object)
            held, total = [], 0
    if held:
        yield pd.Series(held, dtype=object)


def tree_keys(sets: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each tree, a key of the first ``depth`` MinHash values of a set."""
    mult = multipliers(trees * depth, 29)
    least = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sets), 2048):
        np.minimum(least, (sets[at : at + 2048, None] * mult[None, :]).min(axis=0), out=least)
    places = multipliers(depth, 41)
    return _mixed((_mixed(least.reshape(trees, depth)) * places[None, :]).sum(axis=1)).view(np.int64)


def signatures(rows: DataFrame, trees: int, depth: int) -> DataFrame:
    """Located rows with set_id (null without words), n_shingles and the keys of their tries."""

    @F.pandas_udf("struct<set_id: string, n: int, keys: array<long>>")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                s = shingles(text)
                out.append((xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), tree_keys(s, trees, depth)) if len(s) else (None, 0, None))
            yield pd.DataFrame(out, columns=["set_id", "n", "keys"])

    return rows.select("doc_id", *LOCATOR, signed(F.col("text").cast("string")).alias("v")).select("doc_id", *LOCATOR, "v.*")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of different sorted sets; the diagonal has no meaning."""
    m = len(sets)
    out = np.zeros((m, m))
    parts = -(-sum(map(len, sets)) // RANGE_SHINGLES)  # ranges of hash values, one held at a time
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    cuts = [[0, *np.searchsorted(s, bounds).tolist(), len(s)] for s in sets]
    for k in range(parts):
        _add_intersections(out, [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)])
    return out.astype(np.int64)


def _add_intersections(out: np.ndarray, sets: list[np.ndarray]) -> None:
    m = len(sets)
    columns, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shared = np.cumsum(times > 1) - 1  # only shingles that several sets have count
    keep = (times > 1)[inverse]
    col, row = shared[inverse[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    width = 4096
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [at, at + width])
        dense = np.zeros((m, min(width, int(col[-1]) + 1 - at)), dtype=np.float32)
        dense[row[a:b], col[a:b] - at] = 1
        out += dense @ dense.T


def verify_task(tree: int, cross: bool, blocks: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, threshold: Fraction):
    """Sum of linked copies of each member, and for each member the first member of its component, in one task.

    A ``cross`` task is one of two blocks, either of which may be empty; only pairs across them count there.
    """
    size = np.array([len(s) for s in sets])
    both = intersections(sets)
    linked = threshold.denominator * both >= threshold.numerator * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    if cross:
        linked &= blocks[:, None] != blocks[None, :]
    for earlier in range(tree):
        linked &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None, :], len(sets)).min(axis=1, initial=len(sets))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return linked @ copies, label
        label = new


def verified(tasks: DataFrame, threshold: Fraction) -> DataFrame:
    """(set_id, other, links) of rows (tree, key, i, j, block, set_id, keys, copies, shingles), task by task."""
    n = max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    names = ["tree", "key", "i", "j"]
    dealt = tasks.repartition(n, *names).sortWithinPartitions(*names, "set_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def close() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            rows = rows.drop_duplicates("set_id")
            held.clear()
            ids = rows["set_id"].to_numpy()
            links, label = verify_task(int(rows["tree"].iloc[0]), bool(rows["i"].iloc[0] != rows["j"].iloc[0]), rows["block"].to_numpy(), np.stack(rows["keys"].to_numpy()),
                                       [np.asarray(s).view(np.uint64) for s in rows["shingles"]], rows["copies"].to_numpy(), threshold)
            out = pd.DataFrame({"set_id": ids, "other": ids[label], "links": links})
            return out[(out["links"] > 0) | (out["set_id"] != out["other"])]

        last = None
        for batch in batches:
            if not len(batch):
                continue
            task = pd.MultiIndex.from_frame(batch[names])
            ends = np.flatnonzero(np.append((batch[names].to_numpy()[1:] != batch[names].to_numpy()[:-1]).any(axis=1), True)) + 1
            start = 0
            done = []
            for end in ends:
                if last is not None and held and task[start] != last:
                    done.append(close())
                held.append(batch.iloc[start:end])
                last, start = task[start], end
            if done:
                yield pd.concat(done, ignore_index=True)
        if held:
            yield close()

    return dealt.mapInPandas(run, "set_id string, other string, links long")


def salted_join(rows: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join with a table of one row a key; the rows of a key are dealt into SALTS parts by ``spread``."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(parts, [key, "salt"]).drop("salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), root the smallest of the component, by alternating stars.

    Every step groups by a node with sums made in each task first; joins deal each node into SALTS
    parts, so a hot node is never one task's. Each round is a table in the shared folder.
    """

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted_join(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, low, "a", "b").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stored(small.where("a != b").distinct(), "edges")
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept, LOCATOR; links are to rows with similarity at the threshold or above."""
    return classes_of(located(docs, "doc_id", "text"), **options)


def classes_of(rows: DataFrame, threshold: Fraction = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """``near_classes`` of located rows."""
    send_package(rows.sparkSession)
    depth = depth_for(trees, max_depth, float(threshold), target)
    signed = stored(signatures(rows, trees, depth), "signatures")
    reps = stored(
        signed.where("set_id is not null").groupBy("set_id").agg(
            F.min(first_row("doc_id", *LOCATOR)).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")),
        "representatives",
    )

    entries = reps.select("set_id", "n", F.posexplode("keys").alias("tree", "key"))
    nodes = entries.groupBy("tree", "key").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("n").cast("long")).alias("total"),
        F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("y"),
    ).where("c > 1")
    # nodes of several trees with the same members: the first tree's is enough
    nodes = nodes.groupBy("c", "total", "x", "y").agg(F.min(F.struct("tree", "key")).alias("v")).select("c", "total", "v.*")
    n_blocks = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = entries.join(nodes, ["tree", "key"]).withColumn("k", n_blocks)
    members = members.withColumn("block", F.pmod(F.xxhash64("set_id", "tree"), F.col("k").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    tasks = stored(members.select("tree", "key", "set_id", "block", other).select(
        "tree", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id"), "tasks")

    wanted = stored(tasks.select("set_id").distinct().join(reps, "set_id").select(
        "set_id", "keys", "copies", F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{ROW}").alias(ROW)), "candidates")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    @F.pandas_udf("array<long>")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield from shingle_pieces(texts)

    sets = rows.select("text", *LOCATOR).join(wanted, list(LOCATOR)).select("set_id", "keys", "copies", shingled(F.col("text").cast("string")).alias("shingles"))
    found = stored(verified(tasks.join(sets, "set_id"), threshold), "links")

    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    known = reps.select("set_id", "first", "copies").join(links, "set_id", "left").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    known = known.withColumn("root", F.coalesce("root", "set_id"))
    linked = known.where("copies > 1 or links is not null")
    firsts = linked.groupBy("root").agg(F.min("first").alias("keeper"))
    info = salted_join(linked, firsts, "root", "set_id").select("set_id", "keeper", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", *LOCATOR, "set_id").join(info, "set_id", "left")
    alone = F.col("keeper").isNull()
    own = (F.col(f"keeper.{FILE}") == F.col(FILE)) & (F.col(f"keeper.{ROW}") == F.col(ROW))
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | own).alias("kept"), *LOCATOR,
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, its first; all columns stay."""
    rows = located(docs, "doc_id", "text", whole=True)
    gone = classes_of(rows.drop(WHOLE), **options).where(~F.col("kept")).select(*LOCATOR)
    return rows.select(WHOLE, *LOCATOR).join(gone, list(LOCATOR), "left_anti").select(*kept_columns(docs))
