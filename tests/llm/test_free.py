"""The other operators: against brute force, or by held-out accuracy."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluiceway.llm import langid, near_dup, token_counts, toxicity
from test_native import rank, split


def test_tokens_against_plain_dynamic_programming(edge, none):
    pieces = token_counts.load_pieces()
    byte = min(pieces.values()) - 10

    def brute(word):
        w = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            n = len(w[end - 1].encode())
            options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
            options += [(best[s][0] + pieces[w[s:end]], best[s][1] - 1) for s in range(max(0, end - 16), end) if w[s:end] in pieces]
            best.append(max(options))
        return -best[-1][1]

    want = Counter((r["doc_id"], len((r["text"] or "").split()), sum(map(brute, (r["text"] or "").split()))) for r in edge.collect())
    for limit in (700_000, 50):  # emptying the trie changes nothing
        got = token_counts.count_tokens(edge, max_nodes=limit)
        assert got.columns == [*(c for c in edge.columns if c != "n_tokens"), "n_pretokens", "n_tokens"]
        assert Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.count_tokens(none).count() == 0


def test_trie_shares_prefixes():
    trie = token_counts.PreTokenTrie({"▁a": -1.0, "b": -2.0, "ab": -1.5, "▁": -3.0})
    assert trie.counts["ab"] == 2 and len(trie.children) == 4
    assert trie.counts["abb"] == 3 and len(trie.children) == 5 and trie.counts["a"] == 1


def test_language_id(spark, edge, none):
    rng = random.Random(1)
    stems = {"aa": "kilomno", "bb": "pqrstue"}
    make = lambda lang: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(3, 8))) for _ in range(20))
    rows = [(i, make(lang), lang) for i in range(120) for lang in stems]
    model = langid.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    fresh = spark.createDataFrame([(i, make(lang), lang) for i in range(50) for lang in stems], "doc_id int, text string, lang string")
    assert langid.predict(fresh, model).where("lang = lang_pred and score between 0 and 1").count() == 100
    out = langid.predict(edge, model).collect()
    assert len(out) == edge.count()
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    nobody = langid.train(none)
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(edge, nobody).collect()} == {("und", 0.0)}
    assert langid.predict(none, model).count() == 0


def test_language_counts_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(9)) + " 12 A-b", lang) for i in range(30) for lang in ("x", "y")]
    rows += [(0, rows[0][1], "x"), (99, None, "x"), (98, "aa", None), (97, "", "z")]  # a repeated row counts once
    model = langid.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert model.languages == ["x", "y", "z"]
    seen = {n: defaultdict(lambda: [0, 0, 0]) for n in (0, *langid.LENGTHS)}
    for _, text, lang in set(rows):
        if text is None or lang is None:
            continue
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for n in seen:
                for g in [w] if n == 0 else langid.grams(w, n):
                    seen[n][g]["xyz".index(lang)] += 1
    for n, (names, values) in model.tables.items():
        k = np.array([seen[n][g] for g in names], dtype=float)
        assert sorted(names) == sorted(seen[n])
        logs = np.log((k + 0.5) / (k.sum(axis=0) + 0.5 * len(k)))
        assert np.allclose(values, logs - logs.mean(axis=1, keepdims=True))
    assert np.allclose(np.diff(model.prior), np.log([30 / 31, 1 / 30]))


def test_training_holds_little_on_the_driver(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    rows = [(i, " ".join(word() for _ in range(60)), "xy"[i % 2]) for i in range(400)] + [(400, "ab" * 1_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    tracemalloc.start()
    try:
        model = langid.train(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    names = [x for kept, _ in model.tables.values() for x in kept]
    assert len(names) > 50_000 and "ab" * 1_000 in names  # one long word doesn't widen the others
    assert most < 300 * len(names)


def test_rare_and_mixed_languages(spark):
    rng = random.Random(8)
    stems = {"aa": "kilomno", "bb": "pqrstue", "zz": "vwxyzgh"}
    make = lambda lang, n=20: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(i, make(lang), lang) for i in range(1500) for lang in ("aa", "bb")] + [(9999 + i, make("zz"), "zz") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    _, sample = langid.stratified_sample(docs, 300, 50)
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert sizes["zz"] == 3 and all(60 <= sizes[x] <= 150 for x in ("aa", "bb"))
    fresh = [(0, make("zz"), "zz"), (1, make("aa", 15) + " " + make("bb", 5), "aa"), (2, make("bb", 1), "bb"), (2, make("aa", 30_000), "aa"), (None, make("zz", 3), "zz")]
    got = langid.predict(spark.createDataFrame(fresh, "doc_id int, text string, want string"), langid.train(docs, 300)).collect()
    assert all(r["lang_pred"] == r["want"] and 0.3 < r["score"] <= 1 for r in got)


def test_back_off_many_at_a_time():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé🙂"), rng.integers(1, 8))) for _ in range(400)]
    vec = lambda: rng.normal(size=3)
    tables = {0: {w: vec() for w in words[:50]}}
    for n in langid.LENGTHS:
        tables[n] = {g: vec() for g in sorted({g for w in words for g in langid.grams(w, n)}) if rng.random() < 0.2}
    packed = {n: (list(t), np.array(list(t.values())).reshape(-1, 3)) for n, t in tables.items()}
    rows = langid.WordRows(langid.Model(["x", "y", "z"], np.zeros(3), packed), size=100)

    def brute(w):
        if w in tables[0]:
            return tables[0][w]
        for n in langid.LENGTHS:
            if found := [tables[n][g] for g in langid.grams(w, n) if g in tables[n]]:
                return np.mean(found, axis=0)
        return np.zeros(3)

    for _ in range(20):
        texts = [list(rng.choice(words, rng.integers(1, 30))) for _ in range(rng.integers(1, 9))]
        assert np.allclose(rows.totals(texts), [sum(brute(w) for w in t) for t in texts])


def test_toxicity(spark, edge, none):
    rng = random.Random(4)
    plain, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["scoundrel", "wretch", "villain"]

    def make(toxic):
        ws = [rng.choice(plain) for _ in range(40)]
        for _ in range(3 * toxic):
            ws[rng.randrange(40)] = rng.choice(bad)
        return " ".join(ws)

    rows = [(i, make(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id int, text string, toxic int"))
    fresh = [(i, make(i % 5 == 0), int(i % 5 == 0)) for i in range(300)]
    out = toxicity.score(spark.createDataFrame(fresh, "doc_id int, text string, toxic int"), model).collect()
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 295 and all(0 <= r["score"] <= 1 for r in out)
    again = toxicity.score(edge, model)  # edge has a column of the same name
    assert again.where("score is null").count() == 0 and again.count() == edge.count()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(0, 0), (None, 1), (7, None)], "doc_id int, toxic int")
    kept = toxicity.drop_toxic(spark.createDataFrame(rows, "doc_id int, text string, x int"), labels)
    assert kept.columns == ["doc_id", "text", "x"] and 475 <= kept.count() <= 485 and kept.where("x = 0").count() >= 478
    one_kind = toxicity.train(spark.createDataFrame(rows[1:4], "doc_id int, text string, toxic int"))
    assert {r["score"] for r in toxicity.score(edge, one_kind).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_toxicity_lexicon_and_scores_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    rows = []
    for i in range(400):
        ws = rng.choices(vocabulary, k=15) + (["ghastly", "gh4stly"] if i % 4 == 0 else [])
        rows.append((i, " ".join(ws), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + rows[:50], "doc_id int, text string, toxic int")  # repeated rows count once
    model = toxicity.train(docs)
    pos, neg = Counter(), Counter()
    for _, text, toxic in rows:
        (pos if toxic else neg).update(toxicity.entries_of(set(toxicity.WORD.findall(text))))
    want = {}
    for entry, p in pos.items():
        q, share = neg[entry], (p + neg[entry]) / 400
        z = (p / 100 - q / 300) / max(share * (1 - share) * (1 / 100 + 1 / 300), 1e-12) ** 0.5
        odds = np.log((p + 0.5) / 101) - np.log((q + 0.5) / 301)
        if p >= 4 and z >= 4 and odds > 0.7:
            want[entry] = odds
    assert set(model.lexicon) == set(want) and "ghastly" in want and all(abs(model.lexicon[k] - v) < 1e-9 for k, v in want.items())
    texts = [None, "", "GHASTLY!!! you", "plainaa " * 30_000, rows[0][1], rows[0][1]]
    got = toxicity.score(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, predicted string"), model).orderBy("doc_id").collect()
    scored = toxicity.Scored(model.lexicon)
    assert np.allclose([r["score"] for r in got], [model.calibrated(np.array([toxicity.features(t, scored)]))[0] for t in texts])
    assert got[0]["score"] == got[1]["score"] and got[4]["score"] == got[5]["score"] and all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i // 50, f"text {i // 50}") for i in range(4000)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id int, toxic int")
    assert toxicity.labelled(docs, labels).count() == 80  # copies of a row are learned from once
    assert 5 <= toxicity.labelled(docs, labels, 20).count() <= 40


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = toxicity.boost(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    at, share = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(share) >= 0).all() and (np.diff(at) > 0).all() and len(at) == 3


def brute_near(rows, threshold=Fraction(4, 5)):
    sets = []
    for r in rows:
        w = split(r["text"])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i]["doc_id"])
    return Counter((rows[i]["doc_id"], min(ids[find(i)], key=rank), links[i]) for i in range(len(rows))), len(ids)


def test_near_duplicates(edge, none):
    got = near_dup.near_classes(edge).collect()
    want, classes = brute_near(edge.collect())
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = near_dup.drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.count() == classes == sum(r["kept"] for r in got)
    assert near_dup.near_classes(none).count() == 0


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SETS", 16)  # several blocks a node
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(80):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(0, 4)):
            w[at] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{rng.randrange(5000)}" for _ in range(100)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in near_dup.near_classes(docs).collect())
    want, _ = brute_near(docs.orderBy("doc_id").collect())
    recall = sum(k[2] for k in got.elements()) / sum(k[2] for k in want.elements())
    print(f"recall of links in a large group: {recall:.5f}")
    assert 0.999 <= recall <= 1 and {k[:2] for k in got} == {k[:2] for k in want}


def test_near_duplicates_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 70)  # a pair's two texts are dealt into several blocks
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        texts += [" ".join(w), " ".join([*w[:-1], "changed"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["n_links"] for r in near_dup.near_classes(docs).collect()} == {1}


def test_depth_meets_the_recall():
    d = near_dup.depth_for()
    assert 1 - (1 - 0.8**d) ** near_dup.TREES >= near_dup.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_dup.TREES


def test_recall_of_pairs_at_the_threshold():
    """Pairs of sets at a similarity of 0.8, from 20 to 600 shingles: how many meet in a tree."""
    rng, met, n, depth = np.random.default_rng(12), 0, 3000, near_dup.depth_for()
    for _ in range(n):
        k = int(rng.integers(2, 60))
        both = rng.integers(0, 2**63, 10 * k, dtype=np.uint64)  # of each set's 9k shingles, 8k are in both
        a, b = np.unique(both[: 9 * k]), np.unique(np.concatenate([both[: 8 * k], both[9 * k :]]))
        met += bool((near_dup.tree_keys(a, near_dup.TREES, depth) == near_dup.tree_keys(b, near_dup.TREES, depth)).any())
    print(f"recall at similarity 0.8: {met / n:.5f}")
    assert met / n >= 0.999


@pytest.mark.parametrize("n", [1, 40])
def test_intersections(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 60)).astype(np.uint64)) for _ in range(n)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (near_dup.intersections(sets) == want)[~np.eye(n, dtype=bool)].all()


def test_verification_holds_a_bounded_range():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[: 500 * i], rng.integers(0, 1 << 64, 100_000, dtype=np.uint64)])) for i in range(10)]
    tracemalloc.start()
    try:
        got = near_dup.intersections(sets)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    want = 500 * np.minimum.outer(np.arange(10), np.arange(10))
    assert (got == want)[~np.eye(10, dtype=bool)].all()
    assert most < 3 * sum(s.nbytes for s in sets)


def test_shingles_are_handed_over_in_pieces(monkeypatch):
    monkeypatch.setattr(near_dup, "RANGE_SHINGLES", 50)
    texts = [" ".join(f"w{i}x{j}" for j in range(10 * (i % 4))) or None for i in range(40)]
    pieces = list(near_dup.shingle_pieces(pd.Series(texts)))
    assert len(pieces) > 5 and all(sum(map(len, p)) < 50 + 30 for p in pieces)
    got = [x for p in pieces for x in p]
    assert len(got) == 40 and all((x.view(np.uint64) == near_dup.shingles(t)).all() for x, t in zip(got, texts, strict=True))


def test_components(spark):
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("a", "b"), ("c", "b"), ("z", "z")]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(1, 41)} | {"b": "a", "c": "a"}
    assert near_dup.components(spark.createDataFrame([], "a string, b string")).where(F.lit(True)).count() == 0
