"""The pipeline against its stages' brute-force versions, and the queries' registration."""

import re

import __spark_entry__
import corpus_pipeline
from test_free import brute_near
from test_native import brute_contamination

from sluiceway.llm import toxicity
from sluiceway.llm.common import table


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = corpus_pipeline.run(spark, sf_dir)
    assert [c for c in got.columns if not c.startswith("mix_")] == docs.columns
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select("doc_id").collect()}
    rows = sorted((r for r in docs.collect() if r["doc_id"] in kept), key=lambda r: r["doc_id"])
    seen, once = set(), []
    for r in rows:
        key = " ".join((r["text"] or "").split(" "))
        key = "".join(" " if c in "\t\n\v\f\r" else c for c in key)
        while "  " in key:
            key = key.replace("  ", " ")
        if key not in seen:
            seen.add(key)
            once.append(r)
    classes, _ = brute_near(once)
    firsts = {c for _, c, _ in classes}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    want = {r["doc_id"] for r in once if r["doc_id"] in firsts and not brute_contamination(r["text"], items)[-1]}
    out = got.select("doc_id", "mix_position").collect()
    assert {r["doc_id"] for r in out} == want and sorted(r["mix_position"] for r in out) == list(range(len(want)))


def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    labels = [(r["doc_id"], 1, 0) for r in rows[:3]] + [(None, 1, 1), (None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, rows[3]["text"] if rows else "x"), (2, None), (None, "a b c"), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_with_nulls_and_clashing_names(spark, edge, none, tmp_path):
    got = corpus_pipeline.run(spark, tables(spark, tmp_path / "edge", edge))
    assert [c for c in got.columns if c not in ("mix_block", "mix_slot", "mix_position")] == [c for c in edge.columns if c != "mix_slot"]
    rows = got.collect()
    texts = [re.sub(r"[\x20\x09-\x0d]+", " ", r["text"] or "") for r in rows]
    assert len(set(texts)) == len(texts) and sorted(r["mix_position"] for r in rows) == list(range(len(rows)))
    gone = edge.collect()[3]["text"]  # a test item, and so are its copies
    assert gone not in texts and "a b c" not in texts and "" in texts and len(rows) >= 8
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", none)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)
