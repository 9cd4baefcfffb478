"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import decontaminate, exact_dedup, langid, line_dedup, mixing, near_dup, pii, secret_scan, token_counts, toxicity
from sluiceway.llm.common import LOCATOR, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(langid.fold_of("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop(*LOCATOR)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(langid.fold_of("doc_id", 5) == 0, F.lit(False))
    model = toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels").where(~held)))
    return toxicity.score(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "score", "predicted")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"))).drop(*LOCATOR)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop(*LOCATOR)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop(*LOCATOR)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents")).drop(*LOCATOR)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).drop(*LOCATOR)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).drop("text")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL = {
    "op2_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), k AS (
  SELECT doc_id, i, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS x FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), n AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, count(*) OVER (PARTITION BY doc_id) AS m FROM k
), w AS (
  SELECT a.doc_id, a.p, string_agg(b.x, chr(10) ORDER BY b.p) AS t
  FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 2
  WHERE a.p <= greatest(a.m - 2, 1) GROUP BY 1, 2
), f AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS r FROM w
), gone AS (
  SELECT DISTINCT n.doc_id, n.i FROM f JOIN n ON n.doc_id = f.doc_id AND n.p BETWEEN f.p AND f.p + 2 WHERE f.r > 1
), c AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS t, count(gone.i) AS n_removed
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY 1
)
SELECT c.doc_id, coalesce(s.n, 0) AS n_lines, c.n_removed, sha256(coalesce(c.t, '')) AS text_sha256
FROM c LEFT JOIN (SELECT doc_id, count(*) AS n FROM k GROUP BY 1) s ON s.doc_id = c.doc_id
""",
    "op7_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), bn AS (
  SELECT item_id, ws, least(len(ws), 13) AS n FROM bw WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item_id, n, md5(array_to_string(ws[s:s + n - 1], ' ')) AS h
  FROM (SELECT item_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM bn)
), dwin AS (
  SELECT doc_id, n, s, md5(array_to_string(ws[s:s + n - 1], ' ')) AS h
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s
        FROM dw, (SELECT DISTINCT n FROM bn) WHERE len(ws) >= n)
), occ AS (
  SELECT d.doc_id, d.s, d.n, w.item_id FROM dwin d JOIN win w ON w.h = d.h AND w.n = d.n
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM occ) GROUP BY 1
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS i FROM occ) GROUP BY 1
), tok AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM dw
), rk AS (
  SELECT item_id, t.w, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), t.w) AS r, count(*) OVER (PARTITION BY item_id) AS m
  FROM (SELECT DISTINCT item_id, unnest(ws) AS w FROM bw) t LEFT JOIN (SELECT w, count(*) AS df FROM tok GROUP BY 1) f ON f.w = t.w
), placed AS (
  SELECT doc_id, item_id, pos, rk.w, least(m, 3) AS needed FROM tok JOIN rk ON rk.w = tok.w AND r <= 3
), near AS (
  SELECT DISTINCT a.doc_id, a.item_id::varchar AS i
  FROM placed a JOIN placed b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.pos BETWEEN a.pos AND a.pos + 20
  GROUP BY a.doc_id, a.item_id, a.pos, a.needed HAVING count(DISTINCT b.w) = a.needed
), nit AS (
  SELECT doc_id, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS ids FROM near GROUP BY 1
)
SELECT dw.doc_id, len(dw.ws)::bigint AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(dw.ws) AS contaminated,
       coalesce(nit.n_near, 0) AS n_near, coalesce(nit.ids, '') AS near_items
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id LEFT JOIN nit ON nit.doc_id = dw.doc_id
""",
    "op6_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 5 * p.k >= 4 * (a.n + b.n - p.k)
), r AS (
  SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.c
), c AS (
  SELECT x AS doc_id, min(c) AS class_id FROM r GROUP BY 1
)
SELECT c.doc_id, c.class_id, coalesce(m.n_links, 0) AS n_links, c.class_id = c.doc_id AS kept
FROM c LEFT JOIN (SELECT x, count(*) AS n_links FROM l GROUP BY 1) m ON m.x = c.doc_id
""",
}
