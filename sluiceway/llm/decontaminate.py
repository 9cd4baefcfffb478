"""Benchmark decontamination over a distributed positional inverted index.

The index stores one posting (row, term, position, term that follows) for every token of the
training texts, whatever the test items hold, so other test sets can be matched against the same
index. Terms are 64-bit hashes of words. It is a table in the shared folder, written in one pass over the texts, and it also
carries each row's number of words.

Every window of a test item (13 consecutive words, or the whole item if it is shorter) starts from
its rarest term, by postings, that isn't its last. The postings of these anchor terms that are followed
as in the item, adjusted by the term's offset there, give candidate alignments (row, item, shift);
these are then intersected with the offset adjusted lists of the item's other terms, for which only
the postings of rows with a candidate are read on. Runs of matched offsets as long as the window are exact phrase matches. A proximity match
is a place where an item's rarest terms all stand close, in any order.

Defined results: null text has no words; a row without words is never contaminated; items without
words are ignored; items with equal words match together, each under its own id; a null item id
hits words and is not listed or counted; repeated rows and ids are judged row by row; empty tables
give empty results or none hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import LOCATOR, WHOLE, kept_columns, located, stored, words
from sluiceway.llm.spans import let

WINDOW = 13
NEAR_TERMS, SLOP = 3, 20  # a proximity match: so many rarest terms within so many words
#: Sides of joins with the test set are broadcast up to this many rows, and shuffled beyond it.
BROADCAST_ROWS = 500_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class TestItems:
    """Test items by their words: items (item, ws, ids) and item_words (item, n, ipos, word, term, following)."""

    __test__ = False

    def __init__(self, benchmark: DataFrame):
        by_words = (
            benchmark.select(F.col("item_id").cast("string").alias("id"), words(F.col("text")).alias("ws"))
            .where(F.size("ws") > 0)
            .groupBy("ws")
            .agg(F.collect_set("id").alias("ids"))
        )
        self.items = stored(by_words.select(F.monotonically_increasing_id().alias("item"), "ws", "ids"), "items")
        pairs = F.transform("ws", lambda w, i: F.struct(w.alias("word"), F.get("ws", i + 1).alias("after")))
        spelled = self.items.select("item", F.size("ws").alias("n"), F.posexplode(pairs).alias("ipos", "w")).select("item", "n", "ipos", "w.*")
        following = F.when(F.col("after").isNotNull(), F.xxhash64("after"))
        self.item_words = stored(spelled.select("item", "n", "ipos", "word", F.xxhash64("word").alias("term"), following.alias("following")), "item-words")
        self.n_words = self.item_words.count()
        self.terms = _small(self.item_words.select("term").distinct(), self.n_words)


def build_index(rows: DataFrame) -> DataFrame:
    """Postings (LOCATOR, pos, term, next) of every token of located ``rows``, stored; the posting without a term ends a row."""
    none = F.lit(None).cast("long")
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    postings = let(F.concat(hashes, F.array(none)), lambda h: F.transform(h, lambda x, i: F.struct(x.alias("term"), F.get(h, i + 1).alias("next"))))
    return stored(rows.select(*LOCATOR, F.posexplode(postings).alias("pos", "p")).select(*LOCATOR, "pos", "p.*"), "postings", "zstd")


def frequencies(index: DataFrame, items: TestItems) -> DataFrame:
    """(term, df): the number of postings of the items' terms, stored."""
    return stored(index.join(items.terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")


def anchors(frequency: DataFrame, items: TestItems, window: int) -> DataFrame:
    """(item, ipos, term, following) of the rarest term of every window that can occur; its follower lies in the window too."""
    ahead = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, max(window - 2, 0))
    last = (F.col("n") > 1) & (F.col("ipos") == F.col("n") - 1)
    within = F.when((F.col("n") > 1) & (F.lit(window) > 1), F.col("following"))
    return (
        items.item_words.join(frequency, "term", "left")
        .withColumn("rarest", F.min(F.struct(last.alias("last"), F.coalesce("df", F.lit(0)).alias("df"), "ipos", "term", within.alias("following"))).over(ahead))
        .where(F.col("ipos") <= F.greatest(F.col("n") - window, F.lit(0)))
        .where("rarest.df > 0")
        .select("item", "rarest.ipos", "rarest.term", "rarest.following")
        .distinct()
    )


def phrases(index: DataFrame, items: TestItems, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches (LOCATOR, item, shift, starts): offsets in the item at which a whole window occurs in the row."""
    first = stored(anchors(frequency, items, window), "anchors")
    shifted = stored(
        index.join(_small(first, items.n_words), "term")
        .where(F.col("following").isNull() | (F.col("following") == F.col("next")))
        .select(*LOCATOR, "item", (F.col("pos") - F.col("ipos")).alias("shift"))
        .distinct(),
        "alignments",
    )
    aligned = shifted.select(*LOCATOR).distinct()
    read = index.join(items.terms, "term", "left_semi").join(_small(aligned, aligned.count()), list(LOCATOR), "left_semi")
    expected = shifted.join(_small(items.item_words, items.n_words), "item").select(
        *LOCATOR, "item", "shift", "ipos", "n", "term", (F.col("shift") + F.col("ipos")).alias("pos")
    ).where("pos >= 0")
    met = expected.join(read.drop("next"), [*LOCATOR, "pos", "term"])
    met = met.groupBy(*LOCATOR, "item", "shift").agg(F.array_sort(F.collect_list("ipos")).alias("at"), F.first("n").alias("n"))
    size = F.least(F.col("n"), F.lit(window))
    starts = F.filter(F.col("at"), lambda p, i: F.get(F.col("at"), i + size - 1) == p + size - 1)
    return met.select(*LOCATOR, "item", "shift", size.alias("size"), starts.alias("starts")).where(F.size("starts") > 0)


def proximity(index: DataFrame, items: TestItems, frequency: DataFrame, terms: int = NEAR_TERMS, slop: int = SLOP) -> DataFrame:
    """(LOCATOR, item, pos): places of rows from which the item's ``terms`` rarest terms all stand within ``slop`` words."""
    ranked = items.item_words.groupBy("item", "word", "term").agg(F.count(F.lit(1)).alias("times")).join(frequency, "term", "left")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "word"))
    every = F.count(F.lit(1)).over(Window.partitionBy("item"))
    rare = ranked.select("item", "term", rank.alias("r"), F.least(every, F.lit(terms)).alias("needed")).where(F.col("r") <= terms)
    hits = index.join(_small(rare, items.n_words), "term")
    # rows that hold all of them anywhere come first: a set of three a row and item, made in each task
    whole = hits.groupBy(*LOCATOR, "item").agg(F.size(F.collect_set("term")).alias("n"), F.first("needed").alias("of")).where("n = of")
    hits = hits.join(whole.select(*LOCATOR, "item"), [*LOCATOR, "item"], "left_semi")
    near = Window.partitionBy(*LOCATOR, "item").orderBy("pos").rangeBetween(0, slop)
    met = hits.withColumn("n", F.size(F.collect_set("term").over(near)))
    return met.where(F.col("n") == F.col("needed")).select(*LOCATOR, "item", "pos")


def named(found: DataFrame, items: TestItems) -> DataFrame:
    """(LOCATOR, ids): the ids, in order, of the items found in each row."""
    ids = items.items.select("item", F.explode("ids").alias("id"))
    joined = found.select(*LOCATOR, "item").distinct().join(_small(ids, items.n_words), "item")
    return joined.groupBy(*LOCATOR).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_items, LOCATOR.

    near_items are the ids, in order and comma-joined, of the items with a proximity match; these alone don't make a row contaminated.
    """
    return judged(located(docs, "doc_id", "text"), benchmark, **options)


def judged(rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: bool = True) -> DataFrame:
    """``contamination`` of located rows; without ``near``, proximity matches aren't looked for and their columns are absent."""
    items = TestItems(benchmark)
    index = build_index(rows)
    frequency = frequencies(index, items)
    found = stored(phrases(index, items, frequency, window), "phrases")
    hit = (
        found.select(*LOCATOR, F.explode(F.array_distinct(F.flatten(F.transform(
            "starts", lambda s: F.sequence(s + F.col("shift"), s + F.col("shift") + F.col("size") - 1))))).alias("pos"))
        .distinct().groupBy(*LOCATOR).agg(F.count(F.lit(1)).alias("n_hit"))
    )
    sizes = index.where(F.col("term").isNull()).select(*LOCATOR, F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.array().cast("array<string>")
    ids = F.coalesce("ids", none)
    out = rows.select("doc_id", *LOCATOR).join(sizes, list(LOCATOR)).join(hit, list(LOCATOR), "left").join(named(found, items), list(LOCATOR), "left")
    more = []
    if near:
        met = stored(proximity(index, items, frequency).select(*LOCATOR, "item").distinct(), "near-matches")
        out = out.join(named(met, items).withColumnRenamed("ids", "near_ids"), list(LOCATOR), "left")
        near_ids = F.coalesce("near_ids", none)
        more = [F.size(near_ids).cast("long").alias("n_near"), F.array_join(near_ids, ",").alias("near_items")]
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *more, *LOCATOR,
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay."""
    rows = located(docs, "doc_id", "text", whole=True)
    gone = judged(rows.drop(WHOLE), benchmark, near=False).where("contaminated").select(*LOCATOR)
    return rows.select(WHOLE, *LOCATOR).join(gone, list(LOCATOR), "left_anti").select(*kept_columns(docs))
