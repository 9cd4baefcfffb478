"""Exact dedup: streaming deduplication over keyed state on disk, with full bytes checked on hits.

Every text is normalised and reduced to a digest once. The digests then run through a
Structured Streaming aggregation whose state (RocksDB, no watermark and so no expiry) keeps
for each digest the smallest stable identifier, the locator of that row and the number of
rows seen. A digest that was seen more than once is a hit; the whole texts of all hits are
compared byte for byte before the state is believed, and a digest that stands for different
texts is resolved by the texts themselves. Texts of earlier ingests are read back by their
content locators, so they have to stay where they were.

Defined results: null text equals the empty text; null ids sort after every other id; rows
that repeat id and text are told apart by their locator, so exactly one row of a group stays;
an empty table gives an empty result; other columns of the input are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.llm.common import FILE, LOCATOR, ROW, WHOLE, kept_columns, located, scratch_path, stored

WHITE = r"[\x20\x09-\x0D]+"
BATCH = 64 << 30  # bytes of digests that one micro-batch takes up; a lost batch is run again
#: State on disk; commits write a change log, and files aren't allocated ahead of what they hold.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


class DedupState:
    """Keyed state under ``path`` in the shared folder; it outlives the session that fills it.

    ``in`` lists the rows ingested (digest, doc_id, LOCATOR), ``files`` the paths that locators stand for.
    """

    def __init__(self, spark, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "dedup-state")

    def ingest(self, digests: DataFrame) -> None:
        """Add rows (digest, doc_id, LOCATOR) and run them through the state.

        An id must not be ingested twice. Rows are appended before the stream runs: after a
        failure, running the stream again takes up exactly the files it has not yet counted.
        """
        digests.write.mode("append").parquet(f"{self.path}/in")
        self.run(digests.schema)

    def keep_files(self, docs: DataFrame) -> None:
        """Remember the paths of the files that ``docs`` is read from."""
        path = docs.select(docs.metadataColumn("_metadata")["file_path"].alias("path")).distinct()
        path.select(F.xxhash64("path").alias(FILE), "path").write.mode("append").parquet(f"{self.path}/files")

    def texts_at(self, places: DataFrame) -> DataFrame:
        """(places' columns, t) for rows with LOCATOR columns, whose texts are read from their files."""
        files = self.spark.read.parquet(f"{self.path}/files").join(places.select(FILE).distinct(), FILE, "left_semi")
        paths = [r["path"] for r in files.select("path").distinct().toLocalIterator()]  # one a file, as Spark lists them too
        if not paths:
            return places.withColumn("t", F.lit(None).cast("string"))
        texts = located(self.spark.read.parquet(*paths), "text").select(*LOCATOR, normalised(F.col("text")).alias("t"))
        return places.join(texts, list(LOCATOR))

    def run(self, schema) -> None:
        spark, out = self.spark, f"{self.path}/out"
        before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
        for k, v in _STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            stream = (
                spark.readStream.schema(schema)
                .option("maxBytesPerTrigger", BATCH)
                .parquet(f"{self.path}/in")
                .groupBy("digest")
                .agg(
                    F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)).alias("first"),
                    F.count(F.lit(1)).alias("group_size"),
                )
            )

            def sink(batch: DataFrame, epoch: int) -> None:
                # a repeated epoch overwrites its own folder, so the sink is idempotent
                batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

            query = (
                stream.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.path}/checkpoint")
                .trigger(availableNow=True)
                .foreachBatch(sink)
                .start()
            )
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def entries(self) -> DataFrame:
        """The latest entry of each digest: digest, first, group_size."""
        updates = self.spark.read.parquet(f"{self.path}/out")
        latest = F.max_by(F.struct("first", "group_size"), F.col("epoch"))
        return updates.groupBy("digest").agg(latest.alias("e")).select("digest", "e.first", "e.group_size")

    def known(self) -> bool:
        """Whether anything has been ingested."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/out")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)


def exact_groups(docs: DataFrame, digest=sha256_digest, state: DedupState | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, LOCATOR.

    ``digest`` may be a weak function of the text: results stay exact. With a ``state`` that other rows have gone
    through before, groups go over all of them; ``docs`` are then Parquet files, or are stored as such.
    """
    if state is None:
        return groups_of(located(docs, "doc_id", "text"), digest, DedupState(docs.sparkSession))
    if not docs.inputFiles() or not all(f.endswith(".parquet") for f in docs.inputFiles()):
        docs = stored(docs.select("doc_id", "text"), "dedup-texts")
    state.keep_files(docs)
    return groups_of(located(docs, "doc_id", "text"), digest, state)


def groups_of(rows: DataFrame, digest, state: DedupState) -> DataFrame:
    """``exact_groups`` of located rows."""
    texts = rows.select("doc_id", *LOCATOR, normalised(F.col("text")).alias("t"))
    digests = stored(texts.select(digest(F.col("t")).alias("digest"), F.sha2("t", 256).alias("text_sha256"), "doc_id", *LOCATOR), "dedup-digests")
    earlier = stored(state.entries().join(digests.select("digest").distinct(), "digest", "left_semi"), "dedup-earlier") if state.known() else None
    state.ingest(digests.drop("text_sha256"))
    hits = stored(state.entries().where("group_size > 1"), "dedup-hits")

    # whole texts of the hits, compared after combining within each task: a group of any size is a row a task
    compared = texts.withColumn("digest", digest(F.col("t"))).join(
        hits.select(F.xxhash64("digest").alias("k")).distinct(), F.xxhash64("digest") == F.col("k"), "left_semi").select("digest", "t")
    if earlier is not None:
        compared = compared.unionByName(state.texts_at(earlier.select("digest", *[F.col(f"first.{c}").alias(c) for c in LOCATOR])).select("digest", "t"))
    clashes = compared.groupBy("digest").agg(F.min("t").alias("least"), F.max("t").alias("most")).where(F.col("least") != F.col("most")).select("digest")
    clashes.write.mode("append").parquet(f"{state.path}/clashes")
    clashes = state.spark.read.parquet(f"{state.path}/clashes").distinct().join(digests.select("digest").distinct(), "digest", "left_semi")
    clashes = stored(clashes, "dedup-clashes")
    found = digests.join(hits.select("digest", "first", "group_size"), "digest", "left")
    result = found.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first").isNull() | _same_place("first")).alias("kept"),
        "text_sha256", *LOCATOR, "digest",
    )
    if clashes.isEmpty():
        return result.drop("digest")
    every = texts.withColumn("digest", digest(F.col("t"))).join(clashes, "digest", "left_semi")
    mine = every.select("doc_id", *LOCATOR, "t", F.lit(True).alias("mine"))
    if earlier is not None:
        places = state.spark.read.parquet(f"{state.path}/in").join(clashes, "digest", "left_semi").join(digests.select(*LOCATOR), list(LOCATOR), "left_anti")
        mine = mine.unionByName(state.texts_at(places).select("doc_id", *LOCATOR, "t", F.lit(False).alias("mine")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR))
    groups = mine.groupBy("t").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    by_text = mine.where("mine").join(groups, "t").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", _same_place("first").alias("kept"), F.sha2("t", 256).alias("text_sha256"), *LOCATOR)
    return result.join(clashes, "digest", "left_anti").drop("digest").unionByName(by_text)


def _same_place(first: str) -> Column:
    return (F.col(f"{first}.{FILE}") == F.col(FILE)) & (F.col(f"{first}.{ROW}") == F.col(ROW))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an earlier row has; all columns stay."""
    rows = located(docs, "doc_id", "text", whole=True)
    gone = groups_of(rows.drop(WHOLE), sha256_digest, DedupState(docs.sparkSession)).where(~F.col("kept")).select(*LOCATOR)
    return rows.select(WHOLE, *LOCATOR).join(gone, list(LOCATOR), "left_anti").select(*kept_columns(docs))
