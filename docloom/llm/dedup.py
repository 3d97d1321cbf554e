"""Exact deduplication by a streaming query with keyed state.

Method: stateful streaming deduplication. A feed of (digest, doc_id, locator)
is read by Structured Streaming; its state, kept on disk by RocksDB and never
expired, retains for each digest the stable identifier (largest doc_id), the
content locator (file of that row) and the number of rows. Rows of a
micro-batch are aggregated by digest before they are shuffled, so a digest that
a third of all rows share arrives as one row per task. A hit is a row whose
digest has other rows; the full bytes of a digest's rows are compared, and rows
that turn out to differ are grouped by their whole text.

The state lies in a folder. A later call with the same folder goes on from it:
only its own rows are fed and returned, but sizes and identifiers cover all rows
so far. The texts of earlier rows that it hits are fetched by their locators.

Cases: null counts as empty text, empty texts equal each other; texts are
compared whole; of equal texts the row with the largest doc_id stays, and of
repeats of that row (same id, same text) all carry kept, as nothing tells them
apart; null doc_ids stay only where no other id is there; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, discard, join_hot, scratch, text_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Most bytes of digests that are sent to all executors to find hits; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": PROVIDER,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a store is closed when its task ends, so an executor holds as many as it runs tasks
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # many small stores: do not set disk aside beforehand
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
}


def normalised(text: str | Column = "text") -> Column:
    return ascii_lower(text_of(text))


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def keyed_state(feed: DataFrame) -> DataFrame:
    """Streaming (digest, keep_id, locator, group_size): one state row per digest, aggregated before the shuffle."""
    return feed.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("locator", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("locator"),
        F.count("*").alias("group_size"),
    )


def run_stream(spark: SparkSession, feed_path: str, schema, home: str, files_per_batch: int | None) -> str:
    """Run the feed through the state to its end; the path of what the state emitted."""
    out = f"{home}/state"
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)

        def put(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # overwritten if the batch is run again

        query = keyed_state(reader.parquet(feed_path)).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return out


def exact_duplicates(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    state: str | None = None,
    fetch: Callable[[list[str]], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, locator) for every row of docs; locator: the file of the row that stays.

    digest: of the normalised text, as binary; a weaker one than SHA-256 only
    makes more hits to check. files_per_batch: feed files per micro-batch; the
    state carries on from batch to batch, so the result is the same. state: a
    shared folder to go on from. fetch: the rows of some files (their locators),
    with the same columns; without it earlier rows are known by their digests.
    """
    spark = docs.sparkSession
    home, run = (state or scratch(spark, "dedup")).rstrip("/"), uuid.uuid4().hex
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("t"), F.input_file_name().alias("locator"))
    fed = rows.select("doc_id", digest(F.col("t")).alias("digest"), F.unhex(F.sha2("t", 256)).alias("sha"), "locator")
    fed.write.parquet(f"{home}/feed/{run}")
    feed_rows = spark.read.parquet(f"{home}/feed/{run}")
    if not feed_rows.head(1):
        discard(spark, home if state is None else f"{home}/feed/{run}")
        return spark.createDataFrame([], f"doc_id {kind}, keep_id {kind}, group_size long, kept boolean, text_sha256 string, locator string")
    emitted = spark.read.parquet(run_stream(spark, f"{home}/feed", feed_rows.schema, home, files_per_batch))
    # a digest is emitted once per batch that touched it; sizes and ids only grow
    known = cut(emitted.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max_by("locator", "group_size").alias("locator"), F.max("group_size").alias("group_size")))
    repeated = known.where("group_size > 1")
    if fetch is not None:
        own = [r[0] for r in feed_rows.select("locator").distinct().collect()]  # names of files, not of rows
        earlier = [r[0] for r in repeated.join(feed_rows.select("digest"), "digest", "left_semi").where((F.col("locator") != "") & ~F.col("locator").isin(own)).select("locator").distinct().collect()]
        if earlier:
            rows = rows.unionByName(fetch(earlier).select(F.col(doc_id).alias("doc_id"), normalised(text).alias("t"), F.lit("").alias("locator")))
    differing = check_bytes(spark, rows, repeated, digest, broadcast_bytes, f"{home}/checked/{run}")
    out = join_hot(feed_rows.drop("locator"), known, "digest", F.col("group_size"), feed_rows.count())
    if differing is not None:
        out = out.join(differing, ["digest", "sha"], "left").withColumn("keep_id", F.when(F.col("own_size").isNull(), F.col("keep_id")).otherwise(F.col("own_id"))).withColumn("group_size", F.coalesce("own_size", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "locator")


def check_bytes(spark: SparkSession, rows: DataFrame, repeated: DataFrame, digest, broadcast_bytes: int, path: str) -> DataFrame | None:
    """Compare the full bytes of all rows of a digest.

    All texts are equal exactly if the least equals the greatest. Both are
    aggregated before the shuffle, so a task sends two texts a digest at most,
    however many rows share it. None if all agree; else (digest, sha, own_id,
    own_size) for the digests that several texts share.
    """
    n = repeated.count()
    if not n:
        return None
    small = n * 64 <= broadcast_bytes
    repeated = repeated.select("digest")
    hits = rows.select("t", digest(F.col("t")).alias("digest")).join(F.broadcast(repeated) if small else repeated, "digest")
    wrong = hits.groupBy("digest").agg(F.min("t").alias("least"), F.max("t").alias("most")).where("least <> most").select("digest")
    wrong.write.parquet(path)
    wrong = spark.read.parquet(path)
    if not wrong.head(1):
        return None
    whole = rows.select("doc_id", "t", digest(F.col("t")).alias("digest")).join(wrong, "digest").groupBy("digest", "t").agg(F.max("doc_id").alias("own_id"), F.count("*").alias("own_size"))
    return whole.select("digest", F.unhex(F.sha2("t", 256)).alias("sha"), "own_id", "own_size")
