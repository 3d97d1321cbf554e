"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes that a Python worker is sent at a time: a few very long texts fill a batch as well as many short ones.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@lru_cache(maxsize=1)
def trimmer():
    """glibc's malloc_trim, if that is the C library."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return what a Python worker has freed to the system; idle workers live on for a minute, and would keep it."""
    trimmer()(0)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even if they start in another folder, and bound their batches.

    On a cluster the package is shipped with --py-files or installed; the path
    added here then simply does not exist on the executors. Batch sizes that
    the session has below the bounds are left alone.
    """
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not 0 < int(now.rstrip("bB")) <= int(most):
            spark.conf.set(key, most)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none is one chosen: a temporary folder for a
    single-JVM master (tests), a folder in the warehouse otherwise.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        single = sc.master == "local" or sc.master.startswith("local[")
        found = tempfile.mkdtemp(prefix="docloom-") if single else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of scratch()."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def without_old_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go when its result is written, so tables of several steps do not pile them up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows whose crc32 of doc_id as text leaves 0 on division by folds; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds) == 0


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of the keys of a side, those with more than a row in so many of the other are sent to all executors: there are no more keys than that.
HOT_KEYS = 10_000


def join_hot(rows: DataFrame, side: DataFrame, on: str, size: Column, total: int, keys: int = HOT_KEYS) -> DataFrame:
    """rows joined with side (one row a key, each with `size` of the `total` rows) without a task that gets all rows of a hot key.

    At most `keys` keys have more than total / keys rows; their rows meet the side
    where they are, and only the others are shuffled.
    """
    most = max(1, total // keys)
    hot, rest = F.broadcast(side.where(size > most)), side.where(size <= most)
    cold = rows.join(hot.select(on), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(rest, on))


#: Most bytes of keys that are sent to all executors to drop rows; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def without(docs: DataFrame, removed: DataFrame, key: dict[str, Column], row_bytes: int = 64) -> DataFrame:
    """docs without the rows whose key (names of removed to expressions over docs) is in removed."""
    removed = cut(removed.select(*key).distinct())
    small = removed.count() * row_bytes <= BROADCAST_BYTES
    own = {k: unused(docs, k) for k in key}
    side = removed.select(*[F.col(k).alias(f"removed {k}") for k in key])
    on = [F.col(own[k]).eqNullSafe(F.col(f"removed {k}")) for k in key]
    return docs.withColumns({own[k]: c for k, c in key.items()}).join(F.broadcast(side) if small else side, on, "left_anti").select(*docs.columns)
