"""Shared plumbing of the training-data operators: durable tables, column guards, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is unset, a temporary one in local mode; a cluster has to set it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="glossaria-"))
    return _own_dir[0]


def durable(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "lz4")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glossaria_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete durable tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_glossaria_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


#: Keys that hold more than this share of the rows are hot: fewer of them exist than its reciprocal.
_HOT_SHARE = 1 << 16


def spread_join(rows: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows with the columns of right, which has one row a key and the number of rows that hold it; null keys aren't looked up.

    A key with more than 1 / 65,536 of the rows (and more than 64) is hot: there are at most 65,536 of them, whose entries are
    broadcast, so their rows stay where they are. All other keys are joined by shuffle. Both are left joins.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(max(64, total // _HOT_SHARE))
    few = right.where(hot)
    names = [c for c in right.columns if c not in keys and c != count]
    at = rows.join(F.broadcast(few.select(*keys, F.struct(*names).alias("__hot"))), keys, "left")
    near = at.where("__hot is not null").select(*rows.columns, "__hot.*")
    far = at.where("__hot is null").drop("__hot").join(right.where(~hot).drop(count), keys, "left")
    return near.unionByName(far.select(*near.columns))


def word_count(text: Column | str) -> Column:
    """Number of words; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = 1024, size: int | None = None) -> None:
    """Bound the Arrow batches between the JVM and Python, by rows and by bytes: texts are long, and the defaults of 10,000 rows and 64 MB are not sized for them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


def lean(batches: Iterator) -> Iterator:
    """The batches of a task; behind them, memory that the task has freed goes back to the machine.

    Spark keeps Python workers for later tasks, also while stages without Python run, and allocators keep what was freed.
    """
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    `edges` has long columns a and b. Returns (id, component): every vertex that has an edge to
    another one, with the smallest id reachable from it. Each step is a min aggregation with
    map-side combine and an equi-join back; every round is a durable table. A hub's edges are
    rows of the join's larger side, which AQE splits.
    """
    cur = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    if not cur.take(1):
        return cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        tight = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = (
            large.join(tight, F.col("a") == F.col("k"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new = durable(small, "cc")
        # A star forest: no parent is itself a child.
        deep = new.join(new.select(F.col("a").alias("p")), F.col("b") == F.col("p"), "left_semi")
        several = new.groupBy("a").count().where("count > 1")
        release(cur)
        cur = new
        if not several.take(1) and not deep.take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("id")).distinct()
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
