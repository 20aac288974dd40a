"""Physical-layout helpers shared by the operators: shared storage, lineage cuts, hot keys, global ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SETTING = "spark.checkpoint.dir"
#: A table of at most so many counted rows of fixed width is broadcast.
SMALL_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is used on a single machine; on a cluster that is an error,
    since a machine-local folder would lose data with its executor.
    """
    at = spark.conf.get(SETTING, None)
    if not at:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = given.get() if given.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/factloom/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, once, and read back: what reads it twice doesn't compute it twice.

    Lineage and size estimates are cut alike: the planner sees the true size of the files, so a small table is broadcast and a loop doesn't
    multiply guesses. Files survive the loss of executors; they go when the driver ends, or with :func:`free`.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def free(df: DataFrame) -> None:
    """Remove the files of a :func:`cut` that nothing will read again."""
    if path := getattr(df, "_cut_at", None):
        fs, at = _hadoop(df.sparkSession, path)
        fs.delete(at, True)


def sized(df: DataFrame, rows: int, most: int = SMALL_ROWS) -> DataFrame:
    """A join side of so many counted rows: broadcast while they are few, else hashed after a shuffle, which needs no sort."""
    return F.broadcast(df) if rows <= most else df.hint("shuffle_hash")


def time_shards(rows: DataFrame, hot: DataFrame, keys: list[str], at: str, limit: int, grain: int) -> DataFrame:
    """The shard of every grain of time of the hot keys: ``keys``, ``__g``, ``__shard``. rows: instants ``at`` (BIGINT) by key; hot: the keys.

    Rows are counted per key and grain, and every ``limit`` rows a shard begins. Every grain between a key's first and last has a row, so that an
    instant finds its shard by an equi-join of :func:`grain_of`; a row per grain is the most that is held of a key, whatever its rows.
    """
    hist = rows.join(hot, keys, "left_semi").groupBy(*keys, F.floor(F.col(at) / grain).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__g").rowsBetween(W.unboundedPreceding, -1)
    next_ = W.partitionBy(*keys).orderBy("__g")
    placed = hist.withColumns({"__shard": F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / limit), "__end": F.coalesce(F.lead("__g").over(next_) - 1, F.col("__g"))})
    return placed.select(*keys, F.explode(F.sequence("__g", "__end")).alias("__g"), "__shard")


def time_bounds(shards: DataFrame, keys: list[str]) -> DataFrame:
    """The first and last grain of every hot key: ``keys``, ``__low``, ``__high``."""
    return shards.groupBy(*keys).agg(F.min("__g").alias("__low"), F.max("__g").alias("__high"))


def grain_of(at: Column, grain: int) -> Column:
    """The grain of an instant, brought between the key's first (``__low``) and last (``__high``)."""
    return F.least(F.greatest(F.floor(at / grain), F.col("__low")), F.col("__high"))


def global_rank(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``rank``, its place (from 1) in a total order over all rows, without gathering them in one task.

    Rows are sorted across partitions; a row's place is its place within its partition plus the sizes of those before, one number each.
    """
    held = cut(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = sorted((r.p, r.n) for r in held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p bigint, __before bigint"))  # a row per partition
    within = F.col("__m") - F.shiftleft(F.col("__p"), 33)
    return held.withColumn("__p", part).join(starts, "__p").withColumn("rank", F.col("__before") + within + 1).drop("__m", "__p", "__before")
