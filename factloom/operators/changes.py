"""Rebuilding a table's current state from a change feed, as a signed multiset of row images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.plans.layout import cut


def latest_content(feed: DataFrame, *, keys: list[str], content: list[str], landed: str) -> DataFrame:
    """Of each key the content that landed last; ties go to the greater content, so the result is the same on every run.

    A partial aggregate: copies of a change are folded before the shuffle, however many there are. Rows with a null key or landing
    time take no part; an empty feed gives an empty result.
    """
    best = F.max_by(F.struct(*content), F.struct(landed, *content))
    return feed.dropna(subset=[*keys, landed]).groupBy(*keys).agg(best.alias("__c")).select(*keys, *(F.col(f"__c.{c}").alias(c) for c in content))


def _chunked(ch: DataFrame, chunk_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Changes with ``__chunk``, and the keys that have several chunks, or None where no key has.

    The changes of keys with more than ``chunk_rows`` are range-partitioned by key and order, and a partition is a chunk: any number of changes at one
    instant are parted like others, as the order goes on with writer and seq.
    """
    hot = cut(ch.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk_rows))
    whole = F.lit(0).alias("__chunk")
    rows = hot.agg(F.sum("__n")).first()[0]
    if not rows:
        return ch.select("*", whole), None
    keys = hot.select("__key")
    parts = ch.join(keys, "__key", "left_semi").repartitionByRange(-(-rows // chunk_rows), "__key", "__o")
    # written, so that a task that is run again can't deal the chunks otherwise
    dealt = cut(parts.withColumn("__chunk", F.spark_partition_id()))
    return ch.join(keys, "__key", "left_anti").select("*", whole).unionByName(dealt), keys


def apply_changes(
    changes: DataFrame,
    *,
    key: str,
    op: str,
    order: list[str],
    creates: str,
    updates: str,
    deletes: str,
    base: DataFrame | None = None,
    fields: list[str] | None = None,
    chunk_rows: int = 200_000,
) -> DataFrame:
    """The rows that exist after all changes: ``key``, the ``order`` columns of the change that made the row, then ``fields``.

    Changes apply by ``order``: ``creates`` makes an absent row and leaves an existing one as it is, ``updates`` changes an existing row only,
    ``deletes`` removes it. Every change that has an effect contributes -1 of the row image before it and +1 of the image after it; ``base``
    contributes +1 of its images; multiplicities are summed and images with a positive sum are the current rows. An image is the
    order of the change that made it (nulls: ``base``) and the values of ``fields``: of each the last non-null one since the row was created.

    Defined cases: changes with a null key or order, or another ``op``, have no effect; a repeated change counts once, as its images
    cancel out, while different changes of equal order apply by op name; an empty feed leaves the base; of several base rows of a key the greatest
    counts; other columns are ignored.

    Skew: a key with more than ``chunk_rows`` changes is cut into chunks of its order. Whether the row exists at a chunk's start, and which
    image it then is, follows from one summary row for each earlier chunk, so no task sorts a whole hot key. Everything else is one
    shuffle by key: existence, images and their sum follow the same partitioning and sort.
    """
    fields = fields or []
    o, op_ = F.col("__o"), F.col("__op")
    values = [f"__f{i}" for i in range(len(fields))]
    ch = (
        changes.select(F.col(key).alias("__key"), F.col(op).alias("__op"), F.struct(*order, F.col(op).alias("__op")).alias("__o"), *(F.col(f).alias(v) for f, v in zip(fields, values, strict=True)))
        .where(op_.isin(creates, updates, deletes) & F.col("__key").isNotNull())
        .where(" AND ".join(f"__o.`{c}` IS NOT NULL" for c in order))
    )
    if base is not None:
        held = base.select(F.col(key).alias("__key"), F.struct(*(F.col(f).alias(v) for f, v in zip(fields, values, strict=True)), F.lit(0).alias("__")).alias("__b")).dropna(subset=["__key"])
        held = held.groupBy("__key").agg(F.max("__b").alias("__b"))
    ch = cut(ch)  # read for the hot keys and for the images
    ch, hot = _chunked(ch, chunk_rows)
    part = ["__key", "__chunk"]
    w = W.partitionBy(*part).orderBy("__o")
    ahead = w.rowsBetween(W.unboundedPreceding, -1)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    chunks = W.partitionBy("__key").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    last = lambda c, over: F.last(c, ignorenulls=True).over(over)

    # creates leaves a row in any case, deletes none, updates changes nothing about existence
    mark = F.when(op_ == creates, 1).when(op_ == deletes, 0)
    rows = ch if base is None else ch.join(held, "__key", "left")
    based = F.lit(0) if base is None else F.col("__b").isNotNull().cast("int")
    if hot is not None:
        of_hot = ch.join(hot, "__key", "left_semi").groupBy(*part).agg(F.max_by(mark, F.when(mark.isNotNull(), o)).alias("__m"))
        rows = rows.join(of_hot.withColumn("__in", last("__m", chunks)).drop("__m"), part, "left")
        based = F.coalesce("__in", based)
    acts = rows.withColumn("__existed", F.coalesce(last(mark, ahead), based) == 1).where(F.when(op_ == creates, ~F.col("__existed")).otherwise(F.col("__existed")))

    # of each field the last value in the chunk, and what made the row if that was in the chunk; values from before that don't count
    dated = lambda v: F.when(F.col(v).isNotNull() & (op_ != deletes), F.struct(o.alias("o"), F.col(v).alias("v")))
    acts = acts.withColumns({"__made": last(F.when(op_ == creates, o), upto), **{f"__l{v}": last(dated(v), upto) for v in values}})
    fresh = lambda v: F.when(F.col("__made").isNull() | (F.col(f"__l{v}.o") >= F.col("__made")), F.col(f"__l{v}.v"))
    carried = {v: F.lit(None) if base is None else F.col(f"__b.{v}") for v in values}  # at the chunk's start
    carried_o = F.lit(None).cast(acts.schema["__o"].dataType)
    if hot is not None:
        ends = acts.join(hot, "__key", "left_semi").groupBy(*part).agg(F.max_by(F.struct("__op", "__o", "__made", *(fresh(v).alias(v) for v in values)), "__o").alias("__e"))
        reset = F.when(F.col("__e.__made").isNotNull() | (F.col("__e.__op") == deletes), F.col("__chunk"))
        since = lambda v: F.last(F.when(F.col(f"__e.{v}").isNotNull(), F.struct(F.col("__chunk").alias("c"), F.col(f"__e.{v}").alias("v"))), ignorenulls=True).over(chunks)
        ends = ends.withColumns({"__reset": last(reset, chunks), "__co": F.last("__e.__o").over(chunks), **{f"__c{v}": since(v) for v in values}})
        acts = acts.join(ends.drop("__e"), part, "left")
        carried_o = F.col("__co")
        carried = {v: F.when(F.col("__reset").isNull(), F.coalesce(F.col(f"__c{v}.v"), carried[v])).when(F.col(f"__c{v}.c") >= F.col("__reset"), F.col(f"__c{v}.v")) for v in values}
    image = F.struct(o.alias("o"), *(F.coalesce(fresh(v), F.when(F.col("__made").isNull(), carried[v])).alias(v) for v in values))
    start = F.struct(carried_o.alias("o"), *(carried[v].cast(acts.schema[v].dataType).alias(v) for v in values))
    acts = acts.withColumn("__after", image).withColumn("__first", F.row_number().over(w) == 1)
    old = F.when(F.col("__first"), start).otherwise(F.lag("__after").over(w))
    signed = lambda sign, x: F.struct(F.lit(sign).alias("sign"), x.alias("image"))
    both = F.array(F.when(op_ != deletes, signed(1, F.col("__after"))), F.when(op_ != creates, signed(-1, F.col("__old"))))
    all_ = acts.withColumn("__old", old).select("__key", F.explode(F.array_compact(both)).alias("__s")).select("__key", "__s.*")
    if base is not None:
        start_image = F.struct(F.lit(None).cast(acts.schema["__o"].dataType).alias("o"), *(F.col(f"__b.{v}").alias(v) for v in values))
        all_ = all_.unionByName(held.select("__key", F.lit(1).alias("sign"), start_image.alias("image")))
    now = all_.groupBy("__key", "image").agg(F.sum("sign").alias("__n")).where("__n > 0")
    return now.select(F.col("__key").alias(key), *(F.col(f"image.o.{c}").alias(c) for c in order), *(F.col(f"image.{v}").alias(f) for f, v in zip(fields, values, strict=True)))
