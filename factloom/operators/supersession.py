"""Bulk supersession of single-valued predicates: versions, reinforcement runs and their confidence, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions.exprs import ceiling


def reinforcement_runs(rows: DataFrame, *, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``rows`` with ``run``, the number of the run of equal values in order within the key: a restatement of the current value is no new version."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    return rows.withColumn("__new", F.when(first, 1).otherwise(changed)).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def versions(rows: DataFrame, *, keys: list[str], value: str, at: str, order: list[str], confidence: str, source: str) -> DataFrame:
    """One row per version: keys, value, ``t_valid``, ``t_invalid``, ``last_reinforced_at``, ``statements``, ``confidence``.

    A version starts with its run's first row and ends where the next one starts. This equals deciding the rows one by one for single-valued predicates
    without commitments, overrides, closed intervals, falling trust or back-dated rows; other rows need :mod:`factloom.operators.decide`.
    """
    runs = reinforcement_runs(rows, keys=keys, value=value, order=order)
    o = F.struct(*order)
    w = W.partitionBy(*keys).orderBy(*order)
    run = W.partitionBy(*keys, "run")
    # the ceiling that counts is that of the run's first row, so a running maximum suffices and no run is gathered
    marked = runs.withColumn("__first", F.col("run") != F.lag("run", 1, 0).over(w))
    top = F.max(F.when(F.col("__first"), ceiling(F.col(source)))).over(run)
    marked = marked.withColumn("__top", top)
    base = F.greatest(F.max(F.when(F.col("__first"), F.col(confidence))), F.max(F.when(~F.col("__first"), F.least("__top", confidence))))
    per = marked.groupBy(*keys, "run").agg(
        F.min_by(value, o).alias(value), F.min(at).alias("t_valid"), F.max(at).alias("last_reinforced_at"), F.count(F.lit(1)).alias("statements"), base.alias("confidence")
    )
    by_run = W.partitionBy(*keys).orderBy("run")
    return per.withColumn("t_invalid", F.lead("t_valid").over(by_run))
