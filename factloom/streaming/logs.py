"""Effect logs and assertions as streams: exactly-once ingestion, idempotent replay, stateful decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.exprs import complete_json

EFFECTS = T.StructType([T.StructField("writer", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("hlc", T.LongType()), T.StructField("t", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("landed_at", T.TimestampType())])


def read_effects(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The files of an effect log as a stream."""
    return spark.readStream.schema(EFFECTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_effects(stream: DataFrame, out: str) -> None:
    """Append a stream of effects to the table at ``out``, each distinct row once, to the end of what is there; then stop.

    The checkpoint beside the table makes a restart go on where the last committed batch ended. A batch writes a folder of its own number, so one that is
    run again after a failure replaces itself.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.where(complete_json(F.col("payload"))).dropDuplicates().write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_counts(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Effects per kind after streaming the log at ``path`` into ``out``; of each (writer, seq) what landed last counts."""
    from factloom.operators.changes import latest_content

    ingest_effects(read_effects(spark, path), out)
    kept = spark.read.schema(EFFECTS).parquet(f"{out}/data")
    last = latest_content(kept, keys=["writer", "seq"], content=["hlc", "t", "payload"], landed="landed_at")
    return last.groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def windowed_activity(stream: DataFrame, *, at: str, key: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Rows per tumbling window and key, with a watermark for late ones."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("n"))


def high_water_stream(stream: DataFrame) -> DataFrame:
    """The effects of a stream above their writer's mark so far, marks kept as keyed state; a replayed effect gives nothing.

    Within a batch a writer's effects are taken in order of seq.
    """
    schema = "writer string, seq bigint, hlc bigint, t string, payload string"

    def fresh(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values("seq").drop_duplicates("seq")
        rows = rows[rows.seq > mark]
        if len(rows):
            state.update((int(rows.seq.max()),))
            yield rows[["writer", "seq", "hlc", "t", "payload"]]

    return stream.groupBy("writer").applyInPandasWithState(fresh, schema, "mark bigint", "append", "NoTimeout")
