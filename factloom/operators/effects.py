"""A writer's own effect log: what a store's methods change, as rows that other stores can replay.

A log is appended to, never rewritten. Places of a batch of effects are given by a global rank, and the clock is a hybrid one: wall time, but never
backwards and never twice the same.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.layout import cut, global_rank

EFFECTS = "writer string, seq bigint, hlc bigint, t string, payload string"
#: In a batch, what others refer to comes first.
PLACES = (
    "register-predicate", "open-episode", "ensure-entity", "update-entity", "insert-fact", "repoint-predicate", "repoint-facts", "invalidate", "reinforce", "link-conflicts", "unlink-conflicts", "delete-entity",
    "close-episode",
)


@dataclass(frozen=True)
class EffectLog:
    """The effects of one writer so far: ``rows`` (writer, seq, hlc, t, payload), and where its counter and clock stand."""

    spark: SparkSession
    writer: str
    seq: int = 0
    hlc: int = 0
    rows: DataFrame | None = None

    def append(self, effects: DataFrame, now_ms: int) -> EffectLog:
        """The log with a batch of effects (``t``, ``payload``) behind it, in the order of PLACES, then of payload. The batch is computed once, here."""
        place = F.coalesce(*(F.when(F.col("t") == t, F.lit(n)) for n, t in enumerate(PLACES)), F.lit(len(PLACES)))
        ranked = global_rank(effects.withColumn("place", place), "place", "payload")
        start = max(now_ms, self.hlc + 1)
        new = cut(ranked.select(F.lit(self.writer).alias("writer"), (F.col("rank") + self.seq).alias("seq"), (F.col("rank") + (start - 1)).alias("hlc"), "t", "payload"))
        n = new.count()
        if not n:
            return self
        return replace(self, seq=self.seq + n, hlc=start + n - 1, rows=new if self.rows is None else self.rows.unionByName(new))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([], EFFECTS) if self.rows is None else self.rows

    def save(self, folder: str) -> None:
        """Append the log as JSON lines to the writer's own folder below ``folder``, the form :func:`read_logs` reads."""
        lines = self.table().select(F.to_json(F.struct("writer", "seq", "hlc", "t", "payload")).alias("value"))
        lines.write.mode("append").text(f"{folder.rstrip('/')}/writer={self.writer}")

    @classmethod
    def resume(cls, spark: SparkSession, writer: str, log: DataFrame) -> EffectLog:
        """Where a writer's log in a folder of logs ends, to go on from."""
        at = log.where(F.col("writer") == writer).agg(F.max("seq").alias("seq"), F.max("hlc").alias("hlc")).first()
        return cls(spark, writer, at.seq or 0, at.hlc or 0)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The effects in a folder of logs, each (writer, seq) once; lines that aren't whole are passed over."""
    lines = spark.read.text(folder, recursiveFileLookup=True).select(F.from_json("value", EFFECTS).alias("e")).select("e.*")
    return lines.where("writer IS NOT NULL AND seq IS NOT NULL AND t IS NOT NULL AND payload IS NOT NULL").dropDuplicates(["writer", "seq"])


def effect(rows: DataFrame, t: str, payload: Column) -> DataFrame:
    """One effect for each row: ``t``, and a struct as its JSON ``payload``."""
    return rows.select(F.lit(t).alias("t"), F.to_json(payload).alias("payload"))


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def fact_effects(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """insert-fact for each fact, its subject and object by name, as ids mean nothing to others."""
    e = entities.select(F.struct("id", "name", "type", "scope").alias("__e"))
    named = facts.join(e.select(F.col("__e.id").alias("subject_id"), F.col("__e").alias("__subject")), "subject_id", "left")
    named = named.join(e.select(F.col("__e.id").alias("object_ref"), F.col("__e").alias("__object")), "object_ref", "left")
    fact = F.struct(
        "id", F.col("__subject").alias("subject"), "predicate", F.col("object_kind").alias("object-kind"), F.col("__object").alias("object-ref"), F.col("object_lit").alias("object-lit"),
        millis("t_valid").alias("t-valid"), millis("t_invalid").alias("t-invalid"), millis("recorded_at").alias("recorded-at"), millis("last_reinforced_at").alias("last-reinforced-at"), "confidence", "epistemic", "scope",
        F.col("source_type").alias("source-type"), "episode", F.col("invalidation_reason").alias("invalidation-reason"),
    )
    return effect(named, "insert-fact", F.struct(fact.alias("fact")))


def entity_effects(entities: DataFrame) -> DataFrame:
    return effect(entities, "ensure-entity", F.struct(F.struct("id", "name", "type", "scope", "aliases").alias("entity")))


def predicate_effects(rows: DataFrame) -> DataFrame:
    return effect(rows, "register-predicate", F.struct(F.struct(*(F.col(c).alias(c.replace("_", "-")) for c in rows.columns)).alias("predicate")))
