"""Queries on histories: attributes as known at event time, change feeds, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.exprs import complete_json
from factloom.operators.as_known import as_known
from factloom.operators.changes import apply_changes, latest_content
from factloom.operators.incremental import Target, content_version, process_runs
from factloom.plans.layout import shared_path
from factloom.sources.tables import table

READ_SLOTS = ("core/has-version", "core/has-status", "core/defined-in")
SUPERSEDER = r"(?i)superseded\s+by\s+([a-z]+-[0-9]+)"


def closings_known(facts: DataFrame, all_facts: DataFrame) -> DataFrame:
    """``facts`` with ``closing_known_from``: when the superseding fact that the reason names was recorded, else the fact itself.

    A named fact that is missing or has no recorded_at leaves null: the closing never becomes known.
    """
    by = F.nullif(F.regexp_extract(F.coalesce("invalidation_reason", F.lit("")), SUPERSEDER, 1), F.lit(""))
    recorded = all_facts.select(F.col("id").alias("__by"), F.col("recorded_at").alias("__at")).dropna(subset=["__by"]).groupBy("__by").agg(F.min("__at").alias("__at"))
    return (
        facts.withColumn("__by", by)
        .join(recorded, "__by", "left")
        .withColumn("closing_known_from", F.when(F.col("__by").isNull(), F.col("recorded_at")).otherwise(F.col("__at")))
        .drop("__by", "__at")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each read and each of version, status and defining file: the fact valid and known at asked_at."""
    facts = table(spark, folder, "facts").select("id", "subject_id", "scope", "predicate", "t_valid", "t_invalid", "recorded_at", "invalidation_reason")
    wanted = closings_known(facts.where(F.col("predicate").isin(*READ_SLOTS)), facts)
    reads = table(spark, folder, "retrievals").where("type = 'read'").select("seq", F.col("entity_id").alias("subject_id"), "scope", "asked_at")
    found = as_known(
        reads, wanted, keys=["subject_id", "scope"], slot="predicate", event_id="seq", event_time="asked_at", version_id="id",
        valid_from="t_valid", valid_to="t_invalid", known_from="recorded_at", closing_known_from="closing_known_from",
    )
    return found.select("seq", "predicate", F.col("id").alias("fact_id"))


P1_SQL = """
WITH f AS (SELECT DISTINCT id, subject_id, scope, predicate, t_valid, t_invalid, recorded_at,
         nullif(regexp_extract(coalesce(invalidation_reason, ''), '(?i)superseded\\s+by\\s+([a-z]+-[0-9]+)', 1), '') AS by_id
       FROM facts WHERE predicate IN ('core/has-version', 'core/has-status', 'core/defined-in')),
     k AS (SELECT f.*, CASE WHEN by_id IS NULL THEN f.recorded_at ELSE s.at END AS known
       FROM f LEFT JOIN (SELECT id, min(recorded_at) AS at FROM facts GROUP BY id) s ON s.id = f.by_id),
     r AS (SELECT DISTINCT seq, entity_id, scope, asked_at FROM retrievals WHERE type = 'read' AND entity_id IS NOT NULL AND asked_at IS NOT NULL)
SELECT r.seq, k.predicate, arg_max(k.id, (k.t_valid, k.recorded_at, k.id)) AS fact_id
FROM r JOIN k ON k.subject_id = r.entity_id AND k.scope = r.scope AND k.t_valid <= r.asked_at AND k.recorded_at <= r.asked_at
 AND (k.t_invalid IS NULL OR k.t_invalid > r.asked_at OR k.known IS NULL OR k.known > r.asked_at)
GROUP BY r.seq, k.predicate
"""


ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "type", "scope")] + [T.StructField("aliases", T.ArrayType(T.StringType()))])
ENTITY_PAYLOAD = T.StructType([T.StructField("entity", ENTITY), T.StructField("id", T.StringType()), T.StructField("updates", ENTITY)])
ENTITY_FIELDS = ["name", "type", "scope", "aliases"]


def entity_changes(effects: DataFrame) -> DataFrame:
    """The entity effects that count, once each: entity_id, t, hlc, writer, seq and the fields they set."""
    kinds = ("ensure-entity", "update-entity", "delete-entity")
    whole = effects.where(complete_json(F.col("payload"))).withColumn("payload", F.when(F.col("t").isin(*kinds), F.col("payload")))
    last = latest_content(whole, keys=["writer", "seq"], content=["hlc", "t", "payload"], landed="landed_at").where(F.col("t").isin(*kinds))
    read = last.withColumn("p", F.from_json("payload", ENTITY_PAYLOAD))
    made = F.col("t") == "ensure-entity"
    field = lambda f: F.when(made, F.col(f"p.entity.{f}")).when(F.col("t") == "update-entity", F.col(f"p.updates.{f}")).alias(f)
    return read.select(F.when(made, F.col("p.entity.id")).otherwise(F.col("p.id")).alias("entity_id"), "t", "hlc", "writer", "seq", *map(field, ENTITY_FIELDS))


def current_entities(effects: DataFrame, base: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """The entities that exist after all effects, each with the effect that last created or changed it."""
    return apply_changes(
        entity_changes(effects), key="entity_id", op="t", order=["hlc", "writer", "seq"], creates="ensure-entity", updates="update-entity",
        deletes="delete-entity", base=base, fields=fields,
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that exist now, with the effect that last created or changed each."""
    return current_entities(table(spark, folder, "effects")).select("entity_id", "writer", "seq")


def p4_state(spark: SparkSession, folder: str) -> DataFrame:
    """The entities that exist now, with their fields."""
    now = current_entities(table(spark, folder, "effects"), fields=ENTITY_FIELDS)
    return now.select("entity_id", "hlc", "name", "type", "scope", F.array_join("aliases", "|").alias("aliases"))


_P4_CTE = """
WITH whole AS (SELECT * FROM effects WHERE json_valid(payload)),
     last AS (SELECT writer, seq, arg_max(hlc, landed_at) AS hlc, arg_max(t, landed_at) AS t, arg_max(payload, landed_at) AS payload FROM whole GROUP BY writer, seq),
     e AS (SELECT coalesce(json_extract_string(payload, '$.entity.id'), json_extract_string(payload, '$.id')) AS entity_id, t, hlc, writer, seq, payload
           FROM last WHERE t IN ('ensure-entity', 'update-entity', 'delete-entity')),
     gone AS (SELECT entity_id, max((hlc, writer, seq)) AS d FROM e WHERE t = 'delete-entity' GROUP BY entity_id),
     made AS (SELECT e.entity_id, min((hlc, writer, seq)) AS m FROM e LEFT JOIN gone g ON g.entity_id = e.entity_id
              WHERE t = 'ensure-entity' AND (d IS NULL OR (hlc, writer, seq) > d) GROUP BY e.entity_id),
     acts AS (SELECT e.*, m FROM e JOIN made USING (entity_id) WHERE (t = 'update-entity' AND (hlc, writer, seq) > m) OR (hlc, writer, seq) = m)
"""
P4_SQL = _P4_CTE + "SELECT entity_id, arg_max(writer, (hlc, writer, seq)) AS writer, arg_max(seq, (hlc, writer, seq)) AS seq FROM acts GROUP BY entity_id"
P4_STATE_SQL = (
    _P4_CTE
    + """, v AS (SELECT *, CASE WHEN t = 'ensure-entity' THEN json_extract(payload, '$.entity') ELSE json_extract(payload, '$.updates') END AS x FROM acts)
SELECT entity_id, max(hlc) AS hlc,
  arg_max(json_extract_string(x, '$.name'), (hlc, writer, seq)) AS name, arg_max(json_extract_string(x, '$.type'), (hlc, writer, seq)) AS type,
  arg_max(json_extract_string(x, '$.scope'), (hlc, writer, seq)) AS scope,
  arg_max(array_to_string(from_json(json_extract(x, '$.aliases'), '["VARCHAR"]'), '|'), (hlc, writer, seq)) AS aliases
FROM v GROUP BY entity_id"""
)


def increments(spark: SparkSession, folder: str, path: str | None = None) -> Target:
    """The target of all successful runs over the effects."""
    schema = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("writer", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("version", T.StringType())])
    runs = table(spark, folder, "reconcile_runs").where("status = 'ok'").select("run_id", F.unix_micros("started_at").alias("at")).dropna()
    source = table(spark, folder, "effects").where(complete_json(F.col("payload"))).select("writer", "seq", content_version("hlc", "t", "payload").alias("version"), "landed_at")
    target = Target(spark, path or shared_path(spark, "increments"), schema)
    return process_runs(source, target, [(r.run_id, r.at) for r in runs.toLocalIterator()], keys=["writer", "seq"], version="version", arrived="landed_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each successful run, the effects whose content it was the first to see."""
    return increments(spark, folder).read().select("run_id", "writer", "seq").distinct()


P5_SQL = """
WITH runs AS (SELECT run_id, started_at FROM reconcile_runs WHERE status = 'ok'),
     c AS (SELECT writer, seq, hlc, t, payload, min(landed_at) AS at FROM effects WHERE json_valid(payload) GROUP BY writer, seq, hlc, t, payload)
SELECT DISTINCT (SELECT arg_min(run_id, (started_at, run_id)) FROM runs WHERE started_at >= c.at) AS run_id, writer, seq
FROM c WHERE EXISTS (SELECT 1 FROM runs WHERE started_at >= c.at)
"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_state": p4_state, "p5_found": p5_found}
SQL = {"p1_found": P1_SQL, "p4_found": P4_SQL, "p4_state": P4_STATE_SQL, "p5_found": P5_SQL}
