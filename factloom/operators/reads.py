"""Reading facts: as of an instant, by direction, selected, hydrated, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions.exprs import effective_confidence, valid_at


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Facts without whole repeated rows; of one id, one row stays."""
    return facts.dropDuplicates(["id"])


def filter_facts(
    facts: DataFrame, now: Column, *, include_invalidated: bool = False, min_confidence: float | None = None, scope: str | None = None, predicates: list[str] | None = None
) -> DataFrame:
    """Facts valid at ``now``, of a scope and predicates, at least so confident after decay. Every condition but decay reaches the scan."""
    if not include_invalidated:
        facts = facts.where(valid_at(now))
    if scope is not None:
        facts = facts.where(F.col("scope") == scope)
    if predicates is not None:
        facts = facts.where(F.col("predicate").isin(predicates))
    if min_confidence is not None:
        facts = facts.where(effective_confidence(now) >= min_confidence)
    return facts


def select_facts(
    facts: DataFrame, *, ids: list[str] | None = None, source_type: str | None = None, predicates: list[str] | None = None, scopes: list[str] | None = None,
    episodes: DataFrame | None = None, recorded_before: Column | None = None, open_only: bool = False,
) -> DataFrame:
    """The conjunction of the criteria that are given. ``open_only`` means a null end, not validity at an instant."""
    for column, values in (("id", ids), ("predicate", predicates), ("scope", scopes)):
        if values is not None:
            facts = facts.where(F.col(column).isin(values))
    if source_type is not None:
        facts = facts.where(F.col("source_type") == source_type)
    if recorded_before is not None:
        facts = facts.where(F.col("recorded_at") < recorded_before)
    if open_only:
        facts = facts.where(F.col("t_invalid").isNull())
    if episodes is not None:
        facts = facts.join(episodes.select(F.col("id").alias("episode")), "episode", "left_semi")
    return facts


def touching(facts: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Facts with an entity of ``ids`` (column ``id``) as subject (out), object (in) or either; each fact once. Two semi-joins, no disjunction."""
    out = facts.join(ids.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").select(facts.columns)
    into = facts.join(ids.select(F.col("id").alias("object_ref")), "object_ref", "left_semi").select(facts.columns)
    return out if direction == "out" else into if direction == "in" else out.unionByName(into).dropDuplicates(["id"])


def hydrate(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with ``subject_name``, ``subject_type`` and ``object_name``, the object's name or literal. Unknown ids keep the id as name."""
    e = entities.select("id", "name", "type")
    subject = e.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), F.col("type").alias("subject_type"))
    ref = e.select(F.col("id").alias("object_ref"), F.col("name").alias("__object"))
    joined = facts.join(subject, "subject_id", "left").join(ref, "object_ref", "left")
    name = F.when(F.col("object_kind") == "entity", F.coalesce("__object", "object_ref")).otherwise(F.col("object_lit"))
    return joined.withColumn("object_name", name).withColumn("subject_name", F.coalesce("subject_name", "subject_id")).drop("__object")


def history(facts: DataFrame) -> DataFrame:
    """All versions of each (subject, predicate), oldest first, numbered; invalidated ones too.

    The number needs the versions of one subject and predicate in order; the hot subject's facts part by predicate and scope.
    """
    w = W.partitionBy("subject_id", "scope", "predicate").orderBy("t_valid", "recorded_at", "id")
    return facts.withColumn("version", F.row_number().over(w)).withColumn("next_t_valid", F.lead("t_valid").over(w))


def predicate_usage(facts: DataFrame) -> DataFrame:
    """Facts per predicate, invalidated ones too."""
    return facts.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def entity_usage(facts: DataFrame) -> DataFrame:
    """Facts per entity as subject or object; a fact about itself counts twice."""
    ends = facts.select(F.explode(F.array_compact(F.array("subject_id", "object_ref"))).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def stats(entities: DataFrame, facts: DataFrame, episodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Counts of a store as rows (measure, n)."""
    f = facts.agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("t_invalid").isNull()).alias("facts-valid"), F.count_if(F.col("t_invalid").isNotNull()).alias("facts-invalidated"))
    long = f.unpivot([], ["facts", "facts-valid", "facts-invalidated"], "measure", "n")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    by_status = predicates.groupBy(F.concat(F.lit("predicates-"), F.coalesce("status", F.lit("none"))).alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    return long.unionByName(one(entities, "entities")).unionByName(one(episodes, "episodes")).unionByName(by_status)


def episode_plan(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Open episodes with the action due: ``close`` where facts came from them, ``skip-empty`` otherwise."""
    used = facts.groupBy("episode").agg(F.count(F.lit(1)).alias("facts"))
    opened = episodes.where(F.col("closed_at").isNull())
    plan = opened.join(used.select(F.col("episode").alias("id"), "facts"), "id", "left")
    return plan.select("id", F.when(F.col("facts") > 0, "close").otherwise("skip-empty").alias("action"), F.coalesce("facts", F.lit(0)).alias("facts"))


def mechanical_summary(episodes: DataFrame, facts: DataFrame) -> DataFrame:
    """A summary of each episode that has facts: how many, and of which predicates, most frequent first."""
    by_predicate = facts.where(F.col("episode").isNotNull()).groupBy("episode", "predicate").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "predicate", "n")))  # a row per predicate of the registry at most
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(" ", p["n"], p["predicate"])), ", ")
    per = by_predicate.groupBy("episode").agg(F.sum("n").alias("facts"), text.alias("parts"))
    ref = F.when(F.col("ref").isNull(), F.lit("")).otherwise(F.concat(F.lit(" ("), F.col("ref"), F.lit(")")))
    summary = F.concat(F.col("source_type"), F.lit(" episode"), ref, F.lit(": "), F.col("facts"), F.lit(" facts — "), F.col("parts"))
    return per.join(episodes.select(F.col("id").alias("episode"), "source_type", "ref"), "episode").select("episode", summary.alias("summary"))
