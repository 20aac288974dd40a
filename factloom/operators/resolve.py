"""Entity resolution in batches: exact names before aliases before unique normalised names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import constants as K
from factloom.functions.exprs import keyword, norm_name, short_name
from factloom.plans.layout import cut, free

VIA = ("exact", "alias", "normalized")


def entity_names(entities: DataFrame) -> DataFrame:
    """Every name an entity can be found by: entity_id, scope, type, key, kind (0 name, 1 alias, 2 normalised)."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    keyed = lambda k, kind: F.struct(k.alias("key"), F.lit(kind).alias("kind"))
    every = F.concat(
        F.array(keyed(F.col("name"), 0)),
        F.transform(aliases, lambda a: keyed(a, 1)),
        F.transform(F.concat(F.array("name"), aliases), lambda a: keyed(norm_name(a), 2)),
    )
    return entities.select(F.col("id").alias("entity_id"), "scope", F.col("type").alias("entity_type"), F.explode(F.array_distinct(every)).alias("k")).select("entity_id", "scope", "entity_type", "k.*").where("key IS NOT NULL")


def resolve(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """What each distinct mention (name, scope, type) refers to: ``entity_id``, ``via``, ``candidates``.

    The name as it is, else an alias, else the one entity of that normalised name whose type doesn't contradict; two and more of those are
    ``ambiguous`` and none is ``none``. Of several entities of one exact name or alias the smallest id is taken. One equi-join on (scope, key).
    """
    distinct = mentions.select("name", "scope", "type").dropDuplicates()
    keys = F.array(*(F.struct(k.alias("key"), F.lit(kind).alias("kind")) for kind, k in enumerate([F.col("name"), F.col("name"), norm_name(F.col("name"))])))
    asked = distinct.select("name", "scope", "type", F.explode(keys).alias("k")).select("name", "scope", "type", "k.*")
    fits = (F.col("kind") < 2) | F.col("type").isNull() | F.col("entity_type").isNull() | (F.col("type") == F.col("entity_type"))
    hits = asked.join(entity_names(entities), ["scope", "key", "kind"], "left").where(F.col("entity_id").isNull() | fits)
    ids = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("entity_id")))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("entity_id")))
    got = distinct.join(hits.groupBy("name", "scope", "type").agg(first(0).alias("x0"), first(1).alias("x1"), first(2).alias("x2"), ids(2).alias("n2")).select(*(F.col(c).alias(f"__{c}") for c in ("name", "scope", "type")), "x0", "x1", "x2", "n2"),
                        F.col("name").eqNullSafe(F.col("__name")) & F.col("scope").eqNullSafe(F.col("__scope")) & F.col("type").eqNullSafe(F.col("__type")), "left")
    n2 = F.coalesce("n2", F.lit(0))
    via = F.when(F.col("x0").isNotNull(), "exact").when(F.col("x1").isNotNull(), "alias").when(n2 == 1, "normalized").when(n2 > 1, "ambiguous").otherwise("none")
    entity = F.coalesce("x0", "x1", F.when(n2 == 1, F.col("x2")))
    return got.select("name", "scope", "type", entity.alias("entity_id"), via.alias("via"), n2.cast("bigint").alias("candidates"))


def ensure(mentions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of mentions (seq, name, scope, type) adds: entities to mint, and aliases to append to existing ones.

    Unresolved mentions of one normalised name and scope mint one entity, named as first mentioned, its further spellings its aliases; a mention
    found by its normalised name becomes an alias. Ambiguous mentions mint nothing.
    """
    found = resolve(mentions, entities)
    same = ["name", "scope", "type"]
    m, f = mentions.alias("m"), found.alias("f")
    joined = m.join(f, F.expr(" AND ".join(f"m.{c} <=> f.{c}" for c in same))).select("m.*", "f.entity_id", "f.via")
    new = joined.where("via = 'none' AND name IS NOT NULL").withColumn("norm_name", norm_name(F.col("name")))
    minted = new.groupBy("scope", "norm_name").agg(
        F.min_by("name", "seq").alias("name"), F.min_by("type", F.when(F.col("type").isNotNull(), F.col("seq"))).alias("type"), F.sort_array(F.collect_set("name")).alias("names")
    )
    minted = minted.withColumn("aliases", F.array_remove("names", F.col("name"))).drop("names")
    minted = minted.withColumn("id", F.concat(F.lit("e-"), F.substring(F.sha2(F.concat_ws("\0", "scope", "norm_name"), 256), 1, 12)))
    aliases = joined.where("via = 'normalized'").select("entity_id", F.col("name").alias("alias")).dropDuplicates()
    return minted, aliases


def duplicate_clusters(entities: DataFrame) -> DataFrame:
    """Entities that share scope and normalised name: candidates for a merge."""
    by = entities.groupBy("scope", norm_name(F.col("name")).alias("normalized")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return by.where("n > 1 AND normalized IS NOT NULL")


def alias_clusters(entities: DataFrame) -> DataFrame:
    """Entities known by two or more distinct names."""
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return entities.select("id", F.sort_array(names).alias("names")).where("size(names) > 1")


def merge_map(merges: DataFrame) -> DataFrame:
    """The final target of every merged entity, where targets may be merged again: columns ``old``, ``new``. merges: ``old``, ``new``.

    Pointers are doubled in each round, so chains of n merges take log n rounds, and rounds go on until no pointer moves. Of several targets of one entity
    the smallest counts. Merges in a circle have no final target: a ValueError names one of them.
    """
    now = cut(merges.where("old <> new").groupBy("old").agg(F.min("new").alias("new")))
    rounds, moving = now.count().bit_length() + 1, True
    while moving:
        step = now.alias("a").join(now.alias("b"), F.col("a.new") == F.col("b.old"), "left")
        new = cut(step.select("a.old", F.coalesce("b.new", "a.new").alias("new"), F.col("b.new").isNotNull().alias("moved")))
        still = new.where("moved").first()
        moving, rounds = still is not None, rounds - 1
        if moving and not rounds:  # n merges in a row take no more rounds, so these go round
            raise ValueError(f"circular-merge: {still.old}")
        free(now)
        now = new.drop("moved")
        now._cut_at = new._cut_at
    return now


def repoint(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """Facts with subjects and objects of merged entities replaced by their targets, and ``touched`` telling where."""
    s = merged.select(F.col("old").alias("subject_id"), F.col("new").alias("__s"))
    o = merged.select(F.col("old").alias("object_ref"), F.col("new").alias("__o"))
    j = facts.join(s, "subject_id", "left").join(o, "object_ref", "left")
    touched = F.col("__s").isNotNull() | F.col("__o").isNotNull()
    return j.withColumns({"touched": touched, "subject_id": F.coalesce("__s", "subject_id"), "object_ref": F.coalesce("__o", "object_ref")}).select(*facts.columns, "touched")


def resolve_predicates(typed: DataFrame, registry: DataFrame) -> DataFrame:
    """Each distinct typed predicate with the registered ``id`` it means, ``status`` and ``verdict``: ok, register, deprecated-predicate or unknown-predicate.

    Case and punctuation are as typed but for a leading colon and underscores; a bare name means the core predicate of that name, and unknown ``x/`` names
    register themselves.
    """
    raw = F.regexp_replace(keyword(F.col("predicate")), "_", "-")
    asked = typed.select("predicate").dropDuplicates().withColumn("raw", raw)
    asked = asked.withColumn("full", F.when(F.contains("raw", F.lit("/")), F.col("raw")).otherwise(F.concat(F.lit("core/"), F.col("raw"))))
    rows = registry.select(F.col("id").alias("full"), F.col("id").alias("id"), "status", "replaced_by")
    j = asked.join(rows, "full", "left")
    verdict = F.when(F.col("status") == "deprecated", "deprecated-predicate").when(F.col("id").isNotNull(), "ok").when(F.col("full").startswith("x/"), "register").otherwise("unknown-predicate")
    return j.select("predicate", F.coalesce("id", "full").alias("id"), "status", verdict.alias("verdict"), "replaced_by")


def registrations(used: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry rows for ``x/`` predicates in use (column ``predicate``) that have none: on trial, of either object kind, many-valued."""
    new = used.where(F.col("predicate").startswith("x/")).select(F.col("predicate").alias("id")).dropDuplicates().join(registry.select("id"), "id", "left_anti")
    fixed = {"label": F.regexp_replace(short_name(F.col("id")), "-", " "), "object_kind": F.lit("either"), "cardinality": F.lit("many"), "status": F.lit("testing"), "default_epistemic": F.lit("observation")}
    return new.select(*(F.col("id") if f.name == "id" else fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in registry.schema))


def did_you_mean(unknown: DataFrame, registry: DataFrame, *, distance: int = K.DID_YOU_MEAN_DISTANCE, top: int = K.DID_YOU_MEAN_TOP) -> DataFrame:
    """For each distinct unknown predicate the nearest registered names: predicate, suggestion, distance, place. The registry is a small fixed table."""
    from pyspark.sql.window import Window as W

    names = registry.select(F.col("id").alias("suggestion"), short_name(F.col("id")).alias("__name"))
    pairs = unknown.select("predicate").dropDuplicates().join(names)
    far = F.levenshtein(short_name(F.col("predicate")), F.col("__name"), distance)
    w = W.partitionBy("predicate").orderBy("distance", "suggestion")
    return pairs.withColumn("distance", far).where("distance >= 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("__name")
