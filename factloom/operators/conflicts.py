"""Conflicts between facts: pairs worth a verdict, links still open, and what a verdict does. Every pair join has the subject as equi key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import constants as K
from factloom.functions.exprs import norm_name, trust, valid_at

KEPT = ["id", "subject_id", "predicate", "object_name", "object_kind", "object_ref", "object_lit", "epistemic", "source_type", "t_valid", "recorded_at"]


def exclusion_mates(registry: DataFrame) -> DataFrame:
    """Predicates of one exclusion group: ``predicate``, ``mate``."""
    a = registry.where("exclusion_group IS NOT NULL").select(F.col("id").alias("predicate"), "exclusion_group")
    b = a.select(F.col("predicate").alias("mate"), "exclusion_group")
    return a.join(b, "exclusion_group").where("predicate <> mate").select("predicate", "mate")


def _sides(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    keyed = live.select(*KEPT, norm_name(F.col("object_name")).alias("norm_object"))
    return tuple(keyed.select(*(F.col(c).alias(f"{s}_{c}") for c in keyed.columns)) for s in ("a", "b"))


def newer_first(pairs: DataFrame, *more: str) -> DataFrame:
    """Pairs as ``fact_id`` (recorded later; of equals the greater id) and ``candidate_id``."""
    a, b = (F.struct(F.col(f"{s}_recorded_at"), F.col(f"{s}_id")) for s in ("a", "b"))
    return pairs.select(F.when(a >= b, F.col("a_id")).otherwise(F.col("b_id")).alias("fact_id"), F.when(a >= b, F.col("b_id")).otherwise(F.col("a_id")).alias("candidate_id"), *more)


def exclusive_values(live: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs of live facts of one subject and exclusive predicate."""
    only = registry.where("value_exclusivity = 'exclusive'").select(F.col("id").alias("predicate"))
    a, b = _sides(live.join(only, "predicate", "left_semi"))
    return newer_first(a.join(b, (F.col("a_subject_id") == F.col("b_subject_id")) & (F.col("a_predicate") == F.col("b_predicate"))).where("a_id < b_id"))


def rival_counts(live: DataFrame, registry: DataFrame) -> DataFrame:
    """The same links without pairs: per fact its number of rivals and the one recorded last, ``newest_rival``; linear however many values a subject has."""
    only = registry.where("value_exclusivity = 'exclusive'").select(F.col("id").alias("predicate"))
    f = live.join(only, "predicate", "left_semi").select("id", "subject_id", "predicate", "recorded_at")
    o = F.struct("recorded_at", "id")
    # the two newest facts of a group are enough: the newest is every other fact's rival, and its own is the second
    best = f.groupBy("subject_id", "predicate").agg(F.count(F.lit(1)).alias("n"), F.max(o).alias("top"))
    j = f.join(best, ["subject_id", "predicate"])
    second = j.where(F.col("id") != F.col("top.id")).groupBy("subject_id", "predicate").agg(F.max(o).alias("second"))
    j = j.where("n > 1").join(second, ["subject_id", "predicate"])
    return j.select("id", (F.col("n") - 1).alias("rivals"), F.when(F.col("id") == F.col("top.id"), F.col("second.id")).otherwise(F.col("top.id")).alias("newest_rival"))


def cross_predicate(live: DataFrame, registry: DataFrame) -> DataFrame:
    """Pairs of live facts of one subject about loosely the same object by different predicates, one of them a decision."""
    decisions = registry.where("category = 'decision'").select(F.col("id").alias("predicate"), F.lit(True).alias("decision"))
    marked = live.join(decisions, "predicate", "left")
    a, _ = _sides(marked.where("decision"))
    _, b = _sides(marked)
    both = marked.select(F.col("id").alias("b_id"), F.coalesce("decision", F.lit(False)).alias("b_decision"))
    j = a.join(b, (F.col("a_subject_id") == F.col("b_subject_id")) & (F.col("a_norm_object") == F.col("b_norm_object"))).where("a_predicate <> b_predicate")
    return newer_first(j.join(both, "b_id").where("NOT b_decision OR a_id < b_id"))


def stance_conflicts(live: DataFrame, registry: DataFrame) -> DataFrame:
    """Live facts of one subject whose predicates exclude each other on loosely the same object."""
    a, b = _sides(live)
    mates = exclusion_mates(registry).select(F.col("predicate").alias("a_predicate"), F.col("mate").alias("b_predicate"))
    j = a.join(mates, "a_predicate").join(b.withColumnRenamed("b_subject_id", "a_subject_id").withColumnRenamed("b_norm_object", "a_norm_object"), ["a_subject_id", "b_predicate", "a_norm_object"])
    return newer_first(j.where("a_id < b_id"))


def candidates(live: DataFrame, registry: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Pairs for the judge, each once: ``fact_id``, ``candidate_id``, ``reason``; pairs already linked either way are left out."""
    both = exclusive_values(live, registry).withColumn("reason", F.lit("exclusive-values")).unionByName(cross_predicate(live, registry).withColumn("reason", F.lit("cross-predicate")))
    each = both.groupBy("fact_id", "candidate_id").agg(F.max("reason").alias("reason"))  # exclusive-values before cross-predicate
    if links is not None:
        known = links.select("fact_id", "candidate_id").unionByName(links.select(F.col("candidate_id").alias("fact_id"), F.col("fact_id").alias("candidate_id")))
        each = each.join(known, ["fact_id", "candidate_id"], "left_anti")
    return each.select("fact_id", "candidate_id", "reason")


def open_conflicts(facts: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Links whose two facts are both valid: ``fact_id``, ``candidate_id``."""
    ids = facts.where(valid_at(now)).select("id").dropDuplicates()
    both = links.select("fact_id", "candidate_id").dropDuplicates().join(ids.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
    return both.join(ids.select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi").select("fact_id", "candidate_id")


def undisputed(live: DataFrame, links: DataFrame) -> DataFrame:
    """Live facts that have no conflict link of their own."""
    return live.join(links.select(F.col("fact_id").alias("id")), "id", "left_anti")


def object_key() -> Column:
    """The object's identity: kind, and id or literal."""
    return F.struct("object_kind", F.when(F.col("object_kind") == "entity", F.col("object_ref")).otherwise(F.col("object_lit")).alias("value"))


def revenants(facts: DataFrame, now: Column) -> DataFrame:
    """Live facts whose object a dead fact of the same subject and predicate had, while live rivals with other objects exist, below full trust."""
    k = facts.withColumn("o", object_key()).withColumn("live", valid_at(now))
    per = k.groupBy("subject_id", "predicate", "o").agg(F.count_if("live").alias("live_n"), F.count_if(~F.col("live")).alias("dead_n"))
    all_ = k.where("live").groupBy("subject_id", "predicate").agg(F.count(F.lit(1)).alias("all_live"))
    back = per.where("dead_n > 0 AND live_n > 0").join(all_, ["subject_id", "predicate"]).where("all_live > live_n")
    return k.where("live").join(back, ["subject_id", "predicate", "o"]).where(trust(F.col("source_type")) < K.TRUST_FULL).select("id", (F.col("all_live") - F.col("live_n")).alias("rivals"))


def repeated_live(facts: DataFrame, now: Column) -> DataFrame:
    """Live facts that restate an earlier live one, whatever scope and class: ``id``, ``existing_id``."""
    k = facts.where(valid_at(now)).withColumn("o", object_key())
    first = k.groupBy("subject_id", "predicate", "o").agg(F.min(F.struct("recorded_at", "id")).alias("first"))
    return k.join(first, ["subject_id", "predicate", "o"]).where("id <> first.id").select("id", F.col("first.id").alias("existing_id"))


def collapse_plan(facts: DataFrame, now: Column) -> DataFrame:
    """Live facts that equal an earlier recorded one in subject, predicate, object, scope and class: what a merge may close.

    The earliest of each group is an aggregate, so a group may be of any size.
    """
    k = facts.where(valid_at(now)).withColumn("o", object_key())
    same = ["subject_id", "predicate", "o", "scope", "epistemic"]
    keep = k.groupBy(*same).agg(F.min(F.struct("recorded_at", "id")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    join = F.expr(" AND ".join(f"k.{c} <=> g.{c}" for c in same))
    return k.alias("k").join(keep.alias("g"), join).where("k.id <> g.keep.id").select(F.col("k.id").alias("id"), F.col("g.keep.id").alias("keep_id"))


def flag_reasons(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """For single-valued predicates, each statement against the one recorded before it: ``id``, ``previous_id``, ``action``, ``reason``."""
    one = registry.where("cardinality = 'one'").select(F.col("id").alias("predicate"))
    w = W.partitionBy("subject_id", "scope", "predicate").orderBy("recorded_at", "id")
    prev = lambda c: F.lag(c).over(w)
    k = facts.where("recorded_at IS NOT NULL AND t_valid IS NOT NULL").join(one, "predicate", "left_semi").withColumn("o", object_key())
    k = k.withColumns({"p_id": prev("id"), "p_o": prev("o"), "p_t": prev("t_valid"), "p_trust": trust(prev("source_type")), "p_class": prev("epistemic")}).where("p_id IS NOT NULL")
    same = F.col("o").eqNullSafe(F.col("p_o"))
    commitment = F.coalesce(F.col("epistemic") == "commitment", F.lit(False)) | F.coalesce(F.col("p_class") == "commitment", F.lit(False))
    late, outranked = F.col("p_t") > F.col("t_valid"), F.col("p_trust") > trust(F.col("source_type"))
    action = F.when(same, "reinforce").when(commitment | late | outranked, "flag").otherwise("supersede")
    reason = F.when(same | commitment, F.lit(None).cast("string")).when(late, "backdated-overlap").when(outranked, "outranked")
    return k.select("id", F.col("p_id").alias("previous_id"), action.alias("action"), reason.alias("reason"))


def resolution_plan(verdicts: DataFrame, gate: float = K.JUDGE_GATE) -> DataFrame:
    """What a verdict on a pair leads to. verdicts: fact_id (newer), candidate_id, relation, confidence."""
    known = F.col("relation").isin("contradicts", "duplicate", "supersedes", "compatible")
    sure = F.coalesce(F.col("confidence") >= gate, F.lit(False))
    action = (
        F.when(F.col("relation") == "contradicts", "needs-human").when(~F.coalesce(known, F.lit(False)), "unparseable").when(~sure, "low-confidence")
        .when(F.col("relation") == "duplicate", "invalidate-newer").when(F.col("relation") == "supersedes", "invalidate-older").otherwise("unlink")
    )
    target = F.when(action == "invalidate-newer", F.col("fact_id")).when(action == "invalidate-older", F.col("candidate_id"))
    return verdicts.select("fact_id", "candidate_id", action.alias("action"), target.alias("target_id"))
