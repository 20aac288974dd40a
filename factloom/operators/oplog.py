"""Effect logs of several writers: canonical order, high-water marks, and the projections that a replay leaves.

A projection is computed from the whole log in canonical order (hlc, writer, seq), so late effects change nothing about the result and replaying
twice changes nothing at all. Each kind of state is an aggregate over its own effects; none sorts a writer's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.layout import cut, free

ORDER = ("hlc", "writer", "seq")


def dashed(payload: Column) -> Column:
    """A JSON payload with its snake-case keys in kebab case."""
    once = r'"([A-Za-z]+)_([A-Za-z_]+)"\s*:'
    return F.regexp_replace(F.regexp_replace(payload, once, r'"$1-$2":'), once, r'"$1-$2":')


def high_water(log: DataFrame) -> DataFrame:
    """The highest seq per writer."""
    return log.groupBy("writer").agg(F.max("seq").alias("high_water"), F.count_distinct("seq").alias("effects"))


def unapplied(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Effects above each writer's mark (writer, high_water); writers without a mark are new."""
    return log.join(marks.select("writer", "high_water"), "writer", "left").where(F.col("high_water").isNull() | (F.col("seq") > F.col("high_water"))).drop("high_water")


def mentions(log: DataFrame) -> DataFrame:
    """When a log first names each entity, by creating it or in a fact: ``id``, ``known_from`` (its place in canonical order)."""
    p = lambda path: F.get_json_object("j", path)
    rows = log.where(F.col("t").isin("ensure-entity", "insert-fact")).select(dashed(F.col("payload")).alias("j"), F.struct(*ORDER).alias("o"))
    ids = F.array(p("$.entity.id"), p("$.fact.subject.id"), p("$.fact.object-ref.id"))
    return rows.select("o", F.explode(F.array_compact(ids)).alias("id")).groupBy("id").agg(F.min("o").alias("known_from"))


def moves(log: DataFrame, kind: str = "repoint-facts", known: DataFrame | None = None) -> DataFrame:
    """The repointings of a log that apply: ``o``, ``old``, ``new``. known: both ends must have a ``known_from`` before; without it all apply."""
    p = lambda path: F.get_json_object("j", path)
    rows = log.where(F.col("t") == kind).select(F.struct(*ORDER).alias("o"), dashed(F.col("payload")).alias("j")).select("o", p("$.from").alias("old"), p("$.to").alias("new")).where("old <> new")
    if known is not None:
        for end in ("old", "new"):
            since = known.select(F.col("id").alias(end), F.col("known_from").alias("__since"))
            rows = rows.join(since, end).where("__since IS NULL OR o > __since").drop("__since")
    return rows.select("o", "old", "new")


def final_targets(moved: DataFrame) -> DataFrame:
    """Each repointing (``o``, ``old``, ``new``) with where what it moved ends up after all later ones: ``o``, ``old``, ``final``.

    What one moves the next one of its target moves on; pointers to the next are doubled, so a chain of n takes log n rounds. Later never points to earlier,
    so there are no circles.
    """
    a, b = moved.select("o", "new"), moved.select(F.col("old").alias("new"), F.col("o").alias("__o2"))
    after = a.join(b, "new").where("__o2 > o").groupBy("o").agg(F.min("__o2").alias("next"))
    now = cut(moved.join(after, "o", "left").select("o", "old", "new", F.coalesce("next", "o").alias("last")))
    while True:
        jump = now.select(F.col("o").alias("last"), F.col("last").alias("__further"))
        step = cut(now.join(jump, "last").select("o", "old", "new", F.col("__further").alias("last"), (F.col("__further") > F.col("last")).alias("moved")))
        done = step.where("moved").isEmpty()
        free(now)
        now = step.drop("moved")
        now._cut_at = step._cut_at
        if done:
            return now.select("o", "old", F.col("last").alias("__l")).join(now.select(F.col("o").alias("__l"), F.col("new").alias("final")), "__l").select("o", "old", "final")


def follow(rows: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """``rows`` (unique ``id``, ``made``: their place in canonical order, null for before all) with ``column`` as the repointings after them leave it."""
    hit = rows.select("id", "made", F.col(column).alias("old")).join(targets, "old").where("made IS NULL OR o > made")
    new = hit.groupBy("id").agg(F.min_by("final", "o").alias("__new"))
    return rows.join(new, "id", "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def facts(log: DataFrame) -> DataFrame:
    """The facts after replay: id, subject, predicate, object, confidence, t_invalid_ms, reason, last_reinforced_ms.

    The first insert of an id counts; closings and reinforcements count where the fact had been inserted before them, the last of each wins. Subjects, objects
    and predicates are what later repointings leave.
    """
    p = lambda path: F.get_json_object("j", path)
    rows = log.where(F.col("t").isin("insert-fact", "invalidate", "reinforce")).withColumn("j", dashed(F.col("payload"))).withColumn("o", F.struct(*ORDER))
    insert = F.col("t") == "insert-fact"
    rows = rows.select("t", "o", F.when(insert, p("$.fact.id")).otherwise(p("$.fact-id")).alias("id"), "j").where("id IS NOT NULL")
    made = F.when(insert, F.col("o"))
    first = rows.groupBy("id").agg(F.min(made).alias("made"), F.min_by("j", made).alias("j")).where("made IS NOT NULL")
    later = rows.where(~insert).join(first.select("id", "made"), "id").where("o > made")
    last = lambda kind, value: F.max_by(value, F.when(F.col("t") == kind, F.col("o")))
    after = later.groupBy("id").agg(
        last("invalidate", p("$.at").cast("bigint")).alias("t_invalid_ms"), last("invalidate", p("$.reason")).alias("reason"),
        last("reinforce", p("$.at").cast("bigint")).alias("last_reinforced_ms"), last("reinforce", p("$.confidence").cast("double")).alias("raised"),
    )
    held = first.join(after, "id", "left").select(
        "id", "made", p("$.fact.subject.id").alias("subject"), p("$.fact.predicate").alias("predicate"), p("$.fact.object-lit").alias("literal"), p("$.fact.object-ref.id").alias("ref"),
        F.coalesce("raised", p("$.fact.confidence").cast("double")).alias("confidence"), "t_invalid_ms", "reason", "last_reinforced_ms",
    )
    targets = final_targets(moves(log, known=mentions(log)))
    held = follow(follow(held, targets, "subject"), targets, "ref")
    held = follow(held, final_targets(moves(log, "repoint-predicate")), "predicate")
    return held.select("id", "subject", "predicate", F.coalesce("literal", "ref").alias("object"), "confidence", "t_invalid_ms", "reason", "last_reinforced_ms")


def conflict_links(log: DataFrame) -> DataFrame:
    """The links after replay: of each pair the last link or unlink counts. ``fact_id``, ``candidate_id``."""
    rows = log.where(F.col("t").isin("link-conflicts", "unlink-conflicts")).withColumn("j", dashed(F.col("payload")))
    ids = F.from_json(F.get_json_object("j", "$.ids"), T.ArrayType(T.StringType()))
    each = rows.select(F.get_json_object("j", "$.fact-id").alias("fact_id"), F.explode(ids).alias("candidate_id"), (F.col("t") == "link-conflicts").alias("linked"), F.struct(*ORDER).alias("o"))
    return each.groupBy("fact_id", "candidate_id").agg(F.max_by("linked", "o").alias("linked")).where("linked").drop("linked")


def episodes(log: DataFrame) -> DataFrame:
    """The episodes after replay: the first opening, and the last closing after it."""
    p = lambda path: F.get_json_object("j", path)
    rows = log.where(F.col("t").isin("open-episode", "close-episode")).withColumn("j", dashed(F.col("payload"))).withColumn("o", F.struct(*ORDER)).withColumn("id", F.coalesce(p("$.episode.id"), p("$.id"))).where("id IS NOT NULL")
    opened = rows.where("t = 'open-episode'").groupBy("id").agg(F.min("o").alias("o0"), F.min_by(F.coalesce(p("$.episode.summary"), p("$.summary")), "o").alias("first_summary"))
    closed = rows.where("t = 'close-episode'").select("id", "o", "j").join(opened.select("id", "o0"), "id").where("o > o0").groupBy("id").agg(F.max_by(p("$.summary"), "o").alias("closing"), F.max("o.hlc").alias("closed_hlc"))
    return opened.join(closed, "id", "left").select("id", F.col("o0.hlc").alias("opened_hlc"), "closed_hlc", F.coalesce("closing", "first_summary").alias("summary"))


#: The kinds of effects there are.
KINDS = (
    "ensure-entity", "update-entity", "delete-entity", "insert-fact", "invalidate", "reinforce", "link-conflicts", "unlink-conflicts", "open-episode", "close-episode", "repoint-facts", "register-predicate",
    "repoint-predicate",
)


def replay_statuses(log: DataFrame) -> DataFrame:
    """What becomes of each effect of a log that is replayed on nothing: ``writer``, ``seq``, ``t``, ``status`` (applied, skipped, unknown).

    A fact or episode that exists is not made again; what is done to a fact, entity or episode nobody named before is skipped, also if it comes later.
    """
    p = lambda path: F.get_json_object("j", path)
    rows = log.select("t", F.struct(*ORDER).alias("o"), dashed(F.col("payload")).alias("j"))
    of_fact, of_entity, of_episode = F.col("t").isin("invalidate", "reinforce", "link-conflicts", "unlink-conflicts"), F.col("t").isin("update-entity", "delete-entity"), F.col("t").isin("open-episode", "close-episode")
    target = (
        F.when(F.col("t") == "insert-fact", F.concat(F.lit("f:"), p("$.fact.id"))).when(of_fact, F.concat(F.lit("f:"), p("$.fact-id"))).when(of_entity, F.concat(F.lit("e:"), p("$.id")))
        .when(of_episode, F.concat(F.lit("p:"), F.coalesce(p("$.episode.id"), p("$.id")))).when(F.col("t") == "repoint-facts", F.concat(F.lit("e:"), p("$.from")))
    )
    rows = rows.select("t", "o", target.alias("target"), F.when(F.col("t") == "repoint-facts", F.concat(F.lit("e:"), p("$.to"))).alias("other"))
    made = rows.where(F.col("t").isin("insert-fact", "open-episode") & F.col("target").isNotNull()).groupBy("target").agg(F.min("o").alias("first"))
    known = made.unionByName(mentions(log).select(F.concat(F.lit("e:"), "id").alias("target"), F.col("known_from").alias("first")))
    rows = rows.join(known, "target", "left").join(known.select(F.col("target").alias("other"), F.col("first").alias("first_other")), "other", "left")
    makes, after = F.col("t").isin("insert-fact", "open-episode"), lambda c: F.coalesce(F.col(c) < F.col("o"), F.lit(False))
    applied = F.when(F.col("t").isin("ensure-entity", "register-predicate", "repoint-predicate"), True).when(makes, F.coalesce(F.col("first") == F.col("o"), F.lit(False))).when(F.col("t") == "repoint-facts", after("first") & after("first_other")).otherwise(after("first"))
    return rows.select("o.writer", "o.seq", "t", F.when(~F.col("t").isin(*KINDS), "unknown").when(applied, "applied").otherwise("skipped").alias("status"))


def replay_report(log: DataFrame) -> DataFrame:
    """Per kind of effect: how many there are, and how many are applied, skipped and unknown in a replay."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return replay_statuses(log).groupBy("t").agg(F.count(F.lit(1)).alias("effects"), count("applied"), count("skipped"), count("unknown"))


def since_last_mark(retrievals: DataFrame) -> DataFrame:
    """The reads after the last outcome, by one aggregate of its seq."""
    mark = retrievals.where("type = 'outcome'").agg(F.max("seq").alias("mark"))
    return retrievals.where("type = 'read'").join(F.broadcast(mark)).where(F.col("mark").isNull() | (F.col("seq") > F.col("mark"))).drop("mark")


def outcome(facts_: DataFrame, retrievals: DataFrame, valence: str, now: Column) -> DataFrame:
    """Facts in play since the last mark; under ``accepted`` each is reinforced at its existing confidence: id, confidence, last_reinforced_at."""
    if valence not in ("accepted", "rejected"):
        raise ValueError(f"invalid-valence: {valence}")
    ids = since_last_mark(retrievals).select(F.explode("fact_ids").alias("id")).dropDuplicates()
    hit = facts_.dropDuplicates(["id"]).join(ids, "id", "left_semi")
    return hit.select("id", "confidence", now.alias("last_reinforced_at") if valence == "accepted" else F.col("last_reinforced_at"))


def trim_log(log: DataFrame, keep: int = 1000, order: str = "seq") -> DataFrame:
    """The newest entries of a capped log."""
    return log.orderBy(F.desc(order)).limit(keep)
