"""Reconciling other writers' effects into a store: what it hasn't seen is applied in canonical order, entities are met by name.

All effects of a batch are applied together, with the result of going through them in order: whether an effect applies depends on what was made
before it, which is a join on the first making; of several values the last counts; repointings are followed along their chain.
Names are resolved against the store as it was before the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.exprs import complete_json, norm_name, valid_at
from factloom.operators import conflicts, oplog, reads, resolve
from factloom.plans.layout import cut


def _struct(*names: str, **types: str) -> str:
    return "struct<" + ", ".join(f"`{n}`: {types.get(n.replace('-', '_'), 'string')}" for n in names) + ">"


_ENTITY = _struct("id", "name", "type", "scope", "aliases", aliases="array<string>")
_TIMES = dict(t_valid="bigint", t_invalid="bigint", recorded_at="bigint", last_reinforced_at="bigint", opened_at="bigint")
_FACT = _struct(
    "id", "subject", "predicate", "object-kind", "object-ref", "object-lit", "t-valid", "t-invalid", "recorded-at", "last-reinforced-at", "confidence", "epistemic", "scope", "source-type", "episode", "invalidation-reason",
    subject=_ENTITY, object_ref=_ENTITY, confidence="double", **_TIMES,
)
_EPISODE = _struct("id", "source-type", "ref", "summary", "opened-at", "evidence", **_TIMES)


@dataclass(slots=True)
class State:
    """What a store knows of other writers: the highest seq applied of each (writer, high_water), and who their entities are here (foreign_id, local_id)."""

    marks: DataFrame
    entities: DataFrame


@dataclass(slots=True)
class Reconciled:
    """The tables after a batch, the new state, the status of each effect (writer, seq, t, status), and the facts closed as duplicates (id, keep_id)."""

    tables: dict[str, DataFrame]
    state: State
    effects: DataFrame
    duplicates: DataFrame


def no_state(spark) -> State:
    """Of a store that has seen no other writer."""
    return State(spark.createDataFrame([], "writer string, high_water bigint"), spark.createDataFrame([], "foreign_id string, local_id string"))


def _parsed(log: DataFrame, registry: T.StructType) -> DataFrame:
    predicate = _struct(*(f.name.replace("_", "-") for f in registry))
    payload = f"entity {_ENTITY}, id string, updates {_ENTITY}, `from` string, `to` string, fact {_FACT}, `fact-id` string, at bigint, reason string, confidence double, ids array<string>, episode {_EPISODE}, summary string, predicate {predicate}"
    read = log.select(F.struct("hlc", "writer", "seq").alias("o"), "t", "payload", F.from_json(oplog.dashed(F.col("payload")), payload).alias("p"))
    return read.withColumn("whole", complete_json(F.col("payload"))).drop("payload")


def _known_after(rows: DataFrame, known: DataFrame, id: str, column: str) -> DataFrame:
    """``rows`` with ``column``: the local entity that a foreign id means by then, null where it isn't known yet."""
    k = known.select(F.col("foreign_id").alias(id), F.col("local_id").alias(column), F.col("known_from").alias("__since"))
    return rows.join(k, id, "left").withColumn(column, F.when(F.col("__since").isNull() | (F.col("__since") <= F.col("o")), F.col(column))).drop("__since")


def reconcile(tables: dict[str, DataFrame], log: DataFrame, state: State, now: Column, own: str | None = None) -> Reconciled:
    """Apply the effects of ``log`` (writer, seq, hlc, t, payload) that ``state`` hasn't seen and that aren't the store's ``own``.

    tables: entities, facts, episodes, predicates, links. An effect is ``applied``, ``skipped`` (what it is about doesn't exist by then, or what it makes
    exists), ``unknown`` (of a kind not known) or an ``error`` (its payload is cut off, or its fact has no subject that can be named). Entities are met by
    name as in any assertion, new ones get ids by scope and name, and further spellings become aliases. Afterwards facts of the subjects
    touched that are stated twice are closed, never erased. Null writers or seqs take no part, a repeated (writer, seq) counts once.
    """
    entities, facts, episodes, predicates, links = (tables[n] for n in ("entities", "facts", "episodes", "predicates", "links"))
    stand = cut(reads.distinct_facts(facts))
    fresh = log.where("writer IS NOT NULL AND seq IS NOT NULL AND hlc IS NOT NULL").dropDuplicates(["writer", "seq"])
    if own is not None:
        fresh = fresh.where(F.col("writer") != own)
    fresh = oplog.unapplied(fresh, state.marks)
    e = cut(_parsed(fresh.select("writer", "seq", "hlc", "t", "payload"), predicates.schema))
    of = lambda *kinds: e.where(F.col("whole") & F.col("t").isin(*kinds))

    # who the entities are here
    named = lambda rows, c: rows.select("o", F.col(f"{c}.id").alias("foreign_id"), F.col(f"{c}.name").alias("name"), F.col(f"{c}.type").alias("type"), F.coalesce(f"{c}.scope", F.lit("project")).alias("scope"))
    inserts = of("insert-fact")
    said = named(of("ensure-entity"), "p.entity").unionByName(named(inserts, "p.fact.subject")).unionByName(named(inserts, "p.fact.`object-ref`"))
    said = said.where("foreign_id IS NOT NULL AND name IS NOT NULL").join(state.entities.select("foreign_id"), "foreign_id", "left_anti")
    first = cut(said.groupBy("foreign_id").agg(F.min("o").alias("known_from"), F.min_by(F.struct("name", "scope", "type"), "o").alias("e")).select("foreign_id", "known_from", "e.*"))
    asked = first.select(F.col("known_from").alias("seq"), "name", "scope", "type")
    found, (minted, healed) = cut(resolve.resolve(asked, entities)), resolve.ensure(asked, entities)
    minted = cut(minted.select("id", "name", "type", "scope", "aliases", "norm_name"))
    same = F.expr(" AND ".join(f"a.{c} <=> b.{c}" for c in ("name", "scope", "type")))
    met = first.alias("a").join(found.select("name", "scope", "type", "entity_id", "via").alias("b"), same).select("a.*", "b.entity_id", "b.via").withColumn("norm_name", norm_name(F.col("name")))
    met = met.join(minted.select("scope", "norm_name", F.col("id").alias("new_id")), ["scope", "norm_name"], "left")
    local = F.coalesce("entity_id", F.when(F.col("via") == "none", F.col("new_id")))
    met = cut(met.select("foreign_id", local.alias("local_id"), "known_from").where("local_id IS NOT NULL"))
    order = e.schema["o"].dataType
    known = state.entities.select("foreign_id", "local_id", F.lit(None).cast(order).alias("known_from")).unionByName(met)

    # facts: what is made, where repointings leave it, and what is done to it afterwards
    f = lambda c: F.col(f"p.fact.`{c}`")
    made = inserts.select("o", f("id").alias("id"), f("subject")["id"].alias("__s"), f("object-ref")["id"].alias("__r"), "p")
    made = _known_after(_known_after(made, known, "__s", "subject_id"), known, "__r", "object_ref")
    usable = F.col("id").isNotNull() & F.col("subject_id").isNotNull() & (F.col("__r").isNull() | F.col("object_ref").isNotNull())
    firsts = made.where(usable).groupBy("id").agg(F.min("o").alias("__first"))
    made = made.withColumn("usable", usable).join(firsts, "id", "left").join(stand.select("id", F.lit(True).alias("__held")), "id", "left")
    made = cut(made.withColumn("status", F.when(~F.col("usable"), "error").when(F.col("__held") | (F.col("__first") != F.col("o")), "skipped").otherwise("applied")))
    time = lambda c: F.timestamp_millis(f(c)).alias(c.replace("-", "_"))
    text = lambda *cs: [f(c).alias(c.replace("-", "_")) for c in cs]
    new = made.where("status = 'applied'").select(
        "id", F.col("o").alias("made"), "subject_id", *text("predicate"), F.coalesce(f("object-kind"), F.when(F.col("object_ref").isNotNull(), "entity").otherwise("literal")).alias("object_kind"), "object_ref",
        *text("object-lit"), *map(time, ("t-valid", "t-invalid", "recorded-at", "last-reinforced-at")), *text("confidence", "epistemic", "scope", "source-type", "episode", "invalidation-reason"),
    )
    columns = stand.columns
    every = stand.withColumn("made", F.lit(None).cast(order)).unionByName(new.select(*(c for c in columns), "made"))
    ids = cut(every.select(F.col("id").alias("fact_id"), "made"))
    repoints = _known_after(_known_after(of("repoint-facts").select("o", F.col("p.from").alias("__a"), F.col("p.to").alias("__b")), known, "__a", "old"), known, "__b", "new")
    repoints = cut(repoints.withColumn("status", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), "applied").otherwise("skipped")))
    to = oplog.final_targets(repoints.where("status = 'applied' AND old <> new").select("o", "old", "new"))
    every = oplog.follow(oplog.follow(every, to, "subject_id"), to, "object_ref")
    predicate = lambda c: F.regexp_replace(F.col(c), "^:", "")
    renamed = of("repoint-predicate").select("o", predicate("p.from").alias("old"), predicate("p.to").alias("new")).where("old <> new")
    every = oplog.follow(every, oplog.final_targets(renamed), "predicate")
    upon = of("invalidate", "reinforce", "link-conflicts", "unlink-conflicts").select("o", "t", F.col("p.`fact-id`").alias("fact_id"), "p.at", "p.reason", "p.confidence", "p.ids")
    upon = upon.join(ids, "fact_id", "left").join(ids.select("fact_id", F.lit(True).alias("__there")), "fact_id", "left")
    upon = cut(upon.withColumn("status", F.when(F.col("__there") & (F.col("made").isNull() | (F.col("made") < F.col("o"))), "applied").otherwise("skipped")))
    last = lambda kind, v: F.max_by(v, F.when(F.col("t") == kind, F.col("o")))
    done = upon.where("status = 'applied' AND t IN ('invalidate', 'reinforce')").groupBy(F.col("fact_id").alias("id")).agg(
        last("invalidate", F.timestamp_millis("at")).alias("__at"), last("invalidate", F.col("reason")).alias("__why"), last("reinforce", F.timestamp_millis("at")).alias("__again"), last("reinforce", F.col("confidence")).alias("__sure")
    )
    every = every.join(done, "id", "left").withColumns({
        "t_invalid": F.coalesce("__at", "t_invalid"), "invalidation_reason": F.when(F.col("__at").isNotNull(), F.col("__why")).otherwise(F.col("invalidation_reason")), "last_reinforced_at": F.coalesce("__again", "last_reinforced_at"),
        "confidence": F.coalesce("__sure", "confidence"),
    })
    every = cut(every.select(*columns))

    # links: of each pair the last that applies counts
    pairs = upon.where("status = 'applied' AND t IN ('link-conflicts', 'unlink-conflicts')").select("fact_id", F.explode("ids").alias("candidate_id"), (F.col("t") == "link-conflicts").alias("on"), "o")
    pairs = pairs.join(ids.withColumnRenamed("fact_id", "candidate_id"), "candidate_id").where("made IS NULL OR made < o OR NOT on")
    pair = pairs.groupBy("fact_id", "candidate_id").agg(F.max_by("on", "o").alias("on"))
    both = ["fact_id", "candidate_id"]
    links = links.select(*both).dropDuplicates().join(pair.where("NOT on"), both, "left_anti").unionByName(pair.where("on").select(*both)).dropDuplicates()

    # entities: minted, renamed, removed
    changes = _known_after(of("update-entity", "delete-entity").select("o", "t", F.col("p.id").alias("__f"), F.col("p.updates").alias("u")), known, "__f", "id")
    changes = cut(changes.withColumn("status", F.when(F.col("id").isNotNull(), "applied").otherwise("skipped")))
    updated = changes.where("status = 'applied'").groupBy("id").agg(F.bool_or(F.col("t") == "delete-entity").alias("__gone"), *(F.max_by(F.col(f"u.{c}"), F.when((F.col("t") == "update-entity") & F.col(f"u.{c}").isNotNull(), F.col("o"))).alias(f"__{c}") for c in ("name", "type", "scope", "aliases")))
    more = healed.groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("alias").alias("__more"))
    held = entities.unionByName(minted.select(*(c for c in entities.columns if c in minted.columns)), allowMissingColumns=True).join(updated, "id", "left").join(more, "id", "left").where("__gone IS NULL OR NOT __gone")
    none = F.array().cast("array<string>")
    held = held.withColumns({
        "aliases": F.when(F.col("__aliases").isNotNull() | F.col("__more").isNotNull(), F.array_distinct(F.concat(F.coalesce("__aliases", "aliases", none), F.coalesce("__more", none)))).otherwise(F.col("aliases")),
        "name": F.coalesce("__name", "name"), "type": F.coalesce("__type", "type"), "scope": F.coalesce("__scope", "scope"),
    })
    if "norm_name" in held.columns:
        held = held.withColumn("norm_name", F.when(F.col("__name").isNotNull(), norm_name(F.col("name"))).otherwise(F.col("norm_name")))
    entities_now = cut(held.select(*entities.columns))

    # episodes and predicates
    opened = of("open-episode").select("o", F.coalesce("p.episode.id", "p.id").alias("id"), "p")
    begun = opened.where("id IS NOT NULL").groupBy("id").agg(F.min("o").alias("__first"))
    opened = opened.join(begun, "id", "left").join(episodes.select("id", F.lit(True).alias("__held")).dropDuplicates(["id"]), "id", "left")
    opened = cut(opened.withColumn("status", F.when(F.col("id").isNull(), "error").when(F.col("__held") | (F.col("__first") != F.col("o")), "skipped").otherwise("applied")))
    ep = lambda c: F.col(f"p.episode.`{c}`").alias(c.replace("-", "_"))
    new_episodes = opened.where("status = 'applied'").select(
        "id", ep("source-type"), ep("ref"), F.coalesce("p.episode.summary", "p.summary").alias("summary"), F.timestamp_millis(F.coalesce(F.col("p.episode.`opened-at`"), F.col("o.hlc"))).alias("opened_at"), F.lit(None).cast("timestamp").alias("closed_at"), ep("evidence")
    )
    since = episodes.select("id", F.lit(None).cast(order).alias("made")).dropDuplicates(["id"]).unionByName(opened.where("status = 'applied'").select("id", F.col("o").alias("made"))).withColumn("__there", F.lit(True))
    closed = of("close-episode").select("o", "p.id", "p.summary", "p.at").join(since, "id", "left")
    closed = cut(closed.withColumn("status", F.when(F.col("__there") & (F.col("made").isNull() | (F.col("made") < F.col("o"))), "applied").otherwise("skipped")))
    ending = closed.where("status = 'applied'").groupBy("id").agg(F.max_by(F.struct("summary", F.coalesce("at", F.col("o.hlc")).alias("at")), "o").alias("__e"))
    episodes_now = episodes.unionByName(new_episodes.select(*(c for c in episodes.columns if c in new_episodes.columns)), allowMissingColumns=True).join(ending, "id", "left")
    episodes_now = cut(episodes_now.withColumns({"summary": F.coalesce("__e.summary", "summary"), "closed_at": F.coalesce(F.timestamp_millis("__e.at"), "closed_at")}).select(*episodes.columns))
    registered = of("register-predicate").where("p.predicate.id IS NOT NULL").groupBy(F.col("p.predicate.id").alias("id")).agg(F.max_by("p.predicate", "o").alias("x"))
    registered = registered.select(*(F.col(f"x.`{n.name.replace('_', '-')}`").cast(n.dataType).alias(n.name) for n in predicates.schema))
    predicates_now = cut(predicates.join(registered.select("id"), "id", "left_anti").select(*predicates.columns).unionByName(registered))

    # the seams: what both stated is closed once
    touched = new.select("id").join(every.select("id", "subject_id"), "id").select("subject_id").dropDuplicates()
    twice = cut(conflicts.collapse_plan(every.join(touched, "subject_id", "left_semi"), now))
    shut = twice.select("id", F.lit(True).alias("__twice"))
    facts_now = every.join(shut, "id", "left").withColumns({"t_invalid": F.when(F.col("__twice"), now).otherwise(F.col("t_invalid")), "invalidation_reason": F.when(F.col("__twice"), F.lit("stated by two writers")).otherwise(F.col("invalidation_reason"))})

    row = lambda df: df.select("o", "status")
    told = [row(made), row(repoints), row(upon), row(changes), row(opened), row(closed), of("ensure-entity", "register-predicate", "repoint-predicate").select("o", F.lit("applied").alias("status"))]
    status = told[0]
    for t in told[1:]:
        status = status.unionByName(t)
    statuses = e.select("o", "t", "whole").join(status, "o", "left").select("o.writer", "o.seq", "t", F.when(~F.col("whole"), "error").when(F.col("status").isNull(), "unknown").otherwise(F.col("status")).alias("status"))
    marks = state.marks.unionByName(e.groupBy("o.writer").agg(F.max("o.seq").alias("high_water"))).groupBy("writer").agg(F.max("high_water").alias("high_water"))
    after = {"entities": entities_now, "facts": cut(facts_now.select(*facts.columns)), "episodes": episodes_now, "predicates": predicates_now, "links": cut(links)}
    return Reconciled(after, State(cut(marks), cut(known.select("foreign_id", "local_id"))), cut(statuses), twice)


def sweep_candidates(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """The pairs a judge should see after a reconciliation."""
    live = reads.hydrate(tables["facts"], tables["entities"]).where(valid_at(now))
    return conflicts.candidates(live, tables["predicates"], tables["links"])
