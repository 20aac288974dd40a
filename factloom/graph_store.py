"""The engine's front: one object for a store of entities, facts, episodes and predicates, immutable like the tables it holds.

Methods that change the store return a new one; nothing is computed before a result is read or the store is saved. Every method takes the instant that
counts as now; there is no clock inside.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import constants as K
from factloom.functions.exprs import at, effective_confidence, norm_name, valid_at
from factloom.functions.registry import seed
from factloom.operators import conflicts, decide, graph, oplog, reads, reconcile, reports, resolve, retrieval
from factloom.operators.effects import EffectLog, effect, entity_effects, fact_effects, millis, predicate_effects
from factloom.plans.layout import cut, global_rank
from factloom.sources import ingest
from factloom.sources.tables import table

LINK = T.StructType([T.StructField("fact_id", T.StringType()), T.StructField("candidate_id", T.StringType())])
ENTITIES = "id string, name string, type string, scope string, aliases array<string>, norm_name string"
FACTS = (
    "id string, subject_id string, predicate string, object_kind string, object_ref string, object_lit string, t_valid timestamp, t_invalid timestamp, recorded_at timestamp, last_reinforced_at timestamp, "
    "confidence double, epistemic string, scope string, source_type string, episode string, invalidation_reason string"
)
EPISODES = "id string, source_type string, ref string, summary string, opened_at timestamp, closed_at timestamp, evidence string"
TABLES = ("entities", "facts", "episodes", "predicates", "links")


class StoreError(ValueError):
    """An error of the store's vocabulary: entity-not-found, ambiguous-entity, entity-exists, merge-self, fact-not-found, episode-not-found, store-not-empty …"""


@dataclass(frozen=True)
class KnowledgeGraph:
    spark: SparkSession
    entities: DataFrame
    facts: DataFrame
    episodes: DataFrame
    predicates: DataFrame
    links: DataFrame
    log: EffectLog | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> KnowledgeGraph:
        """The store in a folder of Parquet tables; without a table of links there are none."""
        tables = {n: table(spark, folder, n) for n in TABLES if n != "links"}
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/links.parquet")
        has = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return cls(spark, links=table(spark, folder, "links") if has else spark.createDataFrame([], LINK), **tables)

    @classmethod
    def init(cls, spark: SparkSession) -> KnowledgeGraph:
        """An empty store with the core predicates."""
        none = lambda ddl: spark.createDataFrame([], ddl)
        return cls(spark, none(ENTITIES), none(FACTS), none(EPISODES), seed(spark), none(LINK))

    def save(self, folder: str) -> None:
        """Write all tables to a new folder."""
        for n in TABLES:
            getattr(self, n).write.parquet(f"{folder}/{n}.parquet")

    def logged(self, writer: str | EffectLog) -> KnowledgeGraph:
        """The same store, which from now on keeps a log of what its methods change, as a writer of that name or from where a log ended."""
        return replace(self, log=writer if isinstance(writer, EffectLog) else EffectLog(self.spark, writer))

    def _changed(self, now: str | None, *effects: DataFrame, **tables: DataFrame) -> KnowledgeGraph:
        """A new store with the tables given, and the effects in its log where it keeps one."""
        new = replace(self, **tables)
        if self.log is None or not effects:
            return new
        ms = 0 if now is None else int(dt.datetime.fromisoformat(now).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
        every = effects[0]
        for e in effects[1:]:
            every = every.unionByName(e)
        return replace(new, log=self.log.append(every, ms))

    def _one(self, t: str, **payload: object) -> DataFrame:
        """One effect of plain values; snake-case names become kebab-case keys."""
        fields = [(F.lit(v) if not isinstance(v, Column) else v).alias(k.replace("_", "-")) for k, v in payload.items()]
        return effect(self.spark.range(1), t, F.struct(*fields))

    # reading

    def _entity(self, name: str, scope: str = K.DEFAULT_SCOPE) -> str:
        found = resolve.resolve(self.spark.createDataFrame([(name, scope, None)], "name string, scope string, type string"), self.entities).first()
        if found.via == "ambiguous":
            raise StoreError(f"ambiguous-entity: {name}")
        if found.entity_id is None:
            raise StoreError(f"entity-not-found: {name}")
        return found.entity_id

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def hydrated(self) -> DataFrame:
        return reads.hydrate(reads.distinct_facts(self.facts), self.entities)

    def facts_of(self, entity: str, now: str, *, entity_scope: str = K.DEFAULT_SCOPE, direction: str = "out", predicate: str | None = None, scope: str | None = None, include_invalidated: bool = False, min_confidence: float | None = None) -> DataFrame:
        """The facts of an entity, oldest first, with their effective confidence."""
        hit = reads.touching(reads.distinct_facts(self.facts), self._ids(self._entity(entity, entity_scope)), direction)
        kept = reads.filter_facts(hit, at(now), include_invalidated=include_invalidated, min_confidence=min_confidence, scope=scope, predicates=[predicate] if predicate else None)
        return reads.hydrate(kept, self.entities).withColumn("effective_confidence", effective_confidence(at(now))).orderBy("t_valid", "recorded_at", "id")

    def history(self, subject: str, predicate: str, scope: str = K.DEFAULT_SCOPE) -> DataFrame:
        """All versions of one attribute, invalidated ones too, oldest first."""
        mine = reads.distinct_facts(self.facts).where((F.col("subject_id") == self._entity(subject, scope)) & (F.col("predicate") == predicate))
        return reads.hydrate(mine, self.entities).orderBy("t_valid", "recorded_at", "id")

    def neighborhood(self, entity: str, now: str, depth: int = 1, scope: str = K.DEFAULT_SCOPE, predicate: str | None = None) -> tuple[DataFrame, DataFrame]:
        live = reads.filter_facts(reads.distinct_facts(self.facts), at(now), predicates=[predicate] if predicate else None)
        return graph.neighborhood(live, self._ids(self._entity(entity, scope)), depth)

    def guided_walk(self, entity: str, query: str, now: str, *, scope: str = K.DEFAULT_SCOPE, budget: int = K.WALK_BUDGET, beam: int = K.WALK_BEAM) -> DataFrame:
        return graph.guided_walk(self.hydrated(), self._ids(self._entity(entity, scope)), retrieval.tokens_of(self.spark, query), at(now), budget=budget, beam=beam)

    def search(self, query: str, now: str) -> DataFrame:
        return retrieval.search(query, reads.distinct_facts(self.facts), self.entities, at(now)).orderBy(F.desc("score"), "id")

    def recall(self, query: str, now: str, *, evidence: DataFrame | None = None, min_hits: int = 1) -> tuple[str, DataFrame]:
        return retrieval.recall(query, reads.distinct_facts(self.facts), self.entities, self.episodes, at(now), evidence=evidence, min_hits=min_hits)

    def coach(self, query: str, now: str) -> DataFrame:
        """What a task should be told; no rows means nothing is at stake."""
        named = retrieval.find_entities(self.entities, [query, *retrieval.tokens_of(self.spark, query)])
        return retrieval.coach(self.search(query, now), reads.distinct_facts(self.facts), self.open_conflicts(now), named)

    def stats(self) -> DataFrame:
        return reads.stats(self.entities, reads.distinct_facts(self.facts), self.episodes, self.predicates)

    def predicate_list(self, *, category: str | None = None, status: str | None = None) -> DataFrame:
        """The registry with usage, by id."""
        rows = self.predicates
        for column, value in (("category", category), ("status", status)):
            rows = rows.where(F.col(column) == value) if value else rows
        used = reads.predicate_usage(reads.distinct_facts(self.facts)).withColumnRenamed("predicate", "id")
        return rows.join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy("id")

    # writing

    def assert_batch(self, assertions: DataFrame, now: str, *, episode: str | None = None, prefix: str | None = None) -> tuple[KnowledgeGraph, DataFrame]:
        """Decide a batch (columns of the assertions table) against the facts that stand: the new store, and the decision on each row.

        New facts get ids of ``prefix``, by default the instant, and seq. The new store's tables are written to the shared folder.
        """
        live = reads.distinct_facts(self.facts)
        b = decide.assert_onto(self.hydrated(), self.entities, self.predicates, assertions, at(now), prefix or f"f-{now[:19].translate(str.maketrans('', '', '-: T'))}-")
        made = b.facts if episode is None else b.facts.withColumn("episode", F.coalesce("episode", F.lit(episode)))
        facts = live.join(b.closed, "id", "left").join(b.raised, "id", "left").withColumns({
            "t_invalid": F.coalesce("closed.effective_at", "t_invalid"), "confidence": F.coalesce("raised", "confidence"),
            "invalidation_reason": F.coalesce(F.concat(F.lit("superseded by "), F.col("closed.by")), "invalidation_reason"), "last_reinforced_at": F.when(F.col("raised").isNotNull(), at(now)).otherwise(F.col("last_reinforced_at")),
        })
        made = cut(made.select(self.facts.columns))
        new_predicates = cut(resolve.registrations(made, self.predicates))
        minted = cut(b.minted.select(*(c for c in b.minted.columns if c in self.entities.columns)))
        entities = cut(self.entities.unionByName(minted, allowMissingColumns=True))
        moment = F.unix_millis(at(now))
        effects = [] if self.log is None else [
            predicate_effects(new_predicates), entity_effects(minted), fact_effects(made, entities),
            effect(b.closed, "invalidate", F.struct(F.col("id").alias("fact-id"), millis("closed.effective_at").alias("at"), F.concat(F.lit("superseded by "), F.col("closed.by")).alias("reason"))),
            effect(b.raised, "reinforce", F.struct(F.col("id").alias("fact-id"), moment.alias("at"), F.col("raised").alias("confidence"))),
            effect(b.links, "link-conflicts", F.struct(F.col("fact_id").alias("fact-id"), F.array("candidate_id").alias("ids"))),
        ]
        return self._changed(
            now, *effects, facts=cut(facts.select(self.facts.columns).unionByName(made)), links=cut(self.links.unionByName(b.links).dropDuplicates()), predicates=cut(self.predicates.unionByName(new_predicates)), entities=entities
        ), b.decisions

    def invalidate(self, fact_id: str, when: str, reason: str = "invalidated") -> KnowledgeGraph:
        """Close a fact; equal to its start leaves an empty interval."""
        mine = self.facts.where(F.col("id") == fact_id).select("t_valid", (F.col("t_valid") <= at(when)).alias("ok")).first()
        if mine is None:
            raise StoreError(f"fact-not-found: {fact_id}")
        if not mine.ok:
            raise StoreError(f"invalid-interval: {fact_id}")
        hit = F.col("id") == fact_id
        done = self._one("invalidate", fact_id=fact_id, at=F.unix_millis(at(when)), reason=reason)
        return self._changed(when, done, facts=self.facts.withColumns({"t_invalid": F.when(hit, at(when)).otherwise(F.col("t_invalid")), "invalidation_reason": F.when(hit, F.lit(reason)).otherwise(F.col("invalidation_reason"))}))

    def open_episode(self, id: str, source_type: str, when: str, ref: str | None = None, evidence: str | None = None) -> KnowledgeGraph:
        row = self.spark.range(1).select(F.lit(id).alias("id"), F.lit(source_type).alias("source_type"), F.lit(ref).cast("string").alias("ref"), F.lit(None).cast("string").alias("summary"), at(when).alias("opened_at"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(evidence).cast("string").alias("evidence"))
        opened = effect(row, "open-episode", F.struct(F.struct("id", F.col("source_type").alias("source-type"), "ref", "summary", millis("opened_at").alias("opened-at"), "evidence").alias("episode")))
        return self._changed(when, opened, episodes=self.episodes.unionByName(row))

    def close_episode(self, id: str, when: str, summary: str = "") -> KnowledgeGraph:
        if self.episodes.where(F.col("id") == id).isEmpty():
            raise StoreError(f"episode-not-found: {id}")
        hit = F.col("id") == id
        closed = self._one("close-episode", id=id, summary=summary, at=F.unix_millis(at(when)))
        return self._changed(when, closed, episodes=self.episodes.withColumns({"closed_at": F.when(hit, at(when)).otherwise(F.col("closed_at")), "summary": F.when(hit, F.lit(summary)).otherwise(F.col("summary"))}))

    # entities and predicates

    def _renamed(self, id: str, name: Column, more_aliases: Column) -> DataFrame:
        hit = F.col("id") == id
        held = F.coalesce("aliases", F.array().cast("array<string>"))
        e = self.entities.withColumns({"aliases": F.when(hit, F.array_distinct(F.concat(held, more_aliases))).otherwise(F.col("aliases")), "name": F.when(hit, name).otherwise(F.col("name"))})
        return e.withColumn("norm_name", F.when(hit, norm_name(F.col("name"))).otherwise(F.col("norm_name"))) if "norm_name" in e.columns else e

    def _free(self, name: str, scope: str, but: str) -> None:
        hit = resolve.resolve(self.spark.createDataFrame([(name, scope, None)], "name string, scope string, type string"), self.entities).first()
        if hit.via == "ambiguous" or hit.entity_id not in (None, but):
            raise StoreError(f"entity-exists: {name}")

    def rename_entity(self, old: str, new: str, scope: str = K.DEFAULT_SCOPE) -> KnowledgeGraph:
        """Give an entity another name; the old one stays as an alias."""
        id = self._entity(old, scope)
        self._free(new, scope, id)
        return self._updated(id, self._renamed(id, F.lit(new), F.array("name")))

    def _updated(self, id: str, entities: DataFrame) -> KnowledgeGraph:
        new = effect(entities.where(F.col("id") == id), "update-entity", F.struct("id", F.struct("name", "aliases").alias("updates")))
        return self._changed(None, new, entities=entities)

    def alias_entity(self, name: str, alias: str, scope: str = K.DEFAULT_SCOPE) -> KnowledgeGraph:
        id = self._entity(name, scope)
        self._free(alias, scope, id)
        return self._updated(id, self._renamed(id, F.col("name"), F.array(F.lit(alias))))

    def merge_entities(self, old: str, into: str, now: str, scope: str = K.DEFAULT_SCOPE) -> KnowledgeGraph:
        """Point one entity's facts at another, keep its names as aliases, drop it, and close the facts that are then stated twice."""
        a, b = self._entity(old, scope), self._entity(into, scope)
        if a == b:
            raise StoreError(f"merge-self: {old}")
        gone = self.entities.where(F.col("id") == a).select(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).first().n
        moved = resolve.repoint(reads.distinct_facts(self.facts), self.spark.createDataFrame([(a, b)], "old string, new string"))
        about = moved.where((F.col("subject_id") == b) | (F.col("object_ref") == b))
        twice = cut(conflicts.collapse_plan(about, at(now)).select("id", F.lit(True).alias("__twice")))
        facts = moved.join(twice, "id", "left").withColumns({"t_invalid": F.when(F.col("__twice"), at(now)).otherwise(F.col("t_invalid")), "invalidation_reason": F.when(F.col("__twice"), F.lit("duplicate after merge")).otherwise(F.col("invalidation_reason"))})
        entities = cut(self._renamed(b, F.col("name"), F.array(*map(F.lit, gone))).where(F.col("id") != a))
        effects = [
            self._one("repoint-facts", **{"from": a, "to": b}), effect(entities.where(F.col("id") == b), "update-entity", F.struct("id", F.struct("name", "aliases").alias("updates"))),
            self._one("delete-entity", id=a), effect(twice, "invalidate", F.struct(F.col("id").alias("fact-id"), F.unix_millis(at(now)).alias("at"), F.lit("duplicate after merge").alias("reason"))),
        ]
        return self._changed(now, *effects, entities=entities, facts=cut(facts.select(self.facts.columns)))

    def split_entity(self, name: str, into: list[str], now: str, scope: str = K.DEFAULT_SCOPE) -> tuple[KnowledgeGraph, DataFrame]:
        """State that each of the new entities derives from the old one, whose own facts stay."""
        self._entity(name, scope)
        rows = [(i, n, "core/derived-from", name, "entity", scope) for i, n in enumerate(into)]
        batch = self.spark.createDataFrame(rows, "seq bigint, subject string, predicate string, object string, object_kind string, scope string")
        return self.assert_batch(batch, now)

    def duplicates(self) -> DataFrame:
        return resolve.duplicate_clusters(self.entities)

    def register_predicate(self, row: dict) -> KnowledgeGraph:
        """Add a predicate or replace the one of its id."""
        new = self.spark.createDataFrame([tuple(row.get(c) for c in self.predicates.columns)], self.predicates.schema)
        return self._changed(None, predicate_effects(new), predicates=self.predicates.where(F.col("id") != row["id"]).unionByName(new))

    def promote_predicate(self, old: str, new: str) -> KnowledgeGraph:
        """Make a predicate on trial a core one: clone it, move its facts, deprecate it with a pointer to its successor."""
        if not (old.startswith("x/") and new.startswith("core/")):
            raise StoreError(f"unknown-predicate: {old}")
        if self.predicates.where(F.col("id") == old).isEmpty():
            raise StoreError(f"unknown-predicate: {old}")
        hit = F.col("id") == old
        clone = self.predicates.where(hit).withColumns({"id": F.lit(new), "status": F.lit("active")})
        kept = self.predicates.where(F.col("id") != new).withColumns({"status": F.when(hit, "deprecated").otherwise(F.col("status")), "replaced_by": F.when(hit, F.lit(new)).otherwise(F.col("replaced_by"))})
        moved = self.facts.withColumn("predicate", F.when(F.col("predicate") == old, F.lit(new)).otherwise(F.col("predicate")))
        rows = kept.unionByName(clone)
        return self._changed(None, predicate_effects(rows.where(F.col("id").isin(old, new))), self._one("repoint-predicate", **{"from": old, "to": new}), predicates=rows, facts=moved)

    # conflicts and upkeep

    def open_conflicts(self, now: str) -> DataFrame:
        return conflicts.open_conflicts(self.facts, self.links, at(now))

    def conflict_candidates(self, now: str) -> DataFrame:
        return conflicts.candidates(self.hydrated().where(valid_at(at(now))), self.predicates, self.links)

    def resolve_conflicts(self, verdicts: DataFrame, now: str, gate: float = K.JUDGE_GATE) -> tuple[KnowledgeGraph, DataFrame]:
        """Carry out what verdicts (fact_id, candidate_id, relation, confidence) lead to: the new store, and the plan."""
        plan = cut(conflicts.resolution_plan(verdicts, gate))
        other = F.when(F.col("target_id") == F.col("fact_id"), F.concat(F.lit("duplicates "), "candidate_id")).otherwise(F.concat(F.lit("superseded by "), "fact_id"))
        closing = plan.where("target_id IS NOT NULL").select(F.col("target_id").alias("id"), other.alias("__why")).groupBy("id").agg(F.min("__why").alias("__why"))
        facts = self.facts.join(closing, "id", "left").withColumns({"t_invalid": F.when(F.col("__why").isNotNull(), at(now)).otherwise(F.col("t_invalid")), "invalidation_reason": F.coalesce("__why", "invalidation_reason")})
        apart = plan.where("action = 'unlink'")
        links = self.links.join(apart, ["fact_id", "candidate_id"], "left_anti")
        effects = [
            effect(closing, "invalidate", F.struct(F.col("id").alias("fact-id"), F.unix_millis(at(now)).alias("at"), F.col("__why").alias("reason"))),
            effect(apart, "unlink-conflicts", F.struct(F.col("fact_id").alias("fact-id"), F.array("candidate_id").alias("ids"))),
        ]
        return self._changed(now, *effects, facts=facts.select(self.facts.columns), links=links), plan

    def judge(self, verdict: Callable[[DataFrame], DataFrame], now: str) -> tuple[KnowledgeGraph, DataFrame]:
        """Have open conflicts judged by a function of pairs that adds relation and confidence."""
        return self.resolve_conflicts(verdict(self.open_conflicts(now)), now)

    def sweep(self, verdict: Callable[[DataFrame], DataFrame], now: str) -> tuple[KnowledgeGraph, DataFrame]:
        """Link the candidates that a function of pairs finds contradicting; returns the store and the verdicts."""
        judged = verdict(self.conflict_candidates(now))
        hits = judged.where("relation = 'contradicts'").select("fact_id", "candidate_id")
        linked = effect(hits, "link-conflicts", F.struct(F.col("fact_id").alias("fact-id"), F.array("candidate_id").alias("ids")))
        return self._changed(now, linked, links=self.links.unionByName(hits).dropDuplicates()), judged

    def outcome(self, retrievals: DataFrame, valence: str, now: str) -> KnowledgeGraph:
        """Under ``accepted``, the facts read since the last mark are reinforced at the confidence they have."""
        hit = oplog.outcome(self.facts, retrievals, valence, at(now)).select("id", F.lit(True).alias("__hit"))
        if valence != "accepted":
            return self
        facts = self.facts.join(hit, "id", "left").withColumn("last_reinforced_at", F.when(F.col("__hit"), at(now)).otherwise(F.col("last_reinforced_at")))
        again = effect(facts.where("__hit"), "reinforce", F.struct(F.col("id").alias("fact-id"), F.unix_millis(at(now)).alias("at"), "confidence"))
        return self._changed(now, again, facts=facts.select(self.facts.columns))

    def consolidate(self, now: str, summarize: Callable[[DataFrame], DataFrame] | None = None) -> KnowledgeGraph:
        """Close open episodes that facts came from, with a summary: of a function's making (id, summary) or the counted one."""
        due = reads.episode_plan(self.episodes, reads.distinct_facts(self.facts)).where("action = 'close'").select("id")
        made = reads.mechanical_summary(self.episodes, reads.distinct_facts(self.facts)).withColumnRenamed("episode", "id").withColumnRenamed("summary", "__s")
        if summarize is not None:
            own = summarize(due).select("id", F.nullif(F.substring("summary", 1, K.SUMMARY_CHARS), F.lit("")).alias("__own"))
            made = made.join(own, "id", "left").select("id", F.coalesce("__own", "__s").alias("__s"))
        done = cut(made.join(due, "id", "left_semi"))
        e = self.episodes.join(done, "id", "left").withColumns({"closed_at": F.when(F.col("__s").isNotNull(), at(now)).otherwise(F.col("closed_at")), "summary": F.coalesce("__s", "summary")})
        closed = effect(done, "close-episode", F.struct("id", F.col("__s").alias("summary"), F.unix_millis(at(now)).alias("at")))
        return self._changed(now, closed, episodes=e.select(self.episodes.columns))

    def enrich(self, aliases: Callable[[DataFrame], DataFrame], most: int = K.ENRICH_ENTITIES) -> tuple[KnowledgeGraph, DataFrame]:
        """Give the most used entities without aliases those that a function of (id, name) finds (id, aliases). A name that means another entity is left out.

        Returns the store and what was added: id, alias.
        """
        asked = reports.enrichment_candidates(self.entities, reads.entity_usage(reads.distinct_facts(self.facts)), most).select("id", "name")
        scopes = self.entities.select("id", "scope", F.col("type").alias("__type"))
        said = aliases(asked).select("id", F.explode("aliases").alias("alias")).where("trim(alias) <> ''").dropDuplicates().join(scopes, "id")
        taken = resolve.entity_names(self.entities).where("kind = 2").select("scope", "key", F.col("entity_id").alias("__other"))
        named = said.withColumn("key", norm_name(F.col("alias"))).join(taken, ["scope", "key"], "left")
        # new names nobody has, each given to one entity
        free = cut(named.where("__other IS NULL").groupBy("scope", "key").agg(F.min(F.struct("id", "alias")).alias("x")).select("x.*"))
        added = free.groupBy("id").agg(F.sort_array(F.collect_list("alias")).alias("__new"))
        none = F.array().cast("array<string>")
        e = self.entities.join(added, "id", "left").withColumn("aliases", F.when(F.col("__new").isNotNull(), F.array_distinct(F.concat(F.coalesce("aliases", none), "__new"))).otherwise(F.col("aliases")))
        updates = effect(e.where("__new IS NOT NULL"), "update-entity", F.struct("id", F.struct("name", "aliases").alias("updates")))
        return self._changed(None, updates, entities=cut(e.select(self.entities.columns))), free

    # ingestion: an episode around a batch, with the counts of what became of it

    def _take_in(self, rows: DataFrame, now: str, id: str, source_type: str, ref: str | None = None, evidence: str | None = None) -> tuple[KnowledgeGraph, dict[str, int]]:
        """Open an episode, assert (rows in the order of their ``seq``), close it with the counts: the store and the number of rows of every status."""
        g, decisions = self.open_episode(id, source_type, now, ref, evidence).assert_batch(rows, now, episode=id, prefix=f"{id}-")
        seen = {r.status: r.n for r in decisions.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {s: seen.get(s, 0) for s in ("insert", "reinforce", "supersede", "flag", "error")}
        return g.close_episode(id, now, ", ".join(f"{n} {s}" for s, n in counts.items() if n)), counts

    def ingest_code(self, files: DataFrame, now: str, id: str, *, path: str = "path", text: str = "content", scope: str = K.DEFAULT_SCOPE) -> tuple[KnowledgeGraph, dict[str, int]]:
        """Assert what source files say of their namespaces, and close the code facts they no longer yield (``stale`` in the counts)."""
        said = cut(ingest.code_facts(files, path=path, text=text, scope=scope).dropDuplicates(["subject", "predicate", "object"]))
        g, counts = self._take_in(global_rank(said, "subject", "predicate", "object").withColumnRenamed("rank", "seq"), now, id, "code")
        stale = cut(ingest.stale_facts(g.hydrated(), said, at(now), (scope, "external")).select("id", F.lit(True).alias("__stale")))
        counts["stale"] = stale.count()
        facts = g.facts.join(stale, "id", "left").withColumns({"t_invalid": F.when(F.col("__stale"), at(now)).otherwise(F.col("t_invalid")), "invalidation_reason": F.when(F.col("__stale"), F.lit("stale code edge")).otherwise(F.col("invalidation_reason"))})
        gone = effect(stale, "invalidate", F.struct(F.col("id").alias("fact-id"), F.unix_millis(at(now)).alias("at"), F.lit("stale code edge").alias("reason")))
        return g._changed(now, gone, facts=cut(facts.select(g.facts.columns))), counts

    def ingest_decisions(self, files: DataFrame, now: str, id: str, *, name: str = "name", text: str = "text") -> tuple[KnowledgeGraph, dict[str, int]]:
        """Assert what decision records state."""
        rows = ingest.decision_facts(ingest.decision_records(files, name=name, text=text))
        return self._take_in(global_rank(rows, "subject", "predicate", "object").withColumnRenamed("rank", "seq"), now, id, "decision-record")

    def ingest_texts(self, texts: DataFrame, extract: Callable[[DataFrame], DataFrame], now: str, id: str, *, kind: str = "session", ref: str | None = None) -> tuple[KnowledgeGraph, dict[str, int]]:
        """Have facts extracted from texts (id, text) by a function that gives replies (id, text), and assert those complete. kind: session, failure, notes or audit.

        ``candidates`` counts what the replies held, ``rejected`` what of it was incomplete.
        """
        read = ingest.transcript(texts, id="id", text="text").select("id", F.col("transcript").alias("text")) if kind == "session" else texts.select("id", "text")
        got = cut(ingest.prepare_candidates(ingest.json_lines(extract(read), id="id", text="text"), kind=kind))
        rows = global_rank(got.where("accepted").drop("accepted", "demoted"), "id", "place").withColumnRenamed("rank", "seq")
        g, counts = self._take_in(rows.drop("id", "place"), now, id, "session-log" if kind in ("session", "failure") else "agent-note", ref)
        n = got.count()
        return g, counts | {"candidates": n, "rejected": n - sum(counts.values())}

    def ingest_notes(self, files: DataFrame, extract: Callable[[DataFrame], DataFrame], now: str, id: str, *, harness: str, begin: str = "<!-- view:begin -->", end: str = "<!-- view:end -->") -> tuple[KnowledgeGraph, dict[str, int]]:
        """Have facts extracted from note files (path, content) that no earlier pass has seen as they are. Each leaves an episode whose ref names path and hash."""
        changed = cut(ingest.changed_notes(ingest.notes(files, begin=begin, end=end), ingest.seen_hashes(self.episodes, harness)))
        g, counts = self.ingest_texts(changed.select(F.col("path").alias("id"), F.col("content").alias("text")), extract, now, id, kind="notes")
        # ids are made of harness, path and hash
        marks = changed.select(F.concat(F.lit(f"{id}-"), F.substring(F.sha2(F.concat_ws("@", "path", "hash"), 256), 1, 12)).alias("id"), F.lit("agent-note").alias("source_type"), ingest.note_ref(harness).alias("ref"), F.lit("").alias("summary"), at(now).alias("opened_at"), at(now).alias("closed_at"), F.lit(None).cast("string").alias("evidence"))
        marks = cut(marks)
        opened = effect(marks, "open-episode", F.struct(F.struct("id", F.col("source_type").alias("source-type"), "ref", "summary", millis("opened_at").alias("opened-at"), "evidence").alias("episode")))
        return g._changed(now, opened, episodes=g.episodes.unionByName(marks.select(g.episodes.columns))), counts | {"changed": marks.count()}

    def session_end(
        self, now: str, *, notes: DataFrame, extract: Callable[[DataFrame], DataFrame], harness: str, id: str, last_consolidated: str | None, days: int = 7, summarize: Callable[[DataFrame], DataFrame] | None = None
    ) -> tuple[KnowledgeGraph, dict[str, object]]:
        """Take in changed notes, compile the view, and consolidate if the last time is ``days`` ago or never was. A stage that fails says so and stops no other.

        The report has ``status`` (ok or partial), per stage its result or ``error: …``, and ``consolidated_at`` to pass next time.
        """
        g, report = self, {"consolidated_at": last_consolidated}
        try:
            g, report["notes"] = g.ingest_notes(notes, extract, now, id, harness=harness)
        except Exception as e:  # noqa: BLE001
            report["notes"] = f"error: {e}"
        try:
            report["context"] = g.compile_context(now)
        except Exception as e:  # noqa: BLE001
            report["context"] = f"error: {e}"
        since = None if last_consolidated is None else dt.datetime.fromisoformat(now) - dt.datetime.fromisoformat(last_consolidated)
        if since is not None and since < dt.timedelta(days=days):
            report["consolidate"] = "skipped"
        else:
            try:
                g = g.consolidate(now, summarize)
                g.episodes.count()
                report |= {"consolidate": "done", "consolidated_at": now}
            except Exception as e:  # noqa: BLE001
                report["consolidate"] = f"error: {e}"
        report["status"] = "partial" if any(str(report[k]).startswith("error: ") for k in ("notes", "context", "consolidate")) else "ok"
        return g, report

    # other writers

    def reconcile(self, log: DataFrame, now: str, state: reconcile.State | None = None) -> tuple[KnowledgeGraph, reconcile.State, dict[str, int]]:
        """Apply other writers' effects that haven't been seen: the store, the state to pass next time, and counts.

        Nothing of it goes into this store's own log, and its own effects in ``log`` are passed over.
        """
        held = {n: getattr(self, n) for n in TABLES}
        got = reconcile.reconcile(held, log, state or reconcile.no_state(self.spark), at(now), self.log.writer if self.log else None)
        by = {r.status: r.n for r in got.effects.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        counts = {"total": sum(by.values()), **{s: by.get(s, 0) for s in ("applied", "skipped", "unknown", "error")}, "duplicates": got.duplicates.count(), "sweep_candidates": reconcile.sweep_candidates(got.tables, at(now)).count()}
        return replace(self, **got.tables), got.state, counts

    def compile_context(self, now: str, budget: int = K.CONTEXT_BUDGET) -> str:
        return reports.compile_context(reports.context_lines(self.hydrated(), self.open_conflicts(now), at(now)), f"## What is known (as of {now[:10]})", budget)

    # moving stores

    def dump(self) -> DataFrame:
        return ingest.dump(self.spark, {"predicate": self.predicates, "entity": self.entities, "episode": self.episodes, "fact": reads.distinct_facts(self.facts), "link": self.links})

    @classmethod
    def load(cls, spark: SparkSession, lines: DataFrame, like: KnowledgeGraph) -> KnowledgeGraph:
        """The store that a dump (column ``json``) holds, with the column types of another store."""
        kinds = {"entities": "entity", "facts": "fact", "episodes": "episode", "predicates": "predicate", "links": "link"}
        return cls(spark, **{t: ingest.load(lines, kind, getattr(like, t).schema) for t, kind in kinds.items()})

    def restore(self, lines: DataFrame) -> KnowledgeGraph:
        """This store, which must be empty but for predicates, with a dump's rows. Entities get ids of scope and name; those of one name become one."""
        if not all(getattr(self, t).isEmpty() for t in ("entities", "facts", "episodes")):
            raise StoreError("store-not-empty")
        got = KnowledgeGraph.load(self.spark, lines, self)
        entities, facts = ingest.remint(got.entities, got.facts)
        registry = self.predicates.join(got.predicates.select("id"), "id", "left_anti").select(self.predicates.columns).unionByName(got.predicates)
        return replace(got, entities=cut(entities), facts=cut(facts), episodes=cut(got.episodes), predicates=cut(registry), links=cut(got.links), log=self.log)
