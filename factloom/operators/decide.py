"""Deciding assertions one by one, in order, per subject: reinforce, supersede, flag or insert.

A decision reads only the facts of its subject under the same predicate and those its exclusion group names, so (subject, group) is the
parallel key. Within a key, rows stream in order past a state that holds live facts and, of dead ones, the objects only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import constants as K
from factloom.functions.exprs import keyword, norm_name
from factloom.plans.shipping import ship


@dataclass(slots=True)
class Fact:
    id: str
    predicate: str
    object: tuple
    loose: str
    t_valid: int
    t_invalid: int | None
    confidence: float
    epistemic: str
    source: str


@dataclass(slots=True)
class Decision:
    action: str
    targets: list[str] = field(default_factory=list)
    effective_at: int | None = None
    reason: str | None = None
    confidence: float | None = None


def _trust(source: str) -> int:
    return K.TRUST.get(source, K.TRUST_UNKNOWN)


class Subject:
    """The facts of one subject that decisions on one group of predicates can see."""

    def __init__(self, now: int, single: set[str], mates: dict[str, set[str]]):
        self.now, self.single, self.mates = now, single, mates
        self.live: dict[str, dict[tuple, Fact]] = {}
        self.dead: dict[str, set[tuple]] = {}

    def _alive(self, f: Fact) -> bool:
        return f.t_valid <= self.now and (f.t_invalid is None or f.t_invalid > self.now)

    def _add(self, f: Fact) -> None:
        if self._alive(f):
            self.live.setdefault(f.predicate, {})[f.object] = f
        else:
            self.dead.setdefault(f.predicate, set()).add(f.object)

    def hold(self, f: Fact) -> None:
        """A fact that stands already; of two live ones with one object the first is kept in view."""
        if not (self._alive(f) and f.object in self.live.get(f.predicate, {})):
            self._add(f)

    def _close(self, f: Fact, at: int) -> None:
        f.t_invalid = at
        if not self._alive(f):
            del self.live[f.predicate][f.object]
            self.dead.setdefault(f.predicate, set()).add(f.object)

    def decide(self, new: Fact, override: str | None) -> Decision:
        """What becomes of ``new``; the state changes accordingly."""
        peers = self.live.get(new.predicate, {})
        if (old := peers.get(new.object)) is not None:
            top = K.CEILING.get(old.source, K.CEILING_UNKNOWN)
            old.confidence = max(old.confidence, min(top, new.confidence))
            return Decision("reinforce", [old.id], confidence=old.confidence)
        against = list(peers.values()) if new.predicate in self.single else []
        for mate in sorted(self.mates.get(new.predicate, ())):
            against += [f for f in self.live.get(mate, {}).values() if f.loose and f.loose == new.loose]
        rivals = list(peers.values())
        if against:
            committed = new.epistemic == "commitment" or any(f.epistemic == "commitment" for f in against)
            policy = override or ("flag" if committed else "supersede")
            reason = None
            if policy == "supersede":
                if any(f.t_valid > new.t_valid for f in against):
                    policy, reason = "flag", "backdated-overlap"
                elif any(_trust(f.source) > _trust(new.source) for f in against):
                    policy, reason = "flag", "outranked"
            ids = sorted(f.id for f in against)
            if policy == "supersede":
                for f in against:
                    self._close(f, new.t_valid)
                self._add(new)
                return Decision("supersede", ids, new.t_valid)
            self._add(new)
            return Decision("flag", ids, reason=reason) if policy == "flag" else Decision("insert")
        back = _trust(new.source) < K.TRUST_FULL and rivals and new.object in self.dead.get(new.predicate, ())
        self._add(new)
        if back and override not in ("ignore", "supersede"):
            return Decision("flag", sorted(f.id for f in rivals), reason="revenant")
        return Decision("insert")


COLUMNS = ("held_id", "seq", "predicate", "object_kind", "object_key", "loose", "t_valid", "t_invalid", "confidence", "epistemic", "source_type", "on_conflict")

#: Columns of an assertion that may be missing, and their types.
OPTIONAL = {
    "subject_type": "string", "object_type": "string", "object_kind": "string", "epistemic": "string", "scope": "string", "confidence": "double", "source_type": "string",
    "on_conflict": "string", "t_valid": "timestamp", "t_invalid": "timestamp", "episode": "string",
}


def prepare(assertions: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Assertions with defaults filled in and names brought to keys, each with an ``error`` that is null where it may be decided.

    Errors: missing-subject, missing-predicate, missing-object, unknown-predicate, deprecated-predicate, object-kind-mismatch, invalid-epistemic,
    invalid-interval. Predicates that name none of the registry but ``x/…`` register themselves. Optional columns may be missing.
    """
    assertions = assertions.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in assertions.columns})
    typed = F.regexp_replace(F.regexp_replace(F.lower(keyword(F.col("predicate"))), r"\s*/\s*", "/"), r"[\s_]+", "-")
    full = F.when(F.contains(typed, F.lit("/")), typed).otherwise(F.concat(F.lit("core/"), typed))
    rows = registry.select(F.col("id").alias("predicate"), F.col("object_kind").alias("__kind"), "status", "default_epistemic", "exclusion_group")
    a = assertions.withColumn("predicate", full).join(rows, "predicate", "left")
    kind = F.when(F.col("__kind").isin("entity", "literal"), F.col("__kind")).otherwise(F.coalesce("object_kind", F.lit("literal")))
    epistemic = F.coalesce("epistemic", "default_epistemic", F.lit("observation"))
    start = F.coalesce("t_valid", now)
    error = (
        F.when(F.col("subject").isNull(), "missing-subject").when(F.col("predicate").isNull(), "missing-predicate").when(F.col("object").isNull(), "missing-object")
        .when(F.col("status") == "deprecated", "deprecated-predicate").when(F.col("status").isNull() & ~F.col("predicate").startswith("x/"), "unknown-predicate")
        .when(F.col("object_kind").isNotNull() & (F.col("object_kind") != kind), "object-kind-mismatch").when(~epistemic.isin(*K.EPISTEMIC), "invalid-epistemic")
        .when(F.col("t_invalid") <= start, "invalid-interval")
    )
    return a.select(
        "seq", "subject", "subject_type", "object", "object_type", "episode", norm_name(F.col("subject")).alias("subject_key"), "predicate", F.coalesce("exclusion_group", "predicate").alias("group"), kind.alias("object_kind"),
        F.when(kind == "entity", norm_name(F.col("object"))).otherwise(F.col("object")).alias("object_key"), norm_name(F.col("object")).alias("loose"),
        start.alias("t_valid"), "t_invalid", F.coalesce("confidence", F.lit(K.DEFAULT_CONFIDENCE)).alias("confidence"), epistemic.alias("epistemic"),
        F.coalesce("scope", F.lit(K.DEFAULT_SCOPE)).alias("scope"), F.coalesce("source_type", F.lit(K.DEFAULT_SOURCE)).alias("source_type"), "on_conflict", error.alias("error"),
    )


SCHEMA = "seq bigint, status string, fact_id string, targets array<string>, effective_at bigint, reason string, confidence double"


def predicate_rules(registry: DataFrame) -> tuple[set[str], dict[str, set[str]]]:
    """The single-valued predicates, and for each predicate those it excludes. The registry is a small fixed table."""
    table = registry.select("id", "cardinality", "exclusion_group").collect()
    group = {r.id: r.exclusion_group for r in table if r.exclusion_group}
    return {r.id for r in table if r.cardinality == "one"}, {p: {q for q, h in group.items() if h == g and q != p} for p, g in group.items()}


def _fold(rows: DataFrame, registry: DataFrame, now: Column, prefix: str) -> DataFrame:
    """The decisions on rows (subject_key, group, COLUMNS), in order of seq per key; rows with a held_id are facts that stand already."""
    single, mates = predicate_rules(registry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, subject = None, None
        for batch in batches:
            out = []
            for s, g, now_, held, seq, predicate, kind, obj, loose, start, end, confidence, epistemic, source, override in zip(*(batch.column(c).to_pylist() for c in ("subject_key", "group", "__now", *COLUMNS)), strict=True):
                if (s, g) != key:
                    key, subject = (s, g), Subject(now_, single, mates)
                fact = Fact(held or f"{prefix}{seq}", predicate, (kind, obj), loose, start, end, confidence, epistemic, source)
                if held is not None:
                    subject.hold(fact)
                    continue
                d = subject.decide(fact, override)
                again = d.action == "reinforce"
                out.append((seq, d.action, d.targets[0] if again else fact.id, [] if again else d.targets, d.effective_at, d.reason, d.confidence))
            if out:
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["seq", "status", "fact_id", "targets", "effective_at", "reason", "confidence"])

    timed = rows.withColumns({"t_valid": F.unix_micros("t_valid"), "t_invalid": F.unix_micros("t_invalid"), "__now": F.unix_micros(now), "__new": F.col("held_id").isNull()})
    ship(rows.sparkSession)
    ordered = timed.repartition("subject_key", "group").sortWithinPartitions("subject_key", "group", "__new", "seq").select("subject_key", "group", "__now", *COLUMNS)
    return ordered.mapInArrow(run, SCHEMA).withColumn("effective_at", F.timestamp_micros("effective_at"))


def _failed(rows: DataFrame) -> DataFrame:
    none = F.lit(None)
    return rows.where("error IS NOT NULL").select("seq", F.lit("error").alias("status"), none.cast("string").alias("fact_id"), F.array().cast("array<string>").alias("targets"), none.cast("timestamp").alias("effective_at"), F.col("error").alias("reason"), none.cast("double").alias("confidence"))


def assert_batch(assertions: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """The decision on every assertion (unique ``seq``), in order of seq: ``seq``, ``status``, ``fact_id``, ``targets``, ``effective_at``, ``reason``, ``confidence``.

    Liveness is taken at ``now``. A row with an error has status ``error`` and its reason, and doesn't stop others. The new fact of a row is ``f-<seq>``.
    Subjects and entity objects are told apart by normalised name.

    A key is decided in sequence, that is its nature; its rows stream, and what a task holds is the key's distinct live objects.
    """
    rows = prepare(assertions, registry, now)
    good = rows.where("error IS NULL").withColumn("held_id", F.lit(None).cast("string"))
    return _fold(good, registry, now, "f-").unionByName(_failed(rows))


@dataclass(slots=True)
class Batch:
    """What a batch changes: decisions per row, facts and links to add, facts to close (id, at, by) and to raise (id, raised), entities to mint."""

    decisions: DataFrame
    facts: DataFrame
    links: DataFrame
    closed: DataFrame
    raised: DataFrame
    minted: DataFrame


def _minted_id(name: str) -> Column:
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat_ws("\0", F.lit(K.DEFAULT_SCOPE), norm_name(F.col(name))), 256), 1, 12))


def assert_onto(held: DataFrame, entities: DataFrame, registry: DataFrame, assertions: DataFrame, now: Column, prefix: str) -> Batch:
    """Decide a batch against the facts that stand. held: facts with ``object_name``. New facts are ``<prefix><seq>``.

    Names are resolved first, in one pass; unresolved ones mint an entity for each normalised name. A name that fits several entities is an error of its row,
    ``ambiguous-entity``. Of the facts held only those of the batch's subjects are read.
    """
    from factloom.operators.resolve import ensure, resolve
    from factloom.plans.layout import cut

    rows = prepare(assertions, registry, now)
    scope = F.lit(K.DEFAULT_SCOPE).alias("scope")
    named = rows.where("error IS NULL")
    mentions = named.select((F.col("seq") * 2).alias("seq"), F.col("subject").alias("name"), scope, F.col("subject_type").alias("type")).unionByName(
        named.where("object_kind = 'entity'").select((F.col("seq") * 2 + 1).alias("seq"), F.col("object").alias("name"), scope, F.col("object_type").alias("type"))
    )
    found = cut(resolve(mentions, entities))
    minted, _ = ensure(mentions, entities)

    def side(name: str) -> DataFrame:
        return found.select(F.col("name").alias(f"__{name}"), F.col("type").alias(f"__{name}_type"), F.col("entity_id").alias(f"__{name}_id"), F.col("via").alias(f"__{name}_via"))

    for name in ("subject", "object"):
        rows = rows.join(side(name), F.col(name).eqNullSafe(F.col(f"__{name}")) & F.col(f"{name}_type").eqNullSafe(F.col(f"__{name}_type")), "left")
    entity = F.col("object_kind") == "entity"
    unclear = (F.col("__subject_via") == "ambiguous") | (entity & (F.col("__object_via") == "ambiguous"))
    rows = rows.withColumns({
        "error": F.coalesce("error", F.when(unclear, "ambiguous-entity")), "subject_key": F.coalesce("__subject_id", _minted_id("subject")),
        "object_key": F.when(entity, F.coalesce("__object_id", _minted_id("object"))).otherwise(F.col("object")), "held_id": F.lit(None).cast("string"),
    })
    rows = cut(rows)
    groups = registry.select(F.col("id").alias("predicate"), F.coalesce("exclusion_group", "id").alias("group"))
    good = rows.where("error IS NULL")
    stand = held.join(good.select(F.col("subject_key").alias("subject_id")).dropDuplicates(), "subject_id", "left_semi").join(groups, "predicate", "left").select(
        F.col("subject_id").alias("subject_key"), F.coalesce("group", "predicate").alias("group"), F.col("id").alias("held_id"), F.unix_micros(F.coalesce("recorded_at", "t_valid", now)).alias("seq"), "predicate", "object_kind",
        F.when(entity, F.col("object_ref")).otherwise(F.col("object_lit")).alias("object_key"), norm_name(F.col("object_name")).alias("loose"), "t_valid", "t_invalid", F.coalesce("confidence", F.lit(K.DEFAULT_CONFIDENCE)).alias("confidence"),
        "epistemic", "source_type", F.lit(None).cast("string").alias("on_conflict"),
    ).where("t_valid IS NOT NULL")
    need = ["subject_key", "group", *COLUMNS]
    done = cut(_fold(good.select(need).unionByName(stand.select(need)), registry, now, prefix).unionByName(_failed(rows)))
    made = done.where("status IN ('insert', 'supersede', 'flag')")
    closing = made.where("status = 'supersede'").select(F.explode("targets").alias("id"), "effective_at", F.col("fact_id").alias("by"))
    closed = cut(closing.groupBy("id").agg(F.min(F.struct("effective_at", "by")).alias("closed")))
    raised = cut(done.where("status = 'reinforce'").groupBy(F.col("fact_id").alias("id")).agg(F.max("confidence").alias("raised")))
    facts = good.join(made.select("seq", F.col("fact_id").alias("id")), "seq").join(closed, "id", "left").join(raised, "id", "left").select(
        "id", F.col("subject_key").alias("subject_id"), "predicate", "object_kind", F.when(entity, F.col("object_key")).alias("object_ref"), F.when(~entity, F.col("object")).alias("object_lit"), "t_valid",
        F.coalesce("closed.effective_at", "t_invalid").alias("t_invalid"), now.alias("recorded_at"), now.alias("last_reinforced_at"), F.coalesce("raised", "confidence").alias("confidence"), "epistemic", "scope", "source_type", "episode",
        F.concat(F.lit("superseded by "), F.col("closed.by")).alias("invalidation_reason"),
    )
    links = made.where("status = 'flag'").select("fact_id", F.explode("targets").alias("candidate_id"))
    return Batch(done, facts, links, closed, raised, minted)
