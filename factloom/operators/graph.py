"""Walking the graph that entity-valued facts form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import constants as K
from factloom.functions.exprs import effective_confidence, short_name, valid_at, walk_score
from factloom.plans.layout import cut

#: A frontier of at most so many counted entities is broadcast.
SMALL_FRONTIER = 100_000


def edges(facts: DataFrame) -> DataFrame:
    """Entity-valued facts as edges, once each: id, subject_id, predicate, object_ref."""
    return facts.where("object_kind = 'entity' AND subject_id IS NOT NULL AND object_ref IS NOT NULL").select("id", "subject_id", "predicate", "object_ref").dropDuplicates(["id"])


def neighborhood(facts: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Entities within ``depth`` steps of ``roots`` (column ``id``) in either direction, with the first level seen, and the edges walked.

    A level is one pair of semi-joins of the frontier with the edges; the frontier is broadcast while its counted size allows. Lineage is cut per level in
    the shared folder.
    """
    graph = edges(facts)
    seen = cut(roots.select(F.col("id").alias("entity_id")).dropDuplicates().withColumn("depth", F.lit(0)))
    frontier, walked = seen.select("entity_id"), None
    for level in range(1, depth + 1):
        n = frontier.count()
        if not n:
            break
        near = F.broadcast(frontier) if n <= SMALL_FRONTIER else frontier
        out = graph.join(near.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_semi").select(graph.columns)
        into = graph.join(near.withColumnRenamed("entity_id", "object_ref"), "object_ref", "left_semi").select(graph.columns)
        step = cut(out.unionByName(into).dropDuplicates(["id"]))
        walked = step if walked is None else walked.unionByName(step).dropDuplicates(["id"])
        ends = step.select(F.explode(F.array("subject_id", "object_ref")).alias("entity_id")).dropDuplicates()
        fresh = cut(ends.join(seen, "entity_id", "left_anti"))
        seen = cut(seen.unionByName(fresh.withColumn("depth", F.lit(level))))
        frontier = fresh
    return seen, walked if walked is not None else graph.limit(0)


def guided_walk(hydrated: DataFrame, roots: DataFrame, tokens: list[str], now: Column, *, budget: int = K.WALK_BUDGET, beam: int = K.WALK_BEAM, rounds: int = K.WALK_ROUNDS) -> DataFrame:
    """The ``budget`` best facts of a beam search from ``roots``: id, score. hydrated: facts with ``subject_name`` and ``object_name``.

    Each round scores the facts at the frontier that weren't collected yet and keeps ``beam`` of them; the entities at their ends are the next frontier.
    """
    spark = hydrated.sparkSession
    live = hydrated.where(valid_at(now)).dropDuplicates(["id"])
    words = F.array(*(F.lit(t.lower()) for t in tokens)) if tokens else F.array().cast("array<string>")
    text = F.concat_ws(" ", "subject_name", short_name(F.col("predicate")), "object_name")
    scored = live.select("id", "subject_id", "object_ref", walk_score(text, words, effective_confidence(now)).alias("score"))
    frontier = roots.select("id").dropDuplicates()
    got: list[tuple[str, float]] = []
    known: set[str] = set()
    for _ in range(rounds):
        hits = scored.join(frontier.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").select(scored.columns).unionByName(
            scored.join(frontier.select(F.col("id").alias("object_ref")), "object_ref", "left_semi").select(scored.columns)
        )
        new = hits.where(~F.col("id").isin(list(known))) if known else hits
        best = new.dropDuplicates(["id"]).orderBy(F.desc("score"), "id").limit(beam).collect()  # a beam, the feature's own limit
        if not best:
            break
        got += [(r.id, r.score) for r in best]
        known |= {r.id for r in best}
        if len(got) >= budget:
            break
        ends = sorted({e for r in best for e in (r.subject_id, r.object_ref) if e})
        frontier = spark.createDataFrame([(e,) for e in ends], "id string")
    got = sorted(got, key=lambda x: (-x[1], x[0]))[:budget]
    return spark.createDataFrame(got, "id string, score double")
