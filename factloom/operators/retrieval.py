"""Searching: text, entity and neighbourhood routes fused by reciprocal rank, and the tiers below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.functions import constants as K
from factloom.functions.exprs import effective_confidence, query_tokens, valid_at
from factloom.operators.reads import touching
from factloom.operators.resolve import resolve
from factloom.plans.layout import cut, global_rank


def tokens_of(spark, query: str) -> list[str]:
    """The tokens of one query, in order."""
    return spark.range(1).select(query_tokens(F.lit(query)).alias("t")).first().t


def text_hits(rows: DataFrame, columns: list[Column], terms: list[str]) -> DataFrame:
    """Rows any of whose columns contains a term, whatever the case: ``id`` and ``term``, the place of the first term found. One scan for all terms."""
    held = lambda t: F.coalesce(*(F.when(F.contains(F.lower(c), F.lit(t.lower())), True) for c in columns), F.lit(False))
    first = F.coalesce(*(F.when(held(t), F.lit(n)) for n, t in enumerate(terms)))
    return rows.select("id", first.alias("term")).where("term IS NOT NULL").groupBy("id").agg(F.min("term").alias("term"))


def find_entities(entities: DataFrame, terms: list[str], scope: str = K.DEFAULT_SCOPE) -> DataFrame:
    """Entities that the terms resolve to, in one scope: ``id``."""
    asked = entities.sparkSession.createDataFrame([(t, scope, None) for t in dict.fromkeys(terms)], "name string, scope string, type string")
    return resolve(asked, entities).where("entity_id IS NOT NULL").select(F.col("entity_id").alias("id")).dropDuplicates()


def search(query: str, facts: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Facts by fused rank: ``id``, ``score``. facts: distinct.

    Routes: literals that contain the query or a token of it (in order of the first that they contain, then id); facts that touch an entity a term names, by
    effective confidence; facts of those facts' other ends, likewise. A fact's score is the sum of weight / (60 + rank) over its routes times its
    effective confidence. Invalid facts take up ranks but aren't returned.
    """
    terms = list(dict.fromkeys([query, *tokens_of(facts.sparkSession, query)]))
    named = cut(find_entities(entities, terms))
    fresh = (-effective_confidence(now)).alias("key")
    near = touching(facts, named)
    ends = near.select(F.explode(F.array_compact(F.array("subject_id", "object_ref"))).alias("id")).dropDuplicates().join(named, "id", "left_anti")
    found = {
        "text": text_hits(facts, [F.col("object_lit")], terms).select("id", F.col("term").cast("double").alias("key")), "entity": near.select("id", fresh),
        "hop": touching(facts, cut(ends), "out").select("id", fresh),
    }
    routes = [rows.select(F.lit(n).alias("route"), "id", "key") for n, rows in enumerate(found.values())]
    # one order for all routes: a rank within a route is the rank in it less the routes before
    ranked = cut(global_rank(routes[0].unionByName(routes[1]).unionByName(routes[2]), "route", "key", "id").select("route", "id", "rank"))
    sizes = {r.route: r.n for r in ranked.groupBy("route").agg(F.count(F.lit(1)).alias("n")).collect()}
    term, before = F.lit(0.0), 0
    for n, name in enumerate(found):
        term = F.when(F.col("route") == n, K.ROUTE_WEIGHTS[name] / (K.RRF_K + F.col("rank") - before)).otherwise(term)
        before += sizes.get(n, 0)
    rrf = ranked.groupBy("id").agg(F.sum(term).alias("rrf"))
    return facts.where(valid_at(now)).join(rrf, "id").select("id", (F.col("rrf") * effective_confidence(now)).alias("score"))


def evidence_lines(documents: DataFrame, terms: list[str], *, id: str, text: str, most: int = K.EVIDENCE_LINES) -> DataFrame:
    """The first ``most`` lines of each document that contain a term, whatever the case: id, place, line."""
    held = lambda line: F.coalesce(*(F.when(F.contains(F.lower(line), F.lit(t.lower())), True) for t in terms), F.lit(False))
    lines = F.slice(F.filter(F.split(F.col(text), "\n"), held), 1, most)
    return documents.where(held(F.col(text))).select(F.col(id), F.posexplode(lines).alias("place", "line"))


def recall(query: str, facts: DataFrame, entities: DataFrame, episodes: DataFrame, now: Column, *, evidence: DataFrame | None = None, min_hits: int = 1) -> tuple[str, DataFrame]:
    """The cheapest tier that answers: ('facts' | 'episodes' | 'evidence' | 'nothing', its rows). evidence: sha256, content."""
    terms = list(dict.fromkeys([query, *tokens_of(facts.sparkSession, query)]))
    found = search(query, facts, entities, now)
    if found.limit(min_hits).count() >= min_hits:
        return "facts", found
    summaries = text_hits(episodes, [F.col("summary")], terms)
    enough = summaries.limit(min_hits).count()
    lines = None
    if enough < min_hits and evidence is not None and terms[1:]:
        lines = evidence_lines(episodes.join(evidence.select(F.col("sha256").alias("evidence"), "content"), "evidence"), terms[1:], id="id", text="content")
    if enough:
        return "episodes", summaries
    if lines is not None and not lines.isEmpty():
        return "evidence", lines
    return "nothing", found


def coach(found: DataFrame, facts: DataFrame, open_pairs: DataFrame, named: DataFrame, *, most: int = K.COACH_SECTION) -> DataFrame:
    """What a task should be told: rows (section, place, id) of commitments and failure modes found, and open conflicts they touch. No rows: nothing to push."""
    hits = found.join(facts.select("id", "epistemic", "predicate"), "id")
    by_score = W.partitionBy("section").orderBy(F.desc("score"), "id")
    sections = hits.where("epistemic = 'commitment'").select(F.lit("commitment").alias("section"), "id", "score").unionByName(hits.where("predicate = 'core/failure-mode'").select(F.lit("hazard").alias("section"), "id", "score"))
    ids = found.select("id")
    subjects = facts.join(named.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").select("id")
    either = ids.unionByName(subjects).dropDuplicates()
    touched = open_pairs.join(either.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").select("fact_id", "candidate_id").unionByName(
        open_pairs.join(either.select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi").select("fact_id", "candidate_id")
    )
    conflicts = touched.dropDuplicates().select(F.lit("conflict").alias("section"), F.concat_ws(" ", "fact_id", "candidate_id").alias("id"), F.lit(0.0).alias("score"))
    return sections.unionByName(conflicts).withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= most).select("section", "place", "id")
