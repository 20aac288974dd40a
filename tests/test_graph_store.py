"""A project's history told in batches, and what the store must then answer."""

import pytest
from pyspark.sql import functions as F

from factloom.graph_store import KnowledgeGraph, StoreError
from tests.test_decide import ASSERTIONS, assertion, when

NOW = "2026-07-01 00:00:00"


def objects(df):
    return sorted(r.object_name for r in df.collect())


@pytest.fixture(scope="module")
def kg(spark):
    g = KnowledgeGraph.init(spark).open_episode("ep-1", "session-log", "2026-01-02 00:00:00", "sess-1").open_episode("ep-2", "session-log", "2026-03-01 00:00:00")
    first = [
        assertion(1, "shoply", "has-version", "0.1.0", t_valid=when(4)), assertion(2, "shoply", "decided-against", "GraphQL", object_kind="literal", epistemic="commitment", source_type="session-log", confidence=0.7),
        assertion(3, "shoply.api", "depends-on", "shoply.db"), assertion(4, "shoply.auth", "prefers", "argon2 for hashing", object_kind="literal", source_type="session-log", confidence=0.6),
        assertion(5, "shoply", "deployed-via", "Heroku", object_kind="literal", t_valid=when(4)), assertion(6, "shoply.cache", "depends-on", "shoply.db"),
    ]
    g, d1 = g.assert_batch(spark.createDataFrame(first, ASSERTIONS), "2026-01-10 00:00:00", episode="ep-1", prefix="a-")
    second = [
        assertion(1, "shoply", "has-version", "0.2.0", t_valid=when(68)), assertion(2, "shoply", "deployed-via", "Fly.io", object_kind="literal", t_valid=when(68)),
        assertion(3, "shoply", "prefers", "graph-ql", object_kind="literal", source_type="session-log", t_valid=when(80)), assertion(4, "SHOPLY.API", "depends-on", "shoply-db", t_valid=when(80)),
    ]
    g, d2 = g.assert_batch(spark.createDataFrame(second, ASSERTIONS), "2026-03-25 00:00:00", prefix="b-")
    assert [r.status for r in d1.orderBy("seq").collect()] == ["insert"] * 6
    assert [(r.status, r.targets) for r in d2.orderBy("seq").collect()] == [("supersede", ["a-1"]), ("insert", []), ("flag", ["a-2"]), ("reinforce", [])]
    return g.invalidate(next(r.id for r in g.facts.where("object_lit = 'Heroku'").collect()), "2026-03-10 00:00:00", "moved")


def test_reads_as_of(kg):
    ask = lambda now, p: objects(kg.facts_of("shoply", now, predicate=p))
    assert ask("2025-12-01 00:00:00", "core/has-version") == []
    assert ask("2026-02-01 00:00:00", "core/has-version") == ["0.1.0"] and ask(NOW, "core/has-version") == ["0.2.0"]
    assert ask("2026-02-01 00:00:00", "core/deployed-via") == ["Heroku"] and ask(NOW, "core/deployed-via") == ["Fly.io"]
    h = kg.history("shoply", "core/has-version").collect()
    assert [(r.object_name, r.invalidation_reason) for r in h] == [("0.1.0", "superseded by b-1"), ("0.2.0", None)]
    assert kg.facts_of("Shoply.API", NOW).count() == 1
    assert {r.subject_name for r in kg.facts_of("shoply.db", NOW, direction="in").collect()} == {"shoply.api", "shoply.cache"}
    with pytest.raises(StoreError, match="entity-not-found"):
        kg.facts_of("shoply.ap", NOW)


def test_conflicts_and_judging(kg, spark):
    pairs = {tuple(r) for r in kg.open_conflicts(NOW).collect()}
    assert pairs == {("b-3", "a-2")}
    say = lambda rel, conf=0.9: lambda df: df.withColumns({"relation": F.lit(rel), "confidence": F.lit(conf)})
    assert kg.judge(say("contradicts"), NOW)[0].open_conflicts(NOW).count() == 1
    assert kg.judge(say("supersedes", 0.5), NOW)[0].open_conflicts(NOW).count() == 1
    after, plan = kg.judge(say("supersedes"), NOW)
    assert after.open_conflicts(NOW).count() == 0 and plan.first().target_id == "a-2"
    assert after.facts.where("id = 'a-2'").first().t_invalid is not None
    assert kg.judge(say("compatible"), NOW)[0].links.count() == 0
    swept, judged = kg.sweep(say("contradicts"), NOW)
    assert judged.where("reason IS NOT NULL").count() == swept.links.count() - 1


def test_graph_and_search(kg):
    nodes, edges = kg.neighborhood("shoply.db", NOW, 2)
    assert nodes.count() == 3 and edges.count() == 2
    assert kg.neighborhood("shoply", NOW, 3)[0].count() == 1
    found = [r.id for r in kg.search("shoply.auth argon2", NOW).collect()]
    assert found[0] == "a-4"
    assert kg.search("postgres", NOW).count() == 0
    assert kg.recall("postgres", NOW)[0] == "nothing" and kg.recall("argon2", NOW)[0] == "facts"
    done = kg.consolidate(NOW)
    assert done.recall("sess-1", NOW)[0] == "episodes"
    walk = kg.guided_walk("shoply.api", "cache db", NOW, budget=3, beam=1).collect()
    assert 1 <= len(walk) <= 3
    told = {r.section for r in kg.coach("shoply GraphQL", NOW).collect()}
    assert told == {"commitment", "conflict"} and kg.coach("nothing here", NOW).count() == 0


def test_curation(kg):
    merged = kg.merge_entities("shoply.cache", "shoply.api", NOW)
    assert objects(merged.facts_of("shoply.cache", NOW)) == ["shoply.db"]
    assert merged.facts.where("invalidation_reason = 'duplicate after merge'").count() == 1 and merged.entities.count() == kg.entities.count() - 1
    with pytest.raises(StoreError, match="merge-self"):
        kg.merge_entities("shoply.api", "shoply-api", NOW)
    with pytest.raises(StoreError, match="entity-exists"):
        kg.rename_entity("shoply.api", "shoply.db")
    assert kg.rename_entity("shoply.api", "gateway").facts_of("shoply.api", NOW).first().subject_name == "gateway"
    assert kg.alias_entity("shoply.api", "edge").facts_of("edge", NOW).count() == 1
    split, d = kg.split_entity("shoply.api", ["shoply.read", "shoply.write"], NOW)
    assert d.count() == 2 and objects(split.facts_of("shoply.read", "2026-07-02 00:00:00")) == ["shoply.api"]
    with pytest.raises(StoreError, match="fact-not-found"):
        kg.invalidate("nope", NOW)
    with pytest.raises(StoreError, match="invalid-interval"):
        kg.invalidate("b-1", "2020-01-01 00:00:00")
    with pytest.raises(StoreError, match="episode-not-found"):
        kg.close_episode("nope", NOW)


def test_registry(kg):
    assert kg.predicates.count() == 23 and {r.id for r in kg.predicates.where("cardinality = 'one'").collect()} == {"core/defined-in", "core/has-version", "core/has-status"}
    g = kg.register_predicate({"id": "x/owned-by", "label": "owned by", "object_kind": "either", "cardinality": "many", "status": "testing"}).promote_predicate("x/owned-by", "core/owned-by")
    rows = {r.id: (r.status, r.replaced_by, r.n) for r in g.predicate_list().collect()}
    assert rows["x/owned-by"] == ("deprecated", "core/owned-by", 0) and rows["core/owned-by"][0] == "active" and rows["core/has-version"][2] == 2
    with pytest.raises(StoreError):
        kg.promote_predicate("core/has-version", "core/other")


def test_episodes_context_and_round_trip(kg, spark, tmp_path):
    done = kg.consolidate(NOW)
    ep = {r.id: (r.summary, r.closed_at is not None) for r in done.episodes.collect()}
    assert ep["ep-2"] == (None, False) and ep["ep-1"][1]
    assert ep["ep-1"][0].startswith("session-log episode (sess-1): 6 facts — 2 core/depends-on, 1 core/decided-against")
    text = kg.compile_context(NOW)
    assert '- shoply decided-against "GraphQL" (since 2026-01-03)' in text and "### Statements at odds" in text and len(text.encode()) <= 25_000
    lines = done.dump()
    back = KnowledgeGraph.load(spark, lines, done)
    for n in ("entities", "episodes", "predicates", "links"):
        assert sorted(map(str, getattr(back, n).collect())) == sorted(map(str, getattr(done, n).collect()))
    assert {(r.id, r.object_lit, r.t_invalid) for r in back.facts.collect()} == {(r.id, r.object_lit, r.t_invalid) for r in done.facts.collect()}
    done.save(str(tmp_path / "kg"))
    again = KnowledgeGraph.open(spark, str(tmp_path / "kg"))
    assert {r.measure: r.n for r in again.stats().collect()} == {r.measure: r.n for r in done.stats().collect()}
