"""Two writers who know nothing of each other, and what their stores hold once each has the other's log."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.graph_store import KnowledgeGraph, StoreError
from factloom.operators import oplog
from factloom.operators.effects import EFFECTS, EffectLog, read_logs
from tests.test_decide import ASSERTIONS, assertion

NOW = "2026-07-01 00:00:00"


def triples(g):
    h = g.hydrated().collect()
    return {(r.id, r.predicate, r.object_name, r.t_invalid is None) for r in h}


@pytest.fixture(scope="module")
def writers(spark):
    a, b = KnowledgeGraph.init(spark).logged("w-a"), KnowledgeGraph.init(spark).logged("w-b")
    a, _ = a.assert_batch(spark.createDataFrame([assertion(1, "api-layer", "decided-against", "GraphQL", object_kind="literal", epistemic="commitment", source_type="decision-record"), assertion(2, "AuthService", "prefers", "argon2", object_kind="literal")], ASSERTIONS), "2026-01-10 00:00:00", prefix="a-")
    b, _ = b.assert_batch(spark.createDataFrame([assertion(1, "auth-service", "prefers", "argon2", object_kind="literal"), assertion(2, "api-layer", "prefers", "GraphQL", object_kind="literal"), assertion(3, "billing", "depends-on", "stripe")], ASSERTIONS), "2026-01-11 00:00:00", prefix="b-")
    return a, b


def test_two_writers_converge(spark, writers, tmp_path):
    a, b = writers
    for g in writers:
        g.log.save(str(tmp_path / "logs"))
    (tmp_path / "logs/writer=w-b/zz.txt").write_text('{"writer": "w-b", "seq"')  # cut off
    logs = read_logs(spark, str(tmp_path / "logs"))
    assert logs.count() == a.log.seq + b.log.seq and EffectLog.resume(spark, "w-b", logs).seq == b.log.seq
    a2, state, counts = a.reconcile(logs, NOW)
    assert counts["applied"] == counts["total"] > 0 and counts["error"] == counts["unknown"] == 0
    assert a2.facts_of("billing", NOW).count() == 1
    argon = [r for r in a2.facts_of("AuthService", NOW, include_invalidated=True).collect() if r.object_lit == "argon2"]
    assert len(argon) == 2 and sum(r.t_invalid is None for r in argon) == 1 and counts["duplicates"] == 1
    assert counts["sweep_candidates"] > 0
    again, _, second = a2.reconcile(logs, NOW, state)
    assert second["total"] == second["duplicates"] == 0 and triples(again) == triples(a2)
    b2, _, back = b.reconcile(logs, NOW)
    assert back["error"] == 0 and triples(b2) == triples(a2)
    assert b2.facts_of("AuthService", NOW).first().subject_name == "auth-service"
    assert a2.log.seq == a.log.seq  # what comes from others isn't logged as one's own


def test_every_mutation_is_logged_and_replays(spark, writers):
    a, _ = writers
    g = a.open_episode("ep-1", "session-log", "2026-02-01 00:00:00").close_episode("ep-1", "2026-02-02 00:00:00", "done")
    g, _ = g.assert_batch(spark.createDataFrame([assertion(1, "shoply", "has-version", "1"), assertion(2, "Shoply2", "has-version", "2"), assertion(3, "shoply", "x/likes", "tea", object_kind="literal"), assertion(4, "api-layer", "prefers", "graphql", object_kind="literal")], ASSERTIONS), "2026-03-01 00:00:00", prefix="c-")
    g, _ = g.assert_batch(spark.createDataFrame([assertion(1, "shoply", "has-version", "3")], ASSERTIONS), "2026-03-02 00:00:00", prefix="d-")
    g = g.rename_entity("shoply", "Shoply One").alias_entity("AuthService", "auth").merge_entities("Shoply2", "Shoply One", "2026-04-01 00:00:00")
    g = g.invalidate("a-2", "2026-05-01 00:00:00", "gone").promote_predicate("x/likes", "core/likes")
    g, _ = g.judge(lambda df: df.withColumns({"relation": F.lit("compatible"), "confidence": F.lit(0.9)}), "2026-05-02 00:00:00")
    log = g.log.table()
    rows = log.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1)) and all(x.hlc < y.hlc for x, y in zip(rows, rows[1:], strict=False))
    assert {r.t for r in rows} >= set(oplog.KINDS) - {"reinforce"}
    fresh, _, counts = KnowledgeGraph.init(spark).logged("w-z").reconcile(log, NOW)
    assert counts["error"] == counts["unknown"] == counts["skipped"] == 0
    assert triples(fresh) == triples(g) and fresh.links.count() == g.links.count()
    names = lambda s: {(r.name, tuple(sorted(r.aliases or ()))) for r in s.entities.collect()}
    assert names(fresh) == names(g)
    assert {(r.id, r.status, r.replaced_by) for r in fresh.predicates.collect()} == {(r.id, r.status, r.replaced_by) for r in g.predicates.collect()}
    assert [(r.id, r.summary) for r in fresh.episodes.collect()] == [("ep-1", "done")]


def test_effects_on_what_is_not_there(spark):
    e = lambda seq, t, p, hlc=None: ("w", seq, hlc or seq, t, p if isinstance(p, str) else json.dumps(p))
    who = {"id": "x1", "name": "Shop", "type": "service", "scope": "project"}
    rows = [
        e(1, "invalidate", {"fact-id": "f1", "at": 5, "reason": "early"}), e(2, "insert-fact", {"fact": {"id": "f1", "subject": who, "predicate": "core/prefers", "object-lit": "tea", "t-valid": 1, "confidence": 0.5}}),
        e(3, "insert-fact", {"fact": {"id": "f1", "subject": who, "predicate": "core/prefers", "object-lit": "other"}}), e(4, "insert-fact", {"fact": {"id": "f2", "subject": {"id": "nobody"}, "predicate": "core/prefers", "object-lit": "x"}}),
        e(5, "heartbeat", {}), e(6, "update-entity", {"id": "nobody", "updates": {"name": "No"}}), e(7, "update-entity", '{"id": "x1", "upd'), e(8, "repoint-facts", {"from": "x1", "to": "nobody"}), e(9, "reinforce", {"fact_id": "f1", "at": 7, "confidence": 0.9}),
        e(10, "link-conflicts", {"fact-id": "f1", "ids": ["f9"]}), e(11, "close-episode", {"id": "p", "summary": "s", "at": 4}), ("v", 1, 3, "ensure-entity", json.dumps({"entity": {"id": "y", "name": "shop", "scope": "project"}})),
        ("v", 2, 12, "delete-entity", json.dumps({"id": "y"})), (None, 5, 1, "heartbeat", "{}"), e(9, "reinforce", {"fact_id": "f1", "at": 7, "confidence": 0.9}),
    ]
    g, _, counts = KnowledgeGraph.init(spark).reconcile(spark.createDataFrame(rows, EFFECTS), NOW)
    assert counts | {"sweep_candidates": 0} == {"total": 13, "applied": 5, "skipped": 5, "unknown": 1, "error": 2, "duplicates": 0, "sweep_candidates": 0}
    f = g.facts.collect()
    assert [(r.id, r.object_lit, r.t_invalid, r.confidence) for r in f] == [("f1", "tea", None, 0.9)]
    assert g.entities.count() == 0  # both names meant one entity, which the other writer removed
    none, _, counts = KnowledgeGraph.init(spark).reconcile(spark.createDataFrame([], EFFECTS), NOW)
    assert counts["total"] == 0 and none.facts.count() == 0


def test_chains_of_repointings(spark):
    m = [(i, f"e{i}", f"e{i + 1}") for i in range(40)] + [(50, "e40", "e0"), (60, "e0", "z")]
    moved = spark.createDataFrame(m, "o int, old string, new string")
    to = oplog.final_targets(moved)
    rows = spark.createDataFrame([("a", None, "e0"), ("b", 30, "e31"), ("c", 30, "e5"), ("d", 55, "e0"), ("e", 70, "e0"), ("f", 0, None)], "id string, made int, s string")
    assert {r.id: r.s for r in oplog.follow(rows, to, "s").collect()} == {"a": "z", "b": "z", "c": "e5", "d": "z", "e": "e0", "f": None}


def test_restore_needs_an_empty_store(spark, writers):
    a, b = writers
    with pytest.raises(StoreError, match="store-not-empty"):
        a.restore(b.dump())
    back = KnowledgeGraph.init(spark).restore(b.dump())
    assert triples(back) == triples(b) and back.facts_of("Auth Service", NOW).count() == 1


def test_ingestion_from_end_to_end(spark):
    g = KnowledgeGraph.init(spark).logged("w")
    code = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    g, n = g.ingest_code(code(("a.clj", "(ns app.a (:require [app.b :as b] [lib.c]))"), ("b.clj", "(ns app.b)")), "2026-01-01 00:00:00", "c1")
    assert n == {"insert": 6, "reinforce": 0, "supersede": 0, "flag": 0, "error": 0, "stale": 0}
    g, n = g.ingest_code(code(("a.clj", "(ns app.a (:require [app.b :as b]))"), ("b.clj", "(ns app.b)")), "2026-02-01 00:00:00", "c2")
    assert n["reinforce"] == 5 and n["stale"] == 1 and g.facts_of("app.a", "2026-02-02 00:00:00", predicate="core/depends-on").count() == 1
    adr = spark.createDataFrame([("0001-cache.md", "# ADR-1: Use a cache\nStatus: accepted\nRejected: none at all")], "name string, text string")
    g, n = g.ingest_decisions(adr, "2026-02-03 00:00:00", "d1")
    assert n["insert"] == 2 and g.episodes.where("id = 'd1'").first().summary == "2 insert"
    reply = lambda df: df.select("id", F.lit('Here:\n{"subject": "cache", "predicate": "prefers", "object": "redis", "object_kind": "literal", "confidence": 0.9}\n{"subject": "cache", "predicate": ""}\n').alias("text"))
    texts = spark.createDataFrame([("s1", "user: hello")], "id string, text string")
    g, n = g.ingest_texts(texts, reply, "2026-02-04 00:00:00", "s1", kind="failure")
    assert (n["candidates"], n["rejected"], n["insert"]) == (2, 1, 1) and g.facts.where("episode = 's1'").first().confidence == 0.7
    notes = spark.createDataFrame([("n.md", "cache is redis"), ("m.md", " ")], "path string, content string")
    g, n = g.ingest_notes(notes, reply, "2026-02-05 00:00:00", "n1", harness="pad")
    assert n["changed"] == 1 and n["candidates"] == 2
    g, n = g.ingest_notes(notes, reply, "2026-02-06 00:00:00", "n2", harness="pad")
    assert n["changed"] == n["candidates"] == 0
    more, added = g.enrich(lambda df: df.select("id", F.array(F.concat("name", F.lit(" thing")), F.lit("cache")).alias("aliases")))
    assert added.count() > 0 and "cache" not in {r.alias for r in added.collect()} and more.log.seq > g.log.seq
