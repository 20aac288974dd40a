import pytest
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import oplog, reports
from factloom.plans.layout import global_rank, shared_dir
from factloom.sources import ingest


def test_namespaces():
    read = ingest.namespace_of
    assert read('(ns a.b "doc (x)" (:require [c.d :as d] e.f [c.d :refer [x]]) (:use g))\n(defn f [])') == ("a.b", ["c.d", "e.f", "g"])
    assert read("; note\n(ns x)") == ("x", []) and read("(def a 1)") is None and read("(ns") is None and read(None) is None and read("text") is None


def test_code_facts(spark):
    files = spark.createDataFrame([("src/a.clj", "(ns p.a (:require [p.b] [ext.lib]))"), ("src/b.clj", "(ns p.b)"), ("c", None)], "path string, text string")
    got = {(r.subject, r.predicate, r.object, r.scope) for r in ingest.code_facts(files, path="path", text="text").collect()}
    assert {x for x in got if x[1] == "core/depends-on"} == {("p.a", "core/depends-on", "p.b", "project"), ("p.a", "core/depends-on", "ext.lib", "external")} and len(got) == 6


ADR = "# ADR-7: Use argon2\n\nStatus: Accepted\nSupersedes: ADR-2, ADR-3\n\n## Considered Options\n* argon2\n* \"bcrypt\"\n- scrypt\n\n## Decision\nChosen option: \"argon2\", since\n\nRejected: md5\n"


def test_decision_records(spark):
    files = spark.createDataFrame([("0007-use.md", ADR), ("0012-x.md", "# Plain\n\n## Status\n\nproposed\n"), ("notes.md", "nothing"), ("n", None)], "name string, text string")
    rows = {r.name: r for r in ingest.decision_records(files, name="name", text="text").collect()}
    a = rows["0007-use.md"]
    assert (a.record_id, a.title, a.status, a.supersedes, a.superseded_by, a.rejected) == ("ADR-7", "Use argon2", "accepted", ["ADR-2", "ADR-3"], [], ["bcrypt", "scrypt", "md5"])
    assert (rows["0012-x.md"].record_id, rows["0012-x.md"].status) == ("ADR-12", "proposed") and rows["notes.md"].record_id == "notes" and rows["notes.md"].status is None and len(rows) == 3
    facts = {(r.subject, r.predicate, r.object) for r in ingest.decision_facts(ingest.decision_records(files, name="name", text="text")).collect()}
    assert ("ADR-7", "core/decided-against", "md5") in facts and ("ADR-12", "core/has-status", "proposed") in facts and len(facts) == 7


def test_json_lines_and_transcripts(spark):
    reply = 'Here:\n```\n{"subject":"a","predicate":"p","object":"o","class":"commitment","confidence":0.9}\n{"subject":"b","predicate":"p"}\n{"cut": \n{"x":1} more'
    df = spark.createDataFrame([(1, reply), (2, None), (3, "")], "id int, text string")
    got = ingest.prepare_candidates(ingest.json_lines(df, id="id", text="text"), kind="notes").orderBy("place").collect()
    assert [(r.subject, r.accepted, r.confidence, r.epistemic, r.demoted) for r in got] == [("a", True, 0.65, "observation", True), ("b", False, 0.55, None, False)]
    jl = '{"role":"user","content":"hi"}\n\n{"message":{"role":"assistant","content":"yo"}}\n{"type":"tool"}'
    t = spark.createDataFrame([(1, jl), (2, "user: hi\n{}"), (3, None)], "id int, text string")
    assert [r.transcript for r in ingest.transcript(t, id="id", text="text").orderBy("id").collect()] == ["user: hi\n\nassistant: yo", "user: hi\n{}", None]


def test_complete_json(spark):
    cases = {"{}": True, '{"a":1}': True, "{": False, "": False, '{"a":1} x': False, "1,2": False, '[1,{"b":null}]': True, "null": True, '{"a":"x-0': False}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string").select("x", X.complete_json(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases | {None: False}


def test_notes_and_hashes(spark):
    df = spark.createDataFrame([("a.md", "x\nB\nmine\nE\ny"), ("b.md", "x\nB\nopen"), ("c.md", "  \n")], "path string, content string")
    got = {r.path: r.content for r in ingest.notes(df, begin="B", end="E").collect()}
    assert got == {"a.md": "x\n\ny", "b.md": "x"}
    seen = ingest.seen_hashes(spark.createDataFrame([("pad:a.md@0a1b",), ("other:a.md@ff",), (None,), ("pad:odd",)], "ref string"), "pad").collect()
    assert [tuple(r) for r in seen] == [("a.md", "0a1b")]


def test_expressions(spark):
    row = spark.range(1).select(X.norm_name(F.lit("Auth-Service_x. y/z")).alias("n"), X.keyword(F.lit(" :core/x ")).alias("k"), X.keyword(F.lit(" ")).alias("e"), X.query_tokens(F.lit("(shoply.api) the db! db the-x shoply.api")).alias("t"), X.munge_path(F.lit("/a/b.c")).alias("m"), X.parse_instant(F.lit("2026-01-02")).alias("d"), X.parse_instant(F.lit(" ")).alias("b")).first()
    assert (row.n, row.k, row.e, row.t, row.m, row.b) == ("authservicexyz", "core/x", None, ["shoply.api", "the-x"], "-a-b-c", None) and row.d.day == 2
    with pytest.raises(Exception, match="invalid-instant"):
        spark.range(1).select(X.parse_instant(F.lit("soon"))).collect()


def test_budget():
    lines = [f"- line {i}" for i in range(10)]
    full = reports.fit("P", [("A", lines, 10), ("B", [], 0), ("C", ["- c"], 1)], 1000)
    assert full.count("- line") == 10 and "### B" not in full and full.endswith("### C\n- c")
    cut = reports.fit("P", [("A", lines, 10), ("C", ["- c"], 1)], 60)
    assert len(cut.encode()) <= 60 and "more" in cut and "- line 0" in cut
    assert reports.fit("P", [("A", lines, 10)], 9) == "P"
    kept = cut.count("- line")
    assert f"… {10 - kept} more" in cut


def test_logs(spark):
    rows = [("w", 1, 10, "insert-fact", '{"fact":{"id":"f1","object_lit":"x"}}'), ("w", 2, 20, "invalidate", '{"fact-id":"f1","at":5,"reason":"r"}'), ("v", 1, 5, "invalidate", '{"fact-id":"f1","at":1,"reason":"early"}'), ("v", 2, 30, "reinforce", '{"fact_id":"nope","at":1}'),
            ("v", 3, 31, "link-conflicts", '{"fact-id":"f1","ids":["a","b"]}'), ("v", 4, 32, "unlink-conflicts", '{"fact-id":"f1","ids":["a"]}')]
    log = spark.createDataFrame(rows, "writer string, seq bigint, hlc bigint, t string, payload string")
    f = oplog.facts(log).collect()
    assert [(r.id, r.object, r.t_invalid_ms, r.reason) for r in f] == [("f1", "x", 5, "r")]
    assert [tuple(r) for r in oplog.conflict_links(log).collect()] == [("f1", "b")]
    assert {r.writer: r.high_water for r in oplog.high_water(log).collect()} == {"w": 2, "v": 4}
    marks = spark.createDataFrame([("w", 1)], "writer string, high_water bigint")
    assert {(r.writer, r.seq) for r in oplog.unapplied(log, marks).collect()} == {("w", 2), ("v", 1), ("v", 2), ("v", 3), ("v", 4)}
    reads = spark.createDataFrame([(1, "read"), (2, "outcome"), (3, "read")], "seq bigint, type string")
    assert [r.seq for r in oplog.since_last_mark(reads).collect()] == [3]
    with pytest.raises(ValueError, match="invalid-valence"):
        oplog.outcome(log, reads, "maybe", F.lit(1))


def test_global_rank(spark):
    df = spark.range(500, numPartitions=7).withColumn("k", (F.col("id") * 37) % 101)
    got = [(r.k, r.id) for r in global_rank(df, "k", "id").orderBy("rank").collect()]
    assert got == sorted(got) and [r["rank"] for r in global_rank(df, "k", "id").orderBy("k", "id").collect()] == list(range(1, 501))
    assert shared_dir(spark)
