import pytest
from pyspark.sql import functions as F

from factloom.functions.exprs import at
from factloom.functions.registry import seed
from factloom.operators import audit, measures, resolve
from factloom.plans.settings import Lease, Locked, merge_settings, resolve_setting
from factloom.sources import ingest, replies


def test_settings():
    ask = lambda **kw: resolve_setting("ttl", env_name="TTL", kind=int, **kw)
    assert ask(flags={"ttl": 5}, env={"TTL": "6"}, config={"ttl": 7}, default=8) == (5, "flag")
    assert ask(env={"TTL": "6"}, config={"ttl": 7}) == (6, "env") and ask(env={"TTL": "x"}, config={"ttl": "7"}) == (7, "config")
    assert ask(env={}, default=8) == (8, "default") and ask(env={}) == (None, None)
    assert merge_settings({"a": 1, "b": None}, [{"b": 2, "c": None}, {"b": 3, "c": 4}]) == {"a": 1, "b": 2, "c": 4}


def test_lease(spark, tmp_path):
    a, b = Lease(spark, str(tmp_path), "a"), Lease(spark, str(tmp_path), "b")
    with a.taken():
        with pytest.raises(Locked, match="store-locked: a"):
            b.acquire(wait_ms=0)
        assert a.held()["owner"] == "a"
    assert a.held() is None
    gone = Lease(spark, str(tmp_path), "gone", ttl_ms=-1)
    gone.acquire()
    b.acquire(wait_ms=0)  # what ran out is broken
    gone.release()
    assert b.held()["owner"] == "b"
    b.release()


def test_medians_rates_majorities(spark):
    df = spark.createDataFrame([("a", 1.0, True, "x"), ("a", 3.0, None, "y"), ("a", 10.0, False, "x"), ("b", None, True, None), ("b", 4.0, True, "z"), ("b", 6.0, True, "y")], "k string, v double, f boolean, w string")
    assert {r.k: (r.n, r["median"], r.most) for r in measures.medians(df, ["k"], "v").collect()} == {"a": (3, 3.0, 10.0), "b": (2, 5.0, 6.0)}
    assert {r.k: (r.n, r.hits, r.rate) for r in measures.rates(df, ["k"], "f").collect()} == {"a": (3, 1, 0.333333333), "b": (3, 3, 1.0)}
    assert {r.k: (r.w, r.votes, r.flip_rate) for r in measures.majority(df, ["k"], "w").collect()} == {"a": ("x", 3, 0.333333333), "b": ("y", 2, 0.5)}
    assert measures.medians(df.limit(0), ["k"], "v").count() == 0


def test_tf_idf(spark):
    df = spark.createDataFrame([(1, "Cache, cache lock"), (2, "the lock"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.score for r in measures.tf_idf(df, ["cache", "LOCK", "lock"], id="id", text="text").collect()}
    import math

    assert got == {1: round(2 / 3 * math.log(5) + 1 / 3 * math.log(3), 9), 2: round(1 / 2 * math.log(3), 9)}
    assert measures.tf_idf(df, [], id="id", text="text").count() == 0


def test_decision_records(spark):
    text = "# ADR 12 — Pick a store\r\nStatus: In Review\nSupersedes: ADR-1, ADR-2 ,\nsuperseded-by: ADR-30\n\n## Considered Options\n* kuzu-db\n- \"plain LMDB\"\n* SQLite\n\nChosen option: \"Plain LMDB\", since it is small.\nRejected alternatives: GraphQL\n"
    other = "## Context\nno title\n## Status\n\nAccepted on Monday\n## Options\n- a\n- b\n# Late title\n"
    df = spark.createDataFrame([("0007-x.md", text), ("0042-y.md", other), ("notes.md", ""), ("z.md", None), ("9.md", "# ADR-7 no dash")], "name string, text string")
    got = {r.name: r for r in ingest.decision_records(df, name="name", text="text").collect()}
    r = got["0007-x.md"]
    assert (r.record_id, r.title, r.status, r.supersedes, r.superseded_by, r.rejected) == ("ADR-12", "Pick a store", "in review", ["ADR-1", "ADR-2"], ["ADR-30"], ["kuzu-db", "SQLite", "GraphQL"])
    r = got["0042-y.md"]
    assert (r.record_id, r.title, r.status, r.rejected) == ("ADR-42", "Late title", "accepted", [])
    assert (got["notes.md"].record_id, got["notes.md"].title, got["notes.md"].status) == ("notes", None, None) and set(got) == {"0007-x.md", "0042-y.md", "notes.md", "9.md"}
    assert (got["9.md"].record_id, got["9.md"].title) == ("ADR-7", "ADR-7 no dash")
    facts = {(x.subject_type, x.predicate, x.object, x.object_type, x.epistemic, x.on_conflict) for x in ingest.decision_facts(ingest.decision_records(df.where("name = '0007-x.md'"), name="name", text="text")).collect()}
    assert ("decision-record", "core/has-status", "in review", None, None, "supersede") in facts and ("decision-record", "core/supersedes", "ADR-1", "decision-record", None, None) in facts
    assert ("decision-record", "core/decided-against", "GraphQL", None, "commitment", None) in facts and len(facts) == 7


def test_audit_of_a_pile(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "A.md").write_text("first")
    (tmp_path / "rules/b.md").write_text("second")
    files = audit.pile(spark, [(str(tmp_path), "*.md"), (str(tmp_path / "rules"), "*.md")])
    assert files.count() == 2 and audit.pile(spark, []).count() == 0
    line = lambda s, p, o, k="literal": f'{{"subject": "{s}", "predicate": "{p}", "object": "{o}", "object_kind": "{k}"}}'
    reply = "\n".join([line("shop", "has-version", "1.0"), line("Shop", "has-version", "2.0"), line("api", "depends-on", "db", "entity"), line("", "x", "y"), line("shop", "prefers", "tea"), line("shop", "has-version", "1.0")])
    code = spark.createDataFrame([("api", "core/depends-on", "db", "entity")], "subject string, predicate string, object string, object_kind string")
    extract = lambda df: df.select("id", F.when(F.col("text") == "first", F.lit(reply)).otherwise(F.lit(line("shop", "prefers", "Tea"))).alias("text"))
    got = audit.audit_pile(files, code, extract, seed(spark), at("2026-01-01 00:00:00"))
    kinds = [(r.kind, r.subject, r.object, r.file.endswith("A.md"), r.place, r.quote, None if r.other_file is None else r.other_file.endswith(".md"), r.other_quote) for r in got.findings.orderBy("seq").collect()]
    assert ("restatement", "api", "db", True, 2, "api depends-on db", None, None) in kinds
    assert ("disagreement", "Shop", "2.0", True, 1, "Shop has-version 2.0", True, "shop has-version 1.0") in kinds
    assert {tuple(r.names) for r in got.clusters.collect()} == {("Shop", "shop")}
    assert got.injection.first().pile_bytes == 11 and got.restatements.where("n = 2").count() >= 1
    assert sum(r.n for r in got.scorecard.collect()) == 6
    calm = audit.audit_pile(files, code, extract, seed(spark), at("2026-01-01 00:00:00"), judge=lambda df: df.withColumn("relation", F.lit("compatible")))
    assert {r.kind for r in calm.findings.collect()} == {"restatement"}


def test_replies(spark):
    df = spark.createDataFrame([('{"relation": "Duplicate", "confidence": 3, "rationale": "same"}',), ("no",)], "r string").select(replies.judgment(F.col("r")).alias("j"), replies.hook_output(F.when(F.col("r") == "no", F.lit(" ")).otherwise(F.lit("mind the gap"))).alias("h"))
    a, b = df.collect()
    assert tuple(a.j) == ("duplicate", 1.0, "same") and tuple(b.j) == ("unparseable", 0.0, None) and b.h is None and '"additionalContext":"mind the gap"' in a.h
    p = spark.range(1).select(replies.summary_prompt(F.array(F.lit("a"), F.lit("b"))).alias("s"), replies.alias_prompt(F.lit("Shop"), F.array(F.lit("x"))).alias("a"), *(replies.extraction_prompt(F.lit("T"), ["p"], ["n"], k).alias(k) for k in replies.ABOUT)).first()
    assert p.s.endswith("a\nb") and "Shop" in p.a and len({p[k] for k in replies.ABOUT}) == 4


def test_merges_of_merges(spark):
    chain = spark.createDataFrame([(f"e{i:02d}", f"e{i + 1:02d}") for i in range(70)] + [("x", "y"), ("x", "z"), ("q", "q")], "old string, new string")
    got = {r.old: r.new for r in resolve.merge_map(chain).collect()}
    assert {got[f"e{i:02d}"] for i in range(70)} == {"e70"} and got["x"] == "y" and "q" not in got
    with pytest.raises(ValueError, match="circular-merge"):
        resolve.merge_map(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "old string, new string"))
