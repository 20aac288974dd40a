from pyspark.sql import functions as F

from factloom.functions.exprs import at, strip_section
from factloom.operators.audit import audit
from factloom.sources import ingest, replies
from tests.test_decide import registry


def test_replies(spark):
    rows = ['{"relation":"duplicate","confidence":1.7}', 'Sure:\n{"x":1}\n{"relation":"Supersedes","confidence":0.9}\n{"relation":"compatible"}', "no idea", None, '{"relation":"hm"}', '{"relation":"compatible"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").select("i", replies.judgment(F.col("r")).alias("j"), replies.summary(F.col("r"), 10).alias("s")).orderBy("i")
    got = df.collect()
    assert [tuple(r.j)[:2] for r in got] == [("duplicate", 1.0), ("supersedes", 0.9), ("unparseable", 0.0), ("unparseable", 0.0), ("unparseable", 0.0), ("compatible", 0.0)]
    assert got[2].s == "no idea" and got[3].s is None and got[0].s == '{"relation…'
    a = spark.createDataFrame([('ok ["Auth", "login", "login", " ", "sso", "x", "y"] ["z"]', "auth", ["SSO"]), ("none", "a", None), (None, "a", None)], "r string, n string, h array<string>")
    assert [r.x for r in a.select(replies.aliases(F.col("r"), F.col("n"), F.col("h")).alias("x")).collect()] == [["login", "x", "y"], [], []]
    h = spark.createDataFrame([('{"tool_input":{"command":"ls"}}',), ('{"prompt":"p"}',), ("{}",)], "p string")
    assert [r.q for r in h.select(replies.hook_query(F.col("p")).alias("q")).collect()] == ["ls", "p", None]


def test_audit(spark):
    cols = "subject string, predicate string, object string, object_kind string"
    code = spark.createDataFrame([("p.a", "core/depends-on", "p.b", "entity"), ("p.a", "core/has-version", "2", "literal")], cols)
    claims = spark.createDataFrame(
        [("A.md", 1, "p.a", "core/depends-on", "p.b", "entity", "agent-note"), ("A.md", 2, "p.a", "core/has-version", "1", "literal", "agent-note"), ("A.md", 3, "svc", "core/prefers", "tabs", "literal", "agent-note"), ("A.md", 4, "svc", "core/prefers", None, "literal", "agent-note"), ("B.md", 1, "svc", "core/decided-against", "Tabs", "literal", "agent-note"), ("B.md", 2, "svc", "core/has-status", "done", "literal", "agent-note")],
        "file string, place bigint, " + cols + ", source_type string",
    )
    findings, card = audit(code, claims, registry(spark), at("2027-01-01"))
    assert {(r.kind, r.subject) for r in findings.collect()} == {("restatement", "p.a"), ("stale", "p.a"), ("rejected", "svc"), ("contradiction", "svc")}
    assert {r.kind: r.n for r in card.collect()} == {"restatement": 1, "stale": 1, "rejected": 1, "contradiction": 1, "claim": 2}


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("x\ny")
    (tmp_path / "d/b.txt").write_text("no")
    assert [r.content for r in ingest.text_files(spark, str(tmp_path)).collect()] == ["x\ny"]
    (tmp_path / "in.jsonl").write_text('{"subject":"a","predicate":"p","object":"o","class":"commitment","valid-from":"2026-01-02","object-kind":"literal"}\njunk\n{"subject":"b","epistemic":"preference","class":"commitment","confidence":0.5}\n')
    got = ingest.assertions(spark, str(tmp_path / "in.jsonl")).orderBy("seq").collect()
    assert [(r.subject, r.epistemic, r.object_kind, r.confidence, r.t_valid and r.t_valid.day) for r in got] == [("a", "commitment", "literal", None, 2), ("b", "preference", None, 0.5, None)]


def test_managed_section(spark):
    df = spark.createDataFrame([("top\n<b>old</e>\nend",), ("plain",), ("x<b>open",)], "t string")
    put = df.select("t", ingest.splice_section(F.col("t"), F.lit("new"), "<b>", "</e>").alias("p"))
    assert [r.p for r in put.collect()] == ["top\n<b>new</e>\nend", "plain<b>new</e>", "x<b>new</e>"]
    assert [r.s for r in put.select(strip_section(F.col("p"), "<b>", "</e>").alias("s")).collect()] == ["top\n\nend", "plain", "x"]


def test_audit_keeps_every_claim(spark):
    cols = "subject string, predicate string, object string, object_kind string"
    code = spark.createDataFrame([("p.a", "core/has-version", "2", "literal")] * 2, cols)
    # two claims of one place, and one far behind
    rows = [("A.md", 1, "s1", "core/prefers", "tabs"), ("A.md", 1, "s2", "core/prefers", "tabs"), ("A.md", 3_000_001, "s3", "core/prefers", "tabs"), ("A.md", None, "s4", "core/prefers", "tabs"), ("A.md", None, "s5", "core/prefers", "tabs")]
    claims = spark.createDataFrame([(*r, "literal", "agent-note") for r in rows], "file string, place bigint, " + cols + ", source_type string")
    _, card = audit(code, claims, registry(spark), at("2027-01-01"))
    assert {r.kind: r.n for r in card.collect()}["claim"] == 5
