import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import constants as K
from factloom.functions.exprs import at
from factloom.operators.decide import Fact, Subject, assert_batch
from factloom.operators.supersession import versions

T0, T1, NOW = 100, 600, 1000


def fact(id, obj="2.0", predicate="core/has-version", t=T1, end=None, epistemic="observation", source="user-assertion", confidence=0.8, kind="literal", loose=None):
    return Fact(id, predicate, (kind, obj), loose or obj.lower(), t, end, confidence, epistemic, source)


def subject(*held, single=("core/has-version",), mates=None):
    s = Subject(NOW, set(single), mates or {"core/prefers": {"core/decided-against"}, "core/decided-against": {"core/prefers"}})
    for f in held:
        s.hold(f)
    return s


OLD = dict(id="f-old", obj="1.0", t=T0)
CASES = {
    "insert": ([], fact("n"), None, ("insert", [], None)),
    "reinforce": ([OLD], fact("n", "1.0"), None, ("reinforce", ["f-old"], None)),
    "supersede": ([OLD], fact("n"), None, ("supersede", ["f-old"], None)),
    "flag": ([OLD], fact("n", epistemic="commitment"), None, ("flag", ["f-old"], None)),
    "flag-old": ([OLD | dict(epistemic="commitment")], fact("n"), None, ("flag", ["f-old"], None)),
    "override": ([OLD], fact("n", epistemic="commitment"), "supersede", ("supersede", ["f-old"], None)),
    "ignore": ([OLD], fact("n", epistemic="commitment"), "ignore", ("insert", [], None)),
    "backdated": ([OLD], fact("n", t=50), None, ("flag", ["f-old"], "backdated-overlap")),
    "backdated-override": ([OLD], fact("n", t=50), "supersede", ("flag", ["f-old"], "backdated-overlap")),
    "equal-start": ([OLD], fact("n", t=T0), None, ("supersede", ["f-old"], None)),
    "outranked": ([OLD], fact("n", source="inferred"), None, ("flag", ["f-old"], "outranked")),
    "many": ([OLD | dict(predicate="core/uses")], fact("n", predicate="core/uses"), None, ("insert", [], None)),
    "antagonist": ([dict(id="f-pref", obj="e-1", predicate="core/prefers", kind="entity", loose="graphql", t=T0)], fact("n", "GraphQL", predicate="core/decided-against", epistemic="commitment"), None, ("flag", ["f-pref"], None)),
    "antagonist-override": ([dict(id="f-pref", obj="e-1", predicate="core/prefers", kind="entity", loose="graphql", t=T0)], fact("n", "GraphQL", predicate="core/decided-against", epistemic="commitment"), "supersede", ("supersede", ["f-pref"], None)),
    "revenant": ([dict(id="d", obj="heroku", predicate="core/deployed-via", t=T0, end=500), dict(id="r", obj="fly", predicate="core/deployed-via", t=500)], fact("n", "heroku", predicate="core/deployed-via", source="session-log"), None, ("flag", ["r"], "revenant")),
    "trusted-return": ([dict(id="d", obj="heroku", predicate="core/deployed-via", t=T0, end=500), dict(id="r", obj="fly", predicate="core/deployed-via", t=500)], fact("n", "heroku", predicate="core/deployed-via"), None, ("insert", [], None)),
}


@pytest.mark.parametrize("name", CASES)
def test_decision_table(name):
    held, new, override, want = CASES[name]
    d = subject(*(fact(**h) for h in held)).decide(new, override)
    assert (d.action, d.targets, d.reason) == want
    if d.action == "supersede":
        assert d.effective_at == new.t_valid


@pytest.mark.parametrize("base,source,incoming,want", [(0.6, "session-log", 0.95, 0.7), (0.65, "session-log", 0.5, 0.65), (0.99, "session-log", 0.95, 0.99), (0.9, "code", 0.99, 0.95)])
def test_reinforced_base(base, source, incoming, want):
    s = subject(fact("o", confidence=base, source=source))
    assert s.decide(fact("n", confidence=incoming), None).confidence == want


REGISTRY = "id string, label string, category string, object_kind string, cardinality string, inverse_of string, exclusion_group string, value_exclusivity string, status string, replaced_by string, default_epistemic string, definition string, maps_to string"


def registry(spark):
    row = lambda id, kind="either", card="many", group=None, status="active", category="decision", excl=None, ep="observation": (id, None, category, kind, card, None, group, excl, status, None, ep, None, None)
    return spark.createDataFrame([row("core/has-version", "literal", "one"), row("core/has-status", "literal", "one"), row("core/prefers", group="stance", excl="exclusive", ep="preference"), row("core/decided-against", group="stance", ep="commitment"), row("core/depends-on", "entity", category="structural"), row("core/deployed-via"), row("core/old", status="deprecated"), row("core/derived-from", "entity")], REGISTRY)


ASSERTIONS = "seq bigint, subject string, subject_type string, predicate string, object string, object_type string, object_kind string, epistemic string, scope string, confidence double, source_type string, on_conflict string, t_valid timestamp, t_invalid timestamp, episode string"


def when(day):
    return dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day)


def assertion(seq, subject, predicate, obj, **kw):
    base = dict(subject_type=None, object_type=None, object_kind=None, epistemic=None, scope=None, confidence=None, source_type=None, on_conflict=None, t_valid=when(seq), t_invalid=None, episode=None) | kw
    return (seq, subject, base["subject_type"], predicate, obj, *(base[c] for c in ("object_type", "object_kind", "epistemic", "scope", "confidence", "source_type", "on_conflict", "t_valid", "t_invalid", "episode")))


def test_batch_statuses_and_errors(spark):
    rows = [
        assertion(1, "Auth-Service", ":core/has_version", "1.0"), assertion(2, "auth service", "has-version", "1.0"), assertion(3, "auth_service", "CORE / has-version", "2.0"), assertion(4, None, "core/prefers", "x"), assertion(5, "a", "core/prefers", None),
        assertion(6, "a", "core/nope", "x"), assertion(7, "a", "core/old", "x"), assertion(8, "a", "x/new", "x"), assertion(9, "a", "core/has-version", "b", object_kind="entity"), assertion(10, "a", "core/prefers", "x", epistemic="guess"),
        assertion(11, "a", "core/prefers", "x", t_invalid=when(11)), assertion(12, "a", None, "x"), assertion(13, "b", "prefers", "GraphQL"), assertion(14, "B", "decided-against", "graph-ql"),
    ]
    got = {r.seq: r for r in assert_batch(spark.createDataFrame(rows, ASSERTIONS), registry(spark), at("2027-01-01")).collect()}
    assert {s: r.status for s, r in got.items()} == {1: "insert", 2: "reinforce", 3: "supersede", **dict.fromkeys((4, 5, 6, 7, 9, 10, 11, 12), "error"), 8: "insert", 13: "insert", 14: "flag"}
    assert {s: r.reason for s, r in got.items() if r.status == "error"} == {4: "missing-subject", 5: "missing-object", 6: "unknown-predicate", 7: "deprecated-predicate", 9: "object-kind-mismatch", 10: "invalid-epistemic", 11: "invalid-interval", 12: "missing-predicate"}
    assert got[3].targets == ["f-1"] and got[2].fact_id == "f-1" and got[14].targets == ["f-13"]
    assert assert_batch(spark.createDataFrame([], ASSERTIONS), registry(spark), at("2027-01-01")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_closed_form_equals_the_fold(spark, seed):
    r = random.Random(seed)
    rows, day = [], {s: 0 for s in "abc"}
    for i in range(200):
        s = r.choice("abc")
        day[s] += r.randrange(3)
        rows.append(assertion(i, s, "core/has-version", r.choice("xyz"), t_valid=when(day[s]), source_type="session-log", confidence=round(r.random(), 3)))
    df = spark.createDataFrame(rows, ASSERTIONS)
    done = assert_batch(df, registry(spark), at("2030-01-01"))
    start = {f"f-{x[0]}": x for x in rows}
    closed, conf = {}, {}
    for d in sorted(done.collect(), key=lambda d: d.seq):
        for t in d.targets:
            closed[t] = d.effective_at
        conf[d.fact_id] = d.confidence if d.status == "reinforce" else rows[d.seq][9]
    fold = {(start[f][1], start[f][4], start[f][12].replace(tzinfo=None), closed.get(f), c) for f, c in conf.items()}
    form = versions(df, keys=["subject"], value="object", at="t_valid", order=["t_valid", "seq"], confidence="confidence", source="source_type").collect()
    assert {(v.subject, v.object, v.t_valid, v.t_invalid, v.confidence) for v in form} == fold
    assert K.CEILING["session-log"] == 0.7 and max(v.confidence for v in form if v.statements > 1) <= 1


def test_hot_subject_streams(spark):
    rows = [assertion(i, "hub", "core/deployed-via", f"h{i % 50}") for i in range(4000)]
    n = {r.status: r["count"] for r in assert_batch(spark.createDataFrame(rows, ASSERTIONS), registry(spark), at("2040-01-01")).groupBy("status").count().collect()}
    assert n == {"insert": 50, "reinforce": 3950}


def test_effective_confidence(spark):
    from factloom.functions.exprs import effective_confidence

    base = when(0)
    rows = [(0.8, "observation", "inferred", base, base, d) for d in (0, 90, 3650, -400)] + [(0.8, "commitment", "inferred", base, base, 365), (0.8, "observation", "decision-record", base, base, 365), (0.8, "observation", "inferred", None, base, 365)]
    df = spark.createDataFrame(rows, "confidence double, epistemic string, source_type string, recorded_at timestamp, last_reinforced_at timestamp, d int")
    got = [round(r.e, 9) for d in {x[5] for x in rows} for r in df.where(F.col("d") == d).withColumn("e", effective_confidence(F.lit(when(d)))).collect()]
    assert sorted(got) == sorted([0.8, 0.4, 0.05, 0.8, 0.8, 0.8, 0.8])
