import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.as_known import OPEN, VersionTree, as_known

DAY0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
KEYS = dict(keys=["k"], slot="slot", event_id="e", event_time="at", version_id="v", valid_from="vf", valid_to="vt", known_from="kf", closing_known_from="ck")
VERSIONS = "k string, slot string, v string, vf timestamp, vt timestamp, kf timestamp, ck timestamp, at string, extra int"
EVENTS = "e bigint, k string, at timestamp, slot string, vf string"


def t(day):
    return None if day is None else DAY0 + dt.timedelta(hours=day)


def brute(events, versions):
    out = set()
    for e, k, at, *_ in set(events):
        if None in (e, k, at):
            continue
        best = {}
        for vk, slot, v, vf, vt, kf, ck, *_ in set(versions):
            if vk != k or None in (slot, v, vf, kf) or vf > at or kf > at:
                continue
            if vt is not None and vt <= at and ck is not None and ck <= at:
                continue
            best[slot] = max(best.get(slot, (vf, kf, v)), (vf, kf, v))
        out |= {(e, s, b[2]) for s, b in best.items()}
    return out


def run(spark, events, versions, **kw):
    ev, vs = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    rows = as_known(ev, vs, **KEYS, **kw).collect()
    got = {(r.e, r.slot, r.v) for r in rows}
    assert len(got) == len(rows)
    return got


def random_case(seed, n, keys="ab"):
    r = random.Random(seed)
    versions = []
    for i in range(n):
        vf = r.randrange(200)
        vt = r.choice([None, vf + r.randrange(60), vf])
        kf = r.choice([vf, vf + r.randrange(50), None if r.random() < 0.1 else vf])
        ck = None if r.random() < 0.2 else (kf or 0) + r.randrange(80)
        versions.append((r.choice(keys), r.choice("xy"), f"v{i:04d}", t(vf if r.random() > 0.05 else None), t(vt), t(kf), t(ck), "clash", 1))
    versions += versions[: n // 20]
    events = [(i, r.choice([*keys, None]), t(r.choice([None, r.randrange(260)]) if r.random() < 0.1 else r.randrange(260)), "s", "clash") for i in range(n)]
    return events + events[:5], versions


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, dict(shard_rows=10)), (3, dict(shard_rows=3, grain_seconds=3600)), (4, dict(shard_rows=10, task_events=7))])
def test_equals_brute_force(spark, seed, limits):
    events, versions = random_case(seed, 300)
    assert run(spark, events, versions, **limits) == brute(events, versions)


def test_ties_and_empty(spark):
    versions = [("a", "x", v, t(1), None, t(kf), None, None, None) for v, kf in (("v1", 2), ("v2", 3), ("v3", 3))]
    events = [(7, "a", t(5), None, None), (8, "a", t(2), None, None), (9, "a", t(0), None, None)]
    assert run(spark, events, versions) == {(7, "x", "v3"), (8, "x", "v1")}
    assert run(spark, [], versions) == set()
    assert run(spark, events, []) == set()


def test_learnt_later_is_never_seen(spark):
    # closed at 10, which became known at 20; a successor valid from 10 was recorded at 30
    versions = [("a", "x", "old", t(0), t(10), t(0), t(20), None, None), ("a", "x", "new", t(10), None, t(30), None, None, None)]
    events = [(h, "a", t(h), None, None) for h in (5, 15, 20, 25, 30)]
    assert run(spark, events, versions) == {(5, "x", "old"), (15, "x", "old"), (30, "x", "new")}


def test_roots_keep_older_states():
    tree = VersionTree([(0, 0, "a", 10, 20), (5, 6, "b", None, None)])
    find = lambda known, valid: tree.find(known, valid)[2]
    assert find(4, 4) == "a"
    assert find(6, 12) == "b"
    assert find(6, 3) == "a" and find(25, 3) == "a"
    assert find(5, 15) == "a" and find(25, 4) == "a"
    assert tree.find(-1, 3) is None and VersionTree([]).find(OPEN - 1, 3) is None


def test_hot_key_is_cut_into_shards(spark):
    events, versions = random_case(9, 800, keys="a")
    assert run(spark, events, versions, shard_rows=20) == brute(events, versions)
    from factloom.plans.layout import time_shards

    vs = spark.createDataFrame(versions, VERSIONS).where("vf IS NOT NULL").select("k", F.unix_micros("vf").alias("at"))
    shards = time_shards(vs, vs.select("k").distinct(), ["k"], "at", 20, 3_600_000_000).collect()
    assert len({x["__shard"] for x in shards}) > 20
    by_grain = [x["__shard"] for x in sorted(shards, key=lambda x: x["__g"])]
    assert by_grain == sorted(by_grain) and len({x["__g"] for x in shards}) == len(shards)


def test_a_burst_at_one_instant_is_dealt_to_several_tasks(spark):
    # 10^5 versions of one key, recorded in one instant, that end at different times
    rows = spark.range(100_000).selectExpr(
        "'a' AS k", "'x' AS slot", "concat('v', lpad(id, 6, '0')) AS v", "timestamp_seconds(1000000 + id % 50) AS vf", "timestamp_seconds(3000000 + id % 977 * 3600) AS vt", "timestamp_seconds(2000000) AS kf", "timestamp_seconds(2000000) AS ck"
    )
    events = spark.range(2000).selectExpr("id AS e", "'a' AS k", "timestamp_seconds(1999000 + id * 2000) AS at")
    got = {(r.e, r.v) for r in as_known(events, rows, **KEYS, shard_rows=2000, task_events=500).collect()}
    by_end = {}
    for i in range(100_000):
        end = 3_000_000 + i % 977 * 3600
        by_end[end] = max(by_end.get(end, (0, "")), (i % 50, f"v{i:06d}"))
    true = set()
    for e in range(2000):
        t = 1_999_000 + e * 2000
        if t >= 2_000_000 and (open_ := [b for end, b in by_end.items() if end > t]):
            true.add((e, max(open_)[1]))
    assert got == true
