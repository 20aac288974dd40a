import random

import pytest

from factloom.llm.mixing import budgets, fill, mix, shares

DOCS = "id bigint, source string, lang string, kind string, n bigint, uses int"
TARGETS = "mix string, source string, w double, most int"
ARGS = dict(id="id", source="source", lang="lang", domain="kind", size="n", mix_id="mix", share="w", max_repeats="most")


def run(spark, docs, targets, total="met", **kw):
    d = spark.createDataFrame([(*x, 9) for x in docs], DOCS)
    t = spark.createDataFrame(targets, TARGETS)
    u = mix(d, t, total_tokens=total, **ARGS, **kw)
    return u.collect(), {(r.mix, r.source): r for r in shares(u, t, source="source", size="n", mix_id="mix", share="w").collect()}


def corpus(seed, sources, n=3000):
    r = random.Random(seed)
    return [(i, r.choices(list(sources), list(sources.values()))[0], r.choice(["en", "de", None]), r.choice("ab"), r.randrange(20, 400)) for i in range(n)]


def test_fill_and_levels():
    assert fill(10, [1, 1], [3, 100]) == [3, 7]
    assert fill(10, [1, 1, 2], [1, 1, 1]) == [1, 1, 1]
    assert fill(9, [1, 2], [9, 9]) == pytest.approx([3, 6])
    # y runs short in (d, l): its sibling x in the same domain and language takes over before the other domain does
    leaves = [(("d", "l", "x"), 1.0, 100.0), (("d", "l", "y"), 1.0, 2.0), (("e", "l", "x"), 2.0, 100.0)]
    assert budgets(leaves, 40) == pytest.approx([18, 2, 20])
    leaves[0] = (("d", "l", "x"), 1.0, 10.0)
    assert budgets(leaves, 40) == pytest.approx([10, 2, 28])


def test_shares_are_met(spark):
    docs = corpus(1, {"big": 10, "mid": 4, "small": 1})
    rows, s = run(spark, docs, [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 4)])
    assert all(abs(r.reached_share - r.w) < 0.002 for r in s.values())
    assert {r.source: max(x.uses for x in rows if x.source == r.source) for r in rows}["small"] <= 4
    assert len({r.id for r in rows}) == len(rows) == len(docs)
    again, _ = run(spark, docs, [("m", "small", 0.2, 4), ("m", "big", 0.5, 1), ("m", "mid", 0.3, 2)])
    assert {(r.id, r.uses) for r in rows} == {(r.id, r.uses) for r in again}


def test_shortages_and_caps(spark):
    docs = corpus(2, {"big": 20, "small": 1})
    have = sum(d[4] for d in docs if d[1] == "small")
    rows, s = run(spark, docs, [("m", "big", 0.5, 1), ("m", "small", 0.5, 3)], total="all")
    assert s["m", "small"].tokens == 3 * have and s["m", "small"].most_uses == 3
    assert s["m", "big"].tokens <= sum(d[4] for d in docs if d[1] == "big") and s["m", "big"].most_uses == 1
    assert s["m", "small"].unused_tokens == 0 and s["m", "small"].documents == sum(d[1] == "small" for d in docs)
    _, s = run(spark, docs, [("m", "big", 0.5, 1), ("m", "small", 0.5, 3)], total=have)
    assert all(abs(r.reached_share - r.w) < 0.1 and r.tokens <= have for r in s.values()) and s["m", "big"].unused_tokens > 0
    _, s = run(spark, docs, [("m", "big", 0.8, 1), ("m", "gone", 0.2, 3)])
    assert s["m", "gone"].reached_share == 0 and s["m", "big"].reached_share == 1


def test_hot_leaf_in_many_buckets(spark):
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", "en", "a", 10 + i % 50) for i in range(5000)]
    rows, s = run(spark, docs, [("m", "hot", 0.4, 1), ("m", "s0", 0.3, 1), ("m", "s3", 0.3, 1)], bucket_rows=100)
    assert all(abs(r.reached_share - r.w) < 0.002 for r in s.values())
    assert max(r.uses for r in rows) == 1


def test_odd_rows(spark):
    docs = [(1, "a", None, None, 10), (1, "a", None, None, 10), (2, None, "en", "k", 10), (3, "a", "en", "k", 0), (4, "a", "en", "k", None), (5, "a", "en", "k", -5), (None, "a", "en", "k", 5), (6, "a", "en", "k", 10)]
    rows, s = run(spark, docs, [("m", "a", 1.0, 2), ("m", None, 1.0, 1), ("z", "a", None, 2), ("y", "a", 0.5, None), ("m", "a", 0.5, 9)])
    assert sorted((r.mix, r.id, r.uses) for r in rows if r.uses) == [("m", 1, 2), ("m", 6, 2)]
    assert run(spark, [], [("m", "a", 1.0, 2)])[0] == [] and run(spark, docs, [])[0] == []
