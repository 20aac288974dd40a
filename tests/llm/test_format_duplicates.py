import random

from pyspark.sql import functions as F

from factloom.llm.format_duplicates import collapse, format_groups, multiset_hash, pairs_of, parts_of, plain

SCHEMA = "id bigint, s string, o string, first string, n_copies int"


def groups(spark, rows, **kw):
    df = spark.createDataFrame([(i, s, o, "clash", 0) for i, s, o in rows], SCHEMA)
    return {(r.first, r.id) for r in format_groups(df, id="id", fields=["s", "o"], listed=["o"], **kw).collect()}


def test_plain(spark):
    cases = {"A-b_c": "abc", " Cap\u3000X after 5.3 s! ": "capxafter5.3s", "v. 1.2.3.": "v1.2.3", ".5": "5", "Ünï": "ünï", "": "", "…": ""}
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", plain(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_lists_of_parts(spark):
    same = ["a=1; b=x", "b:\tX\na:\t1", '{"a":"1","b":"x"}', "(B=x;A=1);", "A = 1 | B = X", "a: 1, b: x, a: 1"]
    other = ["a=1", "a=1 b", "a b=1; c=2", "b=1; a=x", "note: at 40; then", "a=1; b="]
    df = spark.createDataFrame([(x,) for x in same + other], "x string").select("x", parts_of(F.col("x")).alias("p"))
    got = {r.x: None if r.p is None else frozenset((p["name"], p["value"]) for p in r.p) for r in df.collect()}
    assert {got[x] for x in same} == {frozenset({("a", "1"), ("b", "x")})}
    assert got["b=1; a=x"] == {("b", "1"), ("a", "x")}
    assert [got[x] for x in other if x != "b=1; a=x"] == [None] * 5


def test_groups(spark):
    rows = [(1, "Auth-Service", "a=1; b=2"), (2, "auth service", "B: 2, A: 1"), (3, "auth service", "a=1; b=3"), (4, None, "x"), (5, None, "X!"), (6, "", "x"), (7, "-", "x"), (8, "auth service", "a 1 b 2"), (2, "auth service", "B: 2, A: 1"), (None, "q", "q"), (9, "v1.5", "z"), (10, "v15", "z"), (11, "long", "y" * 200_000), (12, "LONG", "Y" * 200_000)]
    assert groups(spark, rows) == {(1, 1), (1, 2), (3, 3), (4, 4), (4, 5), (6, 6), (6, 7), (8, 8), (9, 9), (10, 10), (11, 11), (11, 12)}
    assert groups(spark, []) == set()


def test_same_fingerprint_of_different_content_is_told_apart(spark):
    rows = [(1, "a", "p"), (2, "A", "P"), (3, "b", "q"), (4, "B", "q."), (5, "c", "r")]
    clash = lambda pairs: F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"))
    assert groups(spark, rows, fingerprint=clash) == groups(spark, rows) == {(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)}


def test_hash_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([("a=1; b=2",), ("b=2; a=1",), ("a=2; b=1",)], "o string")
    h = [tuple(r.h) for r in df.select(multiset_hash(pairs_of(["o"], ["o"])).alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_hot_group_and_collapse(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["X Y", "x-y", " xy "]) if i % 3 == 0 else f"s{i}", "v") for i in range(3000)]
    df = spark.createDataFrame([(i, s, o, "clash", 0) for i, s, o in rows], SCHEMA)
    got = {x.id: x.n_copies for x in collapse(df.drop("n_copies"), id="id", fields=["s", "o"], listed=["o"]).collect()}
    assert got[0] == 1000 and sum(got.values()) == 3000 and len(got) == 2001


def test_nothing_is_sorted(spark, capsys):
    rows = [(i, f"s{i % 50}", "a=1; b=2") for i in range(200)]
    df = spark.createDataFrame([(i, s, o, "clash", 0) for i, s, o in rows], SCHEMA)
    found = format_groups(df, id="id", fields=["s", "o"], listed=["o"])
    found.collect()
    found.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "Join" in plan
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and " Sort " not in plan
