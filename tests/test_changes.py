import random

import pytest

from factloom.operators.changes import apply_changes, latest_content

FEED = "id string, op string, hlc bigint, writer string, seq bigint, name string, kind string, image string"
ARGS = dict(key="id", op="op", order=["hlc", "writer", "seq"], creates="make", updates="set", deletes="drop")


def fold(rows, base):
    state = {k: (None, dict(f)) for k, f in base.items()}
    for id_, op, hlc, writer, seq, name, kind, _ in sorted({r for r in rows if None not in r[:5] and r[1] in ("make", "set", "drop")}, key=lambda r: (r[2], r[3], r[4], r[1])):
        fields = {k: v for k, v in (("name", name), ("kind", kind)) if v is not None}
        if op == "make" and id_ not in state:
            state[id_] = ((hlc, writer, seq), fields)
        elif op == "set" and id_ in state:
            state[id_] = ((hlc, writer, seq), state[id_][1] | fields)
        elif op == "drop":
            state.pop(id_, None)
    return {(k, *(o or (None, None, None)), f.get("name"), f.get("kind")) for k, (o, f) in state.items()}


def feed(seed, n, ids="abcd"):
    r = random.Random(seed)
    rows = [(r.choice([*ids, None]) if i % 40 == 0 else r.choice(ids), r.choice(["make", "set", "set", "drop", "other"]), r.randrange(n), r.choice("wv"), i, r.choice([None, f"n{i}"]), r.choice([None, "t"]), "clash") for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("seed,more", [(1, {}), (2, dict(chunk_rows=10)), (3, dict(chunk_rows=7)), (4, dict(chunk_rows=25))])
def test_equals_sequential_replay(spark, seed, more):
    rows = feed(seed, 400)
    base = {"a": {"name": "base", "kind": None}, "z": {"name": None, "kind": "k"}}
    held = spark.createDataFrame([(k, f["name"], f["kind"], 1) for k, f in base.items()], "id string, name string, kind string, op int")
    got = apply_changes(spark.createDataFrame(rows, FEED), base=held, fields=["name", "kind"], **ARGS, **more).collect()
    assert {tuple(r) for r in got} == fold(rows, base)
    got = apply_changes(spark.createDataFrame(rows, FEED), **ARGS, **more).collect()
    assert {tuple(r) for r in got} == {x[:4] for x in fold(rows, {})}


def test_a_burst_at_one_instant_is_cut_like_any_other(spark):
    # 10^5 changes of one row in one instant
    df = spark.range(100_000).selectExpr("'a' AS id", "CASE WHEN id % 1000 = 0 THEN 'make' WHEN id % 1000 = 998 AND id < 90000 THEN 'drop' ELSE 'set' END AS op", "7L AS hlc", "'w' AS writer", "id AS seq", "CASE WHEN id % 7 = 0 THEN concat('n', id) END AS name", "CASE WHEN id = 90001 THEN 't' WHEN id = 500 THEN 'old' END AS kind", "1 AS image")
    got = apply_changes(df, fields=["name", "kind"], chunk_rows=5000, **ARGS).collect()
    assert [tuple(r) for r in got] == [("a", 7, "w", 99_999, "n99995", "t")]
    got = apply_changes(df.where("seq < 90000"), fields=["name", "kind"], chunk_rows=5000, **ARGS).collect()
    assert got == []


def test_empty_feed_and_repeats(spark):
    none = spark.createDataFrame([], FEED)
    assert apply_changes(none, **ARGS).count() == 0
    base = spark.createDataFrame([("a", "n", "k")], "id string, name string, kind string")
    assert [tuple(r) for r in apply_changes(none, base=base, fields=["name", "kind"], **ARGS).collect()] == [("a", None, None, None, "n", "k")]
    one = ("a", "make", 1, "w", 1, None, None, None)
    assert apply_changes(spark.createDataFrame([one, one, one], FEED), **ARGS).count() == 1


def test_latest_content(spark):
    rows = [("w", 1, 5, "x", 10), ("w", 1, 6, "y", 20), ("w", 1, 6, "y", 20), ("w", 2, 1, "a", 7), ("w", 2, 1, "b", 7), (None, 3, 1, "c", 1), ("w", 4, 1, "c", None)]
    df = spark.createDataFrame(rows, "writer string, seq bigint, hlc bigint, payload string, landed bigint")
    got = {tuple(r) for r in latest_content(df, keys=["writer", "seq"], content=["hlc", "payload"], landed="landed").collect()}
    assert got == {("w", 1, 6, "y"), ("w", 2, 1, "b")}
