import datetime as dt

from factloom.streaming.logs import EFFECTS, high_water_stream, ingest_effects, read_effects, windowed_activity


def write(spark, folder, n, rows):
    df = spark.createDataFrame([(*r, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=r[1])) for r in rows], EFFECTS)
    df.coalesce(1).write.mode("append").parquet(str(folder / f"b{n}"))


def test_ingest_goes_on_where_it_ended(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    write(spark, src, 1, [("w", 1, 1, "heartbeat", "{}"), ("w", 1, 1, "heartbeat", "{}"), ("w", 2, 2, "heartbeat", "{")])
    run = lambda: ingest_effects(read_effects(spark, str(src / "*")), str(out))
    run()
    run()
    assert spark.read.parquet(str(out / "data")).count() == 1
    write(spark, src, 2, [("w", 3, 3, "heartbeat", "{}")])
    run()
    assert {r.seq for r in spark.read.parquet(str(out / "data")).collect()} == {1, 3}


def test_marks_make_replay_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    write(spark, src, 1, [("w", 2, 2, "a", "{}"), ("w", 1, 1, "a", "{}"), ("v", 1, 1, "a", "{}")])
    q = high_water_stream(read_effects(spark, str(src / "*"))).writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        write(spark, src, 2, [("w", 2, 2, "a", "{}"), ("w", 3, 3, "a", "{}")])
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.writer, r.seq) for r in spark.table("fresh").collect()) == [("v", 1), ("w", 1), ("w", 2), ("w", 3)]


def test_windows(spark, tmp_path):
    src = tmp_path / "in"
    write(spark, src, 1, [("w", i, i, "a", "{}") for i in range(0, 180, 20)])
    q = windowed_activity(read_effects(spark, str(src / "*")), at="landed_at", key="writer").writeStream.format("memory").queryName("hours").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.n for r in spark.table("hours").collect()) == [3, 3, 3]


def test_stream_decides_as_a_batch_does(spark, tmp_path):
    from factloom.functions.exprs import at
    from factloom.operators.decide import assert_batch
    from factloom.streaming.decisions import decide_stream
    from tests.test_decide import ASSERTIONS, assertion, registry

    rows = [
        assertion(1, "svc", "has-version", "1"), assertion(2, "svc", "has-version", "2"), assertion(3, "svc", "prefers", "Tabs"), assertion(4, "svc", "prefers", None), assertion(5, "SVC", "has-version", "2", confidence=0.9),
        assertion(6, "svc", "decided-against", "tabs"), assertion(7, "svc", "has-version", "1", source_type="inferred"), assertion(8, "svc", "has-version", "3"),
    ]
    src = tmp_path / "in"
    schema = spark.createDataFrame([], ASSERTIONS).schema
    put = lambda n, part: spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"b{n}"))
    put(1, rows[:4])
    q = decide_stream(spark.readStream.schema(schema).parquet(str(src / "*")), registry(spark), at("2027-01-01")).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        put(2, rows[4:])
        q.processAllAvailable()
    finally:
        q.stop()
    keep = lambda df: sorted((r.seq, r.status, r.fact_id, tuple(r.targets), r.reason) for r in df.collect())
    assert keep(spark.table("decided")) == keep(assert_batch(spark.createDataFrame(rows, schema), registry(spark), at("2027-01-01")))
