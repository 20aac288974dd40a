import datetime as dt

import pytest
from pyspark.sql import types as T

from factloom.operators.incremental import Conflict, Target, content_version, new_records, process_runs

SCHEMA = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("w", T.StringType()), T.StructField("s", T.LongType()), T.StructField("version", T.StringType())])


def at(n):
    return dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=n)


def micros(n):
    return int(at(n).timestamp() * 1e6)


ROWS = [("a", 1, "x", 1), ("a", 1, "x", 3), ("a", 1, "y", 5), ("a", 1, "x", 9), ("b", 1, None, 2), ("b", 1, None, 2), (None, 1, "x", 2), ("c", 1, "x", None), ("d", 1, "", 100)]
RUNS = [(11, micros(2)), (12, micros(4)), (13, micros(6)), (14, micros(20))]
TRUE = {(11, "a", 1), (11, "b", 1), (13, "a", 1)}


def source(spark, rows=ROWS):
    df = spark.createDataFrame([(w, s, p, None if t is None else at(t), "clash") for w, s, p, t in rows], "w string, s bigint, p string, landed timestamp, run_id string")
    return df.withColumn("version", content_version("p"))


def args():
    return dict(keys=["w", "s"], version="version", arrived="landed")


@pytest.mark.parametrize("per", [1, 3, 256])
def test_each_content_belongs_to_the_first_run_that_sees_it(spark, tmp_path, per):
    target = Target(spark, str(tmp_path / "t"), SCHEMA)
    process_runs(source(spark), target, RUNS, backlog=per, **args())
    assert {tuple(r)[:3] for r in target.read().collect()} == TRUE
    assert target.read().count() == 3
    assert target.version() == 4 and [n["runs"] for n in target.notes()] == [[11], [12], [13], [14]]
    process_runs(source(spark), target, RUNS, backlog=per, **args())  # nothing left to do
    assert target.read().count() == 3


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"), SCHEMA)
    process_runs(source(spark), target, RUNS[:1], **args())
    before = target.read().count()
    (tmp_path / "t/data/half").mkdir()
    source(spark).selectExpr("99L AS run_id", "w", "s", "version").write.parquet(str(tmp_path / "t/data/half/x"))  # written, not published
    assert target.read().count() == before and target.version() == 1
    process_runs(source(spark), target, RUNS, **args())
    assert {tuple(r)[:3] for r in target.read().collect()} == TRUE


@pytest.mark.parametrize("posix", [True, False])
def test_only_one_of_two_writers_publishes_a_version(spark, tmp_path, posix):
    target = Target(spark, str(tmp_path / "t"), SCHEMA)
    assert target._local
    if not posix:
        target._local = None  # as on a file system without links
    rows = spark.createDataFrame([(1, "a", 1, "v")], SCHEMA)
    assert target.publish(rows, 0) == 1
    with pytest.raises(Conflict, match="exist"):
        target.publish(rows, 0)
    assert target.version() == 1 and target.read().count() == 1
    assert target.publish(rows, 1) == 2 and target.read(1).count() == 1


def test_a_version_published_in_between_is_neither_lost_nor_repeated(spark, tmp_path):
    class Raced(Target):
        raced = False

        def read(self, version=None, entries=None):
            got = super().read(version, entries)
            if not self.raced:
                # another writer processes the second run between this one's reading of the log and its announcing
                self.raced = True
                process_runs(source(spark), Target(spark, self.path, SCHEMA), RUNS[1:2], **args())
            return got

    target = Raced(spark, str(tmp_path / "t"), SCHEMA)
    target.publish(spark.createDataFrame([], SCHEMA), 0, {"runs": [10]})
    process_runs(source(spark), target, RUNS, **args())
    got = [tuple(r)[:3] for r in target.read().collect()]
    # the other writer saw what arrived before its run started, also what an earlier one would have taken
    assert sorted(got) == [(12, "a", 1), (12, "b", 1), (13, "a", 1)]
    assert [n["runs"] for n in target.notes()] == [[10], [12], [11], [13], [14]]
    assert target.clean(older_than_ms=0) == 1 and target.clean() == 0 and target.read().count() == 3


def test_a_record_that_lands_late_with_an_old_stamp_is_caught(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"), SCHEMA)
    process_runs(source(spark), target, RUNS[:3], **args())
    late = [*ROWS, ("e", 1, "x", 1)]
    process_runs(source(spark, late), target, RUNS, **args())
    assert {tuple(r)[:3] for r in target.read().collect()} == TRUE | {(14, "e", 1)}


def test_empty_source_and_null_safe_anti_join(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"), SCHEMA)
    assert target.read().count() == 0
    process_runs(source(spark, []), target, RUNS, **args())
    assert target.read().count() == 0
    a = spark.createDataFrame([(None, 1, "v"), ("x", 1, "v")], "w string, s bigint, version string")
    b = spark.createDataFrame([(None, 1, "v")], "w string, s bigint, version string")
    assert [tuple(r) for r in new_records(a, b, ["w", "s"], "version").collect()] == [("x", 1, "v")]
