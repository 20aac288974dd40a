"""Processing only new or changed records, with the target itself as the state.

Output rows carry the key and version of the source record they come from. The source is anti-joined against the rows the target
already holds, and each run publishes what is left for it as one new target version. There is no offset or watermark that could disagree with the target:
a run that dies before publishing leaves nothing behind, and one that dies after it has done all its work.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Target:
    """A table of immutable files; version N is what the log entries 1 to N name. Readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop
        self._files = self._hadoop.fs.FileContext.getFileContext(self._at("_log").toUri(), spark._jsc.hadoopConfiguration())
        self._fs = self._at("_log").getFileSystem(spark._jsc.hadoopConfiguration())
        log = self._fs.makeQualified(self._at("_log")).toUri()
        self._local = log.getPath() if log.getScheme() == "file" else None
        self._known: dict[int, dict] = {}  # entries never change once they exist

    def _at(self, *parts: str):
        return self._hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The number of published versions."""
        log = self._at("_log")
        if not self._fs.exists(log):
            return 0
        return max((int(n[:-5]) for f in self._fs.listStatus(log) if (n := f.getPath().getName()).endswith(".json") and n[0] != "_"), default=0)

    def entries(self, version: int | None = None) -> list[dict]:
        """The log up to a version, the newest unless told otherwise, oldest first: a snapshot that later versions don't change."""
        return [self._entry(n) for n in range(1, (self.version() if version is None else version) + 1)]

    def read(self, version: int | None = None, entries: list[dict] | None = None) -> DataFrame:
        """All rows of a version, the newest unless told otherwise, or of a snapshot of the log; no rows where nothing was published."""
        paths = [f"{self.path}/{e['data']}" for e in (self.entries(version) if entries is None else entries)]
        # a run without rows has no folder; the folders there are, by one listing of each pass
        passes = {p.rpartition("/")[0] for p in paths if "/__by=" in p}
        there = {f"{q}/{f.getPath().getName()}" for q in passes if self._fs.exists(self._hadoop.fs.Path(q)) for f in self._fs.listStatus(self._hadoop.fs.Path(q))}
        held = [p for p in paths if p in there or "/__by=" not in p]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*held)

    def _entry(self, n: int) -> dict:
        if n not in self._known:
            stream = self._fs.open(self._at("_log", f"{n:012d}.json"))
            try:
                self._known[n] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._known[n]

    def notes(self) -> list[dict]:
        """What the publishers wrote beside each version, oldest first."""
        return [e["note"] for e in self.entries()]

    def write(self, rows: DataFrame, by: str | None = None) -> str:
        """Write ``rows`` under a name of their own, which no version names yet; the name. With ``by``, each of its values has a folder ``<by>=<value>``."""
        data = f"data/{uuid.uuid4().hex}"
        typed = rows.select(*([F.col(by).alias("__by")] if by else []), *(F.col(f.name).cast(f.dataType) for f in self.schema))
        (typed.write.partitionBy("__by") if by else typed.write).parquet(f"{self.path}/{data}")
        return data

    def announce(self, data: str, after: int, note: dict | None = None) -> int:
        """Make written rows the version that follows ``after``; :class:`Conflict`, without effect, if another writer published that one first.

        The version exists from the moment its log entry gets its name, which either happens as a whole or not at all.
        """
        draft, entry = f"_{uuid.uuid4().hex}.json", f"{after + 1:012d}.json"
        text = json.dumps({"data": data, "note": note or {}})
        if self._local:
            self._link(draft, entry, text)
        else:
            self._rename(draft, entry, text)
        return after + 1

    def _link(self, draft: str, entry: str, text: str) -> None:
        """On a POSIX file system: a link of the written draft, which fails where the name is taken."""
        os.makedirs(self._local, exist_ok=True)
        at = os.path.join(self._local, draft)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(at, os.path.join(self._local, entry))
        except FileExistsError as e:
            raise Conflict(f"{entry} exists") from e
        finally:
            os.unlink(at)

    def _rename(self, draft: str, entry: str, text: str) -> None:
        """On any other: a rename of the written draft that doesn't overwrite."""
        out = self._fs.create(self._at("_log", draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(self._at("_log", draft), self._at("_log", entry), none)
        except Py4JJavaError as e:
            self._fs.delete(self._at("_log", draft), False)
            if self._fs.exists(self._at("_log", entry)):
                raise Conflict(f"{entry} exists") from e
            raise

    def publish(self, rows: DataFrame, after: int, note: dict | None = None) -> int:
        """Write ``rows`` and make them the version that follows ``after``; see :meth:`announce`."""
        return self.announce(self.write(rows), after, note)

    def clean(self, older_than_ms: int = 7 * 86_400_000) -> int:
        """Remove what attempts that never published left behind, if it is older; how many folders that were. Younger ones may still be announced."""
        named = {e["data"].split("/")[1] for e in self.entries()}
        folder = self._at("data")
        if not self._fs.exists(folder):
            return 0
        limit = int(self.spark._jvm.java.lang.System.currentTimeMillis()) - older_than_ms
        lost = [f.getPath() for f in self._fs.listStatus(folder) if f.getPath().getName() not in named and f.getModificationTime() <= limit]
        for path in lost:
            self._fs.delete(path, True)
        return len(lost)


def new_records(source: DataFrame, target: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows of ``source`` whose key and version no row of ``target`` has. Null-safe; a source row occurs as often as it came."""
    same = None
    for c in [*keys, version]:
        term = source[c].eqNullSafe(target[c])
        same = term if same is None else same & term
    return source.join(target, same, "left_anti")


def content_version(*columns: str) -> Column:
    """A version made of content: equal for equal values of the columns, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _run_of(at: Column, due: list[tuple[int, int]]) -> Column:
    """The first of the runs (start, id), in order of start, that began at or after an instant: a search tree, so a row costs log n comparisons."""
    if len(due) == 1:
        return F.lit(due[0][1]).cast("bigint")
    half = len(due) // 2
    return F.when(at <= due[half - 1][0], _run_of(at, due[:half])).otherwise(_run_of(at, due[half:]))


def process_runs(source: DataFrame, target: Target, runs: list[tuple[int, int]], *, keys: list[str], version: str, arrived: str, backlog: int = 256) -> Target:
    """Give each new (key, version) of ``source`` to the first run that sees it, and publish a version for each run; returns the target.

    runs: (run id, start in microseconds) of the successful runs not processed yet; the list is the schedule and grows with time, not
    with data. A run sees the rows with ``arrived`` at or before its start. The log is read once; against the target of that version the source is
    anti-joined, and what the target lacks, in whatever window it arrived, is written in one pass with a folder for each due run (up to ``backlog`` of
    them, more take another pass). Then each run's rows are announced, in order, as the version after the one before. So n runs that are due cost one
    reading of source and target, not n, and a scheduled call has one run.

    Each version is one run, whole. A call that dies has announced some of the runs, the rest is prepared anew by the next call. Where another writer
    publishes first, :class:`Conflict` ends the pass before anything of it is announced on top of that, and the runs still due are anti-joined
    again, with the other's rows as part of the target.

    Defined cases: a null key or arrival takes no part; copies of a record count once; a version seen before never counts again; an empty
    source publishes empty versions, no runs none.
    """
    at = F.unix_micros(F.col(arrived).cast("timestamp"))
    rows = source.select(*keys, version, at.alias("__at")).dropna(subset=[*keys, "__at"])
    while True:
        log = target.entries()
        done = {r for e in log for r in e["note"].get("runs", [])}
        due = sorted(((start, run) for run, start in runs if run not in done))[:backlog]
        if not due:
            return target
        seen = rows.where(F.col("__at") <= due[-1][0])
        fresh = new_records(seen, target.read(entries=log), keys, version) if log else seen
        first = fresh.groupBy(*keys, version).agg(F.min("__at").alias("__at")).select(_run_of(F.col("__at"), due).alias("run_id"), *keys, version)
        # a run with many rows gets many tasks, runs with few share one
        data = target.write(first.hint("rebalance", "run_id"), by="run_id")
        try:
            for n, (_, run) in enumerate(due):
                target.announce(f"{data}/__by={run}", len(log) + n, {"runs": [run]})
        except Conflict:
            continue
        if len(due) < backlog:
            return target
