"""Attributes as they were known at event time.

Each event gets, for every attribute slot of its key, the version that was valid at the event's time according to what had been
recorded by then. Versions of a key and slot form a persistent search tree: recording a version, and learning of its closing, each
copy one path and make a new root. An event picks the root that was current at its time and searches that tree on the valid-time
axis for the latest version that isn't closed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.layout import cut, grain_of, time_bounds, time_shards
from factloom.plans.shipping import ship

OPEN = (1 << 63) - 1
ROW = ("__eid", "__slot", "__vid", "__t", "__to", "__known", "__closing")


class VersionTree:
    """Path-copied search tree over versions ordered by (valid from, known from, id).

    A leaf holds the end of its version as known at a root's time, an inner node the latest end below it, so the latest version
    that starts by ``v`` and ends after ``v`` is found in O(log n). An update copies the path from its leaf to the root.
    """

    __slots__ = ("versions", "starts", "times", "roots", "left", "right", "end", "width")

    def __init__(self, versions: list[tuple]):
        """versions: (valid_from, known_from, id, valid_to or None, closing_known_from or None), instants as integers."""
        self.versions = sorted(versions, key=lambda x: x[:3])
        self.starts = [x[0] for x in self.versions]
        self.width = 1 << max(0, (len(self.versions) - 1).bit_length())
        self.left, self.right, self.end = [0], [0], [-OPEN]
        changes = []
        for rank, (_, known, _, to, closing) in enumerate(self.versions):
            closed = to is not None and closing is not None
            if closed and closing > known:
                changes += [(known, rank, OPEN), (closing, rank, to)]
            else:
                changes.append((known, rank, to if closed else OPEN))
        changes.sort()
        self.times, self.roots, root = [], [], 0
        for at, rank, end in changes:
            root = self._put(root, rank, end)
            self.times.append(at)
            self.roots.append(root)

    def _put(self, root: int, rank: int, end: int) -> int:
        left, right, ends = self.left, self.right, self.end
        path, node, half = [], root, self.width >> 1
        while half:
            path.append(node)
            node = right[node] if rank & half else left[node]
            half >>= 1
        ends.append(end)
        left.append(0)
        right.append(0)
        new, half = len(ends) - 1, 1
        for old in reversed(path):
            a, b = (left[old], new) if rank & half else (new, right[old])
            left.append(a)
            right.append(b)
            ends.append(ends[a] if ends[a] > ends[b] else ends[b])
            new = len(ends) - 1
            half <<= 1
        return new

    def find(self, known_at: int, valid_at: int) -> tuple | None:
        """The version with the latest key among those valid at ``valid_at`` as known at ``known_at``, or None."""
        i = bisect_right(self.times, known_at)
        most = bisect_right(self.starts, valid_at)
        if not i or not most:
            return None
        left, right, ends = self.left, self.right, self.end
        stack = [(self.roots[i - 1], 0, self.width)]
        while stack:
            node, low, width = stack.pop()
            if low >= most or ends[node] <= valid_at:
                continue
            if width == 1:
                return self.versions[low]
            half = width >> 1
            stack.append((left[node], low, half))
            stack.append((right[node], low + half, half))  # the later half first
        return None


def _answer(named: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, versions before events; only one shard's versions are held at a time. Gives the columns ``named`` of each hit."""
    group, held, trees = None, {}, {}
    for batch in batches:
        at: list[int] = []
        got: list[tuple] = []
        names = batch.schema.names
        column = {c: batch.column(i).to_pylist() for i, c in enumerate(names) if c in ("__event", *ROW)}
        groups = zip(*(batch.column(i).to_pylist() for i, c in enumerate(names) if c not in column), strict=True)
        for n, (g, event, slot, vid, t, to, known, closing) in enumerate(zip(groups, column["__event"], *(column[c] for c in ROW[1:]), strict=True)):
            if g != group:
                group, held, trees = g, {}, {}
            if not event:
                held.setdefault(slot, []).append((t, known, vid, to, closing))
                continue
            if held:
                trees, held = {s: VersionTree(v) for s, v in held.items()}, {}
            for s, tree in trees.items():
                if (found := tree.find(t, t)) is not None:
                    at.append(n)
                    got.append((s, *found[:3]))
        if at:
            slots, starts, knowns, ids = zip(*got, strict=True)
            rows = batch.take(pa.array(at))
            new = {"__slot": slots, "__vid": ids, "__from": starts, "__since": knowns}
            kinds = {"__slot": batch.schema.field("__slot").type, "__vid": batch.schema.field("__vid").type}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], kinds.get(c, pa.int64())) if c in new else rows.column(names.index(c)) for c in named], names=list(named))


def _blocks(first: str, last: str) -> F.Column:
    """The dyadic blocks (level, number) that tile the shards from ``first`` to ``last``."""
    sql = f"""flatten(transform(sequence(0, 30), j -> CASE
        WHEN shiftright({first} + shiftleft(1, j) - 1, j) >= shiftright({last} + 1, j) THEN array()
        ELSE filter(array(
            CASE WHEN shiftright({first} + shiftleft(1, j) - 1, j) % 2 = 1 THEN struct(j AS level, shiftright({first} + shiftleft(1, j) - 1, j) AS number) END,
            CASE WHEN shiftright({last} + 1, j) % 2 = 1 THEN struct(j AS level, shiftright({last} + 1, j) - 1 AS number) END), x -> x IS NOT NULL) END))"""
    return F.array_distinct(F.expr(sql))


def as_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    keys: list[str],
    slot: str,
    event_id: str,
    event_time: str,
    version_id: str,
    valid_from: str,
    valid_to: str,
    known_from: str,
    closing_known_from: str,
    shard_rows: int = 20_000,
    task_events: int = 500_000,
    grain_seconds: int = 3600,
) -> DataFrame:
    """For every event and slot, the version valid at the event's time and known by then: ``event_id``, ``slot``, ``version_id``.

    A version counts when ``valid_from`` and ``known_from`` are at or before the event and its closing isn't known to have passed:
    ``valid_to`` is null or later, or ``closing_known_from`` is null (never) or later. Of several, the one with the latest
    (valid_from, known_from, version_id) is taken; an event without a version in a slot gives no row there.

    Defined cases: rows with a null key, id, slot, valid_from, known_from or event time take no part; whole repeated rows count once;
    empty inputs give an empty result; other columns of either input are ignored, whatever their names.

    Skew: a key with more than ``shard_rows`` versions is cut into shards of time. A version goes to the shards where it becomes visible
    and where it ends; for the shards between, only the best version that stays visible throughout can win, and it is found
    by a max-aggregate over dyadic blocks of shards, so no version is copied to every shard. A shard with more than ``task_events``
    events is read by several tasks, each with its own copy of that one shard's versions; a burst of versions that no instant parts is dealt
    to several tasks too, each answers the shard's events from its part, and the best answer of an event counts. Without such keys, which one
    count tells, none of this is planned.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    sch_e, sch_v = events.schema, versions.schema
    same = [F.col(k).alias(x) for k, x in zip(keys, ks, strict=True)]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ev = events.select(*same, F.col(event_id).alias("__eid"), micros(event_time).alias("__t")).dropna().dropDuplicates()
    vs = (
        versions.select(*same, F.col(slot).alias("__slot"), F.col(version_id).alias("__vid"), micros(valid_from).alias("__t"), micros(valid_to).alias("__to"), micros(known_from).alias("__known"), micros(closing_known_from).alias("__closing"))
        .dropna(subset=[*ks, "__slot", "__vid", "__t", "__known"])
        .dropDuplicates()
        .withColumn("__seen", F.greatest("__t", "__known"))
        .withColumn("__gone", F.when(F.col("__to").isNull() | F.col("__closing").isNull(), F.lit(OPEN)).otherwise(F.greatest("__to", "__closing")))
        .where("__seen < __gone")
    )
    vs = cut(vs)  # read for the counts and for the answers
    sides = vs.select(*ks, F.lit(1).alias("__v"), F.lit(0).alias("__e")).unionByName(ev.select(*ks, F.lit(0).alias("__v"), F.lit(1).alias("__e")))
    hot = cut(sides.groupBy(*ks).agg(F.sum("__v").alias("__v"), F.sum("__e").alias("__e")).where((F.col("__v") > shard_rows) | (F.col("__e") > task_events)))
    row, at = ROW[1:], [*ks, "__shard", "__part", "__salt"]
    zero = {c: F.lit(0).cast("bigint") for c in at[len(ks) :]}
    parted = False
    if hot.isEmpty():
        tree_rows, ev = vs.withColumns(zero), ev.withColumns(zero)
    else:
        cold = lambda df: df.join(hot, ks, "left_anti").withColumns(zero)
        hot_rows, hot_ev, deals = _in_shards(vs.join(hot, ks, "left_semi"), ev.join(hot, ks, "left_semi"), hot.select(*ks), ks, shard_rows, task_events, grain_seconds * 1_000_000)
        tree_rows, ev = cold(vs).select(*at, *row).unionByName(hot_rows.select(*at, *row)), cold(ev).select(*at, "__eid", "__t").unionByName(hot_ev.select(*at, "__eid", "__t"))
        parted = not deals.where("__parts > 1").isEmpty()
    eid, vid, kind = sch_e[event_id].dataType, sch_v[version_id].dataType, sch_v[slot].dataType
    none = lambda t: F.lit(None).cast(t)
    both = tree_rows.select(*at, F.lit(False).alias("__event"), none(eid).alias("__eid"), *row).unionByName(
        ev.select(*at, F.lit(True).alias("__event"), "__eid", none(kind).alias("__slot"), none(vid).alias("__vid"), "__t", *(none("bigint").alias(c) for c in row[3:]))
    )
    ship(events.sparkSession)
    types = {"__eid": eid, "__slot": kind, "__vid": vid} | {k: both.schema[k].dataType for k in ks}
    named = (*ks, "__t", *ROW[:3], "__from", "__since") if parted else ROW[:3]
    schema = T.StructType([T.StructField(c, types.get(c, T.LongType())) for c in named])
    found = both.repartition(*at).sortWithinPartitions(*at, "__event").mapInArrow(lambda b: _answer(named, b), schema)
    if parted:
        found = found.groupBy(*ks, "__t", "__eid", "__slot").agg(F.max(F.struct("__from", "__since", "__vid")).alias("__best")).select("__eid", "__slot", "__best.__vid")
    return found.select(F.col("__eid").alias(event_id), F.col("__slot").alias(slot), F.col("__vid").alias(version_id))


def _in_shards(vs: DataFrame, ev: DataFrame, hot: DataFrame, ks: list[str], shard_rows: int, task_events: int, grain: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions and events of hot keys with their ``__shard``, ``__part`` (of its versions) and ``__salt`` (of its events); and the dealing, a row per shard."""
    row = ROW[1:]
    shards = cut(time_shards(vs, hot, ks, "__seen", shard_rows, grain))
    bounds = cut(time_bounds(shards, ks))

    def placed(df: DataFrame, instant: str, into: str) -> DataFrame:
        return df.withColumn("__g", grain_of(F.col(instant), grain)).join(shards.withColumnRenamed("__shard", into), [*ks, "__g"]).drop("__g")

    # a key without versions has no bounds, and its events no answer
    ev = placed(ev.join(bounds, ks), "__t", "__shard").drop("__low", "__high")
    spans = cut(placed(placed(vs.join(bounds, ks), "__seen", "__a"), "__gone", "__b").select(*ks, "__a", "__b", *row))
    home = spans.withColumn("__shard", F.explode(F.array_distinct(F.array("__a", "__b")))).select(*ks, "__shard", *row)
    best = F.max(F.struct("__t", "__known", "__vid", "__to", "__closing")).alias("__best")
    spanning = (
        spans.where("__b - __a > 1")
        .withColumn("__block", F.explode(_blocks("(__a + 1)", "(__b - 1)")))
        .groupBy(*ks, "__slot", "__block")
        .agg(best)
        .withColumn("__shard", F.explode(F.expr("sequence(shiftleft(__block.number, __block.level), shiftleft(__block.number + 1, __block.level) - 1)")))
        .groupBy(*ks, "__slot", "__shard")
        .agg(F.max("__best").alias("__best"))
        .select(*ks, "__shard", "__slot", *(F.col(f"__best.{c}") for c in row[1:]))
    )
    tree_rows = home.unionByName(spanning)
    size = home.select(*ks, "__shard", F.lit(1).alias("__v"), F.lit(0).alias("__e")).unionByName(ev.select(*ks, "__shard", F.lit(0).alias("__v"), F.lit(1).alias("__e")))
    share = lambda c, most: F.greatest(F.lit(1), F.ceil(F.sum(c) / most)).cast("bigint")
    # a shard holds the versions that begin in it and those that end in it; far more than that is a burst at one instant
    deals = cut(size.groupBy(*ks, "__shard").agg(share("__v", 4 * shard_rows).alias("__parts"), share("__e", task_events).alias("__salts")))
    of = [*ks, "__shard"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    deal = lambda c, n: F.expr(f"pmod(xxhash64({c}), {n})")
    tree_rows = tree_rows.join(deals, of).withColumn("__part", deal("__vid", "__parts")).withColumn("__salt", every("__salts"))
    ev = ev.join(deals, of).withColumn("__salt", deal("__eid", "__salts")).withColumn("__part", every("__parts"))
    return tree_rows, ev, deals
