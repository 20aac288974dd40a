"""Filling containers of fixed capacity with whole items.

Items are dealt to shards of bounded size and put into one bin after another (next fit). A local search then moves one item, swaps one for one or two for one
between bins that aren't full, whenever that raises the sum of squared fills; squares reward one full bin beside an emptier one, so bins drain
until they are empty. The bins that stay loose are dealt to new shards as they are, and the search goes on over what all shards left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.layout import cut
from factloom.plans.shipping import ship


class Bins:
    """Bins of one shard. Sizes are positive and at most the capacity."""

    def __init__(self, capacity: int, sizes: list[int], start: list[list[int]] | None = None):
        """start: the items of each bin; without it items go into one bin after another, the largest first (next fit): a third of the space may be empty."""
        self.capacity, self.sizes = capacity, sizes
        if start is None:
            start, left = [], 0
            for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
                if sizes[i] > left:
                    start.append([])
                    left = capacity
                start[-1].append(i)
                left -= sizes[i]
        self.items = [sorted(b, key=lambda i: sizes[i]) for b in start]
        self.fill = [sum(sizes[i] for i in b) for b in start]
        self.room: list[tuple[int, int]] = []  # (gap, bin) of the loose bins, sorted
        self.reach: list[tuple[int, int, int, int]] = []  # (size + gap, size, bin, item) of their items, sorted: how large a swap partner may be

    def _enter(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if gap > 0 and self.items[b]:
            insort(self.room, (gap, b))
            for i in self.items[b]:
                insort(self.reach, (self.sizes[i] + gap, self.sizes[i], b, i))

    def _leave(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if gap > 0 and self.items[b]:
            del self.room[bisect_left(self.room, (gap, b))]
            for i in self.items[b]:
                del self.reach[bisect_left(self.reach, (self.sizes[i] + gap, self.sizes[i], b, i))]

    def search(self, donors: int | None = None, passes: int | None = None) -> None:
        """Local search until a pass over all bins changes nothing; at most ``passes`` of them, over the ``donors`` emptiest bins, where given.

        In a pass the emptiest bins come first. A bin gives what it can: the exchange that raises the squares most is made, until it has none left or is
        empty. Every exchange raises the sum of squares, a whole number with a bound, so the search ends.
        """
        n = 0
        while passes is None or n < passes:
            n += 1
            loose = sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: (self.fill[b], b))
            self.room, self.reach = [], []
            for b in loose:
                gap = self.capacity - self.fill[b]
                self.room.append((gap, b))
                self.reach += [(self.sizes[i] + gap, self.sizes[i], b, i) for i in self.items[b]]
            self.room.sort()
            self.reach.sort()
            changed = False
            for b in loose[:donors]:
                while (step := self.best(b)) is not None:
                    self._make(b, *step)
                    changed = True
            if not changed:
                return

    def best(self, a: int) -> tuple[tuple[int, ...], int | None, int] | None:
        """The exchange of bin ``a`` that raises the sum of squares most: (items given, item taken or None, receiver), or None.

        For each item, and each pair of items that is taken against one, the receiver is looked up that is left with the least gap.
        """
        sizes, mine, have = self.sizes, self.items[a], self.fill[a]
        most, found = 0, None
        for i in reversed(mine):
            s = sizes[i]
            for at in range(bisect_left(self.room, (s, -1)), len(self.room)):
                gap, b = self.room[at]
                if b != a:
                    gain = s * (self.capacity - gap - have + s)
                    if gain > most:
                        most, found = gain, ((i,), None, b)
                    break
        if found is not None:
            return found
        last = 0
        for i in reversed(mine):
            if sizes[i] != last:
                last = sizes[i]
                most, found = self._swap(a, (i,), last, most, found)
        for x in range(len(mine) - 1, 0, -1):
            for y in range(x - 1, -1, -1):
                if y < x - 1 and sizes[mine[y]] == sizes[mine[y + 1]]:
                    continue
                most, found = self._swap(a, (mine[x], mine[y]), sizes[mine[x]] + sizes[mine[y]], most, found)
        return found

    def _swap(self, a: int, given: tuple[int, ...], size: int, most: int, found):
        reach, have = self.reach, self.fill[a]
        for at in range(bisect_left(reach, (size, -1)), len(reach)):
            full, s, b, j = reach[at]
            if full - size >= size:
                break  # what is left of such gaps is more than the exchange is worth
            if b == a or s >= size:
                continue
            d = size - s
            gain = d * (self.capacity - (full - s) - have + d)
            if gain > most:
                most, found = gain, (given, j, b)
            break
        return most, found

    def _make(self, a: int, given: tuple[int, ...], taken: int | None, b: int) -> None:
        self._leave(a)
        self._leave(b)
        for i in given:
            self._put(i, a, b)
        if taken is not None:
            self._put(taken, b, a)
        self._enter(a)
        self._enter(b)

    def _put(self, i: int, a: int, b: int) -> None:
        self.items[a].remove(i)
        insort(self.items[b], i, key=lambda x: self.sizes[x])
        self.fill[a] -= self.sizes[i]
        self.fill[b] += self.sizes[i]


def _pack(tag: str, donors: int | None, passes: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches the shards of a partition, which come sorted; a shard's size is bounded. Columns: pack, shard, bin, first, capacity, size, and what is kept.

    Items that have a bin start in it, others by next fit; ``first`` is the bin an item was put in first.
    """
    current, rows = None, []

    def done(schema: pa.Schema) -> pa.RecordBatch:
        start: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            start.setdefault(r[0], []).append(i)
        sizes = [r[3] for r in rows]
        bins = Bins(rows[0][2], sizes, None if None in start else list(start.values()))
        first = {i: f"{tag}{current[1]}-{n}" for n, items in enumerate(bins.items) for i in items} if None in start else {}
        bins.search(donors, passes)
        out = [(current[0], f"{tag}{current[1]}-{n}", first.get(i, rows[i][1]), *rows[i][2:], f) for n, (items, f) in enumerate(zip(bins.items, bins.fill, strict=True)) for i in items]
        names = [schema.names[0], *schema.names[2:], "fill"]
        kinds = [schema.field(c).type if c in schema.names else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = None
    for batch in batches:
        schema = batch.schema
        for pack_, shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (pack_, shard) != current:
                if rows:
                    yield done(schema)
                current, rows = (pack_, shard), []
            rows.append(tuple(row))
    if rows:
        yield done(schema)


def _small(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A table of rows the driver holds; broadcast while they are few."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= 1000 else df


def pack(
    items: DataFrame, capacities: DataFrame, *, id: str, size: str, pack_id: str, capacity: str,
    shard_items: int = 4000, rounds: int = 3, seed: int = 3, loose_below: float = 1.0, donors: int | None = None, passes: int | None = None,
) -> DataFrame:
    """The bin of every item, for every capacity: ``pack_id``, ``id``, ``part``, ``part_size``, ``bin_id``, ``bin_fill``, ``first_bin``.

    An item above the capacity is cut into parts of exactly the capacity, bins of their own, and a rest that is packed like an item; no other item
    is split. Capacities are a list of container kinds, a few rows, each of which all items are packed into. ``first_bin`` is where the item was put before
    the search, so that counting bins before and after tells what the search did.

    Shards: items are dealt by a hash, into so many shards that one holds about ``shard_items``; a round's loose bins (filled below
    ``loose_below`` of the capacity, by default all that aren't full) are dealt again, bins whole, into as many fewer shards as they hold fewer items. After
    the last of ``rounds`` every bin stands. The waste is that of a few loose bins in the last round's shards, not of a few in every shard. Within a shard
    the search ends where no exchange is left; ``donors`` and ``passes`` end it sooner, see :meth:`Bins.search`.

    Defined cases: items of null, zero or negative size take no room: they get one row with part 0, part_size 0 and a null bin; null ids
    are items like others; repeated rows are items of their own; a capacity that is null or below 1 packs nothing; empty tables give no rows;
    other columns are ignored.
    """
    spark = items.sparkSession
    kinds = capacities.select(F.col(pack_id).cast("string").alias("pack"), F.col(capacity).cast("bigint").alias("capacity")).where("capacity >= 1").dropDuplicates(["pack"])
    sizes = cut(items.select(F.col(id).alias("__id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("__size")).withColumn("piece", F.monotonically_increasing_id()))
    # every item goes into every kind of container: the kinds are joined as one array, a row beside each item
    listed = kinds.agg(F.collect_list(F.struct("pack", "capacity")).alias("kinds"))
    both = sizes.join(F.broadcast(listed)).withColumn("k", F.explode("kinds")).select("__id", "__size", "piece", "k.pack", "k.capacity").withColumn("part", F.expr("__size div capacity"))
    none = F.lit(None).cast("string")
    pool = both.withColumn("size", F.col("__size") % F.col("capacity")).where("size > 0").select("pack", none.alias("bin"), none.alias("first"), "capacity", "size", "piece", "__id", "part")
    out = lambda df: df.select(F.col("pack").alias(pack_id), F.col("__id").alias(id), "part", F.col("size").alias("part_size"), F.col("bin").alias("bin_id"), F.col("fill").alias("bin_fill"), F.col("first").alias("first_bin"))
    whole = both.where("part > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("part") - 1))).withColumn("bin", F.concat_ws("-", F.lit("whole"), "piece", "part"))
    done = [out(whole.withColumns({"size": F.col("capacity"), "fill": F.col("capacity"), "first": F.col("bin")}))]
    done.append(out(both.where("__size = 0").withColumns({"size": F.lit(0).cast("bigint"), "bin": none, "first": none, "fill": F.lit(None).cast("bigint")})))
    schema = T.StructType([*pool.schema.fields, T.StructField("fill", T.LongType())])
    ship(spark)
    for n in range(rounds):
        held = pool.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per container kind
        if not held:
            break
        shards = _small(spark, [(r.pack, -(-r.n // shard_items)) for r in held], "pack string, shards bigint")
        dealt = pool.join(shards, "pack").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + n), F.coalesce("bin", F.col("piece").cast("string"))), F.col("shards")))
        ordered = dealt.select("pack", "shard", *pool.columns[1:]).repartition("pack", "shard").sortWithinPartitions("pack", "shard", "piece")
        packed = cut(ordered.mapInArrow(lambda b, tag=f"{n}-": _pack(tag, donors, passes, b), schema))
        loose = F.col("fill") < F.col("capacity") * loose_below
        done.append(out(packed if n == rounds - 1 else packed.where(~loose)))
        pool = packed.where(loose).drop("fill")
    result = done[0]
    for df in done[1:]:
        result = result.unionByName(df)
    return result


def fill_report(packed: DataFrame, capacities: DataFrame, *, pack_id: str, capacity: str) -> DataFrame:
    """Per container kind: bins before the search and after it, tokens, the least number of bins any packing needs, and the share of space that is filled."""
    kinds = capacities.select(pack_id, F.col(capacity).alias("capacity")).dropDuplicates([pack_id])
    total = packed.groupBy(pack_id).agg(F.countDistinct("first_bin").alias("first_bins"), F.countDistinct("bin_id").alias("bins"), F.sum("part_size").alias("tokens"))
    return total.join(kinds, pack_id).select(pack_id, "capacity", "first_bins", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("filled"))
