import random

import pytest

from factloom.llm.packing import Bins, fill_report, pack

ITEMS = "id bigint, n bigint, bin_id string"


def run(spark, items, kinds, **kw):
    it = spark.createDataFrame([(i, n, "clash") for i, n in items], ITEMS)
    ks = spark.createDataFrame(kinds, "kind string, cap bigint")
    return pack(it, ks, id="id", size="n", pack_id="kind", capacity="cap", **kw), ks


def test_whole_and_cut_items(spark):
    items = [(1, 10), (2, 25), (3, 0), (4, None), (5, 9), (6, 1), (7, -3), (None, 4), (2, 25), (8, 20)]
    rows = run(spark, items, [("k", 10), ("none", None), ("zero", 0), ("k", 10)])[0].collect()
    assert {r.kind for r in rows} == {"k"}
    fill = {}
    for r in rows:
        if r.bin_id is not None:
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.part_size
            assert r.bin_fill <= 10
    assert all(f == r.bin_fill for r in rows if r.bin_id for f in [fill[r.bin_id]])
    assert sorted((r.part, r.part_size) for r in rows if r.id == 2) == [(0, 10), (0, 10), (1, 10), (1, 10), (2, 5), (2, 5)]
    assert [(r.part, r.part_size) for r in rows if r.id == 8] == [(0, 10), (1, 10)] or sorted((r.part, r.part_size) for r in rows if r.id == 8) == [(0, 10), (1, 10)]
    assert [(r.part_size, r.bin_id) for r in rows if r.id in (3, 4, 7)] == [(0, None)] * 3
    assert sum(r.part_size for r in rows) == 10 + 25 + 9 + 1 + 4 + 25 + 20
    assert len([r for r in rows if r.id == 1]) == len([r for r in rows if r.id == 5]) == 1
    assert len(fill) == 10


def test_shards_lose_little(spark):
    r = random.Random(4)
    items = [(i, min(5000, max(1, int(r.lognormvariate(5, 0.9))))) for i in range(6000)]
    packed, ks = run(spark, items, [("s", 512), ("l", 8192)], shard_items=500)
    rows = packed.collect()
    for kind in "sl":
        assert sum(x.part_size for x in rows if x.kind == kind) == sum(n for _, n in items)
    for x in fill_report(packed, ks, pack_id="kind", capacity="cap").collect():
        assert x.filled > 0.99 and x.first_bins > 1.05 * x.bins and x.bins >= x.least_bins


def test_empty(spark):
    assert run(spark, [], [("k", 10)])[0].count() == 0
    assert run(spark, [(1, 5)], [])[0].count() == 0


def squares(b):
    return sum(f * f for f in b.fill)


def best_fit(capacity, sizes):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [x for x in room if x >= s]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - s)
    return len(room)


def used(b):
    return sum(f > 0 for f in b.fill)


@pytest.mark.parametrize("seed", range(4))
def test_search_raises_squares_and_empties_bins(seed):
    r = random.Random(seed)
    sizes = [r.randrange(1, 100) for _ in range(300)]
    b = Bins(100, sizes)
    before, bins = squares(b), used(b)
    b.search()
    assert squares(b) > before and used(b) < 0.9 * bins and used(b) <= 1.06 * best_fit(100, sizes)
    assert sorted(i for items in b.items for i in items) == list(range(300))
    assert all(sum(sizes[i] for i in items) == f <= 100 for items, f in zip(b.items, b.fill, strict=True))
    # it ended where no exchange is left: tried one by one
    for a, mine in enumerate(b.items):
        for c, other in enumerate(b.items):
            if a == c or not mine or not other:
                continue
            gives = [(sizes[i],) for i in mine] + [(sizes[i], sizes[j]) for n, i in enumerate(mine) for j in mine[:n]]
            for give in gives:
                for take in [0] * (len(give) == 1) + [sizes[j] for j in other]:
                    d = sum(give) - take
                    fits = d > 0 and b.fill[c] + d <= 100 and b.fill[c] < 100 and b.fill[a] < 100
                    assert not (fits and d * (b.fill[c] - b.fill[a] + d) > 0 and b.best(a) is None)


def test_fewer_donors_or_passes_end_the_search_sooner():
    r = random.Random(1)
    sizes = [r.randrange(1, 100) for _ in range(400)]
    whole, few = Bins(100, sizes), Bins(100, sizes)
    whole.search()
    few.search(donors=5, passes=1)
    assert used(whole) < used(few)


def test_search_finds_what_best_fit_misses():
    sizes = [12, 1, 25, 10, 31, 9, 1, 7, 7, 41]  # three bins of 48 exactly
    b = Bins(48, sizes)
    assert best_fit(48, sizes) == used(b) == 4
    b.search()
    assert used(b) == 3


def test_exchanges():
    cases = [
        (10, [7, 3], [[0], [1]], ((1,), None)),  # move
        (10, [6, 3, 4], [[0, 1], [2]], ((2,), 1)),  # one for one: 4 for 3
        (10, [5, 4, 3, 2], [[0, 1], [2, 3]], ((2, 3), 1)),  # two for one: 3 + 2 for 4
        (10, [5, 4, 4], [[0, 1], [2]], None),
    ]
    for capacity, sizes, start, step in cases:
        b = Bins(capacity, sizes, start)
        for i in range(len(start)):
            b._enter(i)
        got = b.best(1)
        if step is None:
            assert got is None
            continue
        assert (set(got[0]), got[1], got[2]) == (set(step[0]), step[1], 0)
        before = squares(b)
        b._make(1, *got)
        assert squares(b) > before and b.fill[0] == capacity


def test_later_rounds_go_on_from_the_bins_there_are(spark):
    r = random.Random(7)
    items = [(i, r.randrange(1, 60)) for i in range(3000)]
    bins = []
    for rounds in (1, 3):
        packed, _ = run(spark, items, [("k", 100)], shard_items=100, rounds=rounds)
        rows = packed.collect()
        assert sorted(x.id for x in rows) == list(range(3000)) and all(x.bin_fill <= 100 for x in rows)
        bins.append((len({x.bin_id for x in rows}), len({x.first_bin for x in rows})))
    assert bins[1][0] < bins[0][0] < bins[0][1] == bins[1][1]
