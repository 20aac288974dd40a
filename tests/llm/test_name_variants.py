import random

import pytest

from factloom.llm import name_variants as V
from factloom.llm.name_parts import Lexicon, Name, edits, monge_elkan, same_word, tokens

FORMS = [("Alex", "Alexander", "given"), ("Xander", "Alexander", "given"), ("Sam", "Samantha", "given"), ("Sam", "Samuel", "given"), ("Tony", "Anthony", "given"), ("Bob", "Robert", "given"), ("Ltd", "Limited", "org-word"), ("Svcs", "Services", "org-word"), ("Analyt", "Analytics", "org-word")]
LEX = Lexicon(FORMS, ["cloud", "signal", "media"])
SCHEMA = "id string, name string, type string, scope string, aliases array<string>, norm_name string, cluster string"


def clusters(spark, rows):
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], SCHEMA)
    forms = spark.createDataFrame(FORMS, "form string, full_form string, kind string")
    out = {}
    for r in V.link_names(df, forms).collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(x) for x in out.values()}


def test_edits():
    assert edits("abc", "acb", 2) == 1 and edits("abc", "abc", 0) == 0 and edits("kitten", "sitting", 5) == 3 and edits("a", "abcdef", 2) == 3


def test_reading():
    n = Name("Dr. Alexandsr Dilig\u00faturo", LEX)
    assert n.keys == ["diliguturo"] and n.given == {"alexander"}
    assert Name("Sam D1liguturo", LEX).given == {"samantha", "samuel"} and Name("Sam D1liguturo", LEX).keys == ["diliguturo"]
    assert Name("Diliguturo, A.", LEX).prefix == "a"
    assert Name("SamuelDiliguturo", LEX).given == {"samuel"} and Name("tugeporedo61", LEX).keys == ["tugeporedo"]
    o = Name("Ziyupamemu Signal Analyt. Division 6, Ltd", LEX)
    assert o.keys == ["ziyupamemu"] and o.number == "6" and o.org
    o = Name("ZiyupamemuSignalAnalytics6", LEX)
    assert o.keys == ["ziyupamemu"] and o.number == "6" and Name("Samuel Diligutur0", LEX).keys == ["diliguturo"] and Name("Samuel Diliguturo 2", LEX).number == ""
    assert Name("Jehufuvama DG", LEX).org and not Name("Jehufuvama DG", LEX, "person").org and Name("jehufuvama", LEX, "org").firm and not Name("jehufuvama", LEX, "org").org
    assert tokens("BelalepaRouter x_y") == ["belalepa", "router", "x", "y"]


def test_monge_elkan():
    like = lambda a, b: monge_elkan(Name(a, LEX), Name(b, LEX))
    assert like("Tony Felipufete", "Felipufete, Anthony") == 1.0
    assert like("A. Felipufete", "Anthony Felipufefe") >= 0.8
    assert like("Robert Felipufete", "Anthony Felipufete") == 0.0
    assert like("Xehira Media 8", "Xehira Media 9") == 0.0
    assert like("Robert Felipufete", "Robert Gowelonafu") < 0.8


def test_banding_follows_the_collision_curve():
    bands, rows = V.choose_bands(0.5, 0.97, 240)
    assert V.collision(0.5, bands, rows) >= 0.97 and V.collision(0.5, 240 // (rows + 1), rows + 1) < 0.97
    assert V.choose_bands(0.01, 1.0, 10) == (10, 1)


def test_candidates_reach_the_recall_they_are_tuned_for(spark):
    r = random.Random(5)
    make = lambda: "".join(r.choice("bcdfghjklmnprstvz") + r.choice("aeiou") for _ in range(5))
    words = [make() for _ in range(300)]

    def slip(w):
        i = r.randrange(len(w) - 1)
        return r.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "q" + w[i + 1 :]])

    uses = {w: 5 for w in words}
    for w in words:
        uses.setdefault(slip(w), 1)
        uses.setdefault(slip(slip(w)), 1)
    df = spark.createDataFrame(list(uses.items()), "word string, n bigint")
    links = {(x.a, x.b) for x in V.word_links(df, similarity=0.2, recall=0.95).collect()}
    assert all(same_word(a, b) and (b, a) in links for a, b in links)
    ws = list(uses)
    truth = {(a, b) for a in words for b in ws if a != b and same_word(a, b)}
    assert len(truth & links) / len(truth) >= 0.9


def test_stars_equal_the_sequential_rule(spark):
    r = random.Random(8)
    names = [f"w{i:02d}" for i in range(40)]
    uses = {w: r.randrange(4) for w in names}
    pairs = {tuple(r.sample(names, 2)) for _ in range(60)}
    links = pairs | {(b, a) for a, b in pairs}
    order = sorted(names, key=lambda w: (-uses[w], w))
    centre = {}
    for w in order:
        above = [x for x in order[: order.index(w)] if (x, w) in links and centre[x] == x]
        centre[w] = above[0] if above else w
    got = V.stars(spark.createDataFrame(list(links), "a string, b string"), spark.createDataFrame(list(uses.items()), "word string, n bigint")).collect()
    linked = {a for a, _ in links}
    assert {x.word: x.centre for x in got} == {w: c for w, c in centre.items() if w in linked}


def test_people_and_firms(spark):
    rows = [
        ("e1", "Alexander Diliguturo", "person", "p", []), ("e2", "diliguturo-alexander", "person", "p", None), ("e3", "Xander Diligutur0", None, "q", ["founder"]), ("e4", "adiliguturo", "person", "p", ["@x"]),
        ("e5", "Robert Diliguturo", "person", "p", []), ("e6", "Bob Diligtuuro", "person", "p", []), ("e7", "tugeporedo61", "person", "p", ["Dr. Robert Diliguturo", "on-call lead"]),
        ("e8", "Ziyupamemu Cloud Services Limited", "org", "p", []), ("e9", "Cloud Services, Ziyupamemu", "org", "q", None), ("ea", "Ziyupamemu Cloud Svcs. 4", "org", "p", []), ("eb", "Ziyupamemu Cloud Services No. 4, Ltd", "org", "p", []),
        ("ec", "diliguturo.batch", "service", "p", ["Alexander Diliguturo"]), ("ed", None, "person", "p", None), ("ee", "", "person", "p", []), ("ef", "Samuel Gowelonafu", "person", "p", []), ("ef", "Samuel Gowelonafu", "person", "p", []),
        (None, "Samuel Gowelonafu", "person", "p", []), ("eg", "x" * 5000, "person", "p", []),
    ]
    got = clusters(spark, rows)
    assert frozenset({"e1", "e2", "e3", "e4"}) in got
    assert frozenset({"e5", "e6", "e7"}) in got
    assert frozenset({"e8", "e9"}) in got and frozenset({"ea", "eb"}) in got
    assert frozenset({"ef"}) in got
    assert not any(x & {"ec", "ed", "ee"} for x in got)


def test_ambiguous_names_join_none(spark):
    rows = [("a", "Alexander Diliguturo", "person", "p", []), ("b", "Anthony Diliguturo", "person", "p", []), ("c", "A. Diliguturo", "person", "q", []), ("d", "Anthony Diliguturo", "person", "s", []), ("e", "A. Diliguturo", "person", "s", [])]
    got = clusters(spark, rows)
    assert frozenset({"a"}) in got and frozenset({"b", "d", "e"}) in got and not any("c" in x for x in got)


def test_empty(spark):
    assert clusters(spark, []) == set()


def test_pairs(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "c"), ("y", "d")], "cluster string, id string")
    assert {tuple(r) for r in V.linked_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


@pytest.mark.parametrize("n", [600])
def test_hot_name(spark, n):
    rows = [(f"h{i:04d}", "Robert Gowelonafu" if i % 2 else "Bob Gowelonafu", "person", "p", None) for i in range(n)]
    assert clusters(spark, rows) == {frozenset(r[0] for r in rows)}


def test_hot_family_with_many_given_names(spark):
    given = "Alexander Samantha Anthony Robert Benjamin Christopher Josephine Frederick Isabella Michael Patricia Gabriel Victoria Leonard Dorothy Theodore Nicholas Margaret".split()
    hot = [(f"h{k}{i:02d}", f"{g} Gowelonafu" if k else f"Gowelonafu, {g}", "person", "p", None) for i, g in enumerate(given) for k in range(2)]
    family = ["Diliguturo", "Felipufete", "Zacomabeki", "Hujanirova", "Bekosawimu", "Tarupegoda", "Milovexaca", "Yunebasiko"]
    other = [(f"o{i:02d}", f"{given[i % 9]} {f}", "person", "p", None) for i, f in enumerate(family * 9)]
    rows = [*hot, *other, ("hs", "Robert Gowelonaffu", None, "q", None)]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], SCHEMA)
    got = {}
    for r in V.link_names(df, spark.createDataFrame([(g[:3], g, "given") for g in given], "form string, full_form string, kind string")).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {x for c in got.values() for x in c} == {r[0] for r in rows}
    for i in range(len(given)):
        assert {f"h0{i:02d}", f"h1{i:02d}"} | ({"hs"} if given[i] == "Robert" else set()) in got.values()


def test_firms_of_common_words_alone_have_keys():
    assert Name("Cloud Signal Ltd", LEX, "org").keys == ["cloud", "signal"] and Name("Ziyupamemu Cloud Ltd", LEX, "org").keys == ["ziyupamemu"]
    n = Name("Robert Signal", LEX)
    assert n.keys == ["signal"] and not n.firm


def test_names_with_two_distinctive_words(spark):
    rows = [("a", "Samuel Fernandez Lopez", "person", "p", []), ("b", "Samuel Gonzalez Fernandez", "person", "p", []), ("c", "Samuel Lopez", "person", "q", []), ("d", "Samuel Ferrnandez", "person", "q", []), ("e", "Lopez, Samuel Fernandez", "person", "r", None)]
    got = clusters(spark, rows)
    assert not any({"a", "b"} <= x for x in got) and any({"a", "c", "e"} <= x for x in got)
    assert {i for x in got for i in x} >= {"a", "b", "c", "e"}


def test_clusters_that_share_a_row_are_one(spark):
    chain = [(f"c{i:02d}", f"r{j:02d}") for i in range(20) for j in (i, i + 1)]
    df = spark.createDataFrame([*chain, ("z", "y"), ("z", "z")], "cluster string, id string")
    assert {tuple(r) for r in V.joined(df).collect()} == {("c00", f"r{j:02d}") for j in range(21)} | {("z", "y"), ("z", "z")}


def test_names_without_a_long_word_of_their_own(spark):
    rows = [("a", "Anna Koch", "person", "p", []), ("b", "A. Koch", "person", "p", []), ("c", "Jun Kim", "person", "p", []), ("d", "Kim, Jun", "person", "q", None), ("e", "IBM Ltd", "org", "p", []), ("f", "IBM Limited", "org", "q", [])]
    rows += [("g", "Samuel Roberts", "person", "p", []), ("h", "Roberts, Samuel", "person", "q", []), ("i", "Anthony Roberts", "person", "p", []), ("j", "S. Roberts", "person", "p", []), ("k", "Samuel", "person", "p", []), ("l", "Anna Kock", "person", "p", [])]
    got = clusters(spark, rows)
    assert {frozenset("ab"), frozenset("cd"), frozenset("ef"), frozenset("ghj"), frozenset("i"), frozenset("k"), frozenset("l")} == got


def test_every_reading_of_a_row_counts(spark):
    rows = [("a", "Samuel Gowelonafu", "person", "p", ["on-call lead", "Samuel Diliguturo", "Samuel Felipufete"]), ("b", "Samuel Diliguturo", "person", "p", []), ("c", "S. Felipufete", "person", "q", None), ("d", "Anthony Felipufete", "person", "q", ["on-call lead"])]
    rows += [("e", "Ziyupamemu Cloud Services", "org", "p", ["Jalijabebi Media Services"]), ("f", "Jalijabebi Media Services Ltd", "org", "p", []), ("g", "tugeporedo61", "person", "p", ["Robert Zacomabeki"]), ("h", "tugeporedo61", "person", "q", [])]
    df = spark.createDataFrame([*((*r, None, "clash") for r in rows), ("i", "Anthony Hujanirova", "person", "p", None, "robertzacomabeki", "clash"), ("j", "Anthony Bekosawimu", "person", "p", None, "anthonybeko", "clash")], SCHEMA)
    got = {}
    for r in V.link_names(df, spark.createDataFrame(FORMS, "form string, full_form string, kind string")).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(x) for x in got.values()} == {frozenset("abc"), frozenset("d"), frozenset("ef"), frozenset("ghi"), frozenset("j")}


@pytest.mark.parametrize("finish", [0, 3, 10**6])
def test_stars_of_a_long_chain(spark, finish):
    # each word is like its neighbours only: every other one is a centre, and rounds or one task tell the same
    n = 24 if finish < 10 else 400
    names = [f"w{i:03d}" for i in range(n)]
    links = [(a, b) for a, b in zip(names, names[1:], strict=False)]
    got = V.stars(spark.createDataFrame(links + [(b, a) for a, b in links], "a string, b string"), spark.createDataFrame([(w, 1) for w in names], "word string, n bigint"), finish_rows=finish).collect()
    assert {x.word: x.centre for x in got} == {w: names[i - i % 2] for i, w in enumerate(names)}


def test_buckets_of_any_size_are_compared_in_blocks():
    r = random.Random(3)
    make = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(4))
    words = list(dict.fromkeys([make() for _ in range(300)] + [w[:3] + "x" + w[3:] for w in [make() for _ in range(10)]]))
    words += [w[1:] + "z" for w in words[:50]]
    leaders, links = [], set()
    for w in words:
        hits = [x for x in leaders if same_word(x, w)]
        links |= {(x, w) for x in hits}
        if not hits:
            leaders.append(w)
    for size in (1, 5, 37, 1000):
        held, got = V.Leaders(V.Signed()), []
        for i in range(0, len(words), size):
            got += held.add(words[i : i + size], i + size >= len(words))
        assert set(got) == links and len(got) == len(links)
    for a, b in (("winkler", "wniklre"), ("abcdefgh", "xabcdefgh"), ("koch", "kock"), ("aaaaaaaaa", "aaaaaaa")):
        table = V.Signed().table([a, b])
        assert V.may_be_one(table, table)[0, 1] or not same_word(a, b)


def test_a_family_is_compared_by_what_its_names_say():
    import time

    given = [f"g{a}{b}{c}{d}a" for a in "bcdfg" for b in "aeiou" for c in "lmnr" for d in "aeiou"]
    lexicon = Lexicon([(g, g, "given") for g in given])

    def took(n):
        family, began = V.Family(lexicon), time.perf_counter()
        for i in range(n):
            x = Name(f"{given[i % 500]} Gowelonafu", lexicon, "person")
            at, new = family.find(x, "p")
            if new:
                family.add(x, i, "p")
            else:
                family.see(at, "p")
        return time.perf_counter() - began, len(family.all)

    took(500)
    (few, a), (many, b) = took(2000), took(8000)
    assert a == b == 500 and many < 9 * few  # in proportion, not by the square


def test_a_bucket_links_all_words_but_those_with_a_leader_in_common():
    r = random.Random(4)
    base = ["".join(r.choice("bcdfgk") + r.choice("aeiou") for _ in range(4)) for _ in range(6)]
    words = list(dict.fromkeys(w[:i] + c + w[i + 1 :] for w in base for i in range(8) for c in "xyz"[: 1 + i % 3]))
    r.shuffle(words)
    alike = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if same_word(a, b)}
    plain = V.Leaders(V.Signed()).add(words, True)
    for size in (1, 7, 1000):
        held, got = V.Leaders(V.Signed(), rest=True), []
        for i in range(0, len(words), size):
            got += held.add(words[i : i + size], i + size >= len(words))
        assert set(plain) <= set(got) <= alike and len(got) == len(set(got))
        led = {w: {a for a, b in plain if b == w} for w in words}
        assert all((a, b) in set(got) or led[a] & led[b] for a, b in alike)
    few = ["zacomabeki", "vecotibuko", "zacomabuko", "zacotibuko"]
    assert set(V.Leaders(V.Signed(), rest=True).add(few, True)) == set(zip(few[:2] + few[2:3], few[2:] + few[3:], strict=True))


def test_whatever_is_linked_shares_a_star(spark):
    r = random.Random(6)
    names = [f"w{i:02d}" for i in range(40)]
    uses = [(w, r.randrange(4)) for w in names]
    pairs = {tuple(r.sample(names, 2)) for _ in range(60)}
    links = pairs | {(b, a) for a, b in pairs} | {(f"s{i}", "hub") for i in range(5)} | {("hub", f"s{i}") for i in range(5)}
    links_df = spark.createDataFrame(list(links), "a string, b string")
    words = spark.createDataFrame([*uses, ("hub", 9), *((f"s{i}", 1) for i in range(5))], "word string, n bigint")
    centres = V.stars(links_df, words)
    of = {}
    for x in V.families(links_df, centres).collect():
        assert x.word == x.family or (x.word, x.family) in links
        assert x.family not in of.setdefault(x.word, set())
        of[x.word].add(x.family)
    assert all(of[a] & of[b] for a, b in links) and all(of[b] & of[c] for a, b in links for x, c in links if x == a)
    assert all(c.centre in of[c.word] for c in centres.collect()) and all(of[f"s{i}"] == of["hub"] == {"hub"} for i in range(5))


def test_spellings_between_two_centres_link_both(spark):
    one = lambda family: [(f"{family[:6]}{i}", f"Samuel {family}", "person", "p", None) for i in range(3)]
    between = [*one("Zacomabeki"), *one("Zacotibuko"), ("w", "Samuel Zacomabuko", "person", "q", None), ("v", "Anthony Zacomabuko", "person", "q", None), ("u", "Anthony Zacotibuko", "person", "p", None)]
    assert clusters(spark, between) == {frozenset(r[0] for r in between if r[0] not in "vu"), frozenset("vu")}
    # neither is like the other's centre
    satellites = [*one("Zacomabeki"), *one("Vecotibuko"), ("w", "Samuel Zacomabuko", "person", "q", None), ("v", "Samuel Zacotibuko", "person", "p", None), ("u", "Anthony Vecotibuko", "person", "p", None)]
    assert clusters(spark, satellites) == {frozenset(r[0] for r in satellites if r[0] != "u"), frozenset("u")}
    # two key words, each between centres of its own
    other = [("a", "Samuel Hujanirova Zacomabuko", "person", "p", None), ("b", "Samuel Hujanirova Zacotibuko", "person", "q", None), ("c", "Samuel Bekosawimu Zacotibuko", "person", "p", None), *((i, n.replace("Samuel", "Robert"), *x) for i, n, *x in satellites if i not in "wvu")]
    assert {frozenset("ab"), frozenset("c")} <= clusters(spark, other)


def test_a_name_without_a_given_name_makes_no_two_people_one(spark):
    people = [(f"z{i}", "Samuel Zacomabeki", "person", "p", None) for i in range(3)] + [(f"t{i}", "Anthony Zacotibuko", "person", "p", None) for i in range(2)]
    # between both centres: the more used one's star decides, where it fits nobody the other's does
    got = clusters(spark, [*people, ("bare", "zacomabuko", None, "q", None), ("init", "A. Zacomabuko", "person", "q", None), ("none", "R. Zacomabuko", "person", "q", None)])
    assert got == {frozenset({"z0", "z1", "z2"}), frozenset({"t0", "t1", "init"}), frozenset({"none"})}
    assert clusters(spark, [*people, ("bare", "zacomabuko", None, "q", None)]) == {frozenset({"z0", "z1", "z2", "bare"}), frozenset({"t0", "t1"})}
    found = [("r", "r", None, True), ("s", "s", None, True), ("a", "a", "0 w", True), ("r", "a", "0 w", False), ("s", "a", "0 w", False), ("b", "b", "0 w", True), ("r", "b", "0 w", False), ("r", "c", "0 w", True), ("s", "c", "0 w", False)]
    found += [(None, "d", "0 w", True), ("s", "d", "0 w", False), ("e", "e", "0 w", True), (None, "e", "0 w", False), ("s", "e", "0 w", False)]
    df = spark.createDataFrame(found, "cluster string, id string, of string, first boolean")
    same = [("r", "r"), ("s", "s"), ("a", "a"), ("b", "b"), ("r", "b"), ("r", "c"), ("e", "e")]
    assert sorted(tuple(x) for x in V.settled(df).collect()) == sorted(same)
    both = spark.createDataFrame([*found, ("r", "s", None, True)], df.schema)
    assert ("r", "a") in {tuple(x) for x in V.settled(both).collect()}
