"""Linking the spellings of one person's or organisation's name.

Key words of names (those no lexicon knows: family names, firms' own words) are spread over buckets by MinHash bands on padded q-grams,
with bands and rows taken from the collision curve. Within a bucket a word is compared with the bucket's leading words, and with the others it has no
leading word in common with. Verified links are clustered by star clustering: the most used spelling is a centre, its neighbours its satellites. Stars
overlap: a word is in that of every centre it is linked to, and links that lie in no centre's star have stars of their own. The names of a family
of spellings, which is a star, are then clustered by stars again, a name joining the centre that Monge-Elkan similarity of all key words accepts.
A name is in the families of each of its key words, and the clusters that share a row are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.name_parts import Lexicon, Name, edits, grams, monge_elkan, same_word, slack, tokens
from factloom.plans.layout import cut, free
from factloom.plans.shipping import ship

P31 = (1 << 31) - 1


def collision(similarity: float, bands: int, rows: int) -> float:
    """The chance that two sets of that Jaccard similarity share a bucket."""
    return 1 - (1 - similarity**rows) ** bands


def choose_bands(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding of ``hashes`` whose collision chance at ``similarity`` is at least ``recall``."""
    fits = [(hashes // r, r) for r in range(1, hashes + 1) if collision(similarity, hashes // r, r) >= recall]
    return max(fits, key=lambda x: x[1]) if fits else (hashes, 1)


def signature(word: str) -> int:
    """The letters of a word, by 32 classes, as 128 bits: as many bits of a class as it occurs, four at most."""
    counts = [0] * 32
    for c in word:
        counts[ord(c) & 31] += 1
    return sum(((1 << min(n, 4)) - 1) << (4 * at) for at, n in enumerate(counts) if n)


def most_apart(word: str) -> int:
    """The most bits in which a spelling may differ: an edit changes two letters at most, a swap none."""
    return 2 * slack(len(word)) if len(word) > 4 else 0


class Signed:
    """Signatures of words as 16 bytes, and how far apart a spelling may be; remembered for the words seen last, as a word comes up in many buckets."""

    def __init__(self, most: int = 200_000):
        self.held: dict[str, tuple[bytes, int]] = {}
        self.most = most

    def __call__(self, word: str) -> tuple[bytes, int]:
        if (got := self.held.get(word)) is None:
            if len(self.held) >= self.most:
                self.held.clear()
            got = self.held[word] = (signature(word).to_bytes(16, "little"), most_apart(word))
        return got

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The signatures of words as rows of two numbers, and how far apart spellings may be."""
        got = [self(w) for w in words]
        return np.frombuffer(b"".join(g[0] for g in got), np.uint64).reshape(-1, 2), np.array([g[1] for g in got], np.int16)


def may_be_one(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which words of one table have letters so like those of which of another that they may be spellings of one word."""
    apart = np.bitwise_count(a[0][:, 0, None] ^ b[0][None, :, 0]) + np.bitwise_count(a[0][:, 1, None] ^ b[0][None, :, 1])
    return apart <= np.minimum(a[1][:, None], b[1][None, :])


class Leaders:
    """The words of one bucket that are like none before them, and the links of the others to them. Words come in blocks, so a bucket may be of any size.

    rest: also the links to words that are no leaders, but for two words with a leader in common, which that one's star holds.
    """

    def __init__(self, signed: Signed, rest: bool = False):
        self.signed, self.seen, self.rest = signed, set(), rest
        self.start()

    def start(self) -> None:
        """A new bucket."""
        self.words: list[str] = []
        self.blocks: list[tuple[list[str], tuple[np.ndarray, np.ndarray]]] = []
        self.others: list[tuple[list[str], list[set[str]], tuple[np.ndarray, np.ndarray]]] = []

    def _same(self, x: str, w: str) -> bool | None:
        """Whether two words are spellings of one; None where an earlier bucket has said so. What is remembered spares comparing them again, no more."""
        if (x, w) in self.seen:
            return None
        if not same_word(x, w):
            return False
        if len(self.seen) < 500_000:
            self.seen.add((x, w))
        return True

    def _few(self, words: list[str]) -> list[tuple[str, str]]:
        """The same for a whole bucket of so few words that a table isn't worth it; most have one."""
        links: list[tuple[str, str]] = []
        leads: list[tuple[str, int, int]] = []
        others: list[tuple[str, int, int, set[str]]] = []
        for w in words:
            bits, most = self.signed(w)
            mine, led = int.from_bytes(bits, "little"), set()
            for x, its, allowed in leads:
                if (mine ^ its).bit_count() <= min(most, allowed):
                    said = self._same(x, w)
                    if said is not False:
                        led.add(x)
                        if said:
                            links.append((x, w))
            for x, its, allowed, by in others:
                if led.isdisjoint(by) and (mine ^ its).bit_count() <= min(most, allowed) and self._same(x, w):
                    links.append((x, w))
            if not led:
                leads.append((w, mine, most))
            elif self.rest:
                others.append((w, mine, most, led))
        return links

    def add(self, words: list[str], last: bool) -> list[tuple[str, str]]:
        """The new links (leader, word) of a block of words; last: none of the bucket follow."""
        if last and not self.blocks and len(words) < 8:
            return self._few(words)
        mine, links, led = self.signed.table(words), [], [set() for _ in words]

        def meet(x: str, n: int) -> None:
            said = self._same(x, words[n])
            if said is not False:
                led[n].add(x)
                if said:
                    links.append((x, words[n]))

        def meet_other(x: str, by: set[str], n: int) -> None:
            if led[n].isdisjoint(by) and self._same(x, words[n]):
                links.append((x, words[n]))

        for others, table in self.blocks:
            for n, k in zip(*(z.tolist() for z in np.nonzero(may_be_one(mine, table))), strict=True):
                meet(others[k], n)
        within = list(zip(*(z.tolist() for z in np.nonzero(np.tril(may_be_one(mine, mine), -1))), strict=True))
        for n, k in within:
            if not led[k]:
                meet(words[k], n)
        if self.rest:
            for others, by, table in self.others:
                for n, k in zip(*(z.tolist() for z in np.nonzero(may_be_one(mine, table))), strict=True):
                    meet_other(others[k], by[k], n)
            for n, k in within:
                if led[k]:
                    meet_other(words[k], led[k], n)
        if not last:
            kept = [n for n, by in enumerate(led) if not by]
            self.blocks.append(([words[n] for n in kept], (mine[0][kept], mine[1][kept])))
            if self.rest:
                kept = [n for n, by in enumerate(led) if by]
                self.others.append(([words[n] for n in kept], [led[n] for n in kept], (mine[0][kept], mine[1][kept])))
        return links


class MinHash:
    """Band keys of a word's padded q-grams."""

    def __init__(self, bands: int, rows: int, q: int = 3, seed: int = 11):
        self.bands, self.rows, self.q = bands, rows, q
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, P31, bands * rows, dtype=np.int64)[:, None]
        self.b = rng.integers(0, P31, bands * rows, dtype=np.int64)[:, None]
        self.mix = rng.integers(1, 1 << 62, rows, dtype=np.int64) | 1

    def keys(self, word: str) -> np.ndarray:
        """One BIGINT for each band; its band is part of the value."""
        x = np.fromiter((xxhash.xxh32_intdigest(g) % P31 for g in grams(word, self.q)), np.int64)
        least = ((self.a * x + self.b) % P31).min(axis=1).reshape(self.bands, self.rows)
        with np.errstate(over="ignore"):
            return (least * self.mix).sum(axis=1) * np.int64(1_000_003) + np.arange(self.bands)


def word_links(words: DataFrame, *, similarity: float, recall: float, hashes: int = 200) -> DataFrame:
    """Verified links between distinct words: columns ``a``, ``b`` (both ways). words: ``word``, ``n`` (its uses).

    Within a bucket words come in order of use; each is compared with the bucket's leaders and linked to those it is a spelling of, and one
    that is like none becomes a leader. It is also compared with the words before it that are no leaders, but for those that have a leader in common
    with it: of two spellings of a word both are linked to that word. A spelling used by a third of all rows is one word here.
    """
    bands, rows = choose_bands(similarity, recall, hashes)
    hasher = MinHash(bands, rows)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws, ns = batch.column("word").to_pylist(), batch.column("n")
            if ws:
                keys = np.concatenate([hasher.keys(w) for w in ws])
                at = pa.array(np.repeat(np.arange(len(ws)), bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("word").take(at), ns.take(at)], names=["bucket", "word", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, bucket, block = Leaders(Signed(), rest=True), None, []
        for batch in batches:
            links: list[tuple[str, str]] = []
            for k, w in zip(batch.column("bucket").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if k != bucket:
                    links += leaders.add(block, last=True) if len(block) > 1 or leaders.blocks else []
                    leaders.start()
                    bucket, block = k, []
                elif len(block) == 256:
                    links += leaders.add(block, last=False)
                    block = []
                block.append(w)
            if links:
                yield both_ways(links)
        if block and (links := leaders.add(block, last=True)):
            yield both_ways(links)

    def both_ways(links: list[tuple[str, str]]) -> pa.RecordBatch:
        a, b = (list(x) for x in zip(*links, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a + b), pa.array(b + a)], names=["a", "b"])

    ship(words.sparkSession)
    buckets = words.select("word", "n").mapInArrow(spread, "bucket bigint, word string, n bigint")
    return buckets.repartition("bucket").sortWithinPartitions("bucket", F.desc("n"), "word").mapInArrow(compare, "a string, b string").distinct()


def stars(links: DataFrame, words: DataFrame, finish_rows: int = 200_000) -> DataFrame:
    """Star clustering: ``word``, ``centre`` for every word with a link. links: ``a``, ``b``, both ways; words: ``word``, ``n``.

    In order of use (then of the word), a word with no centre among its neighbours of higher rank is a centre, any other a satellite of the
    highest such centre: the result of going through the words one by one. It is reached in rounds, each deciding all words whose higher neighbours
    are decided, until every word is. Once the links of the words still open are counted to be at most ``finish_rows``, one task goes through them in order,
    which spares a round for each step of the longest chain.
    """
    rank = lambda w: words.select(F.col("word").alias(w), F.struct((-F.col("n")).alias("n"), F.col("word").alias("w")).alias(f"r{w}"))
    ranked = cut(links.join(rank("a"), "a").join(rank("b"), "b"))
    up = ranked.where("rb < ra").select("a", "ra", "b", "rb")
    # a word without a neighbour of higher rank is a centre
    state = cut(ranked.groupBy("a").agg(F.bool_or(F.col("rb") < F.col("ra")).alias("has")).select(F.col("a").alias("word"), F.when(~F.col("has"), F.col("a")).alias("centre")))
    while True:
        open_ = state.where("centre IS NULL").select(F.col("word").alias("a"))
        higher = cut(up.join(open_, "a", "left_semi").join(state.select(F.col("word").alias("b"), "centre"), "b"))
        left = higher.count()
        if not left:
            return state
        if left <= finish_rows:
            now = higher.repartition(1).sortWithinPartitions("ra", "rb").select("a", "b", "centre").mapInArrow(_in_order, "word string, now string")
        else:
            best = higher.groupBy("a").agg(
                F.min(F.when(F.col("centre") == F.col("b"), F.col("rb"))).alias("best"), F.bool_or(F.col("centre").isNull()).alias("wait"), F.min(F.when(F.col("centre").isNull(), F.col("rb"))).alias("first")
            )
            # a satellite once no undecided neighbour ranks above its best centre; a centre once all are decided
            satellite = F.col("best").isNotNull() & (F.col("first").isNull() | (F.col("best") < F.col("first")))
            now = best.select(F.col("a").alias("word"), F.when(satellite, F.col("best.w")).when(~F.col("wait") & F.col("best").isNull(), F.col("a")).alias("now"))
        older, state = state, cut(state.join(now, "word", "left").select("word", F.coalesce("centre", "now").alias("centre")))
        free(older)
        free(higher)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides the open words one by one; rows: a word, a neighbour of higher rank and that one's centre, by rank of the word, then of the neighbour."""
    centre: dict[str, str] = {}
    word, mine = None, None
    for batch in batches:
        for a, b, known in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "centre")), strict=True):
            if a != word:
                if word is not None:
                    centre[word] = mine or word
                word, mine = a, None
            if mine is None and (known or centre.get(b)) == b:
                mine = b
    if word is not None:
        centre[word] = mine or word
        yield pa.RecordBatch.from_arrays([pa.array(list(centre)), pa.array(list(centre.values()))], names=["word", "now"])


def families(links: DataFrame, centres: DataFrame) -> DataFrame:
    """All stars of every word with a link: ``word``, ``family``, the word a star is named by. Whatever is linked, or linked to one word, shares a star.

    links as in :func:`stars`, whose result is ``centres``. A star is a word with all its neighbours. Every centre has one; another word has one
    unless the star of a centre holds all of it. So the spellings of a used word that are like it and each other need that word's star only.
    """
    centre, others = centres.where("word = centre").select(F.col("word").alias("b")), centres.where("word <> centre").select(F.col("word").alias("a"))
    in_centres = cut(links.join(centre, "b", "left_semi"))
    up = in_centres.join(others, "a", "left_semi").select("a", "b")
    degree = links.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    # a neighbour's neighbours among one's own: all but itself are to be there
    common = up.join(links.select("a", F.col("b").alias("c")), "a").join(in_centres.select(F.col("a").alias("c"), "b"), ["c", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    held = up.join(degree, "a").join(common, ["a", "b"], "left").where("coalesce(common, 0) = degree - 1").select("a")
    own = cut(centre.unionByName(others.join(held, "a", "left_anti").select(F.col("a").alias("b"))))
    free(in_centres)
    return links.join(own, "b").select(F.col("a").alias("word"), F.col("b").alias("family")).unionByName(own.select(F.col("b").alias("word"), F.col("b").alias("family")))


def _full(n: Name) -> bool:
    return bool(n.keys and (n.given or n.org) and not n.handle)


def _bare(text: str) -> str:
    return "".join(tokens(text)).replace(" ", "")


def _like(a: Name, b: Name) -> bool:
    """Whether two readings share a key word."""
    return any(same_word(x, y) for x in a.keys for y in b.keys)


def _readings(read: list[Name], lexicon: Lexicon) -> list[Name]:
    """The readings of a row that are names: its own, which comes first, every full name, and user names and initials that say more than these.

    Of full names that differ in the choice of given names only, the one that leaves fewest counts.
    """
    own, chosen = read[0], []
    for n in read:
        if not _full(n):
            continue
        for at, c in enumerate(chosen):
            if n.firm == c.firm and n.number == c.number and sorted(n.keys) == sorted(c.keys) and (n.given & c.given or n.given == c.given):
                if len(n.given) < len(c.given):
                    chosen[at] = n
                break
        else:
            chosen.append(n)
    if not chosen:
        return [own, *(o for o in read[1:] if len(o.keys) == 1 and len(o.keys[0]) > 8)]
    if not _full(own) and own.keys:
        chosen.append(own)
    for o in read[1:]:
        initial = o.prefix and any(g.startswith(o.prefix) for g in lexicon.full_given) and not o.firm
        if not _full(o) and len(o.keys) == 1 and len(o.keys[0]) > 4 and (initial or o.handle and len(o.keys[0]) > 8) and not any(_like(o, c) for c in chosen):
            chosen.append(o)
    return chosen


def _read(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row the readings that count: its name, and the aliases and norm_name that are names. One output row for each key word and reading."""
    for batch in batches:
        out: list[tuple] = []
        ids, names, kinds, scopes, aliases, norms = (batch.column(c).to_pylist() for c in ("__id", "__name", "__type", "__scope", "__aliases", "__norm"))
        for i, name, kind, scope, others, norm in zip(ids, names, kinds, scopes, aliases, norms, strict=True):
            # a norm_name that is the name written together, or the beginning of that, says nothing else
            more = [norm] if norm and not (name and _bare(name).startswith(_bare(norm))) else []
            texts = [t for t in dict.fromkeys([name if name and name.strip() else norm, *(others or []), *more]) if t and t.strip()]
            if not texts:
                continue
            chosen = _readings([Name(t, lexicon, kind) for t in texts], lexicon)
            for nth, n in enumerate(chosen):
                # a typed row whose name has nothing to go by is a family of its own
                for k in n.keys or ([f"\0{i}"] if kind is not None and len(chosen) == 1 else []):
                    out.append((i, kind, scope, nth, n.text, k, _full(n), f"{int(n.firm)}{n.number}"))
        if out:
            cols = list(zip(*out, strict=True))
            types = [batch.schema.field("__id").type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "type", "scope", "nth", "text", "word", "full", "part"])


class Family:
    """The centres of a family, found by what a name says: a given name, the beginning of one, a scope. A row is compared with those that may fit, not with all."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.all: list[tuple[Name, object, set]] = []
        self.by_given: dict[str, list[int]] = {}
        self.unnamed: list[int] = []
        self.by_scope: dict[str | None, list[int]] = {}
        self.begun: dict[str, list[str]] = {}

    def add(self, n: Name, id: object, scope: str | None) -> None:
        at = len(self.all)
        self.all.append((n, id, set()))
        for g in n.given:
            if g not in self.by_given:
                self.by_given[g] = []
                self.begun.clear()
            self.by_given[g].append(at)
        if not n.given:
            self.unnamed.append(at)
        self.see(at, scope)

    def see(self, at: int, scope: str | None) -> None:
        """A row of that scope belongs to a centre."""
        if scope not in self.all[at][2]:
            self.all[at][2].add(scope)
            self.by_scope.setdefault(scope, []).append(at)

    def _may_fit(self, n: Name) -> Iterator[int]:
        if n.given:
            seen: set[int] = set()
            for g in n.given:
                for at in self.by_given.get(g, ()):
                    if at not in seen:
                        seen.add(at)
                        yield at
            yield from self.unnamed
        elif n.prefix:
            # the family's given names that begin so, also with a slip; as many as there are given names, once for each beginning
            if n.prefix not in self.begun:
                self.begun[n.prefix] = [g for g in self.by_given if g.startswith(n.prefix) or (len(n.prefix) > 3 and edits(n.prefix, g[: len(n.prefix)], 1) <= 1)]
            seen = set()
            for g in self.begun[n.prefix]:
                for at in self.by_given[g]:
                    if at not in seen:
                        seen.add(at)
                        yield at
            yield from self.unnamed
        else:
            yield from range(len(self.all))

    def find(self, n: Name, scope: str | None) -> tuple[int | None, bool]:
        """(the centre a name belongs to or None, whether none fits). Of several that fit the one of the name's own scope counts, if it is one."""
        fit = lambda at: monge_elkan(n, self.all[at][0]) >= 0.8
        fits: list[int] = []
        if n.given:
            fits = [at for at in self._may_fit(n) if fit(at)]
            named = [at for at in fits if self.all[at][0].given]
            fits = named or ([at for at in fits if self.all[at][0].prefix] if len(fits) == 1 else [])
        else:
            for at in self._may_fit(n):
                if fit(at):
                    fits.append(at)
                    if len(fits) > 1:  # several: only those of the scope matter
                        fits = [x for x in self.by_scope.get(scope, ()) if fit(x)]
                        return (fits[0] if len(fits) == 1 else None), False
        if len(fits) > 1:
            fits = [at for at in fits if scope in self.all[at][2]]
            return (fits[0] if len(fits) == 1 else None), False
        return (fits[0], False) if fits else (None, True)


def _people(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters the rows of each family and part, which come full names first, of those the longest; only their centres are held.

    Where a person's name without a given name is in several stars by one word, ``of`` names it, for :func:`settled`: in its centre's star it is
    ``first``, and its cluster is null where it fits several.
    """
    current, family = None, Family(lexicon)
    for batch in batches:
        out: list[tuple] = []
        for fam, part, i, nth, kind, scope, text, word, centre, keys, more in zip(*(batch.column(c).to_pylist() for c in ("family", "part", "id", "nth", "type", "scope", "text", "word", "centre", "keys", "more")), strict=True):
            if (fam, part) != current:
                current, family = (fam, part), Family(lexicon)
            n = Name(text, lexicon, kind)
            if not (n.given or n.firm or n.prefix) and len(word) > len(centre) - 2 and not word.startswith(centre[:2]) and edits(word[1:], centre, 1) <= 1:
                n.prefix = word[0]  # a user name: initial and family name
            n.keys = keys
            for x in more:
                n.stars.setdefault(x["centre"], {x["centre"]}).add(x["family"])
            of = None if n.given or n.firm or centre not in n.stars else f"{nth} {centre}"
            at, new = family.find(n, scope)
            if at is not None:
                c = family.all[at]
                family.see(at, scope)
                if n.given and c[0].given & n.given:
                    c[0].given &= n.given
                out.append((c[1], i, of, fam == centre))
            elif new and (kind is not None or n.given or n.firm):
                family.add(n, i, scope)
                out.append((i, i, of, fam == centre))
            elif of and not new:
                out.append((None, i, of, fam == centre))
        if out:
            t = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (t, t, pa.string(), pa.bool_()), strict=True)], names=["cluster", "id", "of", "first"])


def common_words(names: DataFrame, least: int = 12, share: float = 0.001, given: frozenset[str] = frozenset()) -> DataFrame:
    """Words that occur beside many different words, hence tell nothing apart: ``word``. Counted over all names.

    The known given names ``given`` don't count as companions: many of them make a word a family's name, not a common one. A word counts that has at least ``least`` different companions, and as many as ``share`` of the names; so there are at most
    1 / ``share`` times the words of a name, however many names there are.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for t in batch.column(0).to_pylist():
                ws = sorted(set(tokens(t or "")))
                for x in ws:
                    for y in ws:
                        if x != y and len(x) > 3 and y not in given:
                            a.append(x)
                            b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["word", "other"])

    n = names.count()
    beside = names.mapInArrow(pairs, "word string, other string").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return beside.where(F.col("n") >= max(least, share * n)).select("word")


def link_names(
    entities: DataFrame, forms: DataFrame, *, kinds: tuple[str, ...] = ("person", "org"), similarity: float = 0.2, recall: float = 0.95, hashes: int = 200
) -> DataFrame:
    """The cluster of every row that names a person or organisation: ``cluster`` (the id of its centre) and ``id``.

    entities: id, name, type, scope, aliases, norm_name. Rows whose type is neither null nor in ``kinds`` take no part; rows without a type do where
    their name reads like one, or joins a cluster. forms: form, full_form, kind.

    Defined cases: a null or blank name is replaced by norm_name, then by aliases, and a row with none of them is left out; every alias and norm_name
    that is a name counts like the name; those that aren't are passed over, as is a firm's norm_name written in one word; rows with a null id take no part and repeated rows count once; a name that fits several people of a family equally joins none;
    an empty table gives no rows; other columns are ignored.

    Skew: rows that say the same (name, type, scope, aliases and norm_name) are one row until the end, so a name in a third of all rows costs as many as it has
    spellings and scopes. A word is one row in its buckets. A family is parted by kind and number of the name, and a row is compared with the centres
    that its given name or initial admits.
    """
    rows = (
        entities.where(F.col("type").isNull() | F.col("type").isin(*kinds)).dropna(subset=["id"])
        .select(F.col("id").alias("__id"), F.col("name").alias("__name"), F.col("type").alias("__type"), F.col("scope").alias("__scope"), F.col("aliases").alias("__aliases"), F.col("norm_name").alias("__norm"))
        .dropDuplicates(["__id"])
        .withColumn("__says", F.sha2(F.to_json(F.struct("__name", "__type", "__scope", "__aliases", "__norm"), {"ignoreNullFields": "false"}), 256))
    )
    every = cut(rows)
    said = ["__name", "__type", "__scope", "__aliases", "__norm"]
    rows = cut(every.groupBy("__says").agg(F.min("__id").alias("__id"), *(F.first(c).alias(c) for c in said)))
    ship(entities.sparkSession)
    # the lexicon: a table of short forms, and common words whose number the share bounds
    table = [(r.form, r.full_form, r.kind) for r in forms.select("form", "full_form", "kind").collect()]
    given = frozenset(Lexicon(table).given)
    common = [r.word for r in common_words(rows.where(F.col("__type").isNotNull()).select("__name"), given=given).collect()]
    lexicon = Lexicon(table, common)
    schema = rows.select(F.col("__id").alias("id")).schema.add("type", "string").add("scope", "string").add("nth", "integer").add("text", "string").add("word", "string").add("full", "boolean").add("part", "string")
    read = cut(rows.mapInArrow(lambda b: _read(lexicon, b), schema))
    words = cut(read.groupBy("word").agg(F.sum(F.col("full").cast("bigint")).alias("n")))
    links = cut(word_links(words.where("NOT startswith(word, char(0))"), similarity=similarity, recall=recall, hashes=hashes))
    centre = stars(links, words)
    # a word's centre, by which names are compared, and all stars it is in, each of which is a family
    placed = read.join(centre, "word", "left").join(families(links, centre), "word", "left").withColumns({"centre": F.coalesce("centre", "word"), "family": F.coalesce("family", "word")})
    order = F.when(F.col("full") & F.col("type").isNotNull(), 0).when(F.col("full"), 1).when(F.col("type").isNotNull(), 2).otherwise(3)
    # all key words of a reading, by their centres, and the other stars of these; every reading goes to each family
    more = F.collect_set(F.when(F.col("family") != F.col("centre"), F.struct("centre", "family")))
    keyed = placed.groupBy("id", "nth").agg(F.array_sort(F.collect_set("centre")).alias("keys"), F.array_sort(more).alias("more"))
    once = (
        placed.join(keyed, ["id", "nth"]).select("id", "nth", "type", "scope", "text", "word", "centre", "family", "part", "keys", "more", order.alias("o"), (-F.size("keys")).alias("fewer"))
        .dropDuplicates(["id", "nth", "family"])
    )
    of = once.select("id").schema["id"].dataType.simpleString()
    grouped = (
        once.repartition("family", "part").sortWithinPartitions("family", "part", "o", "fewer", "id", "nth").select("family", "part", "id", "nth", "type", "scope", "text", "word", "centre", "keys", "more")
        .mapInArrow(lambda b: _people(lexicon, b), f"cluster {of}, id {of}, of string, first boolean")
    )
    clusters = joined(settled(cut(grouped)))
    same = rows.select(F.col("__id").alias("id"), "__says").join(clusters, "id").select("cluster", "__says")
    return every.join(same, "__says").select("cluster", F.col("__id").alias("id"))


def settled(found: DataFrame) -> DataFrame:
    """``cluster`` and ``id`` of the clusters :func:`_people` found, each name without a given name in those of one person at most.

    A full name that fits people of several stars makes them one. A name without a given name says too little for that: the star of its centre decides; where
    nobody there fits it, the other stars do, unless it fits several people, by the full names, of one or of different stars.
    """
    sure = found.where("cluster IS NOT NULL AND (of IS NULL OR first)").select("cluster", "id")
    decided = found.where("first AND of IS NOT NULL AND (cluster IS NULL OR cluster <> id)").select("id", "of")
    open_ = cut(found.where("of IS NOT NULL AND NOT first").join(decided, ["id", "of"], "left_anti").select("cluster", "id", "of"))
    if open_.isEmpty():
        return sure
    sure = cut(sure)
    person = joined(sure).select(F.col("cluster").alias("person"), F.col("id").alias("cluster"))
    people = F.count_distinct(F.when(F.col("cluster") != F.col("id"), F.coalesce("person", "cluster")))
    one = open_.join(person, "cluster", "left").groupBy("id", "of").agg(people.alias("people"), F.bool_or(F.col("cluster").isNull()).alias("several")).where("people <= 1 AND NOT several")
    return sure.unionByName(open_.join(one, ["id", "of"], "left_semi").select("cluster", "id"))


def joined(clusters: DataFrame) -> DataFrame:
    """Clusters that share a row made one: ``cluster`` (the least of their centres' ids) and ``id``, one row for each id.

    In each round every cluster takes the least name that a row of it has, and every name the name that one has, until nothing changes: rounds
    grow with the logarithm of the longest chain of clusters, and only the clusters of rows that have several take part.
    """
    several = clusters.groupBy("id").agg(F.collect_set("cluster").alias("cs")).where("size(cs) > 1")
    state = cut(several.select("id", F.explode("cs").alias("cluster")).withColumn("least", F.col("cluster")))
    while not state.isEmpty():
        by_row = state.groupBy("id").agg(F.min("least").alias("row_least"))
        name = state.join(by_row, "id").groupBy("cluster").agg(F.min("row_least").alias("name"))
        # a name is itself a cluster: take over what it is called by now
        name = cut(name.alias("a").join(name.select(F.col("cluster").alias("c"), F.col("name").alias("n2")).alias("b"), F.col("a.name") == F.col("b.c"), "left").select("a.cluster", F.least("name", "n2").alias("name")))
        now = cut(state.join(name, "cluster").select("id", "cluster", F.col("name").alias("least"), (F.col("name") < F.col("least")).alias("changed")))
        state = now.drop("changed")
        if now.where("changed").isEmpty():
            break
    names = state.select("cluster", "least").distinct()
    return clusters.join(names, "cluster", "left").select(F.coalesce("least", "cluster").alias("cluster"), "id").distinct()


def linked_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs of the rows of a cluster, smaller id first: ``id_a``, ``id_b``."""
    a, b = clusters.select("cluster", F.col("id").alias("id_a")), clusters.select("cluster", F.col("id").alias("id_b"))
    return a.join(b, "cluster").where("id_a < id_b").select("id_a", "id_b").distinct()


def candidate_recall(words: DataFrame, *, similarity: float = 0.2, recall: float = 0.95, hashes: int = 200, sample: int = 400) -> DataFrame:
    """How many spellings of a word the banding finds: ``length`` of the shorter word, ``pairs``, ``found``, ``recall``. words: ``word``.

    About ``sample`` words, drawn by hash, are compared with all others by :func:`same_word`; a pair is found that shares a bucket. The sample is what is
    sent to every task.
    """
    n = words.count()
    u = F.pmod(F.xxhash64(F.lit(9), "word"), F.lit(1 << 30)) / float(1 << 30)
    drawn = [r.word for r in words.where(u * n < sample).select("word").collect()]  # the stated number
    bands, rows = choose_bands(similarity, recall, hashes)
    hasher = MinHash(bands, rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = Signed()
        asked, held = signed.table(drawn), [frozenset(hasher.keys(w).tolist()) for w in drawn]
        for batch in batches:
            out, ws = [], batch.column("word").to_pylist()
            for first in range(0, len(ws) if drawn else 0, 1000):
                part = ws[first : first + 1000]
                for n, k in zip(*(z.tolist() for z in np.nonzero(may_be_one(signed.table(part), asked))), strict=True):
                    if part[n] != drawn[k] and same_word(drawn[k], part[n]):
                        out.append((min(len(drawn[k]), len(part[n])), not held[k].isdisjoint(hasher.keys(part[n]).tolist())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out])], names=["length", "found"])

    ship(words.sparkSession)
    found = words.select("word").mapInArrow(compare, "length int, found boolean")
    return found.groupBy("length").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("found").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("pairs"), 4))


def key_words(entities: DataFrame, forms: DataFrame, kinds: tuple[str, ...] = ("person", "org")) -> DataFrame:
    """The distinct key words of the names, aliases left out: ``word``."""
    table = [(r.form, r.full_form, r.kind) for r in forms.select("form", "full_form", "kind").collect()]
    lexicon = Lexicon(table)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for t in batch.column(0).to_pylist() for k in Name(t, lexicon).keys], pa.string())], names=["word"])

    ship(entities.sparkSession)
    return entities.where(F.col("type").isin(*kinds) & F.col("name").isNotNull()).select("name").mapInArrow(keys, "word string").distinct()
