"""Reading names as people type them: tokens, known short forms, and how alike two names are. Pure Python, for use inside tasks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

TOKEN = re.compile(r"[^\W_]+")
#: Two or three capitals: a firm's words by their initials.
INITIALISM = re.compile(r"[A-Z]{2,3}")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Digits typed for letters, titles, and words that say nothing about who is meant.
LOOKALIKE = str.maketrans("013457", "oieast")
TITLES = frozenset("dr eng ing mr mrs ms prof sir".split())
EMPTY_WORDS = frozenset("and de der of the von".split())
LEGAL = frozenset("ag bv co company corp corporation gmbh inc incorporated limited llc ltd plc sa sarl".split())
NUMBERING = frozenset("branch div division no nr number unit".split())


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def tokens(name: str) -> list[str]:
    """The folded words of a name; words written together in capitals are parted, digits inside words read as letters."""
    out = []
    for w in TOKEN.findall(CAMEL.sub(" ", name)):
        w = fold(w)
        if not w.isdigit() and sum(c.isdigit() for c in w) <= max(1, len(w) // 4):
            w = w.translate(LOOKALIKE)
        out.append(w)
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most`` + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        older, old = old, new
    return old[-1] if old[-1] <= most else most + 1


def slack(length: int) -> int:
    """The edits allowed in a word of so many letters."""
    return 0 if length < 4 else 1 if length < 7 else 2


def grams(word: str, q: int = 2) -> set[str]:
    """The padded q-grams of a word."""
    padded = "^" * (q - 1) + word + "$" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


class Lexicon:
    """Short forms and words so common that they don't tell one name from another.

    forms: (form, full form, kind), kind 'given' or 'org-word'; common: further words, of orgs.
    """

    def __init__(self, forms: Iterable[tuple[str, str, str]], common: Iterable[str] = ()):
        self.given: dict[str, set[str]] = {}
        self.org: dict[str, set[str]] = {}
        for form, full, kind in forms:
            if form and full:
                into = self.given if kind == "given" else self.org
                for w in (form, full):
                    into.setdefault("".join(tokens(w)), set()).add(fold(full))
        self.full_given = {x for v in self.given.values() for x in v}
        self.org_words = {x for v in self.org.values() for x in v}
        self.common = {c for c in common if len(c) > 3 and c.isalpha() and c not in self.given and c not in self.org}
        words = self.full_given | self.org_words | self.common
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(words):
            self.by_length.setdefault(len(w), []).append(w)
        self._seen: dict[str, tuple[str, frozenset[str]]] = {}

    def read(self, word: str) -> tuple[str, frozenset[str]]:
        """('given' | 'org' | 'other', the full forms it may stand for). A word with slips is read as the nearest known word."""
        if word not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[word] = self._read(word)
        return self._seen[word]

    def _read(self, word: str) -> tuple[str, frozenset[str]]:
        if word in self.given and word not in self.org:
            return "given", frozenset(self.given[word])
        if word in self.org:
            return "org", frozenset(self.org[word])
        if word in self.common:
            return "org", frozenset([word])
        if len(word) < 5:
            return "other", frozenset()
        best, least = set(), 3
        mine = grams(word)
        for n in range(len(word) - 2, len(word) + 3):
            for w in self.by_length.get(n, ()):
                most = min(slack(min(len(w), len(word))), least)
                if not most or len(mine & grams(w)) < len(mine) - 3 * most:
                    continue
                d = edits(word, w, most)
                if d < least and d <= most:
                    best, least = {w}, d
                elif d == least and d <= most:
                    best.add(w)
        given = best & self.full_given
        if given:
            return "given", frozenset(given)
        return ("org", frozenset(best)) if best else ("other", frozenset())


class Name:
    """A name as read: its key words (what tells families and firms apart), given names or a prefix of them, number.

    kind: 'person' or 'org' where that is known. stars: the families of key words that are in several.
    """

    __slots__ = ("keys", "given", "prefix", "org", "firm", "number", "handle", "text", "stars")

    def __init__(self, text: str, lexicon: Lexicon, kind: str | None = None):
        self.text = text
        self.handle = text.strip().startswith("@")
        self.keys: list[str] = []
        self.stars: dict[str, set[str]] = {}
        self.given: frozenset[str] = frozenset()
        self.prefix = self.number = ""
        self.org = 0
        words = [w for w in self._words(text, lexicon) if w not in TITLES and w not in EMPTY_WORDS and w != "hq"]
        short: list[str] = []
        common: list[str] = []
        named: list[tuple[str, frozenset[str]]] = []
        for w in words:
            if w.isdigit():
                self.number = w.lstrip("0") or "0"
                continue
            sort, full = lexicon.read(w)
            if sort == "given":
                named.append((w, full))
                if not self.given:
                    self.given = full
                elif self.given & full:
                    self.given &= full
            elif sort == "org" and full <= lexicon.common and w not in LEGAL and w not in NUMBERING:
                common.append(w)
            elif sort == "org" or w in LEGAL or w in NUMBERING:
                self.org += 1
            elif len(w) <= 4:
                short.append(w)
            else:
                self._unglue(w, lexicon)
        if kind != "person" and not self.given and len(words) > 1 and any(INITIALISM.fullmatch(w) for w in TOKEN.findall(text)):
            self.org += 1
        if self.org or not self.given:  # beside a given name a common word may be a family name
            self.org += len(common)
        if kind == "person":
            self.org = 0
        self.firm = self.org > 0 or kind == "org"  # what it is taken for, while org counts the words that say so
        if not self.firm:
            self.number = ""
        # a common word tells nothing apart beside a firm's own word, but may be all a name has, and a person's family name
        if not self.firm or not self.keys:
            self.keys += common
        if not self.keys:
            self._from_rest(text, named, short, lexicon)
        if not self.given and any(w.isalpha() for w in short) and not self.firm:
            # an initial or the first letters of a given name
            self.prefix = min(short, key=lambda w: (len(w) == 1, 0))
        elif not self.given and len(self.keys) > 1 and not self.firm:
            fits = [w for w in self.keys if any(g.startswith(w) for g in lexicon.full_given)]
            if len(fits) == 1:
                self.prefix = fits[0]
                self.keys.remove(fits[0])

    def _from_rest(self, text: str, named: list[tuple[str, frozenset[str]]], short: list[str], lexicon: Lexicon) -> None:
        """The key words of a name without a long word of its own: a family name that reads like a given name, else short words, which count exactly.

        What is written before a comma is the family name. A given name alone is no key.
        """
        before = set(tokens(text.partition(",")[0])) if "," in text else set()
        if self.firm:
            self.keys = [w for w in short if len(w) > 1] or [w for w, _ in named] or ["".join(short)] * bool(short)
            if not short and named:
                self.given = frozenset()
            return
        if len(named) > 1:
            # only one word is the given name: not one before a comma, rather one that is written as the table has it
            first = min(range(len(named)), key=lambda i: (named[i][0] in before, named[i][0] not in lexicon.given, i))
            self.given = named[first][1]
            rest = [w for i, (w, _) in enumerate(named) if i != first]
            self.keys = [w for w in rest if w in before] or rest[-1:]
        elif named and short and (named[0][0] not in lexicon.given or named[0][0] in before) and not any(len(w) > 1 and w in before for w in short):
            self.keys, self.given = [named[0][0]], frozenset()  # an initial and a family name like a given name
        else:
            whole = [w for w in short if len(w) > 1]
            if whole:
                self.keys = [w for w in whole if w in before][:1] or whole[-1:]
                short.remove(self.keys[0])

    @staticmethod
    def _words(text: str, lexicon: Lexicon) -> list[str]:
        """The tokens, but for a number at the end of a word that is parted from it: one of a firm, or behind a user name."""
        out = []
        for raw in TOKEN.findall(CAMEL.sub(" ", text)):
            bare = (w := fold(raw)).rstrip("0123456789")
            number = w[len(bare) :]
            if number and len(bare) >= 4 and (len(number) > 1 or number not in "013457" or lexicon.read(bare)[0] != "other"):
                out += [*tokens(bare), number]
            else:
                out += tokens(raw)
        return out

    def _unglue(self, word: str, lexicon: Lexicon) -> None:
        if not self.given and len(word) >= 11:
            for g in lexicon.full_given:
                rest = word[len(g) :] if word.startswith(g) else word[: -len(g)] if word.endswith(g) else ""
                if len(rest) >= 5:
                    self.given = frozenset([g])
                    self.keys.append(rest)
                    return
        self.keys.append(word)


def same_word(a: str, b: str) -> bool:
    """Whether two key words are spellings of one: equal but for a few edits, or an initial written in front of one."""
    # a word of four letters or fewer is too short for slips
    most = slack(min(len(a), len(b))) if min(len(a), len(b)) > 4 else 0
    if edits(a, b, most) <= most:
        return True
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    return len(short) >= 7 and edits(long[1:], short, 1) <= 1


def similar(a: str, b: str) -> float:
    """Likeness of two words, 1 for equal ones, from their edit distance."""
    most = max(len(a), len(b))
    return 1 - edits(a, b, most) / most if most else 1.0


def alike_given(a: Name, b: Name) -> float:
    """Likeness of what two names say of the given name; 1 where either says nothing."""
    if a.given and b.given:
        return 1.0 if a.given & b.given else max(similar(x, y) for x in a.given for y in b.given) / 2
    if a.given or b.given:
        full, prefix = (a.given, b.prefix) if a.given else (b.given, a.prefix)
        if not prefix:
            return 1.0
        if any(g.startswith(prefix) for g in full):
            return 1.0
        return 0.9 if len(prefix) > 3 and any(edits(prefix, g[: len(prefix)], 1) <= 1 for g in full) else 0.0
    if a.prefix and b.prefix:
        return 1.0 if a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix) else 0.0
    return 1.0


def one_family(a: Name, x: str, b: Name, y: str) -> bool:
    """Whether a key word of one name is in a family with one of another."""
    return bool(a.stars or b.stars) and not a.stars.get(x, {x}).isdisjoint(b.stars.get(y, {y}))


def monge_elkan(a: Name, b: Name) -> float:
    """Monge-Elkan similarity: each part of the name with fewer parts takes its best counterpart, and the mean counts.

    Parts are the key words and the given name; words of one family count 1, words that aren't spellings of one count 0, and a given name that contradicts
    the other's, or another number, makes it 0.
    """
    given = alike_given(a, b)
    if given < 0.8 or a.number != b.number or not a.keys or not b.keys:
        return 0.0
    few, many = (a, b) if len(a.keys) <= len(b.keys) else (b, a)
    parts = [max(1.0 if x == y or one_family(few, x, many, y) else 0.9 if same_word(x, y) else 0.0 for y in many.keys) for x in few.keys]
    return (sum(parts) + given) / (len(parts) + 1)
