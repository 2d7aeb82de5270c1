"""Problem 7: variant spellings of names typed by people.

Method: noisy-channel attribution. Candidate canonical forms are the frequent spellings, ranked: those written like a register entry are the entry's, those that no
entry explains are people outside the register, the rest are variants. A spelling's posterior for a form combines the form's frequency with the likelihood that
the typist's channel makes the spelling out of it: order of the parts, titles, initials, short forms, glued or parted words, Latin letters, and typing errors.
The likelihoods of these choices are counted from the frequent variants, aligned with their forms. The spelling goes to the form of the highest posterior, if
the channel can make it at all.

Each distinct spelling is resolved once, however many mentions it has. The register is a fixed table; frequent spellings have at
least ``SHARE`` of all mentions, so there are at most 1 / SHARE of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sokhan.llm.canonical import canonicalize
from sokhan.materialize import materialize

#: Least share of all mentions, and least count, of a spelling that stands for a name of its own.
SHARE, COUNT = 1e-4, 5
#: The most that typing errors may cost in a part of a name; one usual error costs 1.
ERRORS = 1.5

# Titles before a name, kinds of firms, and what follows firms' names in Latin letters.
TITLES = ("سرکار", "خانم", "آقای", "اقای", "جناب", "دکتر", "مهندس", "استاد", "حاج", "سید")
KINDS = ("گروه صنعتی", "شرکت", "فروشگاه", "مؤسسه", "موسسه", "بازرگانی", "پخش", "کارخانه", "تعاونی")
LATIN_KINDS = ("group", "ltd", "co", "inc", "company", "trading", "store", "institute")
LATIN_TITLES = ("mr", "mrs", "ms", "dr", "eng")
# Letters that sound alike, and the Latin letters of each.
_SOUND = str.maketrans("ذضظصثطغحآأإؤئة", "زززسستقهاااویه")
_LATIN_OF = {"ب": "b", "پ": "p", "ت": "t", "ج": "j", "چ": "c", "خ": "x", "د": "d", "ر": "r", "ز": "z", "ژ": "J", "س": "s", "ش": "S", "ف": "f", "ق": "q", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ه": "h"}
_paren = re.compile(r"\([^)]*\)?|\[[^\]]*\]?")
_token = re.compile(r"[^\W\d_]+[.٫]?|[،,]")
_zwnj = re.compile("[‌-‏]")


def sound(text: str) -> str:
    """Letters only, those that sound alike made one."""
    return "".join(c for c in text.translate(_SOUND) if c.isalpha() and c != "ع")


def latin_skeleton(text: str) -> str:
    """Consonants of a name in Latin letters, the ways to write one sound made one."""
    t = text.lower()
    for a, b in (("tch", "c"), ("sch", "S"), ("sh", "S"), ("sc", "S"), ("ch", "c"), ("zh", "J"), ("kh", "x"), ("gh", "q"), ("ph", "f"), ("ck", "k")):
        t = t.replace(a, b)
    t = "".join(c for c in t if c in "bptjcxdrzJsSfqkglmnh")
    return re.sub(r"(.)\1", r"\1", t)


def persian_skeleton(text: str) -> str:
    """The same of a name in Persian letters."""
    return re.sub(r"(.)\1", r"\1", "".join(_LATIN_OF.get(c, "") for c in sound(text)))


def typing_cost(a: str, b: str, most: float = 3.0) -> float:
    """Cost of the typing errors that make ``b`` out of ``a``: 1 for a letter changed, lost, added or swapped with its neighbour, 0.7 for one doubled."""
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    if abs(n - m) > most + 0.5:
        return most + 1
    before: list[float] = []
    row = [float(j) for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [float(i)]
        x = a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            add = 0.7 if j > 1 and y == b[j - 2] else 1.0
            c = min(row[j] + 1.0, new[j - 1] + add, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                c = min(c, before[j - 2] + 1.0)
            new.append(c)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[m]


def given_cost(typed: str, name: str) -> tuple[float, str]:
    """Cost of ``typed`` for the given name ``name`` (both ``sound``), above 3 if it can't be, and what was done: none, exact, initial, typo or short."""
    if not typed:
        return 0.3, "none"
    if typed == name:
        return 0.0, "exact"
    if len(typed) == 1:
        return (0.3 if name.startswith(typed) else 4.0), "initial"
    cost = typing_cost(name, typed, ERRORS)
    if cost <= ERRORS:
        return cost, "typo"
    body = typed[:-1] if len(typed) > 2 and typed[-1] in "یو" else typed
    if body[0] == name[0] and len(body) <= len(name):
        at = 0
        for c in body:
            at = name.find(c, at) + 1
            if not at:
                return 4.0, "short"
        return 0.8, "short"
    return 4.0, "short"


class Way(NamedTuple):
    """How the channel makes a spelling from a form: its cost, by which ways that can't be are told, and the choices it took."""

    cost: float
    script: str
    given: str
    order: str
    parting: str
    errors: float


NO_WAY = Way(9.0, "persian", "typo", "straight", "parted", 9.0)
CHOICES = {"script": ("persian", "latin"), "given": ("exact", "none", "initial", "short", "typo"), "order": ("straight", "reversed"), "parting": ("parted", "glued")}
#: Letters that a wrong one may be.
LETTERS = 33


class Likelihood:
    """Log likelihoods of the channel's choices and of typing errors; before anything is counted, usual ways are as likely as in plain text."""

    def __init__(self):
        self.counts = {k: dict.fromkeys(v, 1.0) for k, v in CHOICES.items()}
        for k, v in CHOICES.items():
            self.counts[k][v[0]] += 8.0
        self.mentions, self.errors = 10.0, 1.0

    def of(self, way: Way) -> float:
        told = sum(math.log(self.counts[k][getattr(way, k)] / sum(self.counts[k].values())) for k in CHOICES)
        return told + way.errors * (math.log(self.errors / self.mentions) - math.log(LETTERS))

    def count(self, way: Way, n: int) -> None:
        for k in CHOICES:
            self.counts[k][getattr(way, k)] += n
        self.mentions, self.errors = self.mentions + n, self.errors + n * way.errors


class Canon:
    """A candidate canonical form, ready to be compared."""

    def __init__(self, ident: int, name: str, company: bool, weight: float):
        words = [sound(w) for w in _zwnj.sub("", canonicalize(name) or "").split()]
        if company:
            kind = next((k for k in KINDS if name.startswith(k)), "")
            words = words[len(kind.split()) :]
        self.ident, self.company = ident, company
        self.first, self.last = (words[0], "".join(words[1:])) if len(words) > 1 else ("", "".join(words))
        self.whole = self.first + self.last
        raw = canonicalize(name) or ""
        parts = raw.split()[len(kind.split()) if company else 0 :]
        self.latin = (persian_skeleton(parts[0]), persian_skeleton("".join(parts[1:]))) if len(parts) > 1 else ("", persian_skeleton("".join(parts)))
        self.prior = math.log(weight + 1.0)


class Channel:
    """Resolves spellings against candidates."""

    def __init__(self, canons: list[Canon], likelihood: Likelihood | None = None):
        self.canons, self.likelihood = canons, likelihood or Likelihood()
        self.grams: dict[str, list[int]] = {}
        self.latin_grams: dict[str, list[int]] = {}
        for i, c in enumerate(canons):
            for g in self._grams(c.last) | self._grams(c.first):
                self.grams.setdefault(g, []).append(i)
            for g in self._grams("".join(c.latin)):
                self.latin_grams.setdefault(g, []).append(i)
        self._index = {k: np.array(v) for k, v in self.grams.items()}
        self._latin = {k: np.array(v) for k, v in self.latin_grams.items()}
        self.exact: dict[str, list[int]] = {}
        for i, c in enumerate(canons):
            self.exact.setdefault(c.last, []).append(i)

    @staticmethod
    def _grams(s: str) -> set[str]:
        return {s[i : i + 2] for i in range(len(s) - 1)}

    def _near(self, index: dict[str, np.ndarray], text: str) -> list[int]:
        score = np.zeros(len(self.canons), np.int16)
        for g in self._grams(text):
            if g in index:
                score[index[g]] += 1
        best = int(score.max(initial=0))
        if best < 2:
            return []
        # every candidate that could still be within the errors allowed: an error spoils at most three pairs of letters
        return [int(i) for i in np.flatnonzero(score >= max(2, best - 4))]

    def parse(self, spelling: str) -> tuple[list[str], bool, bool]:
        """(tokens, whether a title stood before them, whether they are Latin) of a spelling; roles in parentheses are dropped."""
        text = _zwnj.sub("", canonicalize(_paren.sub(" ", spelling)) or "")
        tokens = [t for t in _token.findall(text) if t not in "،,"]
        latin = sum(c.isascii() for t in tokens for c in t if c.isalpha()) * 2 > sum(c.isalpha() for t in tokens for c in t)
        titles = LATIN_TITLES if latin else TITLES
        titled = False
        while len(tokens) > 1 and tokens[0].strip(".").lower() in titles:
            tokens, titled = tokens[1:], True
        return tokens, titled, latin

    def way(self, c: Canon, tokens: list[str], latin: bool) -> Way:
        """The cheapest way of the channel from the candidate to the tokens."""
        if latin:
            first, last = c.latin
            words = [latin_skeleton(t) for t in tokens if t.strip(".").lower() not in LATIN_KINDS]
            initial = [bool(len(t.strip(".")) <= 2) for t in tokens if t.strip(".").lower() not in LATIN_KINDS]
        else:
            first, last = c.first, c.last
            words, initial = [sound(t) for t in tokens], [False] * len(tokens)
        script, best = "latin" if latin else "persian", NO_WAY
        n = len(words)
        for i in range(n + 1):
            for order, given, family in (("straight", words[:i], words[i:]), ("reversed", words[i:], words[:i])):
                if not family:
                    continue
                fam = "".join(family)
                if abs(len(fam) - len(last)) > 2:
                    continue
                most = min(ERRORS, 0.25 * len(last)) if not latin else min(1.0, 0.2 * len(last))
                d = typing_cost(last, fam, most)
                if d > most:
                    continue
                g = "".join(given)
                if c.company:
                    e, how = self._brand(first, g, latin), "exact" if g == first else "typo"
                elif latin:
                    short = given and initial[words.index(given[0])] if given else False
                    e = 0.3 if not g and not given else (0.3 if short and first.startswith(g[:1]) else typing_cost(first, g, 1.0))
                    how = "none" if not given else "initial" if short else "exact" if not e else "typo"
                    e = e if e <= 1.0 else 4.0
                else:
                    e, how = given_cost(g, first)
                if d + e < best.cost:
                    best = Way(d + e, script, how, order if given else "straight", "parted", d + (e if how == "typo" else 0.0))
        if not c.company and not latin and n == 1:  # all glued
            for order, glued in (("straight", first + last), ("reversed", last + first)):
                d = typing_cost(glued, words[0], ERRORS)
                if d <= ERRORS and d < best.cost:
                    best = Way(d, script, "exact", order, "glued", d)
        return best

    @staticmethod
    def _brand(brand: str, typed: str, latin: bool) -> float:
        if not typed:
            return 4.0
        d = typing_cost(brand, typed, min(ERRORS, 0.3 * len(brand)))
        return d if d <= min(ERRORS, 0.3 * len(brand)) else 4.0

    def company_tokens(self, spelling: str, tokens: list[str]) -> list[str]:
        """The tokens without the kind of firm, spelled out (with errors) or as an initial."""
        if len(tokens) >= 3 and "".join(tokens[:2]) in ("گروهصنعتی",):
            return tokens[2:]
        if len(tokens) >= 2:
            head = sound(tokens[0])
            if len(head) == 1 or any(typing_cost(sound(k), head, 1.0) <= 1.0 for k in KINDS if " " not in k):
                return tokens[1:]
            if len(tokens) >= 3 and any(typing_cost(sound("".join(k.split())), sound("".join(tokens[:2])), 1.0) <= 1.0 for k in KINDS if " " in k):
                return tokens[2:]
        return tokens

    def resolve(self, spelling: str | None) -> int | None:
        """Index of the form with the highest posterior, None if the channel makes the spelling from none."""
        at = self.attribute(spelling)
        return None if at is None else at[0]

    def attribute(self, spelling: str | None) -> tuple[int, Way] | None:
        """The same with the way from the form to the spelling."""
        if not spelling:
            return None
        tokens, titled, latin = self.parse(spelling)
        if not tokens:
            return None
        bare = tokens if latin else self.company_tokens(spelling, tokens)
        if latin:
            key = "".join(latin_skeleton(t) for t in tokens if t.strip(".").lower() not in LATIN_KINDS)
            near = self._near(self._latin, key)
        else:
            words = [sound(t) for t in tokens]
            parts = {"".join(words[i:]) for i in range(len(words))} | {"".join(words[:i]) for i in range(1, len(words))}
            # a family name without an error needs no search, unless the given name speaks against it
            same = [i for part in parts for i in self.exact.get(part, ())]
            at = self._best(same, tokens, bare, latin, 1.0)
            if at is not None:
                return at
            near = self._near(self._index, "".join(words))
            if len(bare) < len(tokens):  # the kind of a firm must not draw the search away from the firm's name
                near = sorted({*near, *self._near(self._index, "".join(words[len(tokens) - len(bare) :]))})
        return self._best(near, tokens, bare, latin, 2.5)

    def _best(self, near: list[int], tokens: list[str], bare: list[str], latin: bool, most: float) -> tuple[int, Way] | None:
        best, at = -math.inf, None
        for i in near:
            c = self.canons[i]
            way = self.way(c, bare if c.company else tokens, latin)
            if c.company and not latin and len(bare) == 1:
                glued = sound(bare[0])
                d = min(typing_cost(g, glued, ERRORS) for g in (c.whole, c.last + c.first))
                if d <= ERRORS and d < way.cost:
                    way = Way(d, "persian", "exact", "straight", "glued", d)
            if way.cost > most:
                continue
            posterior = c.prior + self.likelihood.of(way)
            if posterior > best:
                best, at = posterior, (i, way)
        return at


def mentions(calls: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (record_id, mention_no, name): 0 = customer and 1 = owner of a call, positions in crm_names of a window. Null and blank names are no mentions; unreadable JSON has none."""
    j = F.col("client_metadata_json")
    names = F.array(F.get_json_object(j, "$.customer.name"), F.get_json_object(j, "$.crm.owner_name"))
    a = calls.filter(F.try_parse_json(j).isNotNull()).select(F.col("id").alias("record_id"), F.posexplode(names).alias("mention_no", "name"))
    b = windows.select(F.col("window_id").alias("record_id"), F.posexplode("crm_names").alias("mention_no", "name"))
    return a.unionByName(b).filter((F.trim("name") != "") & F.col("record_id").isNotNull()).distinct()


def canonical_forms(ranked: list[tuple[str, int]], register: list[tuple[int, str, bool]], rounds: int = 2) -> Channel:
    """The channel with its forms and likelihoods, from the frequent spellings (spelling, mentions), most frequent first.

    Every spelling is a candidate form. One that the channel makes from a register entry is that entry's, the entry's frequency being that of the spelling it is written like; one of two plain parts
    that no entry and no more frequent form explains is the form of somebody outside the register; the others are variants. The variants are aligned with their forms, and the channel's
    likelihoods counted from that, in a few rounds. Entries that no frequent spelling is written like are forms with a frequency of 0.
    """
    weight = dict(ranked)
    entries = [Canon(i, name, company, weight.get(name, 0)) for i, name, company in register]
    likelihood = Likelihood()
    channel = Channel(entries, likelihood)
    outside = []
    for name, n in ranked:
        if channel.attribute(name) is None:
            tokens, titled, latin = channel.parse(name)
            if not latin and not titled and len(tokens) == 2 and all(len(t) > 2 for t in tokens):
                outside.append(Canon(-1, " ".join(tokens), False, n))
    for _ in range(rounds):
        channel, counted = Channel(entries + outside, likelihood), Likelihood()
        for name, n in ranked:
            at = channel.attribute(name)
            if at is not None:
                counted.count(at[1], n)
        likelihood = counted
    return Channel(entries + outside, likelihood)


def link_names(mentioned: DataFrame, register: DataFrame, share: float = SHARE, least: int = COUNT) -> DataFrame:
    """(record_id, mention_no, person_id) of the mentions (record_id, mention_no, name) of a registered person or firm.

    ``register``: (person_id, full_name, kind person | company), a fixed table; rows with a null name are left out. An empty register links nothing.
    """
    mentioned = materialize(mentioned)
    counted = mentioned.groupBy("name").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    entries = [(r.person_id, r.full_name, r.kind == "company") for r in register.filter("full_name is not null and person_id is not null").collect()]
    often = counted.filter(F.col("n") >= max(least, math.ceil(share * total))).orderBy(F.desc("n"), "name").collect()
    channel = canonical_forms([(r.name, r.n) for r in often], entries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [channel.resolve(n) for n in b.name]
            ids = [None if i is None or channel.canons[i].ident < 0 else channel.canons[i].ident for i in at]
            out = pd.DataFrame({"name": b.name, "person_id": pd.array(ids, dtype="Int64")})
            yield out[out.person_id.notna()]

    parts = max(int(mentioned.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    resolved = counted.select("name").repartition(parts).mapInPandas(run, "name string, person_id long")
    return mentioned.join(resolved, "name").select("record_id", "mention_no", "person_id")
