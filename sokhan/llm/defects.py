"""Problem 3: broken prompt and response pairs.

Method: noisy labelling functions for every defect, combined by an expectation-maximization label model. Each function looks at a pair in
its own way and votes or not: at characters, lengths, words shared with the input, corrections of the reference that are missing, lists of phrases, a character model of the
inputs' language, and a word model of refusals, the last two learnt from all rows. For each defect, the counts of vote patterns over all rows (a handful of numbers, however many rows)
are fitted by a two-class model in which the functions err independently; its posterior is the probability of the defect. An answer keeps
every defect whose posterior exceeds the defect's cutoff. Cutoffs are validated on all inputs and references, to which the defects
are done on purpose; of these, too, only counts of vote patterns are gathered.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sokhan.materialize import discard, materialize

#: In the order in which one of several defects is chosen.
DEFECTS = ("refusal", "empty", "other_language", "copied", "truncated")
#: Different counts that a task holds before it hands them on.
HELD = 500_000

# How a model excuses itself, says that it can't, and names its task, in Persian, English, German, Turkish and Arabic.
EXCUSE = r"متأسفم|متاسفم|عذرخواهی|پوزش|شرمنده|ببخشید|هوش مصنوعی|مدل زبانی|\b(sorry|apologi[sz]e|unfortunately|as an ai|language model|leider|entschuldigung|üzgünüm|maalesef)\b|آسف|عذرا|أعتذر"
INABILITY = r"نمی‌?توان(م|یم)|نمی توانم|قادر به|معذورم|اجازه ندارم|امکان انجام|مجاز نیستم|\b(i|we) (cannot|can't|can not|am unable|must decline|won't|am not able|am not allowed)\b|\bi'm (unable|not able|not allowed)\b|\bkann ich (das|diesen)|\bich kann\b.{0,40}\bnicht\b|\b(edemem|yapamam|yardımcı olamam)\b|لا (أستطيع|يمكنني)"
TASK = r"این (متن|رونوشت|مکالمه|درخواست|مورد)|\b(this|the|your) (text|transcript|request|conversation|input|message)\b|\b(guidelines|personal data|another text|more context)\b|ضوابط من|اطلاعات شخصی|درخواست دیگری|diesen text|bu metni|هذا النص"
_excuse, _inability, _task = (re.compile(p, re.I) for p in (EXCUSE, INABILITY, TASK))
_said = re.compile(r"[^\W_]")
_word = re.compile(r"[\w\u200c']+")
_solid = re.compile(r"[^\W_]+")
# a few words and a colon before the answer itself
_lead = re.compile(r"\W{0,3}(?:[^\W\d_]+[\s\u200c]+){0,5}[^\W\d_]+\s*:")
_mark = re.compile(r"(?<![\w])[\[(]?[0-9۰-۹]{1,4}[\]).:\-]\s*")
_latin_run, _arabic_run, _other_run = re.compile("[A-Za-zÀ-ɏ]+"), re.compile("[\u0621-\u06d3\ufb50-\ufdfb\ufe70-\ufefc]+"), re.compile("[\u0370-\u058f\u0900-\u1fff\u3040-\ud7ff]+")
# Common words that tell the languages of Latin script apart.
_LATIN_WORDS = {
    "en": frozenset("the a an of to and is was are be been by has have for with in on at this that your our we you not can cannot because after before until while please so will it".split()),
    "de": frozenset("der die das den dem ein eine und ist wurde wird nicht mit auf für von zu wegen noch wir um sie ich bitte deshalb bevor ohne".split()),
    "tr": frozenset("ve bir bu için ile çok değil olarak da de size lütfen bugün yarın henüz ayrıca çünkü".split()),
}
_arabic_word = re.compile("^(و?ال|لل)|[ةىإ]|^(من|مع|عن|على|في|إلى|حتى|قبل|بعد|لأن|لذلك|وسوف|سوف|تم|غير|بسبب|هذا|هذه|أن|بكم|يوم|أعيد|ينتظر|تأخر|وصل|يرجى)$")
_persian_letter = re.compile("[پچژگکی‌]")


# Without one of these no sign of INABILITY can match, whatever the case of its letters; most texts have none, and a search takes long.
_unable = ("توان", "قادر به", "معذورم", "اجازه ندارم", "امکان انجام", "مجاز نیستم", " can", " am ", " must ", " won't", "'m ", "kann", "edemem", "yapamam", "olamam", "لا أ", "لا ي")


def unable(text: str) -> bool:
    """True if INABILITY occurs in ``text``."""
    low = text.lower().replace("ſ", "s")
    return any(map(low.__contains__, _unable)) and bool(_inability.search(text))


def unmarked(text: str) -> str:
    """``text`` without numbers before its words or lines."""
    return _mark.sub("", text) if any(c in text for c in "]).:-") else text


def parted(text: str) -> tuple[list[str], list[str]]:
    """The runs of letters and digits of a text, and its words."""
    return _solid.findall(text), _word.findall(text)


_parted_short, _unable_short = lru_cache(1_000)(parted), lru_cache(1_000)(unable)


@lru_cache(200_000)
def _is_arabic(word: str) -> bool:
    return bool(_arabic_word.search(word))


def own_words(words: list[str], theirs: set[tuple[str, ...]], single: set[str]) -> list[str]:
    """The words not taken from the caller: in no run of three that the input or the reference has; of fewer than three words, those they lack."""
    if len(words) < 3:
        return [w for w in words if w not in single]
    taken = [False] * len(words)
    for i, run in enumerate(zip(words, words[1:], words[2:])):
        if run in theirs:
            taken[i] = taken[i + 1] = taken[i + 2] = True
    return [w for w, t in zip(words, taken) if not t]


@lru_cache(1_000)
def _language_short(text: str) -> str:
    return language(text)


def language(text: str) -> str:
    """fa, ar, en, de, tr, another script's "xx", or "" for a text without letters; the language of most of the letters."""
    latin, arabic, other = (sum(map(len, r.findall(text))) for r in (_latin_run, _arabic_run, _other_run))
    if not latin + arabic + other:
        return ""
    if other > max(latin, arabic):
        return "xx"
    words = _word.findall(text.lower())
    if latin > arabic:
        hits = {k: sum(map(v.__contains__, words)) for k, v in _LATIN_WORDS.items()}
        if any(c in text for c in "ışğİ"):
            hits["tr"] += 3
        return max(sorted(hits), key=hits.__getitem__) if any(hits.values()) else "en"
    like = sum(map(_is_arabic, words))
    return "ar" if like * 2 > sum(not w.isascii() for w in words) else "fa"


class Tally:
    """Counts to learn from: ``grams``, runs of three characters of inputs; ``said``, words of inputs; ``told``, words of rejected lines that the input lacks."""

    def __init__(self):
        self.grams, self.said, self.told = Counter(), Counter(), Counter()

    def add(self, source: str, lines: list[str | None]) -> None:
        own = _word.findall(source.lower())
        flat = " ".join(own)
        self.grams.update([flat[i : i + 3] for i in range(len(flat) - 2)])
        self.said.update(own)
        for line in lines:
            # a rejected line that asks for no edit is the model speaking
            if line and "→" not in line:
                self.told.update(set(_word.findall(line.lower())) - set(own))

    def hand_on(self) -> pd.DataFrame:
        """(kind, what, n); the tally is empty again."""
        out = [(kind, w, n) for kind in ("grams", "said", "told") for w, n in getattr(self, kind).items()]
        self.__init__()
        return pd.DataFrame(out, columns=["kind", "what", "n"])


class Learnt:
    """What the rows tell: how the inputs' language goes in runs of three characters, and which words refusals are made of."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        tally = Tally()
        for source, lines in rows:
            tally.add(source, lines)
        self._count(tally.grams, {w: (n, tally.said[w]) for w, n in tally.told.items()}, sum(tally.told.values()), sum(tally.said.values()))

    def _count(self, grams: dict[str, int], told: dict[str, tuple[int, int]], all_told: int, all_said: int) -> None:
        """``told``: of each word how often it was told, and said."""
        total, kinds = sum(grams.values()) + 1, len(grams) + 1
        self.known: dict[str, float] = {}
        self.rare = math.log(0.5 / (total + kinds))
        self.grams = {g: math.log((n + 0.5) / (total + kinds)) for g, n in grams.items()}
        a, b = all_told + 1.0, all_said + 1.0
        self.odds = {w: math.log((n + 0.1) / a) - math.log((m + 0.5) / b) for w, (n, m) in told.items() if n > 1}

    @classmethod
    def of(cls, answers: DataFrame) -> Learnt:
        """Learnt from all rows of (input, lines); counts are summed by the tasks, and those of words that nobody told stay there."""

        def tallies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tally = Tally()
            for b in batches:
                for source, lines in zip(b.input, b.lines):
                    tally.add(source, [] if lines is None else list(lines))
                    if len(tally.grams) + len(tally.said) + len(tally.told) > HELD:
                        yield tally.hand_on()
            yield tally.hand_on()

        counted = answers.filter("input is not null").select("input", "lines").mapInPandas(tallies, "kind string, what string, n long")
        # words told and said stand in one row; runs of characters are apart
        n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
        counted = materialize(counted.groupBy((F.col("kind") == "grams").alias("run"), "what").agg(*map(n, ("grams", "said", "told"))))
        whole = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("said", "told"))).first()
        kept = counted.filter("run or told > 1").select("run", "what", F.col("grams") + F.col("told"), "said").collect()
        discard(counted)
        out = cls([])
        out._count({w: k for run, w, k, _ in kept if run}, {w: (k, m) for run, w, k, m in kept if not run}, whole.told, whole.said)
        return out

    def surprise(self, text: str) -> float:
        """Mean negative log probability of a run of three characters; 0 for fewer."""
        if (known := self.known.get(text)) is not None:
            return known
        flat = " ".join(_word.findall(text.lower()))
        n = len(flat) - 2
        out = -sum(map(self.grams.get, [flat[i : i + 3] for i in range(n)], repeat(self.rare, n))) / n if n > 0 else 0.0
        if len(text) < 200 and len(self.known) < 10_000:
            self.known[text] = out
        return out

    def refuses(self, words: list[str]) -> bool:
        """True for four words or more that rather are a refusal's than a caller's: known ones by their odds, unknown ones speak for neither."""
        return len(words) >= 4 and sum(self.odds.get(w.lower(), 0.0) for w in words) > 2.0 * math.sqrt(len(words))


class Given:
    """What the functions ask about an input and its reference, whatever the output; each is found once."""

    def __init__(self, source: str, reference: str):
        self.source, self.reference = source, reference
        (self.letters, self.x), (letters, self.r) = parted(source), parted(reference)
        self.parts = {source.strip(): (self.letters, self.x), reference.strip(): (letters, self.r)}
        self.squash = "".join(self.letters)
        self.given = set(self.x)
        self.known = self.given | set(self.r)

    @cached_property
    def runs(self) -> set[tuple[str, ...]]:
        return {*zip(self.x, self.x[1:], self.x[2:]), *zip(self.r, self.r[1:], self.r[2:])}

    @cached_property
    def language(self) -> str:
        return language(self.source)

    @cached_property
    def changed(self) -> bool:
        return bool(self.squash) and "".join(self.parted(self.reference)[0]) != self.squash

    def parted(self, text: str) -> tuple[list[str], list[str]]:
        """``parted`` of an output, which often is the input or the reference."""
        return self.parts.get(text.strip()) or (_parted_short if len(text) < 200 else parted)(text)

    def plain(self, letters: list[str]) -> list[str]:
        return self.unnumbered if letters == self.letters else unnumbered(letters)

    @cached_property
    def unnumbered(self) -> list[str]:
        return unnumbered(self.letters)

    @cached_property
    def bare(self) -> str:
        return "".join(self.unnumbered)

    @cached_property
    def ordered(self) -> list[str]:
        return sorted(self.unnumbered)

    @cached_property
    def mended(self) -> set[str]:
        return self.known - self.given

    def surprise(self, learnt: Learnt) -> float:
        if not hasattr(self, "_surprise"):
            self._surprise = learnt.surprise(self.source)
        return self._surprise


def unnumbered(words: list[str]) -> list[str]:
    return [w for w in words if len(w) > 3 or not w.isdigit()]


def _tone(own: str) -> tuple[int, int, int]:
    return int(bool(_excuse.search(own))), int(unable(own)), int(bool(_task.search(own)))


_tone_short = lru_cache(10_000)(_tone)


def _refusal(out: str, lines: list[str], about: Given, novel_share: float, learnt: Learnt) -> tuple[int, ...]:
    """Votes excuse, inability, task, and the learnt model's, each only on words that aren't the caller's; of the output and the lines the one with most votes counts."""
    best = (0, 0, 0, 0)
    for k, text in enumerate((out, *lines)):
        # an edit line says where it is to be done; of an output, what isn't the caller's counts
        if not text or not ((novel_share > 0.3 and not k) or (k and "→" not in text) or (_unable_short if len(text) < 200 else unable)(text) or (k and _excuse.search(text))):
            continue
        words = own_words(about.parted(unmarked(text))[1], about.runs, about.known)
        own = " ".join(words)
        best = max(best, (*(_tone_short if len(own) < 200 else _tone)(own), int(learnt.refuses(words))), key=sum)
    return best


def votes(source: str | None, output: str | None, reference: str | None, lines: list[str], learnt: Learnt, about: Given | None = None) -> dict[str, tuple[int, ...]]:
    """The votes of all labelling functions on a pair; ``lines`` are the rejected lines. Null texts count as empty. ``about``: what is known of input and reference."""
    out, about = output or "", about or Given(source or "", reference or "")
    said = bool(_said.search(out))
    v: dict[str, tuple[int, ...]] = dict.fromkeys(DEFECTS, ())
    letters_out, y = about.parted(out)
    bare_out, bare_in = sum(map(len, letters_out)), len(about.squash)
    # white space apart, as only matters where letters are few
    shown = 0 if bare_out * 3 >= len(out) else sum(map(len, out.split()))
    # no letter or digit; signs rather than letters; next to nothing against the input
    v["empty"] = (int(not said), int(bare_out * 3 < shown or not bare_out), int(bare_out < 0.02 * bare_in or not bare_out))
    x = about.x
    known = about.known
    strange = [w for w in y if w not in known]
    novel_share = sum(map(len, strange)) / sum(map(len, y)) if strange else 0.0
    v["refusal"] = _refusal(out, lines, about, novel_share, learnt)

    v["other_language"], same = (0, 0, 0), True
    # where most of the letters stand in the input's words, most of the output is in the input's language
    if said and novel_share > 0.3:
        lang_in, lang_out = about.language, (_language_short if len(out) < 200 else language)(out)
        same = lang_in == lang_out
        # common words and scripts; words that nobody said; runs of characters unlike those of the inputs and of this input
        v["other_language"] = (
            int(bool(lang_in and lang_out) and not same),
            int(novel_share > 0.5 and len(strange) >= 3),
            int(learnt.surprise(" ".join(strange)) > about.surprise(learnt) + 1.0),
        )

    v["copied"], again = (0, 0, 0), False
    squash, changed = about.squash, about.changed
    body = out
    if said and squash:
        forms = [out, unmarked(out)]
        if m := _lead.match(out):
            body = out[m.end() :]
            forms += [body, unmarked(body)]
        parts = {f: letters_out if f is out else about.parted(f)[0] for f in dict.fromkeys(forms)}
        again = any(ws == about.letters or "".join(ws) == squash for ws in parts.values()) or (abs(len(y) - len(x)) > 2 and any(sum(map(len, parts[f])) >= len(about.bare) and "".join(about.plain(parts[f])) == about.bare for f in forms[1::2]))
        spoken = parts[forms[-1]]
        # of fewer parts than the input has without numbers it can't be made
        spoken = about.plain(spoken) if changed and len(spoken) >= len(about.unnumbered) else None
        # the same characters; the same words as often; as long as the input, with none of the reference's corrections
        v["copied"] = (
            int(again and changed), int(spoken is not None and len(spoken) == len(about.unnumbered) and (spoken == about.unnumbered or sorted(spoken) == about.ordered)),
            int(changed and abs(bare_out - len(squash)) <= 0.1 * len(squash) + 12 and about.mended.isdisjoint(y) and not strange[3:]),
        )

    v["truncated"] = (0, 0, 0, 0)
    y = about.parted(unmarked(body))[1] if body is not out or "[" in out[:3] else y
    if said and not again and len(x) >= 4 and len(y) <= 0.9 * len(x):
        head = set(x[: len(y) + 2 + len(y) // 8])
        along = sum(map(head.__contains__, y))
        if along >= 0.4 * len(y):
            tail = x[int(0.9 * len(x)) :]
            behind = set(y[-len(tail) - 3 :])
            ends = [w for w in y[-6:] if w in head]
            # follows the input; its last words stand where the input's are at that length; the input's end is missing; it isn't in another language, and declines nothing
            v["truncated"] = (int(along >= 0.55 * len(y)), int(len(ends) >= min(2, len(y))), int(sum(map(behind.__contains__, tail)) <= 0.5 * len(tail)), int(same and v["refusal"][1] == 0))
    return v


class LabelModel:
    """A two-class model of one defect's functions, which err independently, fitted to the counts of their vote patterns."""

    def __init__(self, n: int, share: float = 0.03):
        self.share, self.hit, self.miss = share, [0.9] * n, [0.03] * n

    def posterior(self, pattern: tuple[int, ...]) -> float:
        s = math.log(self.share / (1 - self.share))
        for v, h, m in zip(pattern, self.hit, self.miss):
            s += math.log(h / m) if v else math.log((1 - h) / (1 - m))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, s))))

    def fit(self, counts: dict[tuple[int, ...], int], rounds: int = 100, tolerance: float = 1e-6) -> LabelModel:
        """Expectation-maximization from the functions' presumed quality; weak priors keep rates off 0 and 1 and the defect the rarer class."""
        total = sum(counts.values())
        for _ in range(rounds if total else 0):
            p = {k: self.posterior(k) for k in counts}
            mass = sum(p[k] * n for k, n in counts.items())
            old = [self.share, *self.hit, *self.miss]
            self.share = min(0.5, (mass + 1) / (total + 40))
            for i in range(len(self.hit)):
                yes = sum(p[k] * n for k, n in counts.items() if k[i])
                no = sum((1 - p[k]) * n for k, n in counts.items() if k[i])
                self.hit[i] = min(0.999, max(0.5, (yes + 9) / (mass + 10)))
                self.miss[i] = min(0.3, max(1e-4, (no + 0.3) / (total - mass + 10)))
            if max(abs(a - b) for a, b in zip(old, [self.share, *self.hit, *self.miss])) < tolerance:
                break
        return self


def damaged(source: str, reference: str, about: Given | None = None) -> list[tuple[str, str, str]]:
    """(defect or "", input, output): a sound pair and the same pair with each defect done to it."""
    about = about or Given(source, reference)
    words = reference.split()
    out = [("", source, reference), ("empty", source, " \n"), ("refusal", source, "متأسفم، نمی‌توانم این متن را اصلاح کنم."), ("refusal", source, "Sorry, I cannot edit this transcript.")]
    if about.squash != "".join(about.parted(reference)[0]):
        out += [("copied", source, source), ("copied", source, "پاسخ: " + source)]
        about.parts[out[-1][2].strip()] = ["پاسخ", *about.letters], ["پاسخ", *about.x]
    if len(words) >= 10:
        at, letters, said = 0, [], []
        for s in (0.3, 0.6, 0.8):
            # white space parts words, so those of a longer head are added to a shorter one's
            more = parted(" ".join(words[at : (at := int(len(words) * s))]))
            letters, said = letters + more[0], said + more[1]
            head = " ".join(words[:at])
            about.parts[head] = letters, said
            out.append(("truncated", source, head))
    if about.language == "fa":
        out.append(("other_language", source, "The parcel was sent back to the seller and we are waiting for a new invoice. Please call us again tomorrow."))
    return out


def choose_cutoffs(models: dict[str, LabelModel], counts: dict[str, dict[tuple[tuple[int, ...], bool], int]]) -> dict[str, float]:
    """For each defect the cutoff with the best F1 on ``damaged`` pairs, halfway to the next lower posterior; 0.5 where none has the defect.

    ``counts``: of each defect how many pairs have a vote pattern and the defect, or a pattern and not the defect.
    """
    cutoffs = {}
    for d in DEFECTS:
        true: Counter[float] = Counter()
        all_: Counter[float] = Counter()
        for (pattern, truth), n in counts.get(d, {}).items():
            p = models[d].posterior(pattern)
            all_[p] += n
            true[p] += n * truth
        positives, best = sum(true.values()), (0.0, 0.5)
        hits, above, levels = positives, sum(all_.values()), sorted(all_)
        for i, level in enumerate(levels):
            f1 = 2 * hits / (above + positives) if positives else 0.0
            best = max(best, (f1, (level + (levels[i - 1] if i else 0.0)) / 2))
            hits, above = hits - true[level], above - all_[level]
        cutoffs[d] = min(0.9, max(0.1, best[1])) if positives else 0.5
    return cutoffs


class Defects:
    """Defects of ``answers`` (pred_id, input, output, reference, rejected_lines array<struct<line, ...>>).

    Rows with a null pred_id are left out; an answer delivered twice counts once, with the defects of all its rows. Null texts count as
    empty, null or empty rejected_lines as none. An empty table gives empty results.
    """

    def __init__(self, answers: DataFrame):
        spark = answers.sparkSession
        read = answers.filter("pred_id is not null").select("pred_id", "input", "output", "reference", F.transform("rejected_lines", lambda x: x["line"]).alias("lines"))
        shared = spark.sparkContext.broadcast(Learnt.of(read))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tried: Counter[tuple[tuple[tuple[int, ...], ...], str]] = Counter()
            told = lambda got: ["".join(map(str, v)) for v in got]
            learnt = shared.value
            for b in batches:
                rows = []
                for k, i, o, r, ls in zip(b.pred_id, b.input, b.output, b.reference, b.lines):
                    about = Given(i or "", r or "")
                    rows.append((k, *told(votes(i, o, r, [] if ls is None else list(ls), learnt, about).values()), None, None))
                    if i is not None and r is not None:
                        tried.update([(tuple(votes(i, out, r, [], learnt, about).values()), truth) for truth, _, out in damaged(i, r, about)])
                yield pd.DataFrame(rows, columns=columns)
            yield pd.DataFrame([(None, *told(got), truth, n) for (got, truth), n in tried.items()], columns=columns)

        columns = ["pred_id", *DEFECTS, "truth", "n"]
        both = materialize(read.mapInPandas(run, "pred_id string, " + ", ".join(f"{d} string" for d in DEFECTS) + ", truth string, n long"))
        # rows of pairs damaged on purpose have a truth, which answers lack
        self.votes = both.filter("truth is null").drop("truth", "n")
        one = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("v"), (F.col("truth") == d).alias("t")) for d in DEFECTS))).alias("x")
        rows = both.select(one, F.coalesce("n", F.lit(1)).alias("n")).groupBy("x.d", "x.v", "x.t").agg(F.sum("n").alias("count")).collect()
        counts: dict[str, dict[tuple[int, ...], int]] = {d: {} for d in DEFECTS}
        tried: dict[str, dict[tuple[tuple[int, ...], bool], int]] = {d: {} for d in DEFECTS}
        for r in rows:
            v = tuple(map(int, r.v))
            if r.t is None:
                counts[r.d][v] = r["count"]
            else:
                tried[r.d][v, r.t] = r["count"]
        sizes = {"refusal": 4, "empty": 3, "other_language": 3, "copied": 3, "truncated": 4}
        self.models = {d: LabelModel(sizes[d]).fit(counts[d]) for d in DEFECTS}
        self.tried, self.cutoffs = tried, choose_cutoffs(self.models, tried)
        self._posterior = {d: {p: self.models[d].posterior(p) for p in counts[d]} for d in DEFECTS}

    def labels(self) -> DataFrame:
        """(pred_id, defect, posterior): every defect of every answer that exceeds its cutoff."""
        spark = self.votes.sparkSession
        table = [(d, "".join(map(str, p)), float(x)) for d in DEFECTS for p, x in self._posterior[d].items() if x > self.cutoffs[d]]
        kept = spark.createDataFrame(table or [("", "-", 0.0)], "defect string, v string, posterior double")
        long = self.votes.select("pred_id", F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("v")) for d in DEFECTS))).alias("x")).select("pred_id", "x.defect", "x.v")
        return long.join(F.broadcast(kept), ["defect", "v"]).groupBy("pred_id", "defect").agg(F.max("posterior").alias("posterior"))

    def first(self) -> DataFrame:
        """(pred_id, defect): one defect per broken answer, in the order of DEFECTS."""
        rank = F.array_position(F.array(*map(F.lit, DEFECTS)), F.col("defect"))
        return self.labels().groupBy("pred_id").agg(F.min_by("defect", rank).alias("defect"))
