"""Problem 10: the reading level of each document.

Method: a Rasch-style latent difficulty model in its partial credit form. A document has a latent level on the specimens' scale, anywhere between the lowest and the
highest grade. A word, and a pair of neighbouring words, which shows how sentences are built, has a difficulty for each step of the scale; between two grades the
log odds of two words change with the level at the rate of their difficulties' difference:

    log p(w | level) = sum over grades k of hat_k(level) * ease(w, k) - log Z(level),    difficulty(w, k) = ease(w, k) - ease(w, k + 1)

with ``hat_k`` the piecewise linear functions of the grades. Estimated is by alternating optimisation, as marginal maximum likelihood does it: each
document's posterior over a grid of levels given the difficulties (each task over its own texts), then the difficulties given all documents' posteriors, by iterative scaling
steps, which never lower the likelihood because the hats add up to one; they need two sums over all documents, of the words by hat and of the text by level,
combined in the tasks before the shuffle. The graded specimens anchor the scale: they keep their levels in every round. Rounds end when the documents' mean log
likelihood per word moves by less than ``TOLERANCE``; a warning tells if that doesn't come within ``ROUNDS``.

Words are hashed into a table of fixed size, so the difficulties that travel to the tasks and the sums that come back have a bound
however large the corpus is.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sokhan.materialize import materialize

SLOTS = 1 << 18
MIN_WORDS = 20
ROUNDS, TOLERANCE = 20, 1e-3
#: Levels between two grades that are told apart, scaling steps a round, occurrences that hold a word to its share of the corpus.
FINE, STEPS, SMOOTH = 8, 3, 0.25
#: Weight of a specimen against a document of the same length.
ANCHOR = 3.0
_WORDS_KEPT = 400_000

# A line's head: who speaks, the number of an article, a reference; it is layout, not wording.
_label = re.compile(r"^[ \t]*[^\W\d_]{2,14}(?:[ \t]+[^\W_]{1,4})?[ \t]*:(?=\s)", re.M)
_digits = re.compile(r"[0-9۰-۹٠-٩]+")
_word = re.compile(r"[\w‌]+")
_fold = str.maketrans("يىكةۀأإآؤ", "ییکههااا" + "و")


def mostly_persian(text: str) -> bool:
    """True if most of the letters are of the Arabic script and the wording is Persian rather than Arabic."""
    n = len(text)
    if not n or len(text.encode("utf-8", "surrogatepass")) - n < 0.42 * n:
        return False
    persian = sum(map(text.count, "پچژگ"))
    arabic = text.count(" ال") + text.count("ة")
    words = text.count(" ") + 1
    forms = sum(map(text.count, "یک")) > 2 * sum(map(text.count, "يكةى"))
    return arabic * 4 < words and (persian * 50 >= words or forms)


class Words:
    """Texts as slots of the table: one for each word and one for each pair of neighbours; numbers are all alike."""

    def __init__(self, slots: int = SLOTS):
        self.slots, self.known = slots, {}

    def of(self, text: str) -> tuple[np.ndarray, int]:
        """(slots of words and pairs, number of words)."""
        if ":" in text:
            text = _label.sub(" ", text)
        words = _word.findall(_digits.sub("0", text))
        known = self.known
        if len(known) > _WORDS_KEPT:
            known.clear()
        new = [w for w in set(words) if w not in known]
        if new:
            # letter forms are folded once for each distinct word
            h = pd.util.hash_array(np.array([w.translate(_fold).lower() for w in new], dtype=object), categorize=False)
            known.update(zip(new, h.tolist()))
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (ids[1:] >> np.uint64(7))
        both = np.concatenate([ids, pairs ^ (pairs >> np.uint64(31))])
        return (both % np.uint64(self.slots)).astype(np.int64), len(words)


def hats(k: int, fine: int = FINE) -> np.ndarray:
    """(k, levels): the piecewise linear functions of ``k`` grades on a grid of ``fine`` levels a step."""
    at = np.linspace(0, k - 1, (k - 1) * fine + 1) if k > 1 else np.zeros(1)
    return np.maximum(0.0, 1.0 - np.abs(at[None, :] - np.arange(k)[:, None]))


class Difficulties:
    """The eases of all slots at each grade, a document's log likelihood under them, and their re-estimation."""

    def __init__(self, slots: int, k: int):
        self.hat = hats(k) if k else np.zeros((0, 1))
        self.ease = np.full((slots, k), -np.log(slots), np.float64)
        self.settle()

    def settle(self, some: np.ndarray | None = None) -> None:
        """Recomputes log Z over the grid; at the grades themselves it is taken into the eases. Slots other than ``some`` are all alike, so one stands for them."""
        if not len(self.hat):
            self.log_z = np.zeros(1)
            return
        few, times = self._few(some)
        shift = np.log(times @ np.exp(few))
        self.ease -= shift
        few = few - shift
        self.log_z = np.array([np.log(times @ np.exp(few @ h)) for h in self.hat.T])

    def _few(self, some: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The eases of ``some`` slots and one that stands for the others, and how many slots each stands for."""
        if some is None:
            some = np.zeros(len(self.ease), bool)
        others = len(some) - int(some.sum())
        few = self.ease[some] if not others else np.vstack([self.ease[some], self.ease[~some][:1]])
        return few, np.concatenate([np.ones(int(some.sum())), [float(others)] if others else []])

    def log_likelihood(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(documents, levels) from the documents' sums of eases and their numbers of slots."""
        return sums @ self.hat - n[:, None] * self.log_z

    def improve(self, seen: np.ndarray, text: np.ndarray, steps: int = STEPS) -> None:
        """Scaling steps towards ``seen`` (slots x grades: slots by hat, summed over the documents) given ``text`` (slots by level).

        A slot is held to its share of the corpus by pseudo documents at each grade in which it occurs ``SMOOTH`` times, less if it is rarer.
        """
        k = len(self.hat)
        some = seen.sum(1) > 0
        for _ in range(steps):
            few, times = self._few(some)
            own = seen[some] if len(few) == int(some.sum()) else np.vstack([seen[some], np.zeros((1, k))])
            whole = own.sum(1, keepdims=True)
            held = SMOOTH * (whole / max(whole.sum(), 1e-9) * k * len(seen)).clip(0.05, 1.0)
            expected = np.exp(few) * (times @ held).sum()
            for g, h in enumerate(self.hat.T):
                if text[g] > 0:
                    expected += np.outer(np.exp(few @ h - self.log_z[g]) * text[g], h)
            moved = np.log((own + held) / np.maximum(expected, 1e-12))
            self.ease[some] += moved[: int(some.sum())]
            if len(few) > int(some.sum()):
                self.ease[~some] += moved[-1]
            self.settle(some)


def posterior(log_likelihood: np.ndarray) -> np.ndarray:
    """Posteriors over the levels, which are equally likely beforehand."""
    p = np.exp(log_likelihood - log_likelihood.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def sums_of(ease: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents x grades sums of eases, numbers of slots, all slots one after another) of documents that have a slot each at least."""
    n = np.fromiter(map(len, slots), np.int64, len(slots))
    flat = np.concatenate(slots)
    starts = np.cumsum(n) - n
    return np.stack([np.add.reduceat(ease[:, c][flat], starts) for c in range(ease.shape[1])], axis=1), n, flat


class ReadingLevels:
    """Levels of ``documents`` (doc_id, text) on the scale of ``specimens`` (text, grade), a small fixed table.

    Rated are documents whose text is mostly Persian and has at least ``min_words`` words; null and blank texts have no level. Ids are unique.
    Repeated texts count as often as they are there. No specimens: nothing is rated. ``rounds_used`` tells how many rounds it took.
    """

    def __init__(self, documents: DataFrame, specimens: DataFrame, min_words: int = MIN_WORDS, rounds: int = ROUNDS, slots: int = SLOTS, tolerance: float = TOLERANCE):
        graded = [(r.text, r.grade) for r in specimens.filter("text is not null and grade is not null").select("text", "grade").collect()]
        self.grades = sorted({g for _, g in graded})
        k = len(self.grades)
        spark = documents.sparkSession

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = Words(slots)
            for b in batches:
                ids, seen = [], []
                for i, t in zip(b.doc_id, b.text):
                    if mostly_persian(t):
                        s, n = words.of(t)
                        if n >= min_words:
                            ids.append(i)
                            seen.append(s.astype(np.int32))
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="int64"), "slots": pd.Series(seen, dtype=object)})

        source = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
        self._read = materialize(source.mapInPandas(read, "doc_id long, slots array<int>"))
        model = self.model = Difficulties(slots, k)
        # the specimens' part of the sums is the same in every round
        own, own_text, words = np.zeros((slots, k)), np.zeros(model.hat.shape[1]), Words(slots)
        for text, grade in graded:
            s, c = words.of(text)[0], self.grades.index(grade)
            np.add.at(own[:, c], s, ANCHOR)
            own_text[c * FINE if k > 1 else 0] += ANCHOR * len(s)
        if k:
            model.improve(own, own_text, 2 * STEPS)
        self.rounds_used, before = 0, None
        for self.rounds_used in range(1, rounds + 1 if k else 1):
            table = spark.sparkContext.broadcast((model.ease.astype(np.float32), model.hat, model.log_z))

            def total(batches: Iterator[pd.DataFrame], table=table) -> Iterator[pd.DataFrame]:
                ease, hat, log_z = table.value
                seen, text, fit, size = np.zeros((k, slots)), np.zeros(len(log_z)), 0.0, 0
                for b in batches:
                    if not len(b):
                        continue
                    sums, n, flat = sums_of(ease, list(b.slots))
                    ll = sums @ hat - n[:, None] * log_z
                    p = posterior(ll)
                    text += n @ p
                    fit += float((ll.max(1) + np.log(np.exp(ll - ll.max(1, keepdims=True)).mean(1))).sum())
                    size += int(n.sum())
                    share = p @ hat.T
                    for c in range(k):
                        # what is far from a grade adds nothing to it
                        on = np.repeat(share[:, c] > 1e-6, n)
                        seen[c] += np.bincount(flat[on], np.repeat(share[:, c], n)[on], slots)
                at = np.flatnonzero(seen.sum(0))
                yield pd.DataFrame({"slot": at.astype(np.int32)} | {f"s{c}": seen[c, at] for c in range(k)})
                # the sums over levels and the fit travel as slots below zero
                rest = np.concatenate([text, [fit, size]])
                yield pd.DataFrame({"slot": -1 - np.arange(len(rest), dtype=np.int32)} | {f"s{c}": rest * (c == 0) for c in range(k)})

            schema = "slot int, " + ", ".join(f"s{c} double" for c in range(k))
            rows = self._read.mapInPandas(total, schema).groupBy("slot").agg(*(F.sum(f"s{c}").alias(f"s{c}") for c in range(k))).toPandas()
            table.unpersist()
            at = rows.slot.to_numpy(np.int64)
            if not len(at):
                break
            seen, rest = own.copy(), np.zeros(len(own_text) + 2)
            seen[at[at >= 0]] += rows.loc[at >= 0, [f"s{c}" for c in range(k)]].to_numpy()
            rest[-1 - at[at < 0]] = rows.s0.to_numpy()[at < 0]
            fit = rest[-2] / max(rest[-1], 1.0)
            model.improve(seen, own_text + rest[:-2])
            if before is not None and abs(fit - before) < tolerance:
                break
            before = fit
        else:
            if k:
                warnings.warn(f"levels have not settled after {rounds} rounds", RuntimeWarning, stacklevel=2)

    def levels(self) -> DataFrame:
        """(doc_id, grade, level, certainty): the mean level of the posterior, the grade nearest to it (of two the lower), and the posterior of the levels nearest to that grade."""
        grades, k = np.array(self.grades), len(self.grades)
        if not k:
            return self._read.select("doc_id", F.lit(0).alias("grade"), F.lit(0.0).alias("level"), F.lit(0.0).alias("certainty")).limit(0)
        m = self.model
        table = self._read.sparkSession.sparkContext.broadcast((m.ease.astype(np.float32), m.hat, m.log_z))
        scale, steps = np.array(self.grades, float) @ m.hat, np.arange(k) @ m.hat
        nearest = np.minimum((np.arange(m.hat.shape[1]) + FINE // 2) // FINE, k - 1)

        def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ease, hat, log_z = table.value
            for b in batches:
                if not len(b):
                    continue
                sums, n, _ = sums_of(ease, list(b.slots))
                p = posterior(sums @ hat - n[:, None] * log_z)
                best = np.ceil(p @ steps - 0.5).astype(int).clip(0, k - 1)
                sure = np.stack([p[:, nearest == c].sum(1) for c in range(k)], axis=1)
                yield pd.DataFrame({"doc_id": b.doc_id, "grade": grades[best].astype(np.int32), "level": p @ scale, "certainty": sure[np.arange(len(best)), best]})

        return self._read.mapInPandas(rate, "doc_id long, grade int, level double, certainty double")

    def profile(self) -> DataFrame:
        """(grade, documents, mean_level)."""
        return self.levels().groupBy("grade").agg(F.count("*").alias("documents"), F.avg("level").alias("mean_level"))
