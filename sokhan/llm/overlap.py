"""Problem 1: the same or near-same records across splits.

Method: passages of sharded, normalised evaluation texts are looked up in all training texts by their hashes, and a training text is set
against an evaluation record where enough passages match in fitting places; the runs of evaluation words that occur in any training text are merged into coverage.

Passages. A text is searched for by disjoint runs of up to ``LONGEST`` words, ``SPARE`` more than the differences that the longest near-same text allows.
A difference spoils one of them at most, so a near-same text holds all but as many as the pair has differences, however common they are, and each at a
place that as many insertions and deletions can move it to: no partner is ever left out. Of all such sets the one is taken that
matches the fewest texts of a sample of the training texts; the sample bears on the effort alone.

Coverage. Every run of ``PASSAGE`` words of an evaluation text that occurs in a training text counts, however common. Texts of fewer than
2 * PASSAGE words are cut into disjoint runs instead.

Scale. Equal texts are one row with its members kept aside, so a text that fills a third of a table is scanned once. Near-same texts have
similar lengths, so evaluation texts are sharded by their length and, where a length has many, by hash, and a training text is sent to
the shards of its lengths only, in chunks of bounded size. Each index is an array built from the rows at the head of its unit and the training texts stream
past it, so memory is bounded by the shard and a task by shard and chunk. Only the sample, of bounded size, is collected, and its
counts broadcast. Passages met are counted in arrays, and their number grows with the product of the tables; texts are compared only where enough of them are met.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sokhan.llm.canonical import canonicalize
from sokhan.materialize import materialize

PASSAGE = 6
SHARE = 0.2
#: Evaluation texts of an index, most training texts that stream past one, bands of lengths for every e-fold length.
SHARD, CHUNK, BANDS = 150_000, 400_000, 3
#: Training texts that are worth an index of their own, passages beyond one more than the differences, passages met that are counted at once.
LEAST, SPARE, AT_ONCE = 20_000, 2, 1 << 20
#: Bits of the sieve for runs that evaluation texts have, a power of two; 8 MB.
BITMAP = 1 << 26
#: Passages for the search: words of the longest, training texts that tell how usual a run is, slots for their counts, words that are planned at once.
LONGEST, SAMPLE, SLOTS, BLOCK = 8, 5_000, 1 << 22, 128

# Letter forms and digits that count as the same when texts are compared.
_FOLD = {ord(a): b for a, b in zip("آأإٱؤئۀة", "ااااویهه")} | {0x6F0 + i: chr(48 + i) for i in range(10)} | {0x660 + i: chr(48 + i) for i in range(10)}
_FOLD |= dict.fromkeys([*range(0x64B, 0x660), 0x670, 0x640, *range(0x300, 0x370)])
_words = re.compile("(?:[^\\W_]|[\u064b-\u065f\u0670\u0640\u0300-\u036f])+")
_half = re.compile("[\u200c-\u200f\u2060\ufeff\xad]")
_KEPT = 300_000


class _Folded(dict):
    """Words as they are compared; each distinct word is folded once. "" for marks that stand alone."""

    def __missing__(self, word: str) -> str:
        if len(self) > _KEPT:
            self.clear()
        self[word] = out = unicodedata.normalize("NFKD", word.lower()).translate(_FOLD)
        return out


_folded = _Folded()


def comparable(text: str | None, half_space: str = "") -> str:
    """Words of ``text`` joined by spaces, with punctuation, spacing, letter case and variant letter forms set aside; "" for null."""
    if not text:
        return ""
    return " ".join(filter(None, map(_folded.__getitem__, _words.findall(_half.sub(half_space, canonicalize(text))))))


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Number of words to insert, drop or change to make ``a`` into ``b`` (bit-parallel); most + 1 if it is more than ``most``."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for w in b:
        eq = where.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diag | plus)), plus & diag
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diag | up)), up & diag
    return min(score, most + 1)


def near_same(a: str, b: str, share: float = SHARE) -> bool:
    """True if two comparable texts are equal but for spacing or differ by at most ``share`` of the longer one's words."""
    if a == b or a.replace(" ", "") == b.replace(" ", ""):
        return bool(a)
    x, y = a.split(), b.split()
    most = int(share * max(len(x), len(y)) + 1e-9)
    return bool(x and y) and word_distance(x, y, most) <= most


_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _word_hashes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of every text, and a 64-bit hash of each word, text after text."""
    words = [t.split(" ") if t else [] for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if not lengths.sum():
        return lengths, np.empty(0, np.uint64)
    codes, vocabulary = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    return lengths, pd.util.hash_array(vocabulary.astype(object), categorize=False)[codes]


def _all_runs(h: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each size from 1 to ``longest`` a 64-bit hash of every run of so many neighbours of ``h``, across the ends of texts too."""
    acc, mixed = np.zeros(len(h), np.uint64), h ^ (h >> np.uint64(29))
    for k in range(longest):
        n = max(0, len(h) - k)
        x, acc = mixed[k : k + n] * _PRIMES[k % 8], acc[:n]
        acc = (acc << np.uint64(7) | acc >> np.uint64(57)) ^ x ^ (x >> np.uint64(32))
        yield acc.view(np.int64)


def _run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` neighbours of ``h``, across the ends of texts too."""
    for acc in _all_runs(h, size):
        pass
    return acc


def passage_hashes(texts: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of ``size`` words of every text: the text's index, the run's first word, a 64-bit hash."""
    lengths, h = _word_hashes(texts)
    acc = _run_hashes(h, size)
    n = len(acc)
    which = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ok = which[:n] == which[size - 1 : size - 1 + n]
    return which[:n][ok], at[:n][ok], acc[ok]


def _folded_rows(df: DataFrame, *more: str) -> DataFrame:
    """(key, source, text, more texts) -> (key, source, more, norm, norm_id, n_words); blank texts are dropped, for they have no words to compare."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["norm"] = [comparable(t) for t in b.text]
            yield b.loc[b.norm != "", ["key", "source", *more, "norm"]]

    schema = ", ".join(f"{c} string" for c in ("key", "source", *more, "norm"))
    return df.select("key", "source", *more, "text").filter("key is not null and text is not null").mapInPandas(fold, schema).withColumns(
        {"norm_id": F.xxhash64("norm"), "n_words": F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1}
    )


def _slices(batches: Iterator[pd.DataFrame], rows: int = 2_000) -> Iterator[pd.DataFrame]:
    """Batches cut small: the words of a text take many times its room while it is hashed."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def allowed(n: int, share: float = SHARE) -> int:
    """Most differences of a text of ``n`` words from any near-same one, which may be longer."""
    m = n
    while m + 1 - int(share * (m + 1) + 1e-9) <= n:
        m += 1
    return int(share * m + 1e-9)


def usual_runs(sample: pd.Series, longest: int = LONGEST) -> np.ndarray:
    """How often runs of 1 .. ``longest`` words occur in ``sample``, by the low bits of their hash: an estimate."""
    lengths, h = _word_hashes(sample)
    which, out = np.repeat(np.arange(len(lengths)), lengths), np.zeros(SLOTS, np.int64)
    for q, acc in enumerate(_all_runs(h, longest), 1):
        n = len(acc)
        out += np.bincount(acc[which[:n] == which[q - 1 : q - 1 + n]] & (SLOTS - 1), minlength=SLOTS)
    return np.minimum(out, 65_535).astype(np.uint16)


def cheapest_runs(costs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stretches of ``sizes`` words from ``starts`` on, the disjoint runs of the least sum of costs, ``need`` of them each.

    ``costs[q - 1, i]`` is that of the ``q`` words from word i on. Gives the stretch, the run's first word in it, its length.
    """
    rows, width = np.arange(len(sizes)), int(sizes.max())
    end = np.arange(width + 1)
    cost = []
    for q in range(1, len(costs) + 1):
        first = (starts[:, None] + end - q).clip(0, costs.shape[1] - 1)
        cost.append(np.where((end >= q) & (end <= sizes[:, None]), costs[q - 1][first], np.float32(np.inf)))
    best, took, where = np.zeros((len(sizes), width + 1), np.float32), [None], [None]
    for _ in range(int(need.max())):
        new, how = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for q, c in enumerate(cost[:width], 1):
            x = best[:, : width + 1 - q] + c[:, q:]
            better = x < new[:, q:]
            np.copyto(new[:, q:], x, where=better)
            np.copyto(how[:, q:], np.int8(q), where=better)
        best = np.minimum.accumulate(new, axis=1)
        how[best < new] = 0
        took.append(how)
        where.append(np.maximum.accumulate(np.where(how > 0, end, 0).astype(np.int16), axis=1))
    at, found = sizes.astype(np.int64), []
    for p in range(int(need.max()), 0, -1):
        on = rows[need >= p]
        last = where[p][on, at[on]].astype(np.int64)
        q = took[p][on, last].astype(np.int64)
        at[on] = last - q
        found.append((on, last - q, q))
    return tuple(map(np.concatenate, zip(*found)))


def pick(texts: pd.Series, usual: np.ndarray, share: float = SHARE, longest: int = LONGEST) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The passages of every text: their first words and their hashes.

    They are disjoint and more than the differences allowed, by ``1 + SPARE`` where the text has words enough.
    """
    lengths, h = _word_hashes(texts)
    costs, hashes = np.full((longest, len(h)), 0, np.float32), np.zeros((longest, len(h)), np.int64)
    for q, acc in enumerate(_all_runs(h, longest), 1):
        # of runs that the sample lacks the longer is the rarer
        costs[q - 1, : len(acc)] = usual[acc & (SLOTS - 1)] + np.float32(0.5 / q)
        hashes[q - 1, : len(acc)] = acc
    wanted = {n: min(n, allowed(n, share) + 1 + SPARE) for n in set(lengths.tolist())}
    firsts = np.cumsum(lengths) - lengths
    text, start, size, need = [], [], [], []
    for i, (n, first) in enumerate(zip(lengths.tolist(), firsts.tolist())):
        parts, whole = -(-n // BLOCK), wanted[n]
        for k in range(parts):
            a, z = n * k // parts, n * (k + 1) // parts
            text.append(i)
            start.append(first + a)
            size.append(z - a)
            need.append(whole * (k + 1) // parts - whole * k // parts)
    text, start, size, need = (np.array(x, np.int64) for x in (text, start, size, need))
    found = [(np.empty(0, np.int64),) * 3]
    order = np.argsort(size, kind="stable")
    for k in range(0, len(order), 256):
        some = order[k : k + 256]
        row, at, q = cheapest_runs(costs, start[some], size[some], need[some])
        found.append((text[some][row], start[some][row] + at, q))
    which, at, q = map(np.concatenate, zip(*found))
    order = np.lexsort((at, which))
    which, at, q = which[order], at[order], q[order]
    cuts = np.cumsum(np.bincount(which, minlength=len(texts)))[:-1] if len(texts) else []
    return np.split((at - firsts[which]).astype(np.int32), cuts), np.split(hashes[q - 1, at], cuts)


def passages(evaluation: DataFrame, training: DataFrame, share: float = SHARE) -> DataFrame:
    """(norm_id, norm, n_words, starts, hashes): the passages of each evaluation text; inputs are (norm_id, norm), the evaluation's distinct."""
    total = training.count()
    # a bounded sample tells how usual a run is; that decides on the effort alone, never on what is found
    few = training.select("norm_id", "norm").filter(F.pmod(F.xxhash64("norm_id", F.lit(1)), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE / max(total, 1)))))
    sample = few.distinct().select(F.substring("norm", 1, 2_000).alias("norm")).limit(2 * SAMPLE).toPandas()
    usual = evaluation.sparkSession.sparkContext.broadcast(usual_runs(sample.norm))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            starts, hashes = pick(b.norm, usual.value, share)
            yield b[["norm_id", "norm"]].assign(n_words=b.norm.str.count(" ") + 1, starts=starts, hashes=hashes)

    return evaluation.select("norm_id", "norm").mapInPandas(cut, "norm_id long, norm string, n_words int, starts array<int>, hashes array<long>")


def covered_runs(evaluation: DataFrame, training: DataFrame, size: int = PASSAGE) -> DataFrame:
    """(eval_id, spans): of each evaluation text every run of ``size`` words that occurs in any training text, however common, as array<struct<a, z>> in order; inputs are (norm_id, norm), distinct.

    A text of fewer than 2 * size words has n // 4 + 1 disjoint runs of up to four words instead. Texts without a match are left out.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            n = b.norm.str.count(" ").to_numpy() + 1
            short = n < 2 * size
            which, at, h = passage_hashes(b.norm[~short], size)
            yield pd.DataFrame({"h": h, "eval_id": b.norm_id[~short].to_numpy()[which], "a": at, "z": at + size})
            for q in range(1, 2 * size if short.any() else 1):
                which, at, h = passage_hashes(b.norm[short], q)
                edges = [{(m * k // (m // 4 + 1), m * (k + 1) // (m // 4 + 1)) for k in range(m // 4 + 1)} for m in n[short].tolist()]
                ok = np.array([(a, a + q) in edges[w] for w, a in zip(which.tolist(), at.tolist())], bool)
                yield pd.DataFrame({"h": h[ok], "eval_id": b.norm_id[short].to_numpy()[which[ok]], "a": at[ok], "z": at[ok] + q})

    own = materialize(evaluation.mapInPandas(runs, "h long, eval_id long, a int, z int"))
    lengths = sorted(r.q for r in own.select((F.col("z") - F.col("a")).alias("q")).distinct().collect())
    bits = evaluation.sparkSession.sparkContext.broadcast(bitmap(own.select("h")))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            for q in lengths:
                h = np.unique(passage_hashes(b.norm, q)[2])
                at = h & (BITMAP - 1)
                # runs that no evaluation text has stay behind, but for those that share a bit with one
                yield pd.DataFrame({"h": h[(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]})

    seen = training.select("norm").mapInPandas(known, "h long").distinct()
    return own.join(seen, "h", "left_semi").groupBy("eval_id").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("spans"))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for the low bits of each ``h``, ``BITMAP`` of them whatever the number of hashes: a sieve that lets through too much, never too little. Tasks make their own and they are joined part by part."""
    parts, size = 64, BITMAP // 8 // 64

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(BITMAP // 8, np.uint8)
        for b in batches:
            at = np.unique(b.h.to_numpy() & (BITMAP - 1))
            np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        cut = own.reshape(parts, size)
        some = [i for i in range(parts) if cut[i].any()]
        yield pd.DataFrame({"part": pd.array(some, dtype="int32"), "bits": pd.Series([cut[i].tobytes() for i in some], dtype=object)})

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows.bits]).tobytes()]})

    out = np.zeros((parts, size), np.uint8)
    for r in hashes.mapInPandas(mark, "part int, bits binary").groupBy("part").applyInPandas(join, "part int, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


HITS = "eval_id long, train_id long"


def length_band(n: Column) -> Column:
    """Texts whose numbers of words are within about 40 % of one another."""
    return F.floor(F.log(n.cast("double")) * BANDS).cast("int")


def plan_units(n_eval: dict[int, int], reach: list[tuple[int, int, int]], shard: int = SHARD, chunk: int = CHUNK) -> dict[int, tuple[int, int, int]]:
    """{band: (first unit, shards, chunks)}: evaluation texts of a band are hashed into shards, the training texts that reach it into chunks, each pair of them a unit.
    Chunks are as large as ``chunk`` where that leaves work for several tasks, for each chunk gets a copy of the shard.

    ``reach``: (lowest band, highest band, training texts). Bands are numbered from the most laborious, so units of a like effort are neighbours.
    """
    n_train = {b: sum(n for low, high, n in reach if low <= b <= high) for b in n_eval}
    plan, first = {}, 0
    for b in sorted(n_eval, key=lambda b: (-n_eval[b] * n_train[b], b)):
        shards = -(-n_eval[b] // shard)
        chunks = max(1, -(-n_train[b] // min(chunk, max(LEAST, n_eval[b] // shards, n_train[b] * shards // 6))))
        plan[b] = (first, shards, chunks)
        first += shards * chunks
    return plan


class _Unit:
    """The evaluation texts of a shard and an index of their passages by hash."""

    def __init__(self, share: float):
        self.share, self.rows, self.keys = share, [], None

    def add(self, rows: pd.DataFrame) -> None:
        self.rows.append(rows)

    def close(self) -> None:
        """All evaluation texts are there: sort their passages."""
        rows, self.rows = self.rows, []
        self.ids = np.concatenate([r.norm_id.to_numpy(np.int64) for r in rows] or [np.empty(0, np.int64)])
        self.sizes = np.concatenate([r.n_words.to_numpy(np.int32) for r in rows] or [np.empty(0, np.int32)])
        self.least = self.sizes - self._most(self.sizes)
        # of texts longer than these lengths none is in reach
        self.most = self._most(np.arange(2 * int(self.sizes.max(initial=0) / (1 - self.share)) + 2))
        self.norms = [t for r in rows for t in r.norm]
        self.counts = np.array([len(x) for r in rows for x in r.hashes], np.int64)
        keys = np.concatenate([x for r in rows for x in r.hashes] or [np.empty(0, np.int64)])
        before = np.concatenate([x for r in rows for x in r.starts] or [np.empty(0, np.int32)]).astype(np.int32)
        del rows
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        self.who, self.before = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.counts)[order], before[order]
        self.keys, first = np.unique(keys, return_index=True)
        self.first = np.append(first, len(keys))
        # a sieve, as in ``bitmap``, that lets through too much, never too little
        self.mask = (1 << max(16, (16 * len(self.keys)).bit_length())) - 1
        self.bits = np.zeros((self.mask + 1) >> 3, np.uint8)
        at = self.keys & self.mask
        np.bitwise_or.at(self.bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def _most(self, n: np.ndarray) -> np.ndarray:
        """Differences allowed of texts whose longer one has ``n`` words."""
        return (self.share * n + 1e-9).astype(np.int32)

    def passages_of(self, norms: pd.Series) -> tuple[np.ndarray, ...]:
        """Numbers of words of training texts, and of each passage that one has: the text, the passage's number here, its first and its last place."""
        lengths, h = _word_hashes(norms)
        which, begin = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
        found = []
        for q, acc in enumerate(_all_runs(h, LONGEST), 1):
            at = acc & self.mask
            at = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))
            at = at[which[at] == which[at + q - 1]]
            key = np.searchsorted(self.keys, acc[at])
            key[key == len(self.keys)] = 0
            ok = self.keys[key] == acc[at]
            found.append((key[ok], at[ok]))
        key, at = map(np.concatenate, zip(*found))
        text = which[at]
        order = np.lexsort((at, key, text))
        key, at, text = key[order], at[order] - begin[text[order]], text[order]
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else np.empty(0, np.int64)
        return lengths, text[new], key[new], at[new], at[np.append(new[1:], len(key)) - 1] if len(key) else at

    def matches(self, ids: np.ndarray, norms: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the evaluation texts and of the training texts ``norms`` that are near-same."""
        if self.keys is None:
            self.close()
        none = np.empty(0, np.int64)
        if not len(self.keys):
            return none, none
        lengths, text, key, low, high = self.passages_of(norms)
        # texts whose passages are met AT_ONCE times are counted together, and what a single one has beyond that in parts
        ends = np.cumsum(self.first[key + 1] - self.first[key])
        found, a = [], 0
        while a < len(key):
            done = ends[a - 1] if a else 0
            z = np.searchsorted(ends, done + AT_ONCE, "right")
            z = np.searchsorted(text, text[z]) if z < len(key) else z
            if z <= a:
                z = np.searchsorted(text, text[a], "right")
            parts, size = [], max(1, AT_ONCE // (int(ends[z - 1] - done) // (z - a) + 1))
            for k in range(a, z, size):
                s = slice(k, min(k + size, z))
                parts.append(self._met(lengths, text[s], key[s], low[s], high[s]))
            pair, n = parts[0] if len(parts) == 1 else self._sum(parts)
            e, t = pair % len(self.ids), pair // len(self.ids)
            ok = n >= self.counts[e] - self._most(np.maximum(self.sizes[e], lengths[t]))
            found += [(self.ids[i], ids[j]) for i, j in zip(e[ok].tolist(), t[ok].tolist()) if near_same(norms.iat[j], self.norms[i], self.share)]
            a = z
        return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (none, none)

    def _met(self, lengths: np.ndarray, text: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (training text's number times evaluation texts, plus the evaluation text's) and how many passages they share in fitting places."""
        n, size = self.first[key + 1] - self.first[key], lengths[text]
        hit = np.repeat(np.arange(len(key), dtype=np.int32), n)
        at = np.arange(len(hit)) + np.repeat(self.first[key] - (np.cumsum(n) - n), n)
        e = self.who[at]
        # evaluation texts stand in order of length
        ok = e >= np.searchsorted(self.sizes, size - self._most(size)).astype(np.int32)[hit]
        ok &= e < np.searchsorted(self.least, size, "right").astype(np.int32)[hit]
        ok = np.flatnonzero(ok)
        e, hit, a = e[ok], hit[ok], self.before[at[ok]]
        own, theirs, low, high = self.sizes[e], size.astype(np.int32)[hit], low.astype(np.int32)[hit], high.astype(np.int32)[hit]
        # the words before a passage and those behind it differ at least by their numbers; a passage that a text repeats fits anywhere between
        tail = theirs - own + a
        shift = np.maximum(low - a, 0) + np.maximum(a - high, 0) + np.maximum(low - tail, 0) + np.maximum(tail - high, 0)
        ok = shift <= self.most[np.maximum(own, theirs)]
        return np.unique(text[hit[ok]] * len(self.ids) + e[ok], return_counts=True)

    @staticmethod
    def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pair, np.bincount(where, np.concatenate([n for _, n in parts]), len(pair)).astype(np.int64)


def scan(picked: DataFrame, training: DataFrame, shard: int = SHARD, chunk: int = CHUNK, share: float = SHARE) -> DataFrame:
    """HITS: an evaluation text and a training text that are near-same by their words. ``picked``: see ``passages``; ``training``: (norm_id, norm, n_words), repeats allowed.

    A training text is sent to the shards of the lengths that a near-same text can have, and to no others.
    """
    low, high = length_band(F.greatest(F.lit(1), F.floor(F.col("n_words") * (1 - share)))), length_band(F.ceil((F.col("n_words") + 1) / (1 - share)))
    n_eval = {r.band: r["count"] for r in picked.groupBy(length_band(F.col("n_words")).alias("band")).count().collect()}
    reach = [tuple(r) for r in training.groupBy(low.alias("low"), high.alias("high")).count().collect()]
    plan = plan_units(n_eval, reach, shard, chunk)
    units = sum(s * c for _, s, c in plan.values())
    tasks = max(1, min(units, max(int(picked.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8, units // 8)))
    # a row per band of lengths: some ten for every tenfold length
    bands = F.broadcast(picked.sparkSession.createDataFrame([(b, *x) for b, x in plan.items()] or [(-1, 0, 1, 1)], "band int, first long, shards long, chunks long"))
    lists = {"starts": "array<int>", "hashes": "array<long>"}
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place = (F.col("first") + F.col("shard") * F.col("chunks") + F.col("chunk")).alias("unit")
    part = lambda key, c: F.pmod(F.xxhash64(key, F.lit(c)), F.col(c)).alias(c.removesuffix("s"))
    ev = picked.withColumn("band", length_band(F.col("n_words"))).join(bands, "band").select("*", part("norm_id", "shards"), upto("chunks").alias("chunk"))
    ev = ev.select(place, F.lit(0).alias("kind"), "norm_id", "norm", "n_words", *lists)
    tr = training.select("norm_id", "norm", "n_words").distinct()
    tr = tr.select("*", F.explode(F.sequence(low, high)).alias("band")).join(bands, "band").select("*", part("norm_id", "chunks"), upto("shards").alias("shard"))
    tr = tr.select(place, F.lit(1).alias("kind"), "norm_id", "norm", "n_words", *(F.lit(None).cast(t).alias(c) for c, t in lists.items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, unit = None, None
        for b in batches:
            same = (b.unit.to_numpy() * 2 + b.kind.to_numpy()).tolist()
            edges = [0, *(i for i in range(1, len(same)) if same[i] != same[i - 1]), len(same)] if same else [0]
            for a, z in zip(edges, edges[1:]):
                if same[a] // 2 != here:
                    here, unit = same[a] // 2, _Unit(share)
                part = b.iloc[a:z]
                if same[a] % 2 == 0:
                    unit.add(part[["norm_id", "norm", "n_words", *lists]])
                    continue
                for some in _slices([part], 1_000):
                    eval_id, train_id = unit.matches(some.norm_id.to_numpy(np.int64), some.norm)
                    yield pd.DataFrame({"eval_id": eval_id, "train_id": train_id})

    return ev.unionByName(tr).repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int")).sortWithinPartitions("unit", "kind", "n_words").mapInPandas(run, HITS)


def same_but_spacing(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """HITS: texts that are equal but for spacing; they need not have a word in common, nor similar lengths. Inputs are (norm_id, norm)."""
    bare = lambda df, name: df.select(F.col("norm_id").alias(name), F.xxhash64(F.replace("norm", F.lit(" "), F.lit(""))).alias("bare")).distinct()
    return bare(evaluation, "eval_id").join(bare(training, "train_id"), "bare").select("eval_id", "train_id")


class Overlaps:
    """Cross-split overlaps of ``evaluation`` with ``training``, both (key, source, text); other columns aren't read.

    Rows with a null key are left out; null, blank and wordless texts overlap with nothing. A key with several texts overlaps where any of them does. Keys are compared as
    strings. Empty inputs give empty results.
    """

    def __init__(self, evaluation: DataFrame, training: DataFrame, size: int = PASSAGE, shard: int = SHARD, chunk: int = CHUNK, share: float = SHARE):
        # both sides are folded in one job, and each is read from its own files again
        side = lambda df, name: df.select(F.col("key").cast("string").alias("key"), "source", "text", F.lit(name).alias("side"))
        both = materialize(_folded_rows(side(evaluation, "e").unionByName(side(training, "t")), "side"))
        self.ev, self.tr = (both.filter(F.col("side") == x).drop("side") for x in "et")
        self.size = size
        self.texts = self.ev.select("norm_id", "norm").distinct()
        self.train_texts = self.tr.select("norm_id", "norm").distinct()
        picked = materialize(passages(self.texts, self.tr, share))
        by_words = scan(picked, self.tr, shard, chunk, share)
        self.hits = materialize(by_words.unionByName(same_but_spacing(self.ev, self.tr)).distinct())

    def links(self) -> DataFrame:
        """(eval_id, train_id): every pair of different near-same texts, a text with all its copies being one; see ``members``."""
        return self.hits

    def members(self) -> DataFrame:
        """(key, source, side evaluation | training, text_id): the text of every record."""
        side = lambda df, name: df.select("key", "source", F.lit(name).alias("side"), F.col("norm_id").alias("text_id")).distinct()
        return side(self.ev, "evaluation").unionByName(side(self.tr, "training"))

    def pairs(self) -> DataFrame:
        """(train_key, train_source, eval_key, eval_source): every pair of near-same records, copies included."""
        same = self.hits.select("eval_id", "train_id")
        ev = self.ev.select(F.col("norm_id").alias("eval_id"), F.col("key").alias("eval_key"), F.col("source").alias("eval_source"))
        tr = self.tr.select(F.col("norm_id").alias("train_id"), F.col("key").alias("train_key"), F.col("source").alias("train_source"))
        return same.join(ev, "eval_id").join(tr, "train_id").select("train_key", "train_source", "eval_key", "eval_source").distinct()

    def coverage(self) -> DataFrame:
        """(key, source, n_words, covered_words, coverage, n_train_texts): per evaluation record the share of its words inside passages matched in any training text."""
        merged = covered_runs(self.texts, self.train_texts, self.size)
        covered = F.aggregate(
            "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, s: F.struct(F.greatest(acc["end"], s["z"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["z"] - F.greatest(s["a"], acc["end"]))).alias("n")),
            lambda acc: acc["n"],
        )
        texts = self.hits.groupBy("eval_id").agg(F.count("*").alias("n_train_texts"))
        covered = merged.select("eval_id", covered.alias("covered_words")).join(texts, "eval_id", "full")
        records = self.ev.select(F.col("norm_id").alias("eval_id"), "key", "source", F.size(F.split("norm", " ")).alias("n_words"))
        return records.join(covered, "eval_id", "left").select(
            "key", "source", "n_words", F.coalesce("covered_words", F.lit(0)).alias("covered_words"),
            (F.coalesce("covered_words", F.lit(0)) / F.col("n_words")).alias("coverage"), F.coalesce("n_train_texts", F.lit(0)).alias("n_train_texts"),
        ).distinct()

    def report(self) -> DataFrame:
        """(eval_source, train_source, pairs, eval_records, train_records): overlaps per split and source."""
        return self.pairs().groupBy("eval_source", "train_source").agg(
            F.count("*").alias("pairs"), F.count_distinct("eval_key").alias("eval_records"), F.count_distinct("train_key").alias("train_records")
        )
