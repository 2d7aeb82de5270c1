import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sokhan.llm import overlap
from sokhan.llm.overlap import Overlaps, comparable, near_same, plan_units, word_distance

S = "key string, source string, text string"


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = brute(a, b)
        assert word_distance(a, b, 99) == d
        assert word_distance(a, b, d - 1) == d if d else True


def test_comparable_sets_forms_aside():
    assert comparable("كتاب، مي‌خوانم ۱۲!") == comparable("کتاب می‌خوانم ١٢")
    assert comparable("Ａbc") == comparable("abc") and comparable(None) == "" == comparable(" ‌.")
    assert near_same("می خوانم", "میخوانم") and not near_same("", "")


def corpus():
    rng = random.Random(7)
    vocabulary = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    train = [(f"t{i}", "train", " ".join(rng.choices(vocabulary, k=rng.randint(3, 60)))) for i in range(120)]
    train += [(f"hot{i}", "train", "shared announcement of the shop read to every caller before the call is put through") for i in range(60)]
    ev = [("e_none", "v", " ".join(rng.choices(vocabulary, k=40)))]
    for i, (k, _, t) in enumerate(train[:100]):
        w = t.split()
        for _ in range(int(len(w) * rng.choice([0, 0.05, 0.1, 0.15]))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["zz"], [w[at], "yy"]])
        ev.append((f"e{i}", "v", " ".join(w)))
    ev.append(("e_hot", "v", train[-1][2]))
    return train, ev


def test_all_pairs_found_against_brute_force(spark):
    train, ev = corpus()
    want = {(a, b) for a, _, s in train for b, _, t in ev if near_same(comparable(s), comparable(t))}
    for shard, chunk in ((25_000, 50_000), (30, 20)):
        o = Overlaps(spark.createDataFrame(ev, S), spark.createDataFrame(train, S), shard=shard, chunk=chunk)
        got = {(r.train_key, r.eval_key) for r in o.pairs().collect()}
        assert got == want and len([x for x in got if x[1] == "e_hot"]) == 60
    cover = {r.key: r for r in o.coverage().collect()}
    assert cover["e_hot"].coverage == 1.0 and cover["e_none"].n_train_texts == 0 and len(cover) == len(ev)
    assert o.report().first().pairs == len(got)


def test_odd_rows(spark):
    long = "واژه " * 20_000
    rows = [("a", "s", None), (None, "s", "یک دو سه"), ("b", "s", ""), ("c", "s", " \n"), ("d", None, long), ("d", None, long), ("e", "s", "x")]
    df = spark.createDataFrame(rows, S).withColumn("norm", F.lit(1)).withColumn("shard", F.lit(2))
    got = {(r.train_key, r.eval_key) for r in Overlaps(df, df).pairs().collect()}
    assert got == {("d", "d"), ("e", "e")}
    empty = df.limit(0)
    for a, b in ((empty, df), (df, empty), (empty, empty)):
        o = Overlaps(a, b)
        assert o.pairs().count() == 0 and o.report().count() == 0


def test_coverage_counts_common_runs(spark):
    rng = random.Random(3)
    text = [f"w{i}" for i in range(40)]
    train = []
    for i in range(40):
        w = list(text)
        w[rng.randrange(40)] = f"x{i}"
        train.append((f"t{i}", "train", " ".join(w)))
    train += [("s1", "train", "p q r s t")]
    ev = [("e", "v", " ".join(text)), ("half", "v", " ".join(text[:20] + [f"y{i}" for i in range(20)])), ("short", "v", "k p q r s t"), ("none", "v", "u v")]
    got = {r.key: (r.covered_words, r.n_words) for r in Overlaps(spark.createDataFrame(ev, S), spark.createDataFrame(train, S)).coverage().collect()}
    # the short text's runs are (k p q) and (r s t)
    assert got == {"e": (40, 40), "half": (20, 40), "short": (3, 6), "none": (0, 2)}


def test_families_of_near_copies_are_found_whole(spark):
    rng = random.Random(5)
    train, ev = [], []
    for f, n in enumerate((12, 50, 120)):
        base = [f"f{f}w{i}" for i in range(50)]
        for i in range(n):
            w = list(base)
            for k in rng.sample(range(50), 5):
                w[k] = f"x{f}a{i}a{k}"
            train.append((f"t{f}_{i}", "train", " ".join(w)))
        for i in range(6):  # two changed as the copies are, two shorter, two longer
            w = list(base)
            for k in sorted(rng.sample(range(50), 4), reverse=True):
                w[k : k + 1] = [[f"y{k}"], [], [w[k], f"y{k}"]][i % 3]
            ev.append((f"e{f}_{i}", "v", " ".join(w)))
    want = {(a, b) for a, _, s in train for b, _, t in ev if near_same(comparable(s), comparable(t))}
    got = {(r.train_key, r.eval_key) for r in Overlaps(spark.createDataFrame(ev, S), spark.createDataFrame(train, S)).pairs().collect()}
    assert len(want) > 500 and got == want


def test_evenly_spread_differences(spark):
    # a difference in every fourth or fifth word of the shorter text leaves no run of six words
    rows, ev = [], []
    for n in (1, 4, 5, 7, 16, 40, 60, 300):
        base = [f"n{n}w{i}" for i in range(n)]
        ev.append((f"e{n}", "v", " ".join(base)))
        rows += [(f"c{n}", "t", " ".join("x" if i % 5 == 4 else w for i, w in enumerate(base))), (f"d{n}", "t", " ".join(w for i, w in enumerate(base) if i % 5 != 4))]
        rows.append((f"i{n}", "t", " ".join(w + " y" if i % 4 == 3 else w for i, w in enumerate(base))))
    want = {(a, b) for a, _, s in rows for b, _, t in ev if near_same(s, t)}
    got = {(r.train_key, r.eval_key) for r in Overlaps(spark.createDataFrame(ev, S), spark.createDataFrame(rows, S)).pairs().collect()}
    assert len(want) > 15 and got == want


def test_texts_equal_but_for_spacing(spark):
    long = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    glued = " ".join(a + b for a, b in zip(long[::2], long[1::2]))
    shifted = " ".join([long[0], *(a + b for a, b in zip(long[1:-1:2], long[2::2])), long[-1]])
    train = [("t1", "t", "a b c d e"), ("t2", "t", " ".join(long)), ("t3", "t", shifted), ("t4", "t", "ab cd f")]
    ev = [("e1", "v", "ab c de"), ("e2", "v", glued), ("e3", "v", "abcd"), ("e4", "v", "a‌b cd f")]
    want = {(a, b) for a, _, s in train for b, _, t in ev if near_same(comparable(s), comparable(t))}
    got = {(r.train_key, r.eval_key) for r in Overlaps(spark.createDataFrame(ev, S), spark.createDataFrame(train, S)).pairs().collect()}
    assert got == want == {("t1", "e1"), ("t2", "e2"), ("t3", "e2"), ("t4", "e4")}


def test_rows_sent_grow_slower_than_the_product():
    # a million evaluation and two million training texts, each of the latter in reach of two of five bands: an 8 GB table
    n_eval, reach = dict.fromkeys(range(11, 16), 200_000), [(b, b + 1, 500_000) for b in range(11, 15)]
    plan = plan_units(n_eval, reach)
    n_train = {b: sum(n for low, high, n in reach if low <= b <= high) for b in n_eval}
    sent = sum(n_eval[b] * chunks + n_train[b] * shards for b, (_, shards, chunks) in plan.items())
    assert sent <= 5 * (sum(n_eval.values()) + sum(n_train.values())) and sum(s * c for _, s, c in plan.values()) >= 20


def test_a_shard_finds_what_comparing_all_finds(monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    base = [rng.choices(words, k=rng.choice([1, 2, 3, 5, 9, 20, 60, 300])) for _ in range(80)] + [["w0"] * n for n in (7, 8, 40, 48)]
    train = []
    for w in base * 3:
        w = list(w)
        for _ in range(rng.randint(0, len(w) // 4)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["zz"], [w[at], "yy"], [w[at]] * 2]) if len(w) > 1 else ["zz"]
        train.append(" ".join(w))
    ev = sorted((" ".join(w) for w in base), key=lambda t: t.count(" "))
    starts, hashes = overlap.pick(pd.Series(ev), overlap.usual_runs(pd.Series(train)))
    want = {(i, j) for i, a in enumerate(ev) for j, b in enumerate(train) if near_same(a, b)}
    compared = []
    monkeypatch.setattr(overlap, "near_same", lambda a, b, share: compared.append(a) or near_same(a, b, share))
    for at_once in (1 << 20, 50):
        monkeypatch.setattr(overlap, "AT_ONCE", at_once)
        unit = overlap._Unit(0.2)
        unit.add(pd.DataFrame({"norm_id": range(len(ev)), "norm": ev, "n_words": [t.count(" ") + 1 for t in ev], "starts": starts, "hashes": hashes}))
        compared.clear()
        got = set(zip(*(x.tolist() for x in unit.matches(np.arange(len(train)), pd.Series(train)))))
        assert len(want) > 200 and got == want and len(compared) < 3 * len(want)
