import json
import random
import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sokhan.llm.consensus import Consensus
from sokhan.llm.defects import DEFECTS, Defects, LabelModel, Learnt, choose_cutoffs, damaged, votes
from sokhan.llm.grouping import allot, call_groups, call_splits, components, difference, group_splits, plan_bins
from sokhan.llm.names import link_names, mentions
from sokhan.operators.ranking import rank_within

LOG = "line_no long, id string, model string, verdict string"


def test_consensus_beats_majority(spark):
    rng, rows, truth, n = random.Random(3), [], {}, 0
    quality = {f"good{i}": 0.9 for i in range(3)} | {f"bad{i}": 0.3 for i in range(4)}
    for i in range(300):
        truth[f"i{i}"] = t = rng.choice(["A", "B", "either", "neither"])
        for m, q in quality.items():
            n += 1
            # the bad ones mostly say A
            said = t if rng.random() < q else "A" if m.startswith("bad") else rng.choice(["A", "B", "either", "neither"])
            rows.append((n, f"i{i}", m, rng.choice([said, said.lower() + " ", f'"{said}"'])))
    c = Consensus(spark.createDataFrame(rows, LOG))
    got = {r.id: r for r in c.items().collect()}
    right = sum(got[i].verdict == t for i, t in truth.items())
    by = {}
    for _, i, _, v in rows:
        by.setdefault(i, Counter())[v.strip(' "').lower()] += 1
    majority = sum(by[i].most_common(1)[0][0] == t.lower() for i, t in truth.items())
    assert right > majority and right > 0.9 * len(truth)
    rel = {r.model: r.reliability for r in c.annotators().collect()}
    assert min(v for k, v in rel.items() if k.startswith("good")) > max(v for k, v in rel.items() if k.startswith("bad"))


def test_messages_settle_or_a_warning_tells(spark):
    rng = random.Random(4)
    rows = [(n, f"i{n // 5}", f"m{n % 5}", rng.choice(["A", "B", "either", "neither"])) for n in range(400)]
    log = spark.createDataFrame(rows, "line_no long, id string, model string, verdict string")
    with pytest.warns(RuntimeWarning, match="not settled after 2 rounds"):
        Consensus(log, rounds=2)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        Consensus(log)


def test_which_lines_count(spark):
    rows = [(1, "x", "m", "A"), (2, "x", "m", "B."), (3, "x", "m", None), (4, "y", "m", "unsure"), (5, "y", "m", "?"), (6, "z", None, "A"), (7, None, "m", "A"), (8, "w", "m", "A"), (8, "w", "m", "A"), (9, "w", "m", "unsure"), (10, "v", "k", " NEITHER ")]
    df = spark.createDataFrame(rows, LOG).withColumn("vote", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.id: (r.verdict, r.n_labels, r.agreement) for r in Consensus(df).items().collect()}
    assert got == {"x": ("B", 1, None), "v": ("neither", 1, None)}
    c = Consensus(df.limit(0))
    assert c.items().count() == 0 and c.annotators().count() == 0


SOUND = ("سفارش من هنوز نرسیده و پیک زنگ نزد لطفا پیگیری کنید که خیلی ضروریه و منتظرم", "سفارش من هنوز نرسیده و پیک زنگ نزد لطفاً پیگیری کنید که خیلی ضروری است و منتظرم")
ANSWERS = "pred_id string, input string, output string, reference string, rejected_lines array<struct<line: string, reason: string>>"


def test_defects(spark):
    s, r = SOUND
    rows = [(f"ok{i}", s, r, r, []) for i in range(30)] + [
        ("e1", s, None, r, None), ("e2", s, "‌ .", r, []), ("r1", s, "متأسفم، نمی‌توانم این متن را اصلاح کنم.", r, []), ("r2", s, r, r, [("Sorry, I cannot edit this transcript.", "unparseable"), (None, None)]),
        ("c1", s, s, r, []), ("c2", s, "پاسخ: " + s.replace(" ", "  "), r, []), ("c3", s, " ".join(f"[{i}]{w}" for i, w in enumerate(s.split(), 1)), r, []), ("same", s, s, s, []),
        ("t1", s, " ".join(r.split()[:8]), r, []), ("l1", s, "The parcel was sent back to the seller and we are waiting for a new invoice.", r, []),
        ("en", "The parcel cannot be matched to the seller.", "The parcel cannot be matched to the seller!", "The parcel cannot be matched to the seller.", []),
        ("n", None, None, None, None), (None, s, s, r, []), ("e1", s, None, r, None), ("big", s * 3_000, r * 3_000, r * 3_000, []),
        ("caller", "متأسفم نمی‌تونم بدون کد کاری انجام بدم ببخشید", "متأسفم نمی‌تونم بدون کد کاری انجام بدم ببخشید.", "متأسفم نمی‌تونم بدون کد کاری انجام بدم ببخشید", []),
    ]
    df = spark.createDataFrame(rows, ANSWERS).withColumn("defect", F.lit("?")).withColumn("lines", F.lit(1))
    d = Defects(df)
    want = {"e1": "empty", "e2": "empty", "n": "empty", "r1": "refusal", "r2": "refusal", "c1": "copied", "c2": "copied", "c3": "copied", "t1": "truncated", "l1": "other_language"}
    assert {x.pred_id: x.defect for x in d.first().collect()} == want
    assert d.labels().count() >= len(want)
    assert Defects(df.limit(0)).first().count() == 0


def test_validation_pairs_are_told_apart():
    for truth, a, b in damaged(*SOUND):
        got = votes(a, b, SOUND[1], [], Learnt([(SOUND[0], [])] * 20))
        told = {d for d in DEFECTS if sum(got[d]) * 2 > len(got[d])}
        # a refusal in English is in another language, too
        assert told - {"other_language"} == {truth} - {"", "other_language"} and (truth != "other_language" or told == {truth})


def test_refusals_are_learnt_from_rejected_lines():
    rows = [(SOUND[0], ["I regret that this one is not for me", "3 a → b"]), (SOUND[0], ["I regret this is beyond me", "That one I must pass on", "I must pass on this one"])] * 5
    learnt = Learnt(rows)
    assert learnt.refuses("I regret that I must pass on this one".split()) and not learnt.refuses(SOUND[1].split()) and not learnt.refuses(["regret"])
    assert votes(SOUND[0], "I regret that I must pass on this one.", SOUND[1], [], learnt)["refusal"][3] == 1
    assert learnt.surprise("Die Bestellung wartet noch auf den Karton") > learnt.surprise(SOUND[1]) + 1
    assert Learnt([]).surprise("") == 0.0 and not Learnt([]).refuses(["a"] * 9)


def test_all_rows_are_learnt_from_and_validated_on(spark):
    rng, words = random.Random(8), SOUND[0].split()
    pairs = [(" ".join(rng.choices(words, k=6)) + f" {i}", " ".join(rng.choices(words, k=12)), [f"I must pass on {i // 2}"] * (i % 2)) for i in range(2_400)]
    rows = [(f"p{i}", s, r, r, [(x, "odd") for x in lines]) for i, (s, r, lines) in enumerate(pairs)] + [("n", None, "x", SOUND[1], None), ("m", SOUND[0], "x", None, [(None, None)])]
    df = spark.createDataFrame(rows, ANSWERS)
    d = Defects(df)
    # more than 2,000 rows to learn from, more than 200 to validate on
    learnt = Learnt.of(df.withColumn("lines", F.transform("rejected_lines", lambda x: x["line"])))
    whole = Learnt([(s, lines) for s, _, lines in pairs] + [(SOUND[0], [None])])
    assert learnt.grams == whole.grams and learnt.odds == whole.odds and learnt.rare == whole.rare
    want = {x: Counter() for x in DEFECTS}
    for s, r, _ in pairs:
        for truth, a, b in damaged(s, r):
            for x, v in votes(a, b, r, [], whole).items():
                want[x][v, truth == x] += 1
    assert d.tried == want and d.cutoffs == choose_cutoffs(d.models, want)
    assert sum(n for (_, t), n in d.tried["empty"].items() if t) == len(pairs)


def test_label_model_finds_the_rare_class():
    rng, counts = random.Random(5), Counter()
    for _ in range(4000):
        bad = rng.random() < 0.05
        counts[tuple(int(rng.random() < (h if bad else m)) for h, m in ((0.9, 0.02), (0.8, 0.05), (0.85, 0.01)))] += 1
    m = LabelModel(3).fit(counts)
    assert 0.03 < m.share < 0.07 and m.posterior((1, 1, 1)) > 0.95 and m.posterior((0, 0, 0)) < 0.02


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(150):03}", f"n{rng.randrange(150):03}") for _ in range(90)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)]
    want = union_find({x for e in edges for x in e}, edges)
    sizes = Counter(want.values())
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: r for n, r in want.items() if sizes[r] > 1}


def meta(**k):
    return json.dumps({"call": {"request_id": k.get("rq", "rq-1"), "parent_id": k.get("parent")}, "customer": {"name": k.get("name"), "account": k.get("account")}, "crm": {"case_no": k.get("case"), "owner_name": k.get("owner")}}, ensure_ascii=False)


def test_call_groups_and_splits(spark):
    rows = [
        ("a", meta(account="AC-1000001")), ("b", meta(account=" ac ۱۰۰۰۰۰۱ ", case="CS-1404-1000009")), ("c", meta(case="cs/1404/1000009")), ("d", meta(parent=" C ")), ("e", meta(account="0")), ("f", meta(account="0")),
        ("g", meta(account="AC-0000000")), ("h", meta(account="AC-0000000", case="CS-1404-0000000")), ("i", meta(rq="probe-0000", account="AC-1000001")), ("j", '{"filler": 1}'), ("k", "{'call': "), ("l", None), ("m", meta(parent="zz")), ("a", meta(account="AC-1000001")), (None, meta(account="AC-1000001")), ("o", meta(parent="o")),
    ]
    df = spark.createDataFrame(rows, "id string, client_metadata_json string").withColumn("parent", F.lit("x")).withColumn("u", F.lit(1))
    assert {r.call_id: r.group_id for r in call_groups(df).collect()} == dict.fromkeys("abcd", "a")
    wins = spark.createDataFrame([("w1", "a"), ("w1", "a"), ("w2", "z"), ("w3", None)], "window_id string, call_id string")
    s = call_splits(df, wins, [("train", 0.8), ("test", 0.2)], 4).collect()
    assert len(s) == 14 and len({r.split for r in s if r.group_id == "a"}) == 1
    assert call_splits(df.limit(0), wins, [("train", 1.0)]).count() == 0 and call_groups(df.limit(0)).count() == 0


def test_shares_are_met(spark):
    rng = random.Random(4)
    weights = [rng.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(3000)] + [3000]
    df = spark.createDataFrame([(f"g{i}", w) for i, w in enumerate(weights)] + [("zero", 0), ("null", None)], "group_id string, weight int")
    out = group_splits(df, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()
    total, by = sum(weights), Counter()
    for r in out:
        by[r.split] += r.weight
    assert len(out) == len(weights) + 2 and abs(by["train"] / total - 0.8) < 0.01 and abs(by["test"] / total - 0.1) < 0.01


def test_differencing_balances():
    parts = difference([8, 7, 6, 5, 4, 3, 3], 3)
    assert sorted(i for p in parts for i in p) == list(range(7)) and difference([], 2) == [[], []]
    plan, load = plan_bins([(5, 7), (1, 20)], 4)
    assert sum(load) == 55 and max(load) - min(load) <= 2
    assert Counter(allot([1] * 10, [("x", 0.7), ("y", 0.3)])) == {"x": 7, "y": 3}


def test_rank_within_a_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"))
    ranks = [r["rank"] for r in rank_within(df, "g", "id").filter("g = 'hot'").collect()]
    assert sorted(ranks) == list(range(2000))


def test_names(spark):
    register = spark.createDataFrame([(1, "الهام غزالینگستر", "person"), (2, "بازرگانی چکاوک کرکسین", "company"), (3, "فاطمه جویبار‌زاده", "person"), (4, None, "person"), (5, "محمدرضا نقشبندگستر", "person")], "person_id long, full_name string, kind string").withColumn("name", F.lit(""))
    good = {1: ["الهام غزالینگستر", "غزالینگستر، الهام (پشتیبان)", "ا. غزالینگستر", "سرکار خانم غزالینگستر", "الهام غزالینگسترر", "Elham Ghazaleengostar", "QAZALINGOSTAR, E.", "الهم غزالینگستر"],
            2: ["چکاوک کرکسین", "کرکسین چکاوک", "ب. چکاوک کرکسین", "چکاوککرکسین (سهامی خاص)", "بازرگانی چکاوک کرگسین", "Chakavak Karkasin Group"],
            3: ["فاطمه جويبار زاده", "فاطی جویبار‌زاده", "  فاطمه   جویبار‌زاده "], 5: ["ممرضا نقشبندگستر", "مهندس نقشبندگستر"]}
    bad = ["الهام غزالینپور", "رامین جویبارنژاد", "test", "", None, "۱۲۳", "شرکت رویان چنارک", "x" * 20_000]
    names = [(n, p) for p, ns in good.items() for n in ns] + [(n, None) for n in bad]
    windows = spark.createDataFrame([("w", [n for n, _ in names]), ("v", None), (None, ["الهام غزالینگستر"]), ("w", [n for n, _ in names])], "window_id string, crm_names array<string>")
    calls = spark.createDataFrame([("c", meta(name="الهام غزالینگستر", owner="چکاوک کرکسین (کارشناس)")), ("d", None), ("e", "{'x"), ("f", '{"filler": 1}')], "id string, client_metadata_json string")
    m = mentions(calls, windows)
    got = {(r.record_id, r.mention_no): r.person_id for r in link_names(m, register).collect()}
    want = {("w", i): p for i, (_, p) in enumerate(names) if p} | {("c", 0): 1, ("c", 1): 2}
    assert got == want
    assert link_names(m, register.limit(0)).count() == 0 and link_names(m.limit(0), register).count() == 0
