import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sokhan.llm.mixing import Mixture, feasible_total, rake
from sokhan.llm.packing import pack, pack_all, pack_report, plan_packs
from sokhan.llm.tokens import PATTERN, TOKENIZER, sized, token_counter

DOCS = "doc_id long, text string, source string, lang string"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), max_size=12))
def test_plan_places_every_item_once(histogram):
    used = defaultdict(int)
    for length, n in histogram.items():
        ranks = []
        for ln, first, last, low, each in plan_packs(histogram, 30):
            if ln == length:
                for r in range(first, last + 1):
                    ranks.append(r)
                    used[low + (r - first) // each] += length
        assert sorted(ranks) == list(range(n))
    assert all(u <= 30 for u in used.values()) and sorted(used) == list(range(len(used)))


def test_plan_is_nearly_full():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 60) for n in range(5, 200)}
    packs = max(low + (last - first) // each for _, first, last, low, each in plan_packs(histogram, 512)) + 1
    assert packs <= -(-sum(k * v for k, v in histogram.items()) // 512) * 1.01 + 1


def test_packs_of_documents(spark):
    items = spark.createDataFrame([(i, 7) for i in range(400)] + [(1000, 95), (1001, 0), (1002, 40), (1003, 41)], "doc_id long, n_tokens int").withColumn("rank", F.lit(1)).withColumn("length", F.lit(9))
    got = pack(items.select("doc_id", "n_tokens"), 40)
    loads = got.groupBy("pack_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 40 for r in loads) and got.filter("doc_id = 1000").count() == 3 and got.filter("doc_id = 1001").count() == 0
    assert got.agg(F.sum("length")).first()[0] == 400 * 7 + 95 + 40 + 41 and got.groupBy("doc_id", "piece_no").count().filter("count > 1").count() == 0
    caps = [("a", 40), ("b", 100)]
    assert {r.pack_name for r in pack_report(pack_all(items, caps), caps).collect()} == {"a", "b"}
    assert pack_all(items.limit(0), caps).count() == 0


@pytest.mark.parametrize("text", ["", " ", "سلام خوب هستید", "a  b\n\nc ", "\tx", "it's 12 o'clock", "می‌شه؟! «بله»", "x \n y", "😀 ok", "word " * 5000])
def test_counts_are_the_tokenizer_s(text):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert token_counter()(text)[0] == len(enc.encode_ordinary(text))


def test_rake_meets_sources_and_caps():
    cells = {("s", "fa", "x"): 100.0, ("s", "en", "y"): 50.0, ("t", "fa", "y"): 400.0, ("u", "fa", "x"): 10.0, ("none", "fa", "x"): 5.0}
    targets, repeats = {"s": 0.5, "t": 0.4, "u": 0.1, "gone": 0.2}, {"s": 2, "t": 1, "u": 3, "gone": 9}
    total = feasible_total({"s": 150, "t": 400, "u": 10}, targets, repeats)
    w = rake(cells, targets, repeats, total)
    assert total == pytest.approx(300) and ("none", "fa", "x") not in w
    for s, share in (("s", 0.5), ("t", 0.4), ("u", 0.1)):
        assert sum(x for c, x in w.items() if c[0] == s) == pytest.approx(300 * share)
    assert all(x <= cells[c] * repeats[c[0]] + 1e-6 for c, x in rake(cells, targets, repeats, 5000).items())
    assert rake({}, targets, repeats, 10) == {} and feasible_total({}, targets, repeats) == 0


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, "سلام " * rng.randint(1, 60), rng.choice(["big", "Big ", " BIG", "small", "odd-one", "none"]), rng.choice(["fa", None, "FA"])) for i in range(3000)]
    rows += [(None, "x", "big", "fa"), (90_000, None, "big", "fa"), (90_001, "", "big", "fa"), (90_002, "x", None, None)]
    sizes = sized(spark.createDataFrame(rows, DOCS).withColumn("copies", F.lit(1)).withColumn("topic", F.lit("?")))
    targets = [("big", 0.5, 1), ("small", 0.3, 2), ("odd_one", 0.15, 1), ("absent", 0.05, 3)]
    m = Mixture(sizes, targets)
    report = {r.source_name: r for r in m.report().collect()}
    assert abs(report["big"].actual_share - 0.5 / 0.95) < 0.02 and abs(report["small"].actual_share - 0.3 / 0.95) < 0.02 and report["absent"].actual_share == 0
    drawn = m.draw().collect()
    assert len({r.doc_id for r in drawn}) == len(drawn) and all(r.copies <= 2 for r in drawn)
    empty = Mixture(sizes.limit(0), targets)
    assert empty.draw().count() == 0 and all(r.drawn_tokens == 0 for r in empty.report().collect())
