import json

import pytest
from pyspark.sql import functions as F

from sokhan.operators import assemble, curate, editing, masking, predict, proposing, reports, scoring, slices, windows
from sokhan.streaming import digest


@pytest.mark.parametrize("n, target, cap", [(5, 3, 2), (5, 12, 3), (5, 40, 3), (5, 5, 1), (1, 4, 9)])
def test_capped_resample(spark, n, target, cap):
    df = spark.range(n).select(F.col("id").cast("string"))
    copies = [r["count"] for r in curate.capped_resample(df, ["id"], n, target, cap, "s").groupBy("id").count().collect()]
    assert sum(copies) == min(target, n * cap)
    assert max(copies) - min(copies) <= 1


@pytest.mark.parametrize("n, target", [(5, 3), (5, 9), (5, 0)])
def test_exact_resample(spark, n, target):
    df = spark.range(n).select(F.col("id").cast("string"))
    assert curate.resample(df, ["id"], n, target, "s").count() == target


@pytest.mark.parametrize("args, want", [((10, 70, 0.3), (10, 23)), ((50, 70, 0.3), (30, 70)), ((5, 5, 0), (0, 5)), ((5, 5, 1), (5, 0)), ((0, 5, 0.5), (0, 5))])
def test_ratio(args, want):
    assert curate.ratio_targets(*args) == want


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(1000).select(F.col("id").cast("string"))
    assert sorted(r["rank"] for r in curate.hash_rank(df, "s", ["id"]).collect()) == list(range(1, 1001))


def test_gates_are_cascaded(spark):
    df = spark.createDataFrame([(None, 90.0), (1.5, 90.0), (0.2, None), (0.2, 10.0), (0.2, 30.0)], "wer_whisper double, overlap_pct double")
    assert {r.gate: r["count"] for r in curate.quality_gates(df).groupBy("gate").count().collect()} == {"wer": 2, "overlap": 2, "kept": 1}


def test_usable_keeps_null_buckets(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", "unpaired", "x"), ("c", "agree", ""), ("d", "agree", None)], "id string, bucket_name string, text_whisper string")
    assert [r.id for r in assemble.usable(df).collect()] == ["a"]


def test_word_confidence_last_wins(spark):
    rows = [("c", 0, (1.0, "s", i, 0), t, x) for i, (t, x) in enumerate([(" a", 0.9), ("b", 0.1), (" ab", 0.2), (" cd.", 0.3), (" ،", 0.0)])]
    rows += [("c", 0, (2.0, "r", 0, 0), " cd", 0.4), ("c", 0, (2.0, "r", 0, 1), "e", 0.9)]
    df = spark.createDataFrame(rows, "call_id string, channel int, pos struct<start_sec:double,id:string,i:int,k:int>, token string, conf double")
    got = assemble.word_confidence(df, 0.5)
    assert {(r.word, r.conf) for r in got.collect()} == {("ab", 0.2), ("cd", 0.3), ("cde", 0.4)}
    assert [r.word for r in assemble.lowest_confidence(got, 2).collect()] == ["ab", "cd"]
    call = spark.createDataFrame([("c", 0), ("x", 0)], "call_id string, channel int")
    assert {r.call_id: r.confidence for r in assemble.with_confidences(call, got).collect()} == {"c": {"ab": 0.2, "cd": 0.3, "cde": 0.4}, "x": {}}


def test_check_and_apply_matches_the_list_version(spark):
    e = "array<struct<start_word:int,end_word:int,original:string,replacement:string>>"
    rows = [("w", "a b c", [(0, 1, "a", "x"), (1, 1, "", "i"), (1, 1, "", "j"), (0, 2, "a b", "y")]), ("v", "", []), ("u", "a", None), ("n", None, [(0, 0, "", "q")])]
    got = {r.window_id: (r.reasons, r.corrected) for r in editing.check_and_apply(spark.createDataFrame(rows, f"window_id string, source string, edits {e}")).collect()}
    assert got["w"] == (["ok", "ok", "ok", "overlap"], "x j i b c")
    assert got["v"] == ([], "") and got["u"][1] == "a"


def test_auc_with_ties(spark):
    rows = [(0.1, False), (0.5, True), (0.5, False), (0.9, True)]
    assert reports.auc(spark.createDataFrame(rows, "score double, positive boolean")).first().auc == pytest.approx(3.5 / 4)
    assert reports.auc(spark.createDataFrame(rows[:1], "score double, positive boolean")).first().auc is None


def test_auc_over_ranges(spark):
    rows = [(i % 37 / 37, i % 3 == 0) for i in range(500)]
    pos, neg = [x for x, p in rows if p], [x for x, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "score double, positive boolean")
    assert reports.auc(df).first().auc == pytest.approx(want)
    assert reports.auc(df, higher=False).first().auc == pytest.approx(1 - want)


def test_uneven_bins(spark):
    df = spark.createDataFrame([(1.0, 1), (0.05, -1), (0.3, 0), (0.79, 2)], "score double, effect int")
    assert [(r.n, r.net) for r in reports.score_bins(df).orderBy("bin").collect()] == [(1, -1), (1, 0), (0, 0), (1, 2), (0, 0), (1, 1)]


def test_judged_precision_weighs_bins_by_candidates(spark):
    scored = spark.createDataFrame([(0.95,)] * 10 + [(0.6,)] * 30 + [(0.1,)] * 5, "score double")
    judged = spark.createDataFrame([(5, "accepted"), (5, "accepted"), (5, "undecided"), (2, "accepted"), (2, "rejected"), (0, "undecided")], "bin int, decision string")
    got = {r.bin: (r.bin_precision, r.precision_from) for r in reports.judged_precision(scored, judged).collect()}
    assert got[5] == (1.0, 1.0) and got[2] == (0.5, pytest.approx((10 + 15) / 40)) and got[0] == (None, pytest.approx(25 / 40)) and got[4] == (None, 1.0)


def test_trend_rules(spark):
    want = {"tie": ([3.0, 2.0, 2.0], "improving", 0), "first": ([1.0], "not enough data", 0), "plateau": ([1.0, 3.0, 2.5, 2.9], "plateaued", 3), "worse": ([1.0, 2.0, 2.5, 2.9], "regressed", 3)}
    rows = [(k, i, v) for k, (vs, _, _) in want.items() for i, v in enumerate(vs)] + [("plateau", 9, None)]
    got = {r.run: (r.trend, r.since) for r in reports.trend(spark.createDataFrame(rows, "run string, step int, value double")).groupBy("run").agg(F.max_by("trend", "step").alias("trend"), F.max_by("since", "step").alias("since")).collect()}
    assert got == {k: (t, n) for k, (_, t, n) in want.items()}


def test_run_ranking(spark):
    rows = [("a", 0.2, 1.0), ("b", None, 0.1), ("c", 0.1, None), ("d", 0.1, 3.0)]
    got = {r.run: (r.place, r.winner) for r in reports.rank_runs(spark.createDataFrame(rows, "run string, wer double, loss double")).collect()}
    assert got == {"d": (1, True), "c": (2, False), "a": (3, False), "b": (4, False)}


def test_cascade(spark):
    from sokhan.operators import judging

    label = lambda rows: spark.createDataFrame(rows, "id string, label string")
    items = spark.createDataFrame([(i,) for i in "abcdefgh"], "id string")
    cheap = label([("a", "either_fine"), ("b", "uncertain"), ("c", "soniox_wrong"), ("d", "real_error"), ("g", "both_wrong")])
    main = label([("a", "real_error"), ("b", "real_error"), ("d", "either_fine"), ("e", "real_error")])
    human = label([("f", "both_wrong"), ("g", "soniox_wrong"), ("e", "real_error")])
    got = {r.id: (r.decision, r.decided_by) for r in judging.decide(items, cheap, main, human).collect()}
    assert got["a"] == ("rejected", "judges (either_fine / real_error)") and got["b"][0] == "accepted" and got["c"][0] == "rejected" and got["d"][0] == "rejected"
    assert got["e"] == ("accepted", "hand label") and got["f"] == ("undecided", "hand label") and got["g"] == ("rejected", "hand label") and got["h"] == ("undecided", "judges (missing / missing)")
    asked = {r.id: r.ask for r in judging.route_items(items, cheap, main).collect()}
    assert asked == {"e": "cheap", "f": "cheap", "g": "main", "h": "cheap"}


def test_replies_and_prompts(spark):
    from sokhan.operators import judging

    rows = [('well {"verdict": "A", "confidence": "high"} so', "A"), ('{"verdict": "C"}', None), ('{"verdict": "A"', None), ("", None), (None, None), ('{"verdict": "unsure"}\n', "unsure")]
    df = spark.createDataFrame(rows, "reply string, want string")
    assert all(r.got == r.want for r in df.select("want", judging.parse_reply(F.col("reply")).getField("verdict").alias("got")).collect())
    one = spark.createDataFrame([("0a", "w", "", ["n"]), ("0b", "w", "s", None)], "id string, w string, s string, names array<string>")
    got = [r[0] for r in one.select(judging.judge_prompt(F.col("id"), F.col("w"), F.col("s"), F.lit("l"), F.lit("r"), F.col("names"))).collect()]
    assert got == ["Known names: n\n\nContext: l ⟦ … ⟧ r\n\nA: w\nB: ∅", "Known names: (none)\n\nContext: l ⟦ … ⟧ r\n\nA: s\nB: w"]


def test_quota_sample_caps_calls_over_all_strata(spark):
    rows = [(f"i{k}", f"c{k % 5}", ("a", "b")[k % 2]) for k in range(60)]
    got = reports.quota_sample(spark.createDataFrame(rows, "id string, call_id string, stratum string"), {"a": 6, "b": 6}, 2, "s", "id").collect()
    calls = [r.call_id for r in got]
    assert len(got) == 10 and max(map(calls.count, calls)) == 2 and sum(r.stratum == "a" for r in got) == 6


def test_filter_rejects_unknown(spark):
    df = spark.createDataFrame([("a",)], "x string")
    for rule in ({"field": "y", "op": "==", "value": 1}, {"field": "x", "op": "like", "value": 1}):
        with pytest.raises(ValueError):
            reports.prediction_filter(df, [rule], ("x",))


def test_parse_edits(spark):
    df = spark.createDataFrame([(1, list("abcd"), "1-2 a b → x\nnonsense\n9 → y\n3 z → y\n4 d →\n4 → e\nNONE\n3 c → c\n → q\n۳ → z\n99999999999999999999 → y"), (2, list("ab"), None), (3, list("ab"), " none "), (4, [], "1 → x")], "k int, words array<string>, output string")
    got = {r.k: r for r in windows.parse_outputs(df, ["k"]).collect()}
    assert [(e.s, e.e, e.o, e.r) for e in got[1].edits] == [(0, 2, ["a", "b"], ["x"]), (3, 4, ["d"], ["e"]), (2, 3, ["c"], ["z"])]
    assert [x.reason for x in got[1].rejected] == ["unparseable", "out_of_range", "original_mismatch", "empty_replacement", "unparseable", "out_of_range", "no_op"]
    assert all(not got[k].edits for k in (2, 3, 4)) and [x.reason for x in got[4].rejected] == ["out_of_range"]


def test_merge_keeps_only_cores(spark):
    ws = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    w = spark.createDataFrame([("k", 0, 0, 37, ws[:50], f"1 {ws[0]} → x\n45 {ws[44]} → y"), ("k", 10, 37, 60, ws[10:], f"35 {ws[44]} → z")], "key string, start_word int, core_start int, core_end int, words array<string>, output string")
    got = {r.key: r for r in windows.merge(w, spark.createDataFrame([("k", " ".join(ws)), ("l", "a b"), ("m", None)], "key string, text string")).collect()}
    assert got["k"].corrected.split()[0] == "x" and got["k"].corrected.split()[44] == "z" and got["k"][2:] == (2, 1, 0)
    assert got["l"].corrected == "a b" and got["m"].corrected == "" and got["m"].n_edits == 0


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 75, 76, 99, 100, 101, 326])
def test_cores_part_the_text(spark, n):
    w = windows.plan(spark.createDataFrame([(1, n)], "k int, n int"), "k", F.col("n")).orderBy("start_word").collect()
    assert w[0].core_start == 0 and w[-1].core_end == n and all(a.core_end == b.core_start for a, b in zip(w, w[1:]))
    assert all(r.end_word - r.start_word <= 50 and r.start_word <= r.core_start <= r.core_end <= r.end_word for r in w)


def test_cut_windows_never_cut_a_span(spark):
    s = "array<struct<start_word:int,end_word:int>>"
    rows = [("k", 200, [(25, 40), (70, 72), (100, 100)]), ("short", 5, []), ("none", 0, None), ("tail", 65, [])]
    df = spark.createDataFrame(rows, f"key string, n int, s {s}")
    got = [tuple(r) for r in windows.cut(df, "key", F.col("n"), F.col("s"), 30, 60).collect()]
    assert got == [tuple(r) for r in windows.cut(df, "key", F.col("n"), F.col("s"), 30, 60).collect()]
    k = [(a, z, inside) for key, a, z, inside in got if key == "k"]
    assert k and all(not a < edge < z for s, e, _ in k for a, z in [(25, 40), (70, 72)] for edge in (s, e)) and all(30 <= z - a <= 60 for a, z, _ in k[:-1])
    assert [(a, z) for key, a, z, _ in got if key == "short"] == [(0, 5)] and not [x for x in got if x[0] == "none"]
    with pytest.raises(ValueError):
        windows.cut(df, "key", F.col("n"), F.col("s"), 10, 60)


def test_assembled_windows(spark):
    d = "array<struct<id:string,start_word:int,end_word:int,original:string,replacement:string,stratum:string>>"
    ws = list("abcdefghijklmnopqrstuvwxyzABCD")
    rows = [(r, "c", ws, [(f"{r}1", 3, 4, "d", "x", "entity"), (f"{r}2", 5, 6, "f", "۵", "other_sub"), (f"{r}3", 8, 8, "", "q", "entity")]) for r in "ab"] + [("g", "c", ws, [("g1", 3, 9, "", "", "garbled")])]
    dec = spark.createDataFrame([("a1", "accepted", "m"), ("a2", "accepted", "m"), ("b1", "accepted", "m"), ("b2", "undecided", "m")], "id string, decision string, decided_by string")
    got = windows.assemble(spark.createDataFrame(rows, f"row_id string, call_id string, words array<string>, diffs {d}"), dec, 40, 80, 5, most_per_50=4).collect()
    assert [r.row_id for r in got] == ["a"] and got[0].n_edits == 1 and got[0].n_numbers == 1 and got[0].target.split()[3] == "x" and got[0].has_entity
    assert got[0].edits[0].decided_by == "m" and got[0].left_context == ""


def test_snap_guards(spark):
    rows = spark.createDataFrame([("k", "به من نمونه پور زفری", ["بهمن", "نمونه‌پور", "ظفری"]), ("n", None, None), ("run", "aa bb aa bb cc", ["aabb", "bbaa"])], "key string, source string, names array<string>")
    freq = spark.createDataFrame([("به", 900), ("من", 900)], "word string, freq long")
    got = {(r.key, r.start_word, r.end_word, r.replacement) for r in editing.snap_names(rows, freq).collect()}
    assert got == {("k", 2, 4, "نمونه‌پور"), ("k", 4, 5, "ظفری"), ("run", 0, 2, "aabb"), ("run", 2, 4, "aabb")}


def test_rules(spark):
    freq = spark.createDataFrame([("ببرای", 1), ("برای", 50), ("سلامخوبی", 1), ("سلام", 40), ("خوبی", 30), ("کردمو", 1), ("کردم", 60), ("و", 90), ("نام", 1), ("رسیدگیمی‌شه", 1), ("رسیدگی", 30), ("می‌شه", 30)], "word string, freq long")
    got = {r.word: (r.fixed, r.rule) for r in proposing.rule_table(freq, 2, 20).collect()}
    assert got == {"ببرای": ("برای", "rule_unstutter"), "سلامخوبی": ("سلام خوبی", "rule_glue_split")}
    more = {r.word: r.fixed for r in proposing.rule_table(freq, 2, 20, extended=True).collect()}
    assert more["کردمو"] == "کردم و" and more["رسیدگیمی‌شه"] == "رسیدگی می‌شه"
    rows = spark.createDataFrame([("k", "ببرای سلامخوبی x", ["ببرای"]), ("n", None, None)], "key string, source string, names array<string>")
    edits = proposing.rule_edits(rows, "key", proposing.rule_table(freq, 2, 20))
    assert {r.key: r.corrected for r in proposing.apply_edit_rows(rows, "key", edits).collect()} == {"k": "ببرای سلام خوبی x", "n": ""}


def test_effects_and_filters(spark):
    rows = spark.createDataFrame([("k", "a X c", "a b c")], "key string, source string, ref string")
    edits = spark.createDataFrame([("k", 1, 2, "X", "b"), ("k", 0, 1, "a", "q"), ("k", 9, 10, "z", "q")], "key string, start_word int, end_word int, original string, replacement string")
    got = {(r.start_word, r.fixed, r.broken, r.effect) for r in proposing.effects(rows, "key", proposing.annotate(edits, F.array(F.lit("b")))).collect()}
    assert got == {(1, 1, 0, 1), (0, 0, 1, -1), (9, 0, 0, 0)}
    e = proposing.effects(rows, "key", proposing.annotate(edits, F.array(F.lit("b"))))
    assert e.filter(proposing.FILTERS["crm"]()).count() == 1 and e.filter(proposing.FILTERS["oracle"]()).count() == 1 and e.filter(proposing.FILTERS["none"]()).count() == 0
    spaced = spark.createDataFrame([("می رود", "می‌رود"), ("a", "b"), ("a", "a")], "original string, replacement string")
    assert proposing.spacing_only(spaced).count() == 1 and proposing.candidate_rows(spaced).count() == 1
    at = proposing.edits_by_key(spark.createDataFrame([("k", "نمونه پور آمد")], "key string, source string"), spark.createDataFrame([("k", "نمونه‌پور"), ("k", "آمد")], "key string, span string"))
    assert {(r.start_word, r.end_word) for r in at.collect()} == {(0, 2), (2, 3)}


def test_word_categories():
    assert scoring.categories("a زفری b c x", "a ظفری b نو x", set().__contains__) == [1, 2, 1, 3, 1]
    assert scoring.categories("a q", "a نو a", {"نو"}.__contains__) == [1, 2, 2] and scoring.categories("", "") == []
    assert scoring.categories("a z b", "a هیچ‌جا b", {"هیچ", "جا"}.__contains__) == [1, 2, 1]


def test_rare_words_of_rows(spark):
    rows = spark.createDataFrame([("k", "a b c a"), ("n", None), ("u", "a")], "key string, t string")
    freq = spark.createDataFrame([("a", 9), ("b", 1), ("z", 1)], "word string, freq long")
    got = {r.key: sorted(r.rare) for r in curate.row_rare_words(rows, "key", F.split("t", " "), freq, 1).collect()}
    assert got == {"k": ["b", "c"], "n": [], "u": []}


def test_splits_and_pools(spark):
    df = spark.range(40).select(F.col("id").cast("string"), (F.col("id") % 10).cast("string").alias("call_id"))
    held = {r.split: r["count"] for r in curate.held_out(df, ["id"], 40, 0.12, "s").groupBy("split").count().collect()}
    assert held == {"validation": 5, "train": 35} and curate.train_fraction(df, ["id"], 40, 0.5, "s").count() == 20
    calls = curate.split_calls(df, "call_id", 0.25, "s").groupBy("call_id").agg(F.count_distinct("split").alias("n"), F.first("split").alias("split")).collect()
    assert all(r.n == 1 for r in calls) and sum(r.split == "validation" for r in calls) == 2
    assert sorted(r.position for r in curate.shuffled(df, "s", ["id"]).collect()) == list(range(1, 41))
    p = curate.pooled({"a": df, "b": df.select("id")}, ["id", "call_id"])
    assert p.count() == 80 and p.filter("call_id is null").count() == 40


def test_publication_and_slices(spark):
    good, bad = spark.createDataFrame([("w1", "c1", "train"), ("w2", "c2", "validation")], "window_id string, call_id string, split string"), spark.createDataFrame([("w1", "c1", "validation")], "window_id string, call_id string, split string")
    assert slices.published_windows([good], ["window_id", "call_id", "split"]).count() == 2
    with pytest.raises(ValueError):
        slices.published_windows([good, bad], ["window_id", "call_id", "split"])
    m = spark.createDataFrame([("r", "a", 1.0), ("r", "a", 3.0), ("r", "b", 8.0)], "run string, slice string, v double")
    assert slices.mean_or_all(m, ["run"], "v", "a", 2).first()["mean"] == 2.0 and slices.mean_or_all(m, ["run"], "v", "b", 2).first().used == "all"
    logged = spark.createDataFrame([("r", "wer", 0.5), ("r", "fix", None), ("r", "keep", 0.25)], "run string, metric string, value double")
    ours = spark.createDataFrame([("r", "wer", 0.5), ("r", "keep", 0.2)], "run string, metric string, value double")
    assert [r.metric for r in scoring.reproduced(ours, logged).collect()] == ["keep"]


def test_classes(spark):
    rows = [("a می‌گیره b", "a میگیره b", "typo"), ("a xyz b", "a کتاب b", "entity"), ("a b", "a b", "neither"), ("", None, "neither"), ("ac bd", "ab cd", "typo"), ("q zz q", "q کتاب q", "entity")]
    got = slices.row_classes(spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(rows)], "k int, source string, target string"), "k").collect()
    assert {r.k: r.row_class for r in got} == {i: c for i, (_, _, c) in enumerate(rows)}


def test_entity_files(spark, tmp_path):
    e = {"span": " تهران ", "category": "place", "subtype": "city", "confidence": "high"}
    (tmp_path / "call7.json").write_text(json.dumps({"groups": {"g": {"group_name": "context", "entities": [e, e | {"span": "xy"}, e | {"category": "amount"}]}}}, ensure_ascii=False))
    assert [(r.call_id, r.span) for r in slices.read_entities(spark, str(tmp_path)).collect()] == [("call7", "تهران")]
    assert slices.read_entities(spark, str(tmp_path), typed=False).count() == 2


def test_union_needs_rows(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert slices.tagged_union({"p": df, "q": df}, ["x"]).count() == 2
    with pytest.raises(ValueError):
        slices.tagged_union({"p": df.limit(0)}, ["x"])


def test_counters_against_plain_counting():
    row = dict(zip(scoring.COUNTERS, scoring.count_row("a X c", "a b Y", "a b c", set().__contains__)))
    assert (row["n_ref"], row["dist_out"], row["dist_in"], row["fix_t"], row["fix_h"], row["keep_t"], row["keep_h"]) == (3, 1, 1, 1, 1, 2, 1)
    blank = dict(zip(scoring.COUNTERS, scoring.count_row("a", "", "", set().__contains__)))
    assert blank["n_ref"] == 0 and blank["fix_t"] == 0


def test_predict_keeps_rows(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", None), ("c", "x")], "k string, p string")
    got = predict.predict(df, "p", lambda: lambda batch: [f"{len(b)}" for b in batch], 2)
    assert {(r.k, r.output) for r in got.collect()} == {("a", "2"), ("b", "0"), ("c", "1")}


def test_premature_rewrite_has_no_candidates():
    assert predict.candidates(" ".join("abcdefghij" * 3), "a b") == []


def test_example_masks(spark):
    spans = "array<struct<a:int,z:int>>"
    df = spark.createDataFrame([("k", "p q", "aa bb", [(0, 1)], [(3, 5)])], f"k string, p string, t string, m {spans}, w {spans}")
    r = masking.examples(df, "k", F.col("p"), F.col("t"), F.col("m"), F.col("w"), 10, 2.0, 0.5).first()
    assert r.tokens == ["p", "q", "aa", "bb", "</s>"] and r.labels == [-100, -100, -100, 3, 4] and r.weights == [1, 1, 1, 2, 0.5] and r.status == "ok"


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:10:00", float(i)) for i, h in enumerate([0, 0, 1, 1, 2, 9])]
    df = spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("event_type", F.lit("x"))
    df.write.parquet(str(tmp_path / "in"))
    s = digest.readings(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, value double, event_type string", "ts")
    digest.run_to_end(digest.window_digest(s, "ts", "1 hour", "event_type"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.n, r.least) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 4.0), (2, 0.0), (2, 2.0)]


def test_every_window_of_a_stream_is_kept(spark, tmp_path):
    for part in ([0, 0, 1, 9], [9, 9, 10]):
        df = spark.createDataFrame([(f"2024-01-01 {h:02d}:10:00", float(h)) for h in part], "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("kind", F.lit("x"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = digest.readings(spark, str(tmp_path / "in"), "ts timestamp_ntz, value double, kind string", "ts")
        digest.latest_windows(digest.window_digest(s, "ts", "1 hour", "kind"), ["window_start", "kind"], str(tmp_path / "out"), str(tmp_path / "state"))
    got = digest.read_latest(spark, str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n) for r in got] == [(0, 2), (1, 1), (9, 3), (10, 1)]


def test_first_answers_and_log(spark, tmp_path):
    schema = "key string, answer string"
    for rows in ([("a", "1"), ("b", "2")], [("a", "3"), ("c", "4")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        digest.run_to_end(digest.first_answers(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key"), str(tmp_path / "log"), str(tmp_path / "state"))
    assert {(r.key, r.answer) for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {("a", "1"), ("b", "2"), ("c", "4")}


def test_answers_from_a_table(spark):
    df = spark.createDataFrame([("a", "p1"), ("b", "p2")], "k string, prompt string")
    old = spark.createDataFrame([("p1", "x", 1), ("p1", "y", 2)], "prompt string, output string, line int")
    assert {r.k: r.output for r in predict.from_table(df, old, "prompt", "line").collect()} == {"a": "y", "b": None}


def test_cuts(spark):
    import os

    from sokhan import materialize as m

    class Unset:
        class conf:
            get = staticmethod(lambda k, d=None: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getConf = staticmethod(lambda: {})

    with pytest.raises(RuntimeError):
        m.shared_folder(Unset)
    Unset.sparkContext.master = "local[4]"
    assert m.shared_folder(Unset) == m.shared_folder(Unset)
    df = m.materialize(spark.range(5))
    path = getattr(df, "_cut_path").removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    m.discard(df, None, spark.range(1))
    assert not os.path.exists(path)
    left = m.materialize(spark.range(2))
    m._sweep()
    assert not os.path.exists(getattr(left, "_cut_path").removeprefix("file://")) and not m._ours.clear()


def test_best_per_run_over_batches(spark, tmp_path):
    schema = "run string, step long, value double"
    for k, rows in enumerate([[("a", 1, 5.0), ("b", 1, 2.0)], [("a", 2, 3.0), ("b", 2, 4.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        digest.best_per_run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "best"), str(tmp_path / "state"))
    assert {(r.run, r.best, r.at_step) for r in spark.read.parquet(str(tmp_path / "best" / "version=1")).collect()} == {("a", 3.0, 2), ("b", 2.0, 1)}
