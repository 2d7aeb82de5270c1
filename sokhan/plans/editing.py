"""Queries: edits of training windows, evaluation slices, window plans, differences, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sokhan.functions import align as A
from sokhan.functions import text as T
from sokhan.materialize import materialize
from sokhan.operators import assemble as S
from sokhan.operators import curate as C
from sokhan.operators import diffs as D
from sokhan.operators import editing as E
from sokhan.operators import masking as M
from sokhan.operators import predict as P
from sokhan.operators import proposing as R
from sokhan.operators import scoring as K
from sokhan.operators import slices as L
from sokhan.operators import windows as W
from sokhan.operators.ranking import hash_order
from sokhan.plans import sql as Q
from sokhan.plans.transcripts import pred, seg, win
from sokhan.sources.tables import table


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    return pred(spark, d).select("pred_id", "run", "eval_slice", F.col("input").alias("source"), F.col("output").alias("hyp"), F.col("reference").alias("ref"), F.col("crm_names").alias("spans"))


def _wer(rows: DataFrame, by: str) -> DataFrame:
    """Error rates of (by, source, hyp, ref) from word distances alone, in one pass over the texts."""
    z = lambda c: T.strip_zwnj(F.coalesce(F.col(c), F.lit("")))
    r = rows.select(by, T.n_words(F.col("ref")).alias("n"), T.n_words(z("ref")).alias("nz"), A.word_distances(F.col("ref"), F.col("hyp"), F.col("source")).alias("d"), A.word_distances(z("ref"), z("hyp")).alias("dz"))
    total = lambda c: F.sum(F.get(*c))
    return r.groupBy(by).agg((total(("d", F.lit(0))) / F.sum("n")).alias("wer"), (total(("d", F.lit(1))) / F.sum("n")).alias("wer_input"), (total(("dz", F.lit(0))) / F.sum("nz")).alias("wer_zwnj"))


def q11_wer_by_slice(spark: SparkSession, d: str) -> DataFrame:
    return _wer(_corrections(spark, d), "eval_slice")


def _forced(spark: SparkSession, d: str) -> DataFrame:
    """References with every seventh word replaced by one that occurs nowhere (source), and the same with every second of those put right (hyp): the alignment is forced, so SQL can say what comes out."""
    p = pred(spark, d).select("pred_id", "run", "eval_slice", "reference")
    ws = T.words(F.coalesce("reference", F.lit("")))
    wrong = lambda step: F.array_join(F.transform(ws, lambda w, i: F.when(i % step == 6, F.concat(F.lit("qx"), i.cast("string"))).otherwise(w)), " ")
    return p.select("pred_id", "run", "eval_slice", wrong(7).alias("source"), wrong(14).alias("hyp"), F.array_join(ws, " ").alias("ref"))


def q11b_wer_forced(spark: SparkSession, d: str) -> DataFrame:
    """q11 over references with words made wrong, where the distances are known."""
    return _wer(_forced(spark, d), "eval_slice").select("eval_slice", "wer", "wer_input")


def q17c_score_forced(spark: SparkSession, d: str) -> DataFrame:
    """q17 over references with words made wrong, where the strict rates are known."""
    r = K.rates(K.row_counters(_forced(spark, d), ["run"]), ["run"])
    return r.select("run", "n", "wer", "fix_rate", "keep_rate", F.round("targeted", 9).alias("targeted"))


def q18b_extract_forced(spark: SparkSession, d: str) -> DataFrame:
    """q18 over references with words made wrong."""
    w = _forced(spark, d).select("pred_id", F.explode(A.edits_between(F.col("source"), F.col("ref"))).alias("e"))
    return w.select("pred_id", "e.start", "e.end", F.array_join("e.original", " ").alias("original"), F.array_join("e.replacement", " ").alias("replacement"))


def q29b_classes_forced(spark: SparkSession, d: str) -> DataFrame:
    """q29 over references with words made wrong: Latin letters and digits, so every changed Persian word is an entity."""
    rows = _forced(spark, d).select("pred_id", "source", F.col("ref").alias("target")).filter(~F.col("target").rlike("[A-Za-z0-9]"))
    return L.row_classes(rows, "pred_id")


def q13_exact_hallucination_premature(spark: SparkSession, d: str) -> DataFrame:
    f = K.row_flags(_corrections(spark, d))
    return f.groupBy("run", "eval_slice").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("exact", "hallucinated", "premature", "changed")))


def _frequent(spark: SparkSession, d: str, least: int) -> DataFrame:
    """Words that occur more than ``least`` times."""
    return C.word_frequency(seg(spark, d), T.words(F.col("text"))).filter(F.col("freq") > least)


def q17_score_all(spark: SparkSession, d: str) -> DataFrame:
    """All rates of each run and slice; every pair is aligned once."""
    rows = _corrections(spark, d)
    ws = T.words(T.normalize_lenient(F.coalesce(F.col("ref"), F.lit(""))))
    parts = F.concat(ws, F.flatten(F.transform(ws, lambda w: F.split(w, T.ZWNJ))))
    return K.rates(K.row_counters(C.row_rare_words(rows, "pred_id", parts, _frequent(spark, d, 1), 1), ["run", "eval_slice"]), ["run", "eval_slice"])


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """(call_id, span): what entity edits put in, call by call; stands in for entity files."""
    e = win(spark, d).select("call_id", F.explode("edits").alias("e")).filter("call_id is not null and e.stratum = 'entity'")
    return e.select("call_id", F.trim("e.replacement").alias("span")).filter("span != ''").distinct()


def _with_spans(spark: SparkSession, d: str) -> DataFrame:
    """Windows with the entity spans of their call; an even hash takes the target for the answer, an odd one the source."""
    w = win(spark, d).select("window_id", "call_id", "split", "source", F.col("target_text").alias("ref"))
    hyp = F.when(F.conv(F.substring(F.md5("window_id"), 1, 1), 16, 10).cast("int") % 2 == 0, F.col("ref")).otherwise(F.col("source"))
    spans = L.entity_spans(w, "window_id", _entities(spark, d), "ref", F.array().cast("array<string>"))
    return w.withColumn("hyp", hyp).join(spans, "window_id")


def q17b_entity_rates(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a call that stand in the reference, kept or put right by the answer."""
    return K.entity_rates(_with_spans(spark, d), ["split"])


def q28b_entity_spans(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a call that stand in a window's target."""
    return _with_spans(spark, d).select("window_id", F.array_join("spans", "|").alias("spans"))


def q18_extract_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits between source and target of each window."""
    w = win(spark, d).select("window_id", F.explode(A.edits_between(F.col("source"), F.col("target_text"))).alias("e"))
    return w.select("window_id", "e.start", "e.end", F.array_join("e.original", " ").alias("original"), F.array_join("e.replacement", " ").alias("replacement"))


def q19_validate_apply(spark: SparkSession, d: str) -> DataFrame:
    done = E.check_and_apply(win(spark, d))
    return done.select("window_id", F.array_join("reasons", ",").alias("reasons"), "corrected")


def q20_edit_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Windows where the extracted edits, applied, don't give the target: none."""
    w = win(spark, d).select("window_id", "source", F.array_join(T.words(F.col("target_text")), " ").alias("want"), A.edits_between(F.col("source"), F.col("target_text")).alias("es"))
    # the aligner runs once: an array that is used more than once is computed where it is made
    w = w.withColumn("edits", F.transform("es", lambda e: F.struct(e["start"].alias("start_word"), e["end"].alias("end_word"), F.array_join(e["original"], " ").alias("original"), F.array_join(e["replacement"], " ").alias("replacement"))))
    done = E.check_and_apply(w, allow_numbers=True, keep=("want",))
    return done.agg(F.count("*").alias("windows"), F.count_if(F.col("corrected") == F.col("want")).alias("same"))


def q21_edit_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = E.flags(E.edit_rows(win(spark, d)))
    return rows.select("window_id", "k", "kind", "number", (T.squash(F.array_join("original", " ")) == T.squash(F.array_join("replacement", " "))).alias("spacing_only"), T.is_filler(F.col("original"), F.col("replacement")).alias("filler_words"), "span_words")


def q21b_style_strata(spark: SparkSession, d: str) -> DataFrame:
    """Style, filler and number edits per stratum, with the mean similarity."""
    f = E.flags(E.edit_rows(win(spark, d)))
    return f.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("style").alias("style"), F.count_if("filler").alias("filler"), F.count_if("number").alias("number"), F.round(F.avg("similarity"), 6).alias("similarity"))


def q22_phonetic_similarity(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "judge_items").select("whisper_span", "soniox_span").filter("whisper_span is not null and soniox_span is not null").distinct()
    return spans.select("whisper_span", "soniox_span", T.sound_similarity(F.col("whisper_span"), F.col("soniox_span")).alias("spoken"), T.span_similarity(F.col("whisper_span"), F.col("soniox_span")).alias("squashed"))


def q22b_sound_keys(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "judge_items").select(F.explode(F.array("whisper_span", "soniox_span")).alias("span")).filter("span is not null").distinct()
    return spans.select("span", T.sound_key(F.col("span")).alias("sound"), T.squash(F.col("span")).alias("squashed"), F.array_join(F.transform(T.words(F.col("span")), T.canonical_word), " ").alias("canonical"))


def q23_clitic_join(spark: SparkSession, d: str) -> DataFrame:
    return win(spark, d).select("window_id", T.normalize_clitics(F.col("source")).alias("joined"))


def q26_crm_snap(spark: SparkSession, d: str) -> DataFrame:
    rows = win(spark, d).select(F.col("window_id").alias("key"), "source", F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce("crm_names", F.array().cast("array<string>")), T.words)), lambda w: F.length(w) >= 3)).alias("names"))
    return E.snap_names(rows, _frequent(spark, d, 20))


def q27_whole_span(spark: SparkSession, d: str) -> DataFrame:
    """Words of entity edits that stand whole in the target of their window, and in its source."""
    w = win(spark, d).select("window_id", "source", "target_text", F.posexplode("edits").alias("k", "e")).filter("e.stratum = 'entity'")
    name = F.col("e.replacement")
    return w.filter((F.length(F.trim(name)) >= 3) & T.whole_span_in(F.col("target_text"), name)).select("window_id", "k", name.alias("name"), T.whole_span_in(F.coalesce("source", F.lit("")), name).alias("in_source"))


def q28_entity_slice(spark: SparkSession, d: str) -> DataFrame:
    s = L.entity_slice(win(spark, d), "source", "target_text", F.col("crm_names"))
    return s.select("window_id", F.array_join("entity_words", " ").alias("entity_words"), "missing_from_source")


def q29_typo_slice(spark: SparkSession, d: str) -> DataFrame:
    return L.row_classes(win(spark, d).select("window_id", "source", F.col("target_text").alias("target")), "window_id")


def q30_eval_union(spark: SparkSession, d: str) -> DataFrame:
    p = pred(spark, d)
    shared = ["pred_id", "call_id", "input"]
    return L.tagged_union({"entity": p.filter("eval_slice = 'entity'"), "typo": p.filter("eval_slice = 'typo'")}, shared)


def _names_of(c: str):
    return F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.words)), lambda w: F.length(w) >= 3))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Word counts of the recognizer's texts, which the rules go by."""
    return C.word_frequency(seg(spark, d), T.words(F.col("text_whisper")))


def _ruled(spark: SparkSession, d: str, rows: DataFrame, key: str) -> DataFrame:
    """(key, source) of (key, source, names) with the rules' edits done."""
    edits = R.rule_edits(rows, key, R.rule_table(_spoken(spark, d), 2, 20))
    return R.apply_edit_rows(rows, key, edits).select(key, F.col("corrected").alias("source"))


def q33b_rule_edits(spark: SparkSession, d: str) -> DataFrame:
    """Rule edits of each window's source; its names are left alone."""
    rows = win(spark, d).select("window_id", "source", _names_of("crm_names").alias("names"))
    return R.rule_edits(rows, "window_id", R.rule_table(_spoken(spark, d), 2, 20)).drop("end_word")


def q25b_glue_extended(spark: SparkSession, d: str) -> DataFrame:
    return E.glue_table(_spoken(spark, d), 2, 20, extended=True)


def q33c_rule_text(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the rules change, as they are after it."""
    rows = win(spark, d).select("window_id", "source", _names_of("crm_names").alias("names"))
    done = R.apply_edit_rows(rows, "window_id", R.rule_edits(rows, "window_id", R.rule_table(_spoken(spark, d), 2, 20)))
    return done.filter("n_edits > 0")


def q34_diff_strata(spark: SparkSession, d: str) -> DataFrame:
    """Differences between source, after the rules, and target of each window with their stratum."""
    w = win(spark, d).select("window_id", "call_id", "source", "target_text", _names_of("crm_names").alias("names"))
    rows = w.drop("source").join(_ruled(spark, d, w, "window_id"), "window_id").select(F.col("window_id").alias("row_id"), F.coalesce("call_id", F.lit("")).alias("call_id"), "source", F.col("target_text").alias("target"), "names")
    s = D.stratified(D.differences(rows), C.word_frequency(seg(spark, d), T.words(F.col("text"))))
    return s.select("id", "row_id", "start_word", "end_word", "kind", "stratum", "neighbours", "least_freq")


def q34b_stratum_counts(spark: SparkSession, d: str) -> DataFrame:
    """Differences per row and stratum."""
    return q34_diff_strata(spark, d).groupBy("row_id", "stratum").agg(F.count("*").alias("n"))


def q35_neighbours_band(spark: SparkSession, d: str) -> DataFrame:
    return E.neighbours(win(spark, d))


def q36_window_plan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return W.plan(docs, "doc_id", F.size(T.words(F.col("text"))))


def q37_cut_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 30 to 60 words over each source, none of which cuts an edit, with the number of edits inside."""
    spans = F.transform("edits", lambda e: F.struct(e["start_word"].alias("start_word"), e["end_word"].alias("end_word")))
    return W.cut(win(spark, d), "window_id", T.n_words(F.col("source")), spans, 30, 60).select("window_id", "a", "z", F.size("inside").alias("inside"))


def q38_window_select_quota(spark: SparkSession, d: str) -> DataFrame:
    """300 windows, 70 % of them judged, two a call at most (a sampling operator)."""
    w = win(spark, d).select("window_id", "call_id", (F.size("edits") > 0).alias("judged"), F.exists("edits", lambda e: e["stratum"] == "entity").alias("has_entity"))
    return W.select_windows(w, 300, 0.7, 2, "select")


def _window_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Planned windows of training sources with their own words and the lines a perfect model would write for them; the source itself stays behind."""
    w = win(spark, d).select("window_id", T.words(F.coalesce("source", F.lit(""))).alias("ws"), "edits")
    each = w.select("window_id", "ws", "edits", F.explode(W.plan_array(F.size("ws"))).alias("p")).select("window_id", "ws", "edits", "p.*")
    inside = lambda e: (e["start_word"] >= F.col("start_word")) & (e["end_word"] <= F.col("end_word"))
    shifted = F.transform(F.filter("edits", inside), lambda e: F.struct((e["start_word"] - F.col("start_word")).alias("start_word"), (e["end_word"] - F.col("start_word")).alias("end_word"), e["original"].alias("original"), e["replacement"].alias("replacement")))
    return each.select(F.col("window_id").alias("key"), "start_word", "core_start", "core_end", F.slice("ws", F.col("start_word") + 1, F.col("end_word") - F.col("start_word")).alias("words"), W.render_target(shifted).alias("output"))


def q39_window_merge(spark: SparkSession, d: str) -> DataFrame:
    return W.merge(_window_outputs(spark, d), win(spark, d).select(F.col("window_id").alias("key"), F.col("source").alias("text")))


def q39b_rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the models read as edit lines of their input, and how many lines are turned down per run and reason."""
    p = pred(spark, d).select("pred_id", "run", T.words(F.coalesce("input", F.lit(""))).alias("words"), F.array_join(F.transform("rejected_lines", lambda x: x["line"]), "\n").alias("output"))
    r = W.parse_outputs(p, ["pred_id", "run"])
    return r.select("run", F.explode("rejected").alias("x")).groupBy("run", "x.reason").agg(F.count("*").alias("lines"))


def q39c_rejected_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines per answer of each run, as stored."""
    return pred(spark, d).groupBy("run").agg(F.count("*").alias("answers"), F.sum(F.size(F.coalesce("rejected_lines", F.array().cast("array<struct<line:string,reason:string>>")))).alias("lines"), F.avg(F.size(F.coalesce("rejected_lines", F.array().cast("array<struct<line:string,reason:string>>")))).alias("rate"))


def q51_gold_pred_pr(spark: SparkSession, d: str) -> DataFrame:
    """The judges' edits against all."""
    e = E.edit_rows(win(spark, d)).withColumn("new", F.array_join("replacement", " "))
    return E.gold_vs_predicted(e, e.filter("decided_by != 'hand label'"), ["start_word", "end_word", "new"])


def q58_loop_trim(spark: SparkSession, d: str) -> DataFrame:
    """Answers made to end in a loop, and trimmed again."""
    looped = pred(spark, d).select("pred_id", F.concat(F.coalesce("output", F.lit("")), F.repeat(F.concat(F.lit(" zz "), F.substring("pred_id", 1, 3)), 9)).alias("text"))
    return P.trim_loops(looped, "pred_id", "text").select("pred_id", "looped", F.size(T.words(F.col("trimmed"))).alias("n"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<struct<a:int,z:int>>")
    w = win(spark, d)
    head = F.get(T.words(F.col("target_text")), F.lit(0))
    first = F.when((F.size("edits") > 0) & head.isNotNull(), F.array(F.struct(F.lit(0).alias("a"), F.length(head).alias("z")))).otherwise(none)
    return M.examples(w, "window_id", F.col("source"), F.col("target_text"), first, none, 512, 2.0)


def q59_token_masks(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d)
    return e.select("window_id", F.size("tokens").alias("n"), F.size(F.filter("labels", lambda x: x == M.IGNORED)).alias("ignored"), "status")


def q60_pad_batches(spark: SparkSession, d: str) -> DataFrame:
    """Padding that batches of like lengths would need."""
    e = _examples(spark, d)
    return M.pad_batches(e, "window_id", F.floor(F.size("tokens") / 16).cast("int"))


def q62_end_to_end_correct(spark: SparkSession, d: str) -> DataFrame:
    """Rules first, then the reference as rewrite; a hash decides which candidates pass."""
    p = pred(spark, d).select("pred_id", F.col("input").alias("source"), F.col("reference").alias("rewrite"), _names_of("crm_names").alias("names"))
    rows = p.drop("source").join(_ruled(spark, d, p, "pred_id"), "pred_id")

    def score(key: str, e: A.Edit) -> float:
        import hashlib

        return int(hashlib.md5(f"{key}:{e.start}".encode()).hexdigest()[:8], 16) / 4294967295

    return P.correct(rows, "pred_id", score, 0.5)


def _edit_texts(spark: SparkSession, d: str) -> DataFrame:
    """(pred_id, run, start_word, end_word, original, replacement) of every edit from input to output, with the row's names."""
    p = pred(spark, d).select("pred_id", "run", _names_of("crm_names").alias("names"), F.explode(A.edits_between(F.coalesce("input", F.lit("")), F.coalesce("output", F.lit("")))).alias("e"))
    return p.select("pred_id", "run", "names", F.col("e.start").alias("start_word"), F.col("e.end").alias("end_word"), F.array_join("e.original", " ").alias("original"), F.array_join("e.replacement", " ").alias("replacement"))


def q78_filter_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each named filter's edits alone, done to the input and scored: methods by slices."""
    from functools import reduce

    rows = pred(spark, d).select("pred_id", "eval_slice", F.col("input").alias("source"), F.col("reference").alias("ref"))
    edits = materialize(R.effects(rows, "pred_id", R.annotate(_edit_texts(spark, d), F.col("names"))))
    one = lambda name, keep: R.apply_edit_rows(rows, "pred_id", edits.filter(keep())).select("pred_id", F.lit(name).alias("method"), F.col("corrected").alias("hyp"))
    hyps = reduce(DataFrame.unionByName, [one(n, k) for n, k in R.FILTERS.items()])
    counted = K.row_counters(rows.join(hyps, "pred_id"), ["method", "eval_slice"])
    both = L.by_slice(counted, {"all": F.lit(True), **{s: F.col("eval_slice") == s for s in ("main", "entity", "typo")}})
    return K.rates(both, ["method", "slice"]).select("method", "slice", "n", "wer", "fix_rate", "keep_rate", "fix_rate_lenient", "keep_rate_lenient", "fixed", "broken", "net")


def q78b_combined(spark: SparkSession, d: str) -> DataFrame:
    """Edits without a model, snapped names before rules, done together; of those that overlap the names' stay."""
    rows = pred(spark, d).select("pred_id", F.col("input").alias("source"), _names_of("crm_names").alias("names"))
    snap = E.snap_names(rows.withColumnRenamed("pred_id", "key"), _frequent(spark, d, 20)).withColumnRenamed("key", "pred_id").drop("similarity").withColumn("proposer", F.lit("crm_snap"))
    edits = snap.unionByName(R.rule_edits(rows, "pred_id", R.rule_table(_spoken(spark, d), 2, 20)))
    done = R.apply_edit_rows(rows, "pred_id", edits, F.when(F.col("proposer") == "crm_snap", 0).otherwise(1))
    return done.filter("n_edits > 0")


def q78c_edit_stats(spark: SparkSession, d: str) -> DataFrame:
    """Edits of each run by kind: style, helpful, harmful and neutral ones, and those that change spacing only."""
    rows = pred(spark, d).select("pred_id", F.col("input").alias("source"), F.col("reference").alias("ref"))
    e = R.effects(rows, "pred_id", R.annotate(_edit_texts(spark, d), F.col("names")))
    spacing = (F.col("kind") == "substitute") & (T.squash(F.col("original")) == T.squash(F.col("replacement")))
    return e.groupBy("run", "kind").agg(F.count("*").alias("edits"), F.count_if("style").alias("style"), F.count_if(F.col("effect") > 0).alias("helpful"), F.count_if(F.col("effect") < 0).alias("harmful"), F.count_if(F.col("effect") == 0).alias("neutral"), F.count_if(spacing).alias("spacing"))


def q73_word_categories(spark: SparkSession, d: str) -> DataFrame:
    """Target words of each window by what the source tells of them, and the characters that a loss would leave out."""
    w = win(spark, d).select(F.col("window_id").alias("key"), "source", F.col("target_text").alias("target"))
    ws = T.words(F.coalesce("target", F.lit("")))
    parts = F.concat(ws, F.flatten(F.transform(ws, lambda x: F.split(x, T.ZWNJ))))
    c = K.word_categories(C.row_rare_words(w, "key", parts, _frequent(spark, d, 1), 1), "key").join(w.select("key", M.char_spans(ws).alias("spans")), "key")
    n = lambda k: F.size(F.filter("categories", lambda x: x == k))
    masked = F.aggregate(K.category_spans(F.col("spans"), F.col("categories"), 3), F.lit(0), lambda acc, x: acc + x["z"] - x["a"])
    return c.select(F.col("key").alias("window_id"), n(1).alias("right"), n(2).alias("recoverable"), n(3).alias("lost"), masked.alias("masked_chars"))


def q73b_categories_forced(spark: SparkSession, d: str) -> DataFrame:
    """q73 over references with words made wrong: those said elsewhere in the source or often can be recovered."""
    r = _forced(spark, d).select(F.col("pred_id").alias("key"), "source", F.col("ref").alias("target")).filter(~F.col("target").rlike("[A-Za-z0-9]"))
    ws = T.words(F.col("target"))
    c = K.word_categories(r.withColumn("rare", F.concat(ws, F.flatten(F.transform(ws, lambda x: F.split(x, T.ZWNJ))))), "key")
    n = lambda k: F.size(F.filter("categories", lambda x: x == k))
    return c.select(F.col("key").alias("pred_id"), n(1).alias("right"), n(2).alias("recoverable"), n(3).alias("lost"))


def _decisions(rows: DataFrame) -> DataFrame:
    """(id, decision, decided_by): a hash decides about each difference, mostly for it."""
    u = T.hash_fraction(F.concat(F.lit("decide:"), "id"))
    return rows.select("id", F.when(u < 0.7, F.lit("accepted")).when(u < 0.9, F.lit("rejected")).otherwise("undecided").alias("decision"), F.lit("judges").alias("decided_by"))


def q72_assemble_windows(spark: SparkSession, d: str) -> DataFrame:
    """Training windows of 40 to 80 words cut from the sources, with the accepted differences as edits; windows with an undecided one are left out."""
    w = win(spark, d)
    diffs = F.transform("edits", lambda e, i: F.struct(T.stable_id(F.col("window_id"), i).alias("id"), e["start_word"].alias("start_word"), e["end_word"].alias("end_word"), e["original"].alias("original"), e["replacement"].alias("replacement"), e["stratum"].alias("stratum")))
    rows = w.select(F.col("window_id").alias("row_id"), "call_id", T.words(F.coalesce("source", F.lit(""))).alias("words"), F.coalesce(diffs, F.array().cast("array<struct<id:string,start_word:int,end_word:int,original:string,replacement:string,stratum:string>>")).alias("diffs"))
    out = W.assemble(rows, _decisions(rows.select(F.explode("diffs.id").alias("id"))), 40, 80, 15)
    return out.select("window_id", "call_id", "left_context", "source", "right_context", "target", "n_edits", "n_numbers")


def q72b_split_calls(spark: SparkSession, d: str) -> DataFrame:
    """Windows with a split by shuffled calls, a twentieth of the calls for validation."""
    return C.split_calls(win(spark, d).select("window_id", "call_id"), "call_id", 0.05, "calls").select("window_id", "split")


def q72c_held_out(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the answers held out, and two thirds of the rest for training."""
    p = C.usable_pairs(pred(spark, d), "input", "reference").select("pred_id")
    split = C.held_out(p, ["pred_id"], p.count(), 0.1, "held")
    train = split.filter("split = 'train'")
    return C.train_fraction(train, ["pred_id"], train.count(), 2 / 3, "part").unionByName(split.filter("split = 'validation'"))


def q79_shuffled(spark: SparkSession, d: str) -> DataFrame:
    """All windows in hash order."""
    return C.shuffled(win(spark, d).select("window_id"), "shuffle", ["window_id"])


def q79b_decode_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many answers each threshold takes from the decoder that must edit; chances are hashes, the right answers known."""
    p = pred(spark, d).select(F.col("pred_id").alias("key"), T.hash_fraction(F.concat(F.lit("none:"), "pred_id")).alias("p_none"), F.coalesce("output", F.lit("")).alias("greedy"), F.coalesce("reference", F.lit("")).alias("blocked"))
    out = R.decode_choice(p, (0.0, 0.3, 0.6, 0.9)).join(p.select("key", "blocked"), "key")
    return out.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("output") == F.col("blocked")).alias("right"))


def q64_publication_checks(spark: SparkSession, d: str) -> DataFrame:
    return L.publication_checks(table(spark, d, "train"))


def q65_window_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Windows by the first reason that keeps them out of training."""
    return win(spark, d).groupBy(L.eligibility(40).alias("reason")).agg(F.count("*").alias("n"))


def q66_contexts(spark: SparkSession, d: str) -> DataFrame:
    return E.contexts(win(spark, d), 6)


def q68_containment(spark: SparkSession, d: str) -> DataFrame:
    """Earlier items, some of them of wider spans, found again among the edits of now."""
    now = E.edit_rows(win(spark, d)).select(T.stable_id(F.col("window_id"), F.col("k")).alias("id"), F.col("window_id").alias("row_id"), "start_word", "end_word", "k")
    old = now.select(F.when(F.col("k") % 3 == 0, F.col("id")).otherwise(F.concat(F.lit("old"), "id")).alias("id"), "row_id", F.greatest(F.col("start_word") - 2, F.lit(0)).alias("start_word"), (F.col("end_word") + 2).alias("end_word"))
    return D.containment(old, now.drop("k"))


def q70_render(spark: SparkSession, d: str) -> DataFrame:
    w = win(spark, d)
    return w.select("window_id", W.render_input(T.words(F.col("source")), F.coalesce("crm_names", F.array().cast("array<string>"))).alias("prompt"), W.render_target(F.col("edits")).alias("answer"))


def q71_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """50 answers drawn by hash (a sampling operator)."""
    return pred(spark, d).orderBy(hash_order("draw", "pred_id"), "pred_id").limit(50).select("pred_id")


QUERIES = {f.__name__: f for f in (q11_wer_by_slice, q11b_wer_forced, q17c_score_forced, q18b_extract_forced, q29b_classes_forced, q13_exact_hallucination_premature, q17_score_all, q17b_entity_rates, q28b_entity_spans, q18_extract_edits, q19_validate_apply, q20_edit_roundtrip, q21_edit_flags, q21b_style_strata, q22_phonetic_similarity, q22b_sound_keys, q23_clitic_join, q26_crm_snap, q27_whole_span, q28_entity_slice, q29_typo_slice, q30_eval_union, q33b_rule_edits, q25b_glue_extended, q33c_rule_text, q34_diff_strata, q34b_stratum_counts, q35_neighbours_band, q36_window_plan, q37_cut_windows, q38_window_select_quota, q39_window_merge, q39b_rejected_lines, q39c_rejected_rate, q51_gold_pred_pr, q58_loop_trim, q59_token_masks, q60_pad_batches, q62_end_to_end_correct, q78_filter_grid, q78b_combined, q78c_edit_stats, q73_word_categories, q73b_categories_forced, q72_assemble_windows, q72b_split_calls, q72c_held_out, q79_shuffled, q79b_decode_sweep, q64_publication_checks, q65_window_eligibility, q66_contexts, q68_containment, q70_render, q71_hash_sample)}

Z = T.ZWNJ
_PAD = lambda t: f"(' ' || array_to_string({Q.words(t)}, ' ') || ' ')"
_FLAT = lambda a: f"replace(array_to_string({a}, ''), '{Z}', '')"
_TOUCH = f"len(list_filter(list_concat(original, replacement), lambda w: {Q.NUMBER})) > 0"
_FOLDED = lambda w: f"translate({w}, '{T.LETTER_FROM}', '{T.LETTER_TO}')"
_CANON = lambda w: "CASE " + " ".join(f"WHEN {_FOLDED(w)} = '{a}' THEN '{b}'" for a, b in T.NUMBER_VARIANTS.items()) + f" ELSE {_FOLDED(w)} END"
_CLITIC = Q.quoted(T.CLITICS)
_LAST = "regexp_extract(acc, '[^ ]*$')"
_SHARE = f"CASE WHEN len(x) = 0 THEN 100.0 ELSE round_even(coalesce({Q.SHARED}, 0) / len(x) * 100, 2) END"
_FORCED = f"""fo AS (SELECT pred_id, run, eval_slice, ws, len(ws) AS n, array_to_string(ws, ' ') AS r, len(ws) // 7 AS w7, (len(ws) + 7) // 14 AS w14 FROM (SELECT *, {Q.words("coalesce(reference, '')")} AS ws FROM pred))"""
_PLAIN = lambda t: "list_reduce(list_transform(string_split(replace(replace(" + t + ", 'ك', 'ک'), 'ي', 'ی'), ' '), lambda w: CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in T.INFORMAL.items()) + " ELSE w END), lambda x, y: x || ' ' || y)"
_LENIENT = lambda t: "(" + _PLAIN(f"regexp_replace(' ' || array_to_string({Q.words(t)}, ' '), ' (ن?می) ', ' \\1{Z}', 'g')") + " || ' ')"
_ENTITY = f"""ent AS (SELECT DISTINCT call_id, trim(e.replacement) AS raw FROM (SELECT call_id, unnest(edits) AS e FROM win) WHERE call_id IS NOT NULL AND e.stratum = 'entity' AND trim(coalesce(e.replacement, '')) <> ''),
    ew AS (SELECT window_id, call_id, split, {_LENIENT("coalesce(source, '')")} AS s, {_LENIENT("coalesce(target_text, '')")} AS r FROM win),
    el AS (SELECT call_id, raw, {_LENIENT("raw")} AS span FROM ent),
    en AS (SELECT window_id, split, any_value(s) AS s, any_value(r) AS r, min(raw) AS raw, arg_min(span, raw) AS span FROM ew JOIN el USING (call_id) WHERE contains(ew.r, el.span) GROUP BY window_id, split, {Q.squash("raw")})"""
_SPOKEN = f"freq AS (SELECT word, count(*) AS freq FROM (SELECT unnest({Q.words('text_whisper')}) AS word FROM seg) GROUP BY 1)"
_GLUE = """glue AS (SELECT word, a AS first, b AS second FROM (SELECT c.word, c.a, c.b, row_number() OVER (PARTITION BY c.word ORDER BY least(fa.freq, fb.freq) DESC, i) AS rn
    FROM (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(2, {upto})) AS i FROM freq WHERE length(word) >= 5 AND freq <= 2 AND {zwnj})) c
    JOIN freq fa ON fa.word = c.a JOIN freq fb ON fb.word = c.b WHERE fa.freq >= 20 AND fb.freq >= 20 AND {plain}) WHERE rn = 1)"""
_STUTTER = "stutter AS (SELECT a.word, b.word AS fixed FROM freq a JOIN freq b ON b.word = substr(a.word, 2) WHERE length(a.word) >= 3 AND substr(a.word, 1, 1) = substr(a.word, 2, 1) AND a.freq <= 2 AND b.freq >= 20)"
_RULES = f"""{_SPOKEN}, {_STUTTER}, {_GLUE.format(zwnj=f"NOT contains(word, '{Z}')", upto="length(word) - 1", plain=f"length(b) > 1 AND b NOT IN ({Q.quoted(E.CLITIC_SUFFIXES)})")},
    rules AS (SELECT word, fixed, 'rule_unstutter' AS rule FROM stutter UNION ALL SELECT word, first || ' ' || second, 'rule_glue_split' FROM glue WHERE word NOT IN (SELECT word FROM stutter))"""
_NAMES = f"coalesce(list_distinct(list_filter(flatten(list_transform(crm_names, lambda n: {Q.words('n')})), lambda w: length(w) >= 3)), [])"
# letters as single bytes, for the distance counts bytes: Persian ones become signs and capitals that no span holds
_BYTES = "ابپتجچخدرزژسشعفقکگلمنویحأإآؤئةءكيَُِّ۰۱۲۳۴۵۶۷۸۹é", "".join(map(chr, (*range(1, 9), *range(14, 32), *b"!#$%&*+<=>@^_`{|}~[]"))) + "".join(map(chr, range(0x3A, 0x3C)))
_SOUND = lambda t: f"translate(translate(replace({t}, '{Z}', ''), '{T.SOUND_FROM}', '{T.SOUND_TO}'), '{_BYTES[0]}', '{_BYTES[1]}')"
_APPLIED = f"""src AS (SELECT window_id, {Q.words("coalesce(source, '')")} AS ws, coalesce(len(edits), 0) AS n FROM win),
        r AS (SELECT ed.*, CASE WHEN NOT (start_word >= 0 AND start_word <= end_word AND end_word <= len(ws)) THEN 'out_of_range' WHEN ws[start_word + 1 : end_word] <> original THEN 'original_mismatch' WHEN original = replacement THEN 'no_op'
            WHEN {_TOUCH} AND {_FLAT('original')} <> {_FLAT('replacement')} THEN 'touches_number' END AS why FROM ed JOIN src USING (window_id)),
        v AS (SELECT a.*, coalesce(a.why, CASE WHEN EXISTS (SELECT 1 FROM r b WHERE b.window_id = a.window_id AND b.k < a.k AND b.why IS NULL AND a.start_word < b.end_word AND b.start_word < a.end_word) THEN 'overlap' ELSE 'ok' END) AS reason FROM r a),
        w AS (SELECT window_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM src),
        d AS (SELECT w.window_id, i, CASE WHEN e.k IS NULL THEN word WHEN e.start_word = i THEN nullif(array_to_string(e.replacement, ' '), '') END AS word FROM w LEFT JOIN v e ON e.window_id = w.window_id AND e.reason = 'ok' AND e.start_word <= i AND i < e.end_word),
        c AS (SELECT window_id, string_agg(word, ' ' ORDER BY i) AS corrected FROM d GROUP BY 1)"""
_LEN = lambda t: f"len({Q.words(t)})"

SQL = {
    "q13_exact_hallucination_premature": f"""WITH {Q.PRED}, w AS (SELECT run, eval_slice, trim(coalesce(output, ''), ' ') = trim(coalesce(reference, ''), ' ') AS exact, {Q.words("coalesce(output, '')")} AS x, {Q.words("coalesce(input, '')")} AS y FROM pred)
        SELECT run, eval_slice, count(*) AS n, count(*) FILTER (exact) AS exact, count(*) FILTER ({_SHARE} < 50) AS hallucinated, count(*) FILTER (len(y) >= 30 AND len(x) < 0.3 * len(y)) AS premature, count(*) FILTER (x <> y) AS changed FROM w GROUP BY 1, 2""",
    "q11b_wer_forced": f"WITH {Q.PRED}, {_FORCED} SELECT eval_slice, sum(w14)::DOUBLE / sum(n) AS wer, sum(w7)::DOUBLE / sum(n) AS wer_input FROM fo GROUP BY 1",
    "q17c_score_forced": f"""WITH {Q.PRED}, {_FORCED} SELECT run, count(*) AS n, sum(w14)::DOUBLE / sum(n) AS wer, sum(w7 - w14)::DOUBLE / sum(w7) AS fix_rate, 1.0::DOUBLE AS keep_rate,
        round(0.5::DOUBLE * sum(w7 - w14) / sum(w7) + 0.5::DOUBLE, 9) AS targeted FROM fo GROUP BY 1""",
    "q18b_extract_forced": f"""WITH {Q.PRED}, {_FORCED} SELECT pred_id, i - 1 AS "start", i AS "end", 'qx' || (i - 1) AS original, w AS replacement FROM (SELECT pred_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM fo) WHERE (i - 1) % 7 = 6""",
    "q29b_classes_forced": f"WITH {Q.PRED}, {_FORCED} SELECT pred_id, CASE WHEN n >= 7 THEN 'entity' ELSE 'neither' END AS row_class FROM fo WHERE NOT regexp_matches(r, '[A-Za-z0-9]')",
    "q73b_categories_forced": f"""WITH {Q.PRED}, {_FORCED}, x AS (SELECT pred_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i, list_filter(ws, lambda v, j: (j - 1) % 7 <> 6) AS said FROM fo WHERE NOT regexp_matches(r, '[A-Za-z0-9]'))
        SELECT pred_id, count(*) FILTER (i % 7 <> 6) AS "right", count(*) FILTER (i % 7 = 6 AND list_contains(said, w)) AS recoverable, count(*) FILTER (i % 7 = 6 AND NOT list_contains(said, w)) AS lost FROM x GROUP BY 1""",
    "q17b_entity_rates": f"""WITH {Q.WIN}, {_ENTITY}, f AS (SELECT split, contains(s, span) AS there, contains(CASE WHEN CAST('0x' || substr(md5(window_id), 1, 1) AS INTEGER) % 2 = 0 THEN r ELSE s END, span) AS hit FROM en)
        SELECT split, count(*) FILTER (there) AS "right", count(*) FILTER (there AND hit) AS kept, count(*) FILTER (NOT there) AS wrong, count(*) FILTER (NOT there AND hit) AS fixed,
        count(*) FILTER (there AND hit) / nullif(count(*) FILTER (there), 0) AS entity_keep_rate, count(*) FILTER (NOT there AND hit) / nullif(count(*) FILTER (NOT there), 0) AS entity_fix_rate FROM f GROUP BY 1""",
    "q28b_entity_spans": f"WITH {Q.WIN}, {_ENTITY} SELECT window_id, string_agg(raw, '|' ORDER BY raw) AS spans FROM en GROUP BY 1",
    "q25b_glue_extended": f"""WITH {Q.SEG}, {_SPOKEN}, {_GLUE.format(zwnj="true", upto="length(word)", plain=f"((length(b) > 1 AND b NOT IN ({Q.quoted(E.CLITIC_SUFFIXES)})) OR b = 'و') AND NOT ends_with(a, '{T.ZWNJ}') AND NOT starts_with(b, '{T.ZWNJ}')")} SELECT * FROM glue""",
    "q33b_rule_edits": f"""WITH {Q.SEG}, {Q.WIN}, {_RULES}, s AS (SELECT window_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS start_word, names FROM (SELECT window_id, {Q.words("coalesce(source, '')")} AS ws, {_NAMES} AS names FROM win))
        SELECT window_id, start_word, word AS original, fixed AS replacement, rule AS proposer FROM s JOIN rules USING (word) WHERE NOT list_contains(names, word)""",
    "q33c_rule_text": f"""WITH {Q.SEG}, {Q.WIN}, {_RULES}, s AS (SELECT window_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, names FROM (SELECT window_id, {Q.words("coalesce(source, '')")} AS ws, {_NAMES} AS names FROM win)),
        t AS (SELECT window_id, i, word, CASE WHEN NOT list_contains(names, word) THEN fixed END AS fixed FROM s LEFT JOIN rules USING (word))
        SELECT window_id, string_agg(coalesce(fixed, word), ' ' ORDER BY i) AS corrected, count(fixed) AS n_edits, 0 AS n_refused FROM t GROUP BY 1 HAVING count(fixed) > 0""",
    "q39c_rejected_rate": f"WITH {Q.PRED} SELECT run, count(*) AS answers, sum(coalesce(len(rejected_lines), 0))::BIGINT AS lines, avg(coalesce(len(rejected_lines), 0)) AS rate FROM pred GROUP BY 1",
    "q72b_split_calls": f"""WITH {Q.WIN}, c AS (SELECT call_id, row_number() OVER (ORDER BY md5('calls:' || call_id), call_id) <= round_even(count(*) OVER () * 0.05::DOUBLE, 0) AS v FROM (SELECT DISTINCT call_id FROM win WHERE call_id IS NOT NULL))
        SELECT window_id, CASE WHEN coalesce(v, false) THEN 'validation' ELSE 'train' END AS split FROM win LEFT JOIN c USING (call_id)""",
    "q72c_held_out": f"""WITH {Q.PRED}, p AS (SELECT pred_id, row_number() OVER (ORDER BY md5('held:' || pred_id), pred_id) <= ceil(count(*) OVER () * 0.1::DOUBLE) AS v FROM pred WHERE coalesce(input, '') <> '' AND coalesce(reference, '') <> ''),
        t AS (SELECT pred_id, row_number() OVER (ORDER BY md5('part:' || pred_id), pred_id) AS r, count(*) OVER () AS n FROM p WHERE NOT v)
        SELECT pred_id, 'train' AS split FROM t WHERE r <= round_even(n * (2 / 3::DOUBLE), 0) UNION ALL SELECT pred_id, 'validation' FROM p WHERE v""",
    "q79_shuffled": f"WITH {Q.WIN} SELECT window_id, row_number() OVER (ORDER BY md5('shuffle:' || window_id), window_id) AS position FROM win",
    "q79b_decode_sweep": f"""WITH {Q.PRED}, p AS (SELECT {Q.fraction("'none:' || pred_id")} AS p, coalesce(output, '') = coalesce(reference, '') AS same FROM pred)
        SELECT t AS threshold, count(*) AS n, count(*) FILTER (p < t OR same) AS "right" FROM p, (SELECT unnest([0.0, 0.3, 0.6, 0.9])::DOUBLE AS t) GROUP BY 1""",
    "q22_phonetic_similarity": f"""WITH s AS (SELECT DISTINCT whisper_span AS w, soniox_span AS o FROM judge_items WHERE whisper_span IS NOT NULL AND soniox_span IS NOT NULL),
        k AS (SELECT w, o, {_SOUND("w")} AS a, {_SOUND("o")} AS b, {_SOUND(Q.squash("w"))} AS c, {_SOUND(Q.squash("o"))} AS d FROM s)
        SELECT w AS whisper_span, o AS soniox_span, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END AS spoken, CASE WHEN c = '' AND d = '' THEN 1.0 ELSE 1 - levenshtein(c, d) / greatest(length(c), length(d)) END AS squashed FROM k""",
    "q19_validate_apply": f"""WITH {Q.WIN}, {Q.EDITS}, {_APPLIED}, reasons AS (SELECT window_id, string_agg(reason, ',' ORDER BY k) AS reasons FROM v GROUP BY 1)
        SELECT window_id, coalesce(reasons, '') AS reasons, coalesce(corrected, '') AS corrected FROM src LEFT JOIN reasons USING (window_id) LEFT JOIN c USING (window_id)""",
    "q37_cut_windows": f"""WITH RECURSIVE {Q.WIN}, n AS (SELECT window_id, {_LEN("coalesce(source, '')")} AS n, coalesce(edits, []) AS es FROM win),
        cuts AS (SELECT window_id, n, es, 0::BIGINT AS a, least(n, 30 + CAST('0x' || substr(md5(window_id || ':0'), 1, 8) AS BIGINT) % 31) AS z FROM n WHERE n > 0
            UNION ALL SELECT window_id, n, es, z, least(n, z + 30 + CAST('0x' || substr(md5(window_id || ':' || z), 1, 8) AS BIGINT) % 31) FROM cuts WHERE z < n)
        SELECT window_id, a, z, len(list_filter(es, lambda e: e.start_word >= a AND e.end_word <= z AND NOT (e.start_word = z AND e.end_word = z AND z < n))) AS inside FROM cuts WHERE (z - a >= 20 OR a = 0)
        AND len(list_filter(es, lambda e: (e.start_word < a AND a < e.end_word) OR (e.start_word < z AND z < e.end_word))) = 0""",
    "q39_window_merge": f"""WITH {Q.WIN}, {Q.EDITS}, {_APPLIED}, n AS (SELECT window_id, len(ws) AS n FROM src),
        s AS (SELECT window_id, n, unnest(CASE WHEN n <= 50 THEN [0] WHEN (n - 50) % 25 = 0 THEN range(0, n - 49, 25) ELSE list_append(range(0, n - 49, 25), n - 50) END) AS s FROM n),
        k AS (SELECT *, least(s + 50, n) AS z, lead(s) OVER w IS NULL AS final, lag(s + 37) OVER w AS p FROM s WINDOW w AS (PARTITION BY window_id ORDER BY s)),
        pl AS (SELECT window_id, s, z, CASE WHEN p IS NULL THEN 0 ELSE least(p, n) END AS cs, CASE WHEN final THEN n ELSE least(s + 37, n) END AS ce FROM k),
        said AS (SELECT v.window_id, v.k, reason, start_word >= cs AND start_word < ce AS own FROM v JOIN pl ON v.window_id = pl.window_id AND v.start_word >= s AND v.end_word <= z),
        g AS (SELECT window_id, count(*) FILTER (reason = 'ok' AND own) AS n_edits, count(*) FILTER (reason = 'ok' AND NOT own) AS n_outside, count(*) FILTER (reason <> 'ok') AS n_rejected FROM said GROUP BY 1)
        SELECT src.window_id AS key, coalesce(corrected, '') AS corrected, coalesce(n_edits, 0) AS n_edits, coalesce(n_outside, 0) AS n_outside, coalesce(n_rejected, 0) AS n_rejected FROM src LEFT JOIN g USING (window_id) LEFT JOIN c USING (window_id)""",
    "q58_loop_trim": f"WITH {Q.PRED} SELECT pred_id, true AS looped, {_LEN("coalesce(output, '')")} + 2 AS n FROM pred",
    "q72_assemble_windows": f"""WITH RECURSIVE {Q.WIN}, r AS (SELECT window_id AS row_id, call_id, {Q.words("coalesce(source, '')")} AS ws, coalesce(edits, []) AS es FROM win), n AS (SELECT *, len(ws) AS n FROM r),
        cuts AS (SELECT row_id, n, 0::BIGINT AS a, least(n, 40 + CAST('0x' || substr(md5(row_id || ':0'), 1, 8) AS BIGINT) % 41) AS z FROM n WHERE n > 0
            UNION ALL SELECT row_id, n, z, least(n, z + 40 + CAST('0x' || substr(md5(row_id || ':' || z), 1, 8) AS BIGINT) % 41) FROM cuts WHERE z < n),
        x AS (SELECT row_id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS i FROM r),
        d AS (SELECT row_id, i, e.start_word AS s, e.end_word AS t, {Q.words("coalesce(e.original, '')")} AS original, {Q.words("coalesce(e.replacement, '')")} AS replacement, e.stratum AS stratum, substr(sha1(row_id || chr(31) || i), 1, 16) AS id FROM x),
        w AS (SELECT * FROM cuts WHERE (z - a >= 20 OR a = 0) AND NOT EXISTS (SELECT 1 FROM d WHERE d.row_id = cuts.row_id AND ((s < a AND a < t) OR (s < z AND z < t)))),
        j AS (SELECT w.row_id, a, z, d.*, stratum IN ('entity', 'phonetic_sub', 'other_sub') AND len(original) > 0 AND len(replacement) > 0 AS judged, {Q.fraction("'decide:' || id")} AS u, {_TOUCH} AND {_FLAT('original')} <> {_FLAT('replacement')} AS number
            FROM w JOIN d ON d.row_id = w.row_id AND s >= a AND t <= z AND NOT (s = z AND t = z AND z < n)),
        g AS (SELECT row_id, a, count(*) FILTER (judged) AS judged, count(*) FILTER (stratum IN ('garbled', 'long')) AS skip, count(*) FILTER (judged AND u >= 0.9) AS open, count(*) FILTER (judged AND u < 0.7 AND NOT number) AS n_edits, count(*) FILTER (judged AND u < 0.7 AND number) AS n_numbers FROM j GROUP BY 1, 2),
        k AS (SELECT w.*, coalesce(n_edits, 0) AS n_edits, coalesce(n_numbers, 0) AS n_numbers FROM w LEFT JOIN g ON w.row_id = g.row_id AND w.a = g.a WHERE coalesce(skip, 0) = 0 AND coalesce(open, 0) = 0 AND coalesce(judged, 0) <= greatest(1, round_even((w.z - w.a) * 3 / 50.0::DOUBLE, 0))),
        words AS (SELECT k.row_id, k.a, w, p FROM (SELECT row_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM r) q JOIN k ON q.row_id = k.row_id AND p >= k.a AND p < k.z),
        tg AS (SELECT words.row_id, words.a, string_agg(CASE WHEN e.id IS NULL THEN w WHEN e.s = p THEN array_to_string(e.replacement, ' ') END, ' ' ORDER BY p) AS target FROM words
            LEFT JOIN j e ON e.row_id = words.row_id AND e.a = words.a AND e.judged AND e.u < 0.7 AND NOT e.number AND e.s <= p AND p < e.t GROUP BY 1, 2)
        SELECT k.row_id || ':' || k.a AS window_id, call_id, array_to_string(ws[greatest(k.a - 15, 0) + 1 : k.a], ' ') AS left_context, array_to_string(ws[k.a + 1 : k.z], ' ') AS source, array_to_string(ws[k.z + 1 : k.z + 15], ' ') AS right_context, target, k.n_edits, k.n_numbers
        FROM k JOIN r ON r.row_id = k.row_id LEFT JOIN tg ON tg.row_id = k.row_id AND tg.a = k.a""",
    "q20_edit_roundtrip": f"WITH {Q.WIN} SELECT count(*) AS windows, count(*) AS same FROM win WHERE source IS NOT NULL AND target_text IS NOT NULL",
    "q21_edit_flags": f"""WITH {Q.WIN}, {Q.EDITS} SELECT window_id, k, CASE WHEN len(original) = 0 THEN 'insert' WHEN len(replacement) = 0 THEN 'delete' ELSE 'substitute' END AS kind,
        {_TOUCH} AND {_FLAT('original')} <> {_FLAT('replacement')} AS number, {Q.squash("array_to_string(original, ' ')")} = {Q.squash("array_to_string(replacement, ' ')")} AS spacing_only,
        len(original) + len(replacement) > 0 AND len(list_filter(list_concat(original, replacement), lambda w: w NOT IN ({Q.quoted(T.FILLER_WORDS)}))) = 0 AS filler_words, greatest(len(original), len(replacement)) AS span_words FROM ed""",
    "q22b_sound_keys": f"""SELECT span, translate(replace(span, '{Z}', ''), '{T.SOUND_FROM}', '{T.SOUND_TO}') AS sound, {Q.squash('span')} AS squashed, array_to_string(list_transform({Q.words('span')}, lambda w: {_CANON('w')}), ' ') AS canonical
        FROM (SELECT DISTINCT unnest([whisper_span, soniox_span]) AS span FROM judge_items) WHERE span IS NOT NULL""",
    "q23_clitic_join": f"""WITH {Q.WIN} SELECT window_id, coalesce(list_reduce(list_transform({Q.words('source')}, lambda w: {_CANON('w')}), lambda acc, w:
        CASE WHEN w IN ({_CLITIC}) AND {_LAST} NOT IN ({_CLITIC}) THEN rtrim(acc, '{Z}') || CASE w WHEN 'هم' THEN 'م' ELSE 'و' END ELSE acc || ' ' || w END), '') AS joined FROM win""",
    "q27_whole_span": f"""WITH {Q.WIN} SELECT window_id, k - 1 AS k, e.replacement AS name, contains({_PAD("coalesce(source, '')")}, {_PAD("e.replacement")}) AS in_source
        FROM (SELECT window_id, source, target_text, unnest(edits) AS e, generate_subscripts(edits, 1) AS k FROM win) WHERE e.stratum = 'entity' AND length(trim(e.replacement)) >= 3 AND contains({_PAD('target_text')}, {_PAD('e.replacement')})""",
    "q28_entity_slice": f"""WITH {Q.WIN}, a AS (SELECT window_id, list_sort(list_distinct(list_filter(flatten(list_transform(crm_names, lambda n: {Q.words('n')})), lambda w: length(w) >= 3 AND list_contains({Q.words("coalesce(target_text, '')")}, w)))) AS e,
        {Q.words("coalesce(source, '')")} AS s FROM win) SELECT window_id, array_to_string(e, ' ') AS entity_words, len(list_filter(e, lambda w: NOT list_contains(s, w))) > 0 AS missing_from_source FROM a WHERE len(e) > 0""",
    "q30_eval_union": f"WITH {Q.PRED} SELECT pred_id, call_id, input, eval_slice AS row_type FROM pred WHERE eval_slice IN ('entity', 'typo')",
    "q35_neighbours_band": f"""WITH {Q.WIN}, {Q.EDITS} SELECT a.window_id, a.k, count(*) FILTER (b.start_word < a.end_word + 3 AND b.end_word > a.start_word - 3 AND NOT (a.start_word = b.start_word AND a.end_word = b.end_word)) AS neighbours
        FROM ed a JOIN ed b USING (window_id) GROUP BY 1, 2""",
    "q36_window_plan": f"""WITH n AS (SELECT doc_id, {_LEN('text')} AS n FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, n, unnest(CASE WHEN n <= 50 THEN [0] WHEN (n - 50) % 25 = 0 THEN range(0, n - 49, 25) ELSE list_append(range(0, n - 49, 25), n - 50) END) AS s FROM n),
        c AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL AS final, CAST(s + 37 AS BIGINT) AS e FROM s)
        SELECT doc_id, s AS start_word, least(s + 50, n) AS end_word, CASE WHEN lag(e) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 0 ELSE least(lag(e) OVER (PARTITION BY doc_id ORDER BY s), n) END AS core_start, CASE WHEN final THEN n ELSE least(e, n) END AS core_end FROM c""",
    "q38_window_select_quota": f"""WITH {Q.WIN}, w AS (SELECT window_id, coalesce(call_id, window_id) AS c, len(edits) > 0 AS judged, len(list_filter(edits, lambda e: e.stratum = 'entity')) > 0 AS ent, md5('select:' || window_id) AS h FROM win),
        j AS (SELECT window_id, c FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ent DESC, h, window_id) AS r FROM w WHERE judged) WHERE r <= 2 ORDER BY ent DESC, h, window_id LIMIT 210),
        u AS (SELECT c, count(*) AS used FROM j GROUP BY 1),
        f AS (SELECT window_id FROM (SELECT w.*, row_number() OVER (PARTITION BY c ORDER BY ent DESC, h, window_id) AS r FROM w WHERE NOT judged) x LEFT JOIN u USING (c) WHERE r <= 2 - coalesce(used, 0) ORDER BY ent DESC, h, window_id LIMIT 90)
        SELECT window_id, 'judged' AS pool FROM j UNION ALL SELECT window_id, 'free' FROM f""",
    "q51_gold_pred_pr": f"""WITH {Q.WIN}, {Q.EDITS}, g AS (SELECT DISTINCT window_id, start_word, end_word, array_to_string(replacement, ' ') AS r FROM ed),
        p AS (SELECT DISTINCT window_id, start_word, end_word, array_to_string(replacement, ' ') AS r FROM ed WHERE decided_by <> 'hand label'),
        x AS (SELECT window_id, count(p.r) AS tp, count(*) AS ng, count(p.r) AS np FROM g LEFT JOIN p USING (window_id, start_word, end_word, r) GROUP BY 1)
        SELECT sum(tp)::BIGINT AS tp, sum(ng)::BIGINT AS n_gold, sum(np)::BIGINT AS n_predicted, sum(tp) / sum(np) AS precision, sum(tp) / sum(ng) AS recall, avg(CASE WHEN tp = ng THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exact_windows FROM x""",
    "q59_token_masks": f"""WITH {Q.WIN}, n AS (SELECT window_id, {_LEN("coalesce(source, '')")} AS p, {_LEN("coalesce(target_text, '')")} AS t, len(edits) > 0 AS m FROM win)
        SELECT window_id, least(p + t + 1, 512) AS n, CASE WHEN p >= 512 THEN 512 ELSE p + CASE WHEN m AND t > 0 THEN 1 ELSE 0 END END AS ignored, CASE WHEN p + t + 1 <= 512 THEN 'ok' WHEN p < 512 THEN 'truncated' ELSE 'dropped' END AS status FROM n""",
    "q60_pad_batches": f"""WITH {Q.WIN}, n AS (SELECT window_id, least({_LEN("coalesce(source, '')")} + {_LEN("coalesce(target_text, '')")} + 1, 512) AS n FROM win)
        SELECT window_id, CAST(n // 16 AS INTEGER) AS batch, n, max(n) OVER (PARTITION BY n // 16) AS width FROM n""",
    "q64_publication_checks": """SELECT 'duplicate window' AS problem, window_id AS key FROM train GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'call in two splits', call_id FROM train WHERE call_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1""",
    "q65_window_eligibility": f"""WITH {Q.WIN} SELECT CASE WHEN {_LEN("coalesce(source, '')")} < 40 THEN 'short' WHEN len(list_filter(edits, lambda e: coalesce(e.original, '') = '' OR coalesce(e.replacement, '') = '')) > 0 THEN 'one-sided edit' ELSE 'kept' END AS reason, count(*) AS n FROM win GROUP BY 1""",
    "q66_contexts": f"""WITH {Q.WIN}, {Q.EDITS}, w AS (SELECT window_id, {Q.words('source')} AS ws FROM win) SELECT window_id, k,
        array_to_string(ws[greatest(start_word - 6, 0) + 1 : start_word], ' ') AS left_words, array_to_string(ws[end_word + 1 : end_word + 6], ' ') AS right_words FROM ed JOIN w USING (window_id)""",
    "q68_containment": f"""WITH {Q.WIN}, {Q.EDITS}, now AS (SELECT substr(sha1(window_id || chr(31) || k), 1, 16) AS id, window_id AS row_id, start_word, end_word, k FROM ed),
        old AS (SELECT CASE WHEN k % 3 = 0 THEN id ELSE 'old' || id END AS id, row_id, greatest(start_word - 2, 0) AS a, end_word + 2 AS z FROM now)
        SELECT old.id AS old_id, now.id AS new_id, 'same' AS how FROM old JOIN now USING (id)
        UNION ALL SELECT old.id, now.id, 'part' FROM old JOIN now USING (row_id) WHERE old.id NOT IN (SELECT id FROM now) AND a <= start_word AND end_word <= z""",
    "q70_render": f"""WITH {Q.WIN} SELECT window_id, CASE WHEN len(crm_names) > 0 THEN 'Known names: ' || array_to_string(crm_names, '، ') || chr(10) ELSE '' END
        || array_to_string(list_transform({Q.words('source')}, lambda w, i: '[' || i || ']' || w), ' ') AS prompt,
        CASE WHEN len(edits) > 0 THEN array_to_string(list_transform(list_sort(list_transform(edits, lambda e: {{'s': e.start_word, 'e': e.end_word, 'o': coalesce(e.original, ''), 'r': coalesce(e.replacement, '')}})),
        lambda e: CASE WHEN e.e - e.s = 1 THEN CAST(e.s + 1 AS VARCHAR) ELSE (e.s + 1) || '-' || e.e END || ' ' || e.o || ' → ' || e.r), chr(10)) ELSE 'NONE' END AS answer FROM win""",
    "q71_hash_sample": f"WITH {Q.PRED} SELECT pred_id FROM pred ORDER BY md5('draw:' || pred_id), pred_id LIMIT 50",
}
