"""Queries: judge logs, scores, sweeps, audits, runs, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sokhan.functions import text as T
from sokhan.materialize import scratch
from sokhan.operators import judging as J
from sokhan.operators import reports as R
from sokhan.operators import scoring as K
from sokhan.plans import sql as Q
from sokhan.plans.transcripts import pred
from sokhan.sources.tables import table
from sokhan.streaming import digest as G

CHEAP, MAIN, PERSON = "pebble-mini@nothink", "lark-large@think", "p12"
THRESHOLDS = (0.1, 0.3, 0.5, 0.7, 0.9)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_answers(table(spark, d, "judge_items"))


def _of(answers: DataFrame, model: str) -> DataFrame:
    return answers.filter(F.col("model") == model)


def q40_judge_latest(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d)


def q41_decide_cascade(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return J.decide(table(spark, d, "judge_items").select("id"), _of(a, CHEAP), _of(a, MAIN), _of(a, PERSON))


def q42_confusion(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return J.confusion(_of(a, MAIN), _of(a, CHEAP))


def q42b_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return J.agreement(_of(a, MAIN), _of(a, CHEAP))


def q43_unanimous(spark: SparkSession, d: str) -> DataFrame:
    return J.unanimous(_answers(spark, d).filter(F.col("model").isin(CHEAP, MAIN)), 2)


def q44_review_set(spark: SparkSession, d: str) -> DataFrame:
    """Items that the person hasn't labelled, or where both judges agree with each other and not with the person."""
    a = _answers(spark, d)
    u = J.unanimous(a.filter(F.col("model").isin(CHEAP, MAIN)), 2, mixed=None).filter("label is not null")
    return J.review_set(table(spark, d, "judge_items"), u, _of(a, PERSON))


def q45_verifier_data(spark: SparkSession, d: str) -> DataFrame:
    """Decided items as yes/no examples with a split by call, numbers left out."""
    items = table(spark, d, "judge_items").filter("whisper_span is not null and soniox_span is not null").groupBy("id").agg(F.min_by(F.struct("call_id", "whisper_span", "soniox_span", "stratum"), "line_no").alias("x"))
    plain = items.select("id", "x.*").filter(~T.changes_number(T.words(F.col("whisper_span")), T.words(F.col("soniox_span"))))
    return plain.join(q41_decide_cascade(spark, d), "id").filter("decision != 'undecided'").select("id", "call_id", "stratum", F.when(F.col("decision") == "accepted", "YES").otherwise("NO").alias("label"), J.split_of(F.col("call_id"), 0.2).alias("split"))


def q45b_split_summary(spark: SparkSession, d: str) -> DataFrame:
    e = q45_verifier_data(spark, d)
    return e.groupBy("split").agg(F.count("*").alias("examples"), F.count_distinct("call_id").alias("calls"), F.count_if(F.col("label") == "YES").alias("yes"), F.count_if(F.col("label") == "NO").alias("no"))


def q45c_split_strata(spark: SparkSession, d: str) -> DataFrame:
    return q45_verifier_data(spark, d).groupBy("split", "stratum").agg(F.count("*").alias("examples"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    v = J.parse_verdict(F.col("verdict"))
    s = table(spark, d, "judge_items").withColumn("v", v).filter("v is not null")
    score = T.hash_fraction(F.concat_ws(":", F.lit("score"), "id", "model", "line_no"))
    return s.select("line_no", "id", "model", score.alias("score"), (F.col("v") == "A").alias("positive"), F.when(F.col("v") == "A", 1).when(F.col("v") == "B", -1).otherwise(0).alias("effect"))


def q46_auc(spark: SparkSession, d: str) -> DataFrame:
    return R.auc(_scored(spark, d))


def q46b_auc_ties(spark: SparkSession, d: str) -> DataFrame:
    """The same with scores in tenths, so that most are tied."""
    return R.auc(_scored(spark, d).withColumn("score", F.floor(F.col("score") * 10)))


def q47_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return R.threshold_report(_scored(spark, d), THRESHOLDS)


def q48_score_bins(spark: SparkSession, d: str) -> DataFrame:
    return R.score_bins(_scored(spark, d))


def q49_judged_precision(spark: SparkSession, d: str) -> DataFrame:
    """Precision at and above each score bin, from a sample of 30 a bin that the cascade has decided on."""
    scored = _scored(spark, d)
    judged = R.bin_sample(scored, 30, "judged", "line_no").join(q41_decide_cascade(spark, d), "id")
    out = R.judged_precision(scored, judged)
    return out.withColumns({c: F.round(c, 9) for c in ("bin_precision", "precision_from", "accepted_from")})


def q49b_effect_by_decision(spark: SparkSession, d: str) -> DataFrame:
    """What the cascade says of candidates, by what they do to the reference."""
    return R.effect_by_decision(_scored(spark, d).join(q41_decide_cascade(spark, d), "id"))


def q48b_second_judge(spark: SparkSession, d: str) -> DataFrame:
    """A second judge's scores of 25 sampled candidates a bin."""
    s = R.bin_sample(_scored(spark, d), 25, "second", "line_no").withColumn("second", F.when(F.col("line_no") % 7 != 0, T.hash_fraction(F.concat_ws(":", F.lit("second"), "line_no"))))
    out = R.second_judge(s)
    return out.select("bin", "sampled", F.round("mean", 9).alias("mean"), F.round(F.get("at_least", F.lit(0)), 9).alias("at_least_20"), F.round(F.get("at_least", F.lit(1)), 9).alias("at_least_30"))


def q42c_agreement_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    strata = table(spark, d, "judge_items").groupBy("id").agg(F.min_by("stratum", "line_no").alias("stratum"))
    return J.agreement_by_stratum(_of(a, MAIN), _of(a, CHEAP), strata)


def q44b_filter_effect(spark: SparkSession, d: str) -> DataFrame:
    """What the main judge said of earlier items, by what filters make of them now; every fifth is gone, every third a matter of style."""
    a = _answers(spark, d)
    n = F.conv(F.substring("id", -2, 2), 16, 10).cast("int")
    now = table(spark, d, "judge_items").select("id", "stratum").distinct().groupBy("id").agg(F.min("stratum").alias("stratum")).filter(n % 5 != 0)
    return J.filter_effect(table(spark, d, "judge_items"), now.withColumn("stratum", F.when(n % 3 == 0, F.lit("style")).otherwise(F.col("stratum"))), _of(a, MAIN))


def q69b_route(spark: SparkSession, d: str) -> DataFrame:
    """Whom to ask next about which item; final failures are left out."""
    a = _answers(spark, d)
    return J.route_items(table(spark, d, "judge_items"), _of(a, CHEAP), _of(a, MAIN))


def q69c_final_failures(spark: SparkSession, d: str) -> DataFrame:
    return J.final_failures(table(spark, d, "judge_items"), "v2", 8000)


def q74_judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a judge would be asked about each item; contexts are not in the log."""
    items = table(spark, d, "judge_items").groupBy("id").agg(F.min_by(F.struct("whisper_span", "soniox_span"), "line_no").alias("x"))
    none = F.lit(None).cast("string")
    return items.select("id", J.judge_prompt(F.col("id"), F.col("x.whisper_span"), F.col("x.soniox_span"), none, none, F.lit(None).cast("array<string>")).alias("prompt"))


def q75_parse_reply(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of the log's verdicts, read back: some in prose, some broken off."""
    v = F.concat(F.lit('{"verdict": "'), F.coalesce(J.parse_verdict(F.col("verdict")), F.lit("?")), F.lit('", "confidence": "'), F.coalesce("confidence", F.lit("")), F.lit('"}'))
    reply = F.when(F.col("line_no") % 11 == 0, F.expr("substring(v, 1, length(v) - 3)")).when(F.col("line_no") % 3 == 0, F.concat(F.lit("So:\n"), F.col("v"), F.lit(" done"))).otherwise(F.col("v"))
    r = table(spark, d, "judge_items").withColumn("v", v).select("line_no", J.parse_reply(reply).alias("p"))
    return r.select("line_no", "p.verdict", "p.confidence")


def q76_merge_labels(spark: SparkSession, d: str) -> DataFrame:
    """Two people's label files, the second before the first."""
    j = table(spark, d, "judge_items")
    one = lambda m: j.filter((F.col("model") == m) & F.col("verdict").isNotNull()).groupBy("id").agg(F.max_by("verdict", "line_no").alias("verdict"))
    return J.merge_labels(one("p11"), one(PERSON))


def q77_quota_sample(spark: SparkSession, d: str) -> DataFrame:
    """Items to be labelled: quotas by stratum, two a call at most (a sampling operator)."""
    items = table(spark, d, "judge_items").groupBy("id").agg(F.min_by(F.struct("call_id", "stratum"), "line_no").alias("x")).select("id", "x.*")
    return R.quota_sample(items, {"entity": 50, "phonetic_sub": 45, "other_sub": 35}, 2, "label", "id")


def q50_stratified_audit(spark: SparkSession, d: str) -> DataFrame:
    """At most 20 rejected helpful and accepted harmful candidates each (a sampling operator)."""
    group = F.when((F.col("effect") > 0) & (F.col("score") < 0.3), F.lit("rejected helpful")).when((F.col("effect") < 0) & (F.col("score") >= 0.5), F.lit("accepted harmful"))
    return R.stratified_sample(_scored(spark, d), group, 20, "audit", "line_no").select("line_no", "id", "stratum_key")


def _series(spark: SparkSession, d: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("run"), step.alias("step"), "value", F.col("event_type").alias("tag"))


def q52_best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return R.best_so_far(_series(spark, d), 10)


def q53_trend(spark: SparkSession, d: str) -> DataFrame:
    return R.trend(_series(spark, d))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).groupBy("run").agg(F.min(F.when(F.col("tag") == "click", F.col("value"))).alias("wer"), F.min(F.when(F.col("tag") == "view", F.col("value"))).alias("loss"))


def q54_run_ranking(spark: SparkSession, d: str) -> DataFrame:
    return R.rank_runs(_runs(spark, d))


def q55_prediction_filter(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"field": "input_overlap_pct", "op": "<", "value": 95.0}, {"field": "eval_slice", "op": "!=", "value": "typo"}, {"field": "output", "op": "contains", "value": "سلام"}]
    return R.prediction_filter(pred(spark, d), rules, ("input_overlap_pct", "eval_slice", "output", "run")).select("pred_id", "run", "input_overlap_pct")


def q56_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    m = pred(spark, d).groupBy("run", F.col("eval_slice").alias("metric")).agg(F.round(F.avg("input_overlap_pct"), 6).alias("value"))
    return R.compare_runs(m, "edit-b", "edit-c")


def q56b_series_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.series_summary(_series(spark, d))


def q61_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    s = _series(spark, d)
    out = K.weighted_loss(s, ["run"], F.col("value"), F.when(F.col("tag") == "click", 2.0).otherwise(1.0), F.col("tag") != "error")
    return out.select("run", F.round("loss", 6).alias("loss"))


def q67_judge_stats(spark: SparkSession, d: str) -> DataFrame:
    return J.judge_stats(table(spark, d, "judge_items"))


def q69_pending(spark: SparkSession, d: str) -> DataFrame:
    """Items that the main judge still has to answer."""
    return J.pending(table(spark, d, "judge_items"), _of(_answers(spark, d), MAIN))


def q63_stream_digest(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a stream, hour by hour, all of them: the table of windows is the answer so far, written anew as it changes."""
    where = scratch(spark, "stream")
    # a file source takes a folder and a pattern, so it sees the events table alone
    stream = G.readings(spark, f"{d}/events.parque[t]", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double", "ts")
    G.latest_windows(G.window_digest(stream, "ts", "1 hour", "event_type"), ["window_start", "event_type"], f"{where}/out", f"{where}/state")
    return G.read_latest(spark, f"{where}/out").select("window_start", "event_type", "n", F.round("mean", 6).alias("mean"), "least")


def q63b_digest_trend(spark: SparkSession, d: str) -> DataFrame:
    """The trend of the hourly means of each kind of event."""
    hours = q63_stream_digest(spark, d).select(F.col("event_type").alias("run"), F.col("window_start").alias("step"), F.col("mean").alias("value"))
    return R.trend(hours)


QUERIES = {f.__name__: f for f in (q40_judge_latest, q41_decide_cascade, q42_confusion, q42b_agreement, q43_unanimous, q44_review_set, q45_verifier_data, q45b_split_summary, q45c_split_strata, q46_auc, q46b_auc_ties, q47_threshold_sweep, q48_score_bins, q49_judged_precision, q49b_effect_by_decision, q48b_second_judge, q42c_agreement_by_stratum, q44b_filter_effect, q69b_route, q69c_final_failures, q74_judge_prompts, q75_parse_reply, q76_merge_labels, q77_quota_sample, q50_stratified_audit, q52_best_so_far, q53_trend, q54_run_ranking, q55_prediction_filter, q56_compare_runs, q56b_series_summary, q61_weighted_loss, q67_judge_stats, q69_pending, q63_stream_digest, q63b_digest_trend)}

_SIDE = lambda m, n: f"{n} AS (SELECT id, label, confidence FROM ans WHERE model = '{m}')"
_REJECTS = lambda c: f"coalesce({c}.label IN ('either_fine', 'soniox_wrong'), false)"
_DECIDED = f"""{_SIDE(CHEAP, 'c')}, {_SIDE(MAIN, 'm')}, {_SIDE(PERSON, 'h')},
    dec AS (SELECT i.id, CASE WHEN h.label = 'real_error' THEN 'accepted' WHEN {_REJECTS('h')} THEN 'rejected' WHEN h.label IS NOT NULL THEN 'undecided'
        WHEN coalesce(m.label = 'real_error', false) AND NOT {_REJECTS('c')} THEN 'accepted' WHEN {_REJECTS('c')} OR {_REJECTS('m')} THEN 'rejected' ELSE 'undecided' END AS decision,
    CASE WHEN h.label IS NOT NULL THEN 'hand label' ELSE 'judges (' || coalesce(c.label, 'missing') || ' / ' || coalesce(m.label, 'missing') || ')' END AS decided_by
    FROM (SELECT DISTINCT id FROM judge_items) i LEFT JOIN c ON i.id = c.id LEFT JOIN m ON i.id = m.id LEFT JOIN h ON i.id = h.id)"""
_UNANIMOUS = f"uni AS (SELECT id, count(DISTINCT label) AS k, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'uncertain' END AS label FROM ans WHERE model IN ('{CHEAP}', '{MAIN}') GROUP BY 1 HAVING count(DISTINCT model) = 2)"
_BOTH = f"{_SIDE(MAIN, 'm')}, {_SIDE(CHEAP, 'c')}"
_BIN = "CASE WHEN score >= 0.9 THEN 5 WHEN score >= 0.8 THEN 4 WHEN score >= 0.7 THEN 3 WHEN score >= 0.5 THEN 2 WHEN score >= 0.3 THEN 1 ELSE 0 END"
_EVERY = "(SELECT unnest(range(0, 6))::INTEGER AS bin) b"
_BINS = f"""bins AS (SELECT b.bin, count(s.score) AS n, count(*) FILTER (effect > 0) AS fixes, count(*) FILTER (effect < 0) AS breaks, count(*) FILTER (effect = 0) AS neutral, coalesce(sum(effect), 0)::BIGINT AS net
    FROM {_EVERY} LEFT JOIN (SELECT *, {_BIN} AS bin FROM scored) s USING (bin) GROUP BY 1)"""
_SAMPLE = lambda n, seed: f"smp AS (SELECT * FROM (SELECT *, {_BIN} AS bin, row_number() OVER (PARTITION BY {_BIN} ORDER BY md5('{seed}:' || line_no), line_no) AS rn FROM scored) WHERE rn <= {n})"
_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn FROM judge_items) WHERE rn = 1)"
_N = "CAST('0x' || right(id, 2) AS INTEGER)"
_REPLY = f"""'{{"verdict": "' || coalesce({Q.PARSED}, '?') || '", "confidence": "' || coalesce(confidence, '') || '"}}'"""
_AUC = """l AS (SELECT {s} AS s, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM scored GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l)
    SELECT sum(p * (below::DOUBLE + n / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(n)::DOUBLE) AS auc, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM b"""
_NUM = f"len(list_filter(list_concat({Q.words('whisper_span')}, {Q.words('soniox_span')}), lambda w: {Q.NUMBER})) > 0 AND replace(array_to_string({Q.words('whisper_span')}, ''), '{T.ZWNJ}', '') <> replace(array_to_string({Q.words('soniox_span')}, ''), '{T.ZWNJ}', '')"
_EXAMPLES = f"""ex AS (SELECT x.id, CASE WHEN decision = 'accepted' THEN 'YES' ELSE 'NO' END AS label, call_id, x.stratum, CASE WHEN CAST('0x' || substr(sha1(call_id), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.2 THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn FROM judge_items WHERE whisper_span IS NOT NULL AND soniox_span IS NOT NULL) WHERE rn = 1) x JOIN dec USING (id) WHERE decision <> 'undecided' AND NOT ({_NUM}))"""

SQL = {
    "q40_judge_latest": f"WITH {Q.ANSWERS} SELECT * FROM ans",
    "q41_decide_cascade": f"WITH {Q.ANSWERS}, {_DECIDED} SELECT * FROM dec",
    "q42_confusion": f"WITH {Q.ANSWERS}, {_BOTH} SELECT m.label AS person, " + ", ".join(f"count(*) FILTER (c.label = '{lab}') AS {lab}" for lab in J.LABELS) + " FROM m JOIN c USING (id) GROUP BY 1",
    "q42b_agreement": f"""WITH {Q.ANSWERS}, {_BOTH} SELECT count(*) AS items, count(*) FILTER (m.label = c.label) / count(*) AS agreement, count(*) FILTER (m.label = 'real_error' AND c.label = 'real_error') / count(*) FILTER (c.label = 'real_error') AS real_error_precision,
        count(*) FILTER (m.label = 'real_error' AND c.label = 'real_error') / count(*) FILTER (m.label = 'real_error') AS real_error_recall, count(*) FILTER (c.label = 'uncertain') / count(*) AS uncertain_share FROM m JOIN c USING (id)""",
    "q43_unanimous": f"WITH {Q.ANSWERS}, {_UNANIMOUS} SELECT id, label FROM uni",
    "q44_review_set": f"""WITH {Q.ANSWERS}, {_UNANIMOUS}, {_SIDE(PERSON, 'h')}, x AS (SELECT i.id, CASE WHEN k = 1 THEN uni.label END AS agreed, h.label AS person FROM (SELECT DISTINCT id FROM judge_items) i LEFT JOIN uni ON i.id = uni.id LEFT JOIN h ON i.id = h.id)
        SELECT *, CASE WHEN person IS NULL THEN 'unlabelled' ELSE 'disagrees with judges' END AS why FROM x WHERE person IS NULL OR agreed <> person""",
    "q42c_agreement_by_stratum": f"WITH {Q.ANSWERS}, {_BOTH} SELECT s.stratum, count(*) AS items, avg(CASE WHEN m.label = c.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS agreement FROM m JOIN c USING (id) JOIN {_FIRST} s USING (id) GROUP BY 1",
    "q44b_filter_effect": f"""WITH {Q.ANSWERS}, {_SIDE(MAIN, 'm')}, cur AS (SELECT id, CASE WHEN {_N} % 3 = 0 THEN 'style' ELSE min(stratum) END AS stratum FROM judge_items WHERE {_N} % 5 <> 0 GROUP BY id)
        SELECT CASE WHEN cur.id IS NULL OR cur.stratum IS NULL THEN 'split' WHEN cur.stratum IN ('style', 'filler', 'garbled') THEN cur.stratum ELSE 'still judged' END AS now, m.label, count(*) AS n FROM m LEFT JOIN cur ON m.id = cur.id GROUP BY 1, 2""",
    "q48b_second_judge": f"""WITH {Q.SCORED}, {_SAMPLE(25, 'second')}, x AS (SELECT bin, {Q.fraction("'second:' || line_no")} AS second FROM smp WHERE line_no % 7 <> 0)
        SELECT b.bin, count(second) AS sampled, round(avg(second), 9) AS mean, round(avg(CASE WHEN second >= 0.2 THEN 1.0::DOUBLE WHEN second < 0.2 THEN 0.0::DOUBLE END), 9) AS at_least_20, round(avg(CASE WHEN second >= 0.3 THEN 1.0::DOUBLE WHEN second < 0.3 THEN 0.0::DOUBLE END), 9) AS at_least_30
        FROM {_EVERY} LEFT JOIN x USING (bin) GROUP BY 1""",
    "q49b_effect_by_decision": f"""WITH {Q.ANSWERS}, {_DECIDED}, {Q.SCORED}, x AS (SELECT unnest([CASE WHEN effect > 0 THEN 'fixes words' WHEN effect < 0 THEN 'breaks words' ELSE 'neutral' END, 'all']) AS effect, decision FROM scored JOIN dec USING (id))
        SELECT effect, count(*) AS n, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision = 'undecided') AS undecided FROM x GROUP BY 1""",
    "q69b_route": f"""WITH {Q.ANSWERS}, {_BOTH} SELECT * FROM (SELECT i.id, CASE WHEN c.id IS NULL THEN 'cheap' WHEN NOT {_REJECTS('c')} AND m.id IS NULL THEN 'main' END AS ask
        FROM (SELECT DISTINCT id FROM judge_items) i LEFT JOIN c ON i.id = c.id LEFT JOIN m ON i.id = m.id) WHERE ask IS NOT NULL""",
    "q69c_final_failures": f"SELECT DISTINCT id, model FROM judge_items WHERE prompt_version = 'v2' AND error = '{J.NO_ROOM}'",
    "q74_judge_prompts": f"""SELECT id, 'Known names: (none)' || chr(10) || chr(10) || 'Context:  ⟦ … ⟧ ' || chr(10) || chr(10) || 'A: ' || CASE WHEN {Q.EVEN} THEN w ELSE s END || chr(10) || 'B: ' || CASE WHEN {Q.EVEN} THEN s ELSE w END AS prompt
        FROM (SELECT id, coalesce(nullif(whisper_span, ''), '∅') AS w, coalesce(nullif(soniox_span, ''), '∅') AS s FROM {_FIRST})""",
    "q75_parse_reply": f"""WITH r AS (SELECT line_no, {Q.PARSED} AS v, coalesce(confidence, '') AS c FROM judge_items), k AS (SELECT line_no, v, c, line_no % 11 <> 0 AND v IS NOT NULL AS ok FROM r)
        SELECT line_no, CASE WHEN ok THEN v END AS verdict, CASE WHEN ok THEN c END AS confidence FROM k""",
    "q76_merge_labels": f"""WITH f AS (SELECT id, model = '{PERSON}' AS k, arg_max(verdict, line_no) AS verdict FROM judge_items WHERE model IN ('p11', '{PERSON}') AND verdict IS NOT NULL GROUP BY 1, 2)
        SELECT id, arg_max(verdict, k::INTEGER) AS verdict FROM f WHERE verdict <> '' GROUP BY 1""",
    "q77_quota_sample": f"""WITH i AS (SELECT id, call_id, stratum, md5('label:' || id) AS h FROM {_FIRST}),
        e AS (SELECT id, call_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY h, id) AS r FROM i WHERE stratum = 'entity') WHERE r <= 2 ORDER BY h, id LIMIT 50), ue AS (SELECT call_id, count(*) AS u FROM e GROUP BY 1),
        p AS (SELECT id, x.call_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY h, id) AS r FROM i WHERE stratum = 'phonetic_sub') x LEFT JOIN ue USING (call_id) WHERE r <= 2 - coalesce(u, 0) ORDER BY h, id LIMIT 45),
        up AS (SELECT call_id, count(*) AS u FROM (SELECT call_id FROM e UNION ALL SELECT call_id FROM p) GROUP BY 1),
        o AS (SELECT id, x.call_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY h, id) AS r FROM i WHERE stratum = 'other_sub') x LEFT JOIN up USING (call_id) WHERE r <= 2 - coalesce(u, 0) ORDER BY h, id LIMIT 35)
        SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM o""",
    "q45c_split_strata": f"WITH {Q.ANSWERS}, {_DECIDED}, {_EXAMPLES} SELECT split, stratum, count(*) AS examples FROM ex GROUP BY 1, 2",
    "q63b_digest_trend": """WITH h AS (SELECT event_type AS run, time_bucket(INTERVAL 1 HOUR, ts) AS step, round(avg(value), 6) AS value FROM events GROUP BY 1, 2),
        a AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step) AS best, row_number() OVER (PARTITION BY run ORDER BY step) AS n, first_value(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM h),
        c AS (SELECT *, max(CASE WHEN value <= best THEN n END) OVER (PARTITION BY run ORDER BY step) AS best_n FROM a)
        SELECT run, step, CASE WHEN n < 2 THEN 'not enough data' WHEN value <= best THEN 'improving' WHEN value <= f THEN 'plateaued' ELSE 'regressed' END AS trend, n - best_n AS since FROM c""",
    "q63_stream_digest": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least FROM events GROUP BY 1, 2",
    "q45_verifier_data": f"WITH {Q.ANSWERS}, {_DECIDED}, {_EXAMPLES} SELECT * FROM ex",
    "q45b_split_summary": f"WITH {Q.ANSWERS}, {_DECIDED}, {_EXAMPLES} SELECT split, count(*) AS examples, count(DISTINCT call_id) AS calls, count(*) FILTER (label = 'YES') AS yes, count(*) FILTER (label = 'NO') AS no FROM ex GROUP BY 1",
    "q46_auc": f"WITH {Q.SCORED}, {_AUC.format(s='score')}",
    "q46b_auc_ties": f"WITH {Q.SCORED}, {_AUC.format(s='floor(score * 10)')}",
    "q47_threshold_sweep": f"""WITH {Q.SCORED} SELECT t AS threshold, count(*) FILTER (score >= t) AS accepted, count(*) FILTER (score >= t AND positive) / nullif(count(*) FILTER (score >= t), 0) AS precision,
        count(*) FILTER (score >= t AND positive) / nullif(count(*) FILTER (positive), 0) AS recall, count(*) FILTER ((score >= t) = positive) / count(*) AS accuracy FROM scored, (SELECT unnest({list(THRESHOLDS)})::DOUBLE AS t) GROUP BY 1""",
    "q48_score_bins": f"WITH {Q.SCORED}, {_BINS} SELECT * FROM bins",
    "q49_judged_precision": f"""WITH {Q.ANSWERS}, {_DECIDED}, {Q.SCORED}, {_SAMPLE(30, 'judged')}, j AS (SELECT bin, count(*) AS sampled, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected FROM smp JOIN dec USING (id) GROUP BY 1),
        n AS (SELECT {_BIN} AS bin, count(*) AS candidates FROM scored GROUP BY 1),
        k AS (SELECT b.bin, coalesce(candidates, 0) AS candidates, coalesce(sampled, 0) AS sampled, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected, accepted / nullif(accepted + rejected, 0) AS pr FROM {_EVERY} LEFT JOIN n USING (bin) LEFT JOIN j USING (bin))
        SELECT bin, candidates, sampled, accepted, rejected, round(pr, 9) AS bin_precision, round(sum(candidates * pr) OVER w / nullif(sum(CASE WHEN pr IS NOT NULL THEN candidates ELSE 0 END) OVER w, 0), 9) AS precision_from,
        round(coalesce(sum(candidates * pr) OVER w, 0), 9)::DOUBLE AS accepted_from FROM k WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)""",
    "q50_stratified_audit": f"""WITH {Q.SCORED}, g AS (SELECT *, CASE WHEN effect > 0 AND score < 0.3 THEN 'rejected helpful' WHEN effect < 0 AND score >= 0.5 THEN 'accepted harmful' END AS stratum_key FROM scored)
        SELECT line_no, id, stratum_key FROM (SELECT *, row_number() OVER (PARTITION BY stratum_key ORDER BY md5('audit:' || line_no), line_no) AS rn FROM g WHERE stratum_key IS NOT NULL) WHERE rn <= 20""",
    "q52_best_so_far": f"""WITH {Q.SERIES}, a AS (SELECT *, coalesce(value < min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, min(value) OVER (PARTITION BY run ORDER BY step) AS best FROM series),
        b AS (SELECT *, sum(improved::INTEGER) OVER (PARTITION BY run ORDER BY step) AS block FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY run, block ORDER BY step) - 1 AS since FROM b) SELECT run, step, value, best, improved, since, since >= 10 AS stop FROM c""",
    "q53_trend": f"""WITH {Q.SERIES}, a AS (SELECT run, step, value, min(value) OVER (PARTITION BY run ORDER BY step) AS best, first_value(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM series WHERE value IS NOT NULL),
        b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS n FROM a), c AS (SELECT *, max(CASE WHEN value <= best THEN n END) OVER (PARTITION BY run ORDER BY step) AS best_n FROM b)
        SELECT run, step, CASE WHEN n < 2 THEN 'not enough data' WHEN value <= best THEN 'improving' WHEN value <= f THEN 'plateaued' ELSE 'regressed' END AS trend, n - best_n AS since FROM c""",
    "q54_run_ranking": f"""WITH {Q.SERIES}, r AS (SELECT run, min(value) FILTER (tag = 'click') AS wer, min(value) FILTER (tag = 'view') AS loss FROM series GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY wer NULLS LAST, loss NULLS LAST, run) AS place FROM r)
        SELECT run, wer, loss, place, place = 1 AND wer IS NOT NULL AS winner FROM p""",
    "q55_prediction_filter": f"WITH {Q.PRED} SELECT pred_id, run, input_overlap_pct FROM pred WHERE input_overlap_pct < 95 AND eval_slice <> 'typo' AND contains(output, 'سلام')",
    "q56_compare_runs": f"""WITH {Q.PRED}, m AS (SELECT run, eval_slice AS metric, round(avg(input_overlap_pct), 6) AS value FROM pred GROUP BY 1, 2)
        SELECT coalesce(x.metric, y.metric) AS metric, x.value AS a, y.value AS b, y.value - x.value AS change FROM (SELECT * FROM m WHERE run = 'edit-b') x FULL JOIN (SELECT * FROM m WHERE run = 'edit-c') y ON x.metric = y.metric""",
    "q56b_series_summary": f"WITH {Q.SERIES} SELECT run, tag, count(*) AS n, arg_max(value, step) AS last, min(value) AS least, max(value) AS most FROM series GROUP BY 1, 2",
    "q61_weighted_loss": f"""WITH {Q.SERIES}, w AS (SELECT run, value, CASE WHEN tag = 'error' THEN 0.0 WHEN tag = 'click' THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM series) SELECT run, round(sum(value * w) / greatest(sum(w), 1e-8), 6) AS loss FROM w GROUP BY 1""",
    "q67_judge_stats": f"SELECT model, count(*) AS lines, count(DISTINCT id) AS items, count(*) FILTER (({Q.PARSED}) IS NULL) AS failed, count(error) AS errors, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd FROM judge_items GROUP BY 1",
    "q69_pending": f"WITH {Q.ANSWERS} SELECT DISTINCT id FROM judge_items WHERE id NOT IN (SELECT id FROM ans WHERE model = '{MAIN}')",
}
