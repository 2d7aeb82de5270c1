"""Queries: what is written and read back, prompts, totals, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sokhan.functions import text as T
from sokhan.materialize import scratch
from sokhan.operators import assemble as S
from sokhan.operators import curate as C
from sokhan.operators import editing as E
from sokhan.operators import judging as J
from sokhan.operators import masking as M
from sokhan.operators import predict as P
from sokhan.operators import proposing as R
from sokhan.operators import reports as K
from sokhan.plans import editing as X
from sokhan.plans import judging as G
from sokhan.plans import sql as Q
from sokhan.plans import transcripts as N
from sokhan.plans.transcripts import pred, seg, win
from sokhan.sources import files as W
from sokhan.sources.tables import table
from sokhan.streaming import digest as D


def q80_jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Answers written as JSON lines and read again, some columns only."""
    path = scratch(spark, "jsonl")
    rows = pred(spark, d).select("pred_id", "run", "input", "output", "rejected_lines")
    W.write_jsonl(rows, path)
    return W.read_jsonl(spark, path, rows.schema, ["pred_id", "run", "output"])


def q81_token_files(spark: SparkSession, d: str) -> DataFrame:
    """Words of low confidence from token files, a record per call, that a recognizer might have written."""
    path = scratch(spark, "tokens")
    t = S.token_stream(S.usable(seg(spark, d)))
    per = t.groupBy("call_id", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token", "conf"))), lambda x: F.struct(x["token"].alias("text"), x["conf"].alias("conf"))).alias("tokens"))
    calls = per.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("channel").cast("string"), F.struct("tokens")))).alias("channels"))
    calls.write.option("compression", "gzip").json(path)
    return S.word_confidence(W.read_tokens(spark, path), 0.1)


def q82_confidence_join(spark: SparkSession, d: str) -> DataFrame:
    """Channels with the number of their words of low confidence; those without tokens have an empty map."""
    use = S.usable(seg(spark, d))
    low = S.word_confidence(S.token_stream(use), 0.02)
    return S.with_confidences(use.select("call_id", "channel").distinct(), low).select("call_id", "channel", F.size("confidence").alias("low_words"))


def q82b_lowest_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The 25 words of least confidence (a top-k report)."""
    return S.lowest_confidence(S.word_confidence(S.token_stream(S.usable(seg(spark, d))), 0.1), 25)


def q83_published_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Word counts of the unique rows, published once and read from there."""
    path = scratch(spark, "published")
    rows = table(spark, d, "segments").filter("coalesce(text_whisper, '') <> '' and coalesce(text, '') <> ''")
    unique = S.keep_one(rows, ["call_id", "channel", "text_whisper"], [F.asc("ingested_at"), F.asc("id"), F.asc("text")])
    W.publish(C.word_frequency(unique, T.words(F.col("text"))), path)
    return spark.read.parquet(path)


def q84_change_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a verifier would be asked about each stored edit."""
    w = win(spark, d)
    ctx = E.contexts(w, 6)
    e = w.select("window_id", "crm_names", F.posexplode("edits").alias("k", "e")).join(ctx, ["window_id", "k"])
    return e.select("window_id", "k", P.change_prompt(F.col("e.original"), F.col("e.replacement"), F.col("left_words"), F.col("right_words"), F.col("crm_names")).alias("prompt"))


def q84b_candidate_items(spark: SparkSession, d: str) -> DataFrame:
    """Stored edits worth scoring as items for the judges, calls of the first judge's items left out."""
    e = win(spark, d).select("call_id", F.explode("edits").alias("e")).select("call_id", "e.start_word", "e.end_word", "e.original", "e.replacement").filter("call_id is not null")
    calm = G._of(G._answers(spark, d), G.MAIN).join(table(spark, d, "judge_items").select("id", "call_id").distinct(), "id").select("call_id")
    kept = R.candidate_rows(e).join(calm, "call_id", "left_anti")
    return kept.select(P.as_item(F.col("call_id"), F.col("start_word"), F.col("end_word"), F.col("original"), F.col("replacement")).alias("i")).select("i.*").distinct()


def q84c_spacing_only(spark: SparkSession, d: str) -> DataFrame:
    """Words of the references parted where a half-space was: edits that change spacing only."""
    p = pred(spark, d).select("pred_id", F.posexplode(T.words(F.coalesce("reference", F.lit("")))).alias("k", "replacement"))
    return R.spacing_only(p.withColumn("original", F.translate("replacement", T.ZWNJ, " "))).select("pred_id", "k", "original")


def q85_token_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.token_totals(X._examples(spark, d))


def q86_no_edit_probability(spark: SparkSession, d: str) -> DataFrame:
    """Chances by hash, lower where a window has edits."""
    w = win(spark, d)
    has = F.size("edits") > 0
    p = T.hash_fraction(F.concat(F.lit("none:"), "window_id")) * F.when(has, 0.8).otherwise(1.0)
    r = K.no_edit_probability(w.select(p.alias("p_none"), F.coalesce(has, F.lit(False)).alias("has_edits")))
    return r.select(F.round("with_edits", 9).alias("with_edits"), F.round("without_edits", 9).alias("without_edits"), "auc")


def q86b_judge_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far the log of verdicts has got, if 5,000 lines are to come."""
    r = D.progress(table(spark, d, "judge_items"), 5_000, "judged_at", "cost_usd")
    return r.select("done", "total", "share", F.round("cost", 6).alias("cost"), "seconds", F.round("eta_seconds", 3).alias("eta_seconds"), F.round("projected_cost", 6).alias("projected_cost"))


def q87_stream_router(spark: SparkSession, d: str) -> DataFrame:
    """The cheap judge's answers as a stream: which items go on to the main judge."""
    where = scratch(spark, "router")
    a = G._of(G._answers(spark, d), G.CHEAP).select("id", "label")
    a.write.parquet(f"{where}/in")
    D.route_answers(spark.readStream.schema("id string, label string").parquet(f"{where}/in"), table(spark, d, "judge_items"), J.REJECTS, f"{where}/out", f"{where}/state")
    return D.read_latest(spark, f"{where}/out").select("id")


def q88_tags(spark: SparkSession, d: str) -> DataFrame:
    return K.tags_of(G._series(spark, d)).select("run", F.array_join("tags", ",").alias("tags"))


def q88b_series(spark: SparkSession, d: str) -> DataFrame:
    return K.series_of(G._series(spark, d), 7, "click")


def q89_describe_words(spark: SparkSession, d: str) -> DataFrame:
    """Words per usable segment: count, mean and range."""
    return K.describe(S.usable(seg(spark, d)), F.size(T.words(F.col("text_whisper")))).select("n", F.round("mean", 6).alias("mean"), "least", "most")


def q89b_strip_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return pred(spark, d).select("pred_id", T.strip_punctuation(F.coalesce("output", F.lit(""))).alias("plain"))


def q89c_pools(spark: SparkSession, d: str) -> DataFrame:
    """Rows of three pools, counted."""
    p = C.pooled({"calls": table(spark, d, "call_meta").select(F.col("id").alias("call_id")), "windows": win(spark, d).select("call_id", "window_id"), "answers": pred(spark, d).select("call_id")}, ["call_id", "window_id"])
    return p.groupBy("pool").agg(F.count("*").alias("n"), F.count("window_id").alias("windows"))


def q89d_predictions_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Windows that an answer's input repeats word for word, with the last answer to it."""
    old = table(spark, d, "predictions").filter("input is not null").select(F.col("input").alias("prompt"), F.col("pred_id").alias("output"), F.struct("created_at", "pred_id").alias("at"))
    w = win(spark, d).select("window_id", F.col("source").alias("text")).filter("text is not null")
    return P.from_table(w, old, "text", "at").filter("output is not null").select("window_id", F.col("output").alias("pred_id"))


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q8") and callable(f)}

_LOW = f"WITH {Q.SEG}, {Q.USABLE}, {N._TOKENS}, {N._CONF}, low AS (SELECT call_id, channel, word, arg_max(round(conf, 4), no) AS conf FROM word WHERE word <> '' AND conf < MOST GROUP BY 1, 2, 3)"
SQL = {
    "q80_jsonl_roundtrip": f"WITH {Q.PRED} SELECT pred_id, run, output FROM pred",
    "q81_token_files": f"{_LOW.replace('MOST', '0.1')} SELECT * FROM low",
    "q82_confidence_join": f"{_LOW.replace('MOST', '0.02')} SELECT u.call_id, u.channel, count(low.word) AS low_words FROM (SELECT DISTINCT call_id, channel FROM use) u LEFT JOIN low ON u.call_id = low.call_id AND u.channel = low.channel GROUP BY 1, 2",
    "q82b_lowest_confidence": f"{_LOW.replace('MOST', '0.1')} SELECT * FROM low ORDER BY conf, call_id, channel, word LIMIT 25",
    "q83_published_frequency": f"""WITH u AS (SELECT text FROM (SELECT *, row_number() OVER (PARTITION BY call_id, channel, text_whisper ORDER BY ingested_at, id, text) AS rn FROM segments WHERE coalesce(text_whisper, '') <> '' AND coalesce(text, '') <> '') WHERE rn = 1)
        SELECT word, count(*) AS freq FROM (SELECT unnest({Q.words('text')}) AS word FROM u) GROUP BY 1""",
    "q84_change_prompts": f"""WITH {Q.WIN}, e AS (SELECT window_id, crm_names, {Q.words('source')} AS ws, unnest(edits) AS e, generate_subscripts(edits, 1) - 1 AS k FROM win)
        SELECT window_id, k, CASE WHEN len(crm_names) > 0 THEN 'Known names: ' || array_to_string(crm_names, '، ') || chr(10) ELSE '' END || 'Context: ' || array_to_string(ws[greatest(e.start_word - 6, 0) + 1 : e.start_word], ' ') || ' ⟦' || coalesce(nullif(e.original, ''), '∅') || '⟧ '
        || array_to_string(ws[e.end_word + 1 : e.end_word + 6], ' ') || chr(10) || 'Proposed change: ⟦' || coalesce(nullif(e.original, ''), '∅') || '⟧ → ⟦' || e.replacement || '⟧' AS prompt FROM e""",
    "q84c_spacing_only": f"""WITH {Q.PRED}, w AS (SELECT pred_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS k FROM (SELECT pred_id, {Q.words("coalesce(reference, '')")} AS ws FROM pred))
        SELECT pred_id, k, replace(w, '{T.ZWNJ}', ' ') AS original FROM w WHERE contains(w, '{T.ZWNJ}') AND len({Q.words(f"replace(w, '{T.ZWNJ}', ' ')")}) BETWEEN 1 AND 4 AND array_to_string({Q.words(f"replace(w, '{T.ZWNJ}', ' ')")}, ' ') <> w""",
    "q85_token_totals": f"""WITH {Q.WIN}, n AS (SELECT {X._LEN("coalesce(source, '')")} AS p, {X._LEN("coalesce(target_text, '')")} AS t, len(edits) > 0 AS m FROM win)
        SELECT CASE WHEN p + t + 1 <= 512 THEN 'ok' WHEN p < 512 THEN 'truncated' ELSE 'dropped' END AS status, count(*) AS examples, sum(least(p + t + 1, 512))::BIGINT AS tokens,
        sum(CASE WHEN p >= 512 THEN 512 ELSE p + CASE WHEN m AND t > 0 THEN 1 ELSE 0 END END)::BIGINT AS ignored_tokens, 0 AS weighted_tokens, 0 AS weighted_examples FROM n GROUP BY 1""",
    "q86_no_edit_probability": f"""WITH {Q.WIN}, x AS (SELECT coalesce(len(edits) > 0, false) AS h, {Q.fraction("'none:' || window_id")} * CASE WHEN coalesce(len(edits) > 0, false) THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS p FROM win),
        b AS (SELECT h, p, sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM x)
        SELECT round(sum(CASE WHEN h THEN p ELSE 0 END) / greatest(count(*) FILTER (h), 1), 9) AS with_edits, round(sum(CASE WHEN h THEN 0 ELSE p END) / greatest(count(*) FILTER (NOT h), 1), 9) AS without_edits,
        sum(CASE WHEN h THEN coalesce(above, 0) ELSE 0 END)::DOUBLE / ((count(*) FILTER (h))::DOUBLE * (count(*) FILTER (NOT h))) AS auc FROM b""",
    "q86b_judge_progress": """WITH g AS (SELECT count(*) AS done, coalesce(sum(cost_usd), 0) AS c, (epoch_us(max(judged_at)) - epoch_us(min(judged_at))) / 1e6::DOUBLE AS s FROM judge_items)
        SELECT done, 5000 AS total, done / 5000.0::DOUBLE AS share, round(c, 6) AS cost, s AS seconds, CASE WHEN done > 1 THEN round(s / (done - 1) * greatest(5000 - done, 0), 3) END AS eta_seconds, CASE WHEN done > 1 THEN round(c + c / done * greatest(5000 - done, 0), 6) END AS projected_cost FROM g""",
    "q87_stream_router": f"WITH {Q.ANSWERS} SELECT DISTINCT id FROM ans WHERE model = '{G.CHEAP}' AND label NOT IN ({Q.quoted(J.REJECTS)})",
    "q88_tags": f"WITH {Q.SERIES} SELECT run, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM series GROUP BY 1",
    "q88b_series": f"WITH {Q.SERIES} SELECT step, value FROM series WHERE run = 7 AND tag = 'click'",
    "q89_describe_words": f"WITH {Q.SEG}, {Q.USABLE}, w AS (SELECT len({Q.words('text_whisper')}) AS n FROM use) SELECT count(n) AS n, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM w",
    "q89b_strip_punctuation": f"WITH {Q.PRED} SELECT pred_id, array_to_string({Q.words(f"translate(coalesce(output, ''), '{T.PUNCTUATION}', '')")}, ' ') AS plain FROM pred",
    "q89c_pools": f"WITH {Q.WIN}, {Q.PRED} SELECT 'calls' AS pool, count(*) AS n, 0 AS windows FROM call_meta UNION ALL SELECT 'windows', count(*), count(window_id) FROM win UNION ALL SELECT 'answers', count(*), 0 FROM pred",
    "q89d_predictions_by_text": f"WITH {Q.WIN}, l AS (SELECT input, arg_max(pred_id, (created_at, pred_id)) AS pred_id FROM predictions WHERE input IS NOT NULL AND created_at IS NOT NULL GROUP BY 1) SELECT window_id, l.pred_id FROM win JOIN l ON win.source = l.input",
}
