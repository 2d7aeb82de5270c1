"""Queries: segments to transcripts, gates, balance, vocabularies, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sokhan.functions import text as T
from sokhan.operators import assemble as S
from sokhan.operators import curate as C
from sokhan.operators import editing as E
from sokhan.plans import sql as Q
from sokhan.sources.tables import table

SEED, RATIO = 42, 0.5


def seg(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "segments"), "id", "ingested_at", "text_whisper", "text_raw", "text")


def win(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "train"), "window_id", "built_at", "source")


def pred(spark: SparkSession, d: str) -> DataFrame:
    return S.latest(table(spark, d, "predictions"), "pred_id", "created_at", "output")


def q01_segment_usable_route(spark: SparkSession, d: str) -> DataFrame:
    return S.usable(seg(spark, d)).select("id", S.route(F.col("call_id"), SEED, RATIO).alias("assembled"))


def q02_assemble_channel(spark: SparkSession, d: str) -> DataFrame:
    return S.assemble_channels(S.usable(seg(spark, d)).filter(S.route(F.col("call_id"), SEED, RATIO)))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.word_metrics(S.usable(seg(spark, d)).filter(~S.route(F.col("call_id"), SEED, RATIO)))


def q03_chunked_rows(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("id", "call_id", "channel", "word_diff_pct", "overlap_pct", "bucket_name")


def q04_word_confidence(spark: SparkSession, d: str) -> DataFrame:
    return S.word_confidence(S.token_stream(S.usable(seg(spark, d))), 0.1)


def q05_call_meta_join(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "call_meta")
    n = seg(spark, d).groupBy("call_id", "channel").agg(F.count("*").alias("n"))
    counted = n.join(S.expected_counts(calls), ["call_id", "channel"], "left").join(S.call_records(calls), "call_id", "left")
    return counted.select("call_id", "channel", "n", "expected", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("matches"), F.get_json_object("crm", "$.call.queue").alias("queue"), F.array_join(S.name_words(F.col("crm")), " ").alias("names"))


def q06_quality_gates(spark: SparkSession, d: str) -> DataFrame:
    return C.quality_gates(_chunks(spark, d)).groupBy("gate").agg(F.count("*").alias("n"))


def q07_ratio_balance(spark: SparkSession, d: str) -> DataFrame:
    """Agreeing segments taken down to 30 % of the rows of the gate, by hash order."""
    rows = C.quality_gates(_chunks(spark, d)).filter("gate = 'kept'").select("id", F.col("bucket_name").eqNullSafe("agree").alias("agree"))
    counts = rows.agg(F.count_if("agree").alias("a"), F.count_if(~F.col("agree")).alias("b")).first()
    a, b = C.ratio_targets(counts.a, counts.b, 0.3)
    ranked = C.hash_rank(rows, "balance", ["id"], ["agree"])
    return ranked.filter((F.col("agree") & (F.col("rank") <= a)) | (~F.col("agree") & (F.col("rank") <= b))).select("id", "agree")


def q08_entity_flag(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose text has a word of their call's names, or a rare word of low confidence."""
    use = S.usable(seg(spark, d))
    freq = C.word_frequency(use, T.words(F.col("text")))
    names = S.call_records(table(spark, d, "call_meta")).select("call_id", S.name_words(F.col("crm")).alias("names"))
    ws = use.select("id", "call_id", "channel", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    low = S.word_confidence(S.token_stream(use), 0.45).filter(F.length("word") >= 3).join(freq.filter("freq <= 3"), "word").select("call_id", "channel", "word").withColumn("rare", F.lit(True))
    named = names.select("call_id", F.explode("names").alias("word")).withColumn("named", F.lit(True))
    hit = ws.join(named, ["call_id", "word"], "left").join(low, ["call_id", "channel", "word"], "left")
    return hit.groupBy("id").agg(F.count("named").alias("name_words"), F.count("rare").alias("rare_words")).filter("name_words > 0 or rare_words > 0")


def q09_capped_resample(spark: SparkSession, d: str) -> DataFrame:
    """Calls' informative segments repeated to 2.5 times their number, thrice at most."""
    rows = S.usable(seg(spark, d)).filter("bucket_name = 'informative'").select("id")
    n = rows.count()
    return C.capped_resample(rows, ["id"], n, n * 5 // 2, 3, "oversample").groupBy("id").agg(F.count("*").alias("copies"))


def q09b_exact_resample(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 1.2 times as many rows: all, and draws with repeats."""
    rows = S.usable(seg(spark, d)).filter("bucket_name = 'agree'").select("id")
    n = rows.count()
    return C.resample(rows, ["id"], n, n * 6 // 5, "draw").groupBy("id").agg(F.count("*").alias("copies"))


def q10_word_frequency(spark: SparkSession, d: str) -> DataFrame:
    return C.word_frequency(table(spark, d, "documents"), T.words(F.col("text")))


def q10b_top_words(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent words (a top-k report)."""
    return q10_word_frequency(spark, d).orderBy(F.desc("freq"), "word").limit(20)


def q24_unstutter(spark: SparkSession, d: str) -> DataFrame:
    return E.unstutter_table(C.word_frequency(seg(spark, d), T.words(F.col("text_whisper"))), 2, 20)


def q25_glue_split(spark: SparkSession, d: str) -> DataFrame:
    return E.glue_table(C.word_frequency(seg(spark, d), T.words(F.col("text_whisper"))), 2, 20)


def q31_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The first segment of each call, channel and hypothesis, both texts not empty."""
    rows = table(spark, d, "segments").filter("coalesce(text_whisper, '') <> '' and coalesce(text, '') <> ''")
    return S.keep_one(rows, ["call_id", "channel", "text_whisper"], [F.asc("ingested_at"), F.asc("id"), F.asc("text")]).select("id", "call_id", "channel")


def q32_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return win(spark, d).select("window_id", "built_at", "split")


def q33_antijoin_calls(spark: SparkSession, d: str) -> DataFrame:
    """Segments of calls without training windows."""
    return seg(spark, d).join(table(spark, d, "train").select("call_id"), "call_id", "left_anti").groupBy("call_id").agg(F.count("*").alias("n"))


def q57_composition(spark: SparkSession, d: str) -> DataFrame:
    use = S.usable(seg(spark, d))
    return use.groupBy(F.coalesce("bucket_name", F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("call_id").alias("calls"), F.round(F.avg("duration"), 3).alias("mean_duration"), F.count_if(S.route(F.col("call_id"), SEED, RATIO)).alias("assembled"))


def q57b_histogram(spark: SparkSession, d: str) -> DataFrame:
    from sokhan.operators.reports import histogram

    return histogram(S.usable(seg(spark, d)), F.size(T.words(F.col("text_whisper"))).cast("double"), 0.0, 200.0, 40)


QUERIES = {f.__name__: f for f in (q01_segment_usable_route, q02_assemble_channel, q03_chunked_rows, q04_word_confidence, q05_call_meta_join, q06_quality_gates, q07_ratio_balance, q08_entity_flag, q09_capped_resample, q09b_exact_resample, q10_word_frequency, q10b_top_words, q24_unstutter, q25_glue_split, q31_dedupe_first, q32_dedupe_last, q33_antijoin_calls, q57_composition, q57b_histogram)}

_MEAN = "floor(sum(CAST(floor({c} * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT))::DOUBLE / count({c}) / 1e6::DOUBLE * 1e4::DOUBLE + 0.5::DOUBLE) / 1e4::DOUBLE"
_ROUTE = f"{Q.fraction(f"'{SEED}:' || call_id")} < {RATIO}"
_CHUNK = f"""chunk AS (SELECT id, call_id, channel, bucket_name, wer_whisper, CASE WHEN len(x) = 0 THEN 0.0 ELSE round_even(abs(len(x) - len(y)) / len(x) * 100, 2) END AS word_diff_pct,
    CASE WHEN len(x) = 0 THEN 0.0 ELSE round_even(coalesce({Q.SHARED}, 0) / len(x) * 100, 2) END AS overlap_pct
  FROM (SELECT *, {Q.words("coalesce(text_whisper, '')")} AS x, {Q.words("coalesce(text_raw, '')")} AS y FROM use WHERE NOT ({_ROUTE})))"""
_GATE = "CASE WHEN NOT coalesce(wer_whisper <= 1, false) THEN 'wer' WHEN NOT coalesce(overlap_pct >= 30, false) THEN 'overlap' ELSE 'kept' END"
_TOKENS = f"""tok AS (SELECT call_id, channel, start_sec, id, i, k, t, {Q.fraction("'conf:' || id || ':' || i || ':' || k")} AS conf FROM (
    SELECT call_id, channel, start_sec, id, i, unnest([0, 1]) AS k, unnest([' ' || substr(w, 1, greatest(1, length(w) // 2)), substr(w, greatest(1, length(w) // 2) + 1)]) AS t
    FROM (SELECT call_id, channel, start_sec, id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT *, {Q.words("text_whisper")} AS ws FROM use))) WHERE t <> '')"""
_CONF = """word AS (SELECT call_id, channel, no, trim(trim(string_agg(t, '' ORDER BY start_sec, id, i, k)), '.,،؟!') AS word, min(conf) AS conf
    FROM (SELECT *, sum(CASE WHEN starts_with(t, ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY call_id, channel ORDER BY start_sec, id, i, k ROWS UNBOUNDED PRECEDING) AS no FROM tok) GROUP BY 1, 2, 3)"""
_FREQ = f"freq AS (SELECT word, count(*) AS freq FROM (SELECT unnest({Q.words('text_whisper')}) AS word FROM seg) GROUP BY 1)"
_HASH = "md5('{}:' || id)"
_READ = "json_valid(client_metadata_json) AND json_extract(client_metadata_json, '$.filler') IS NULL AND coalesce(json_extract_string(client_metadata_json, '$.call.request_id') <> 'probe-0000', true)"
_CRM = f"crm AS (SELECT id AS call_id, CASE WHEN client_metadata_json IS NOT NULL AND {_READ} THEN client_metadata_json END AS crm FROM calls)"
_NAME = lambda p: f"regexp_replace(coalesce(json_extract_string(crm, '{p}'), ''), '\\(.*?\\)', '', 'g')"
_NAMES = f"list_sort(list_distinct(list_filter(list_concat({Q.words("coalesce(json_extract_string(crm, '$.customer.name'), '')")}, {Q.words(_NAME('$.crm.owner_name'))}), lambda w: length(w) >= 3)))"

SQL = {
    "q01_segment_usable_route": f"WITH {Q.SEG}, {Q.USABLE} SELECT id, {_ROUTE} AS assembled FROM use",
    "q02_assemble_channel": f"""WITH {Q.SEG}, {Q.USABLE} SELECT call_id, channel, count(*) AS n_turns, string_agg(coalesce(text_whisper, ''), ' ' ORDER BY start_sec, id) AS text_whisper,
        string_agg(coalesce(text_raw, ''), ' ' ORDER BY start_sec, id) AS text_soniox, string_agg(coalesce(text, ''), ' ' ORDER BY start_sec, id) AS text,
        {_MEAN.format(c="conf_mean")} AS conf_mean, min(conf_min) AS conf_min, {_MEAN.format(c="wer_whisper")} AS wer_whisper FROM use WHERE {_ROUTE} GROUP BY 1, 2""",
    "q03_chunked_rows": f"WITH {Q.SEG}, {Q.USABLE}, {_CHUNK} SELECT id, call_id, channel, word_diff_pct, overlap_pct, bucket_name FROM chunk",
    "q04_word_confidence": f"WITH {Q.SEG}, {Q.USABLE}, {_TOKENS}, {_CONF} SELECT call_id, channel, word, arg_max(round(conf, 4), no) AS conf FROM word WHERE word <> '' AND conf < 0.1 GROUP BY 1, 2, 3",
    "q05_call_meta_join": f"""WITH {Q.SEG}, {Q.CALLS}, {_CRM}, n AS (SELECT call_id, channel, count(*) AS n FROM seg GROUP BY 1, 2),
        x AS (SELECT id AS call_id, unnest([0, 1]) AS channel, unnest([coalesce(n_seg_c0, 0), coalesce(n_seg_c1, 0)]) AS expected FROM calls)
        SELECT n.call_id, n.channel, n.n, expected, coalesce(n.n = expected, false) AS matches, json_extract_string(crm, '$.call.queue') AS queue,
        array_to_string({_NAMES}, ' ') AS names FROM n LEFT JOIN x ON n.call_id = x.call_id AND n.channel = x.channel LEFT JOIN crm ON n.call_id = crm.call_id""",
    "q06_quality_gates": f"WITH {Q.SEG}, {Q.USABLE}, {_CHUNK} SELECT {_GATE} AS gate, count(*) AS n FROM chunk GROUP BY 1",
    "q07_ratio_balance": f"""WITH {Q.SEG}, {Q.USABLE}, {_CHUNK}, r AS (SELECT id, bucket_name IS NOT DISTINCT FROM 'agree' AS agree FROM chunk WHERE {_GATE} = 'kept'),
        c AS (SELECT count(*) FILTER (agree) AS a, count(*) FILTER (NOT agree) AS b FROM r),
        t AS (SELECT a, b, round_even(0.3 / (1 - 0.3) * b, 0) AS want, round_even((1 - 0.3) / 0.3 * a, 0) AS other FROM c)
        SELECT id, agree FROM (SELECT *, row_number() OVER (PARTITION BY agree ORDER BY {_HASH.format('balance')}, id) AS rank FROM r), t
        WHERE CASE WHEN agree THEN rank <= CASE WHEN b = 0 OR want > a THEN a ELSE want END ELSE rank <= CASE WHEN a = 0 OR want <= a THEN b ELSE least(other, b) END END""",
    "q08_entity_flag": f"""WITH {Q.SEG}, {Q.USABLE}, {Q.CALLS}, {_CRM}, {_TOKENS}, {_CONF},
        f AS (SELECT word, count(*) AS freq FROM (SELECT unnest({Q.words('text')}) AS word FROM use) GROUP BY 1),
        low AS (SELECT DISTINCT word.call_id, word.channel, word.word FROM word JOIN f USING (word) WHERE conf < 0.45 AND length(word.word) >= 3 AND freq <= 3),
        nm AS (SELECT call_id, unnest({_NAMES}) AS word FROM crm), ws AS (SELECT id, call_id, channel, unnest(list_distinct({Q.words('text')})) AS word FROM use)
        SELECT ws.id, count(nm.word) AS name_words, count(low.word) AS rare_words FROM ws LEFT JOIN nm ON ws.call_id = nm.call_id AND ws.word = nm.word
        LEFT JOIN low ON ws.call_id = low.call_id AND ws.channel = low.channel AND ws.word = low.word GROUP BY 1 HAVING count(nm.word) > 0 OR count(low.word) > 0""",
    "q09_capped_resample": f"""WITH {Q.SEG}, {Q.USABLE}, r AS (SELECT id, row_number() OVER (ORDER BY {_HASH.format('oversample')}, id) AS rank, count(*) OVER () AS n FROM use WHERE bucket_name = 'informative'),
        t AS (SELECT *, least(n * 5 // 2, n * 3) - n AS extra FROM r) SELECT id, 1 + extra // n + CASE WHEN rank <= extra % n THEN 1 ELSE 0 END AS copies FROM t""",
    "q09b_exact_resample": f"""WITH {Q.SEG}, {Q.USABLE}, r AS (SELECT id, row_number() OVER (ORDER BY {_HASH.format('draw')}, id) AS rank, count(*) OVER () AS n FROM use WHERE bucket_name = 'agree'),
        d AS (SELECT CAST('0x' || substr(md5('draw:' || i), 1, 8) AS BIGINT) % n + 1 AS rank FROM (SELECT DISTINCT n, unnest(range(0, n * 6 // 5 - n)) AS i FROM r))
        SELECT id, 1 + (SELECT count(*) FROM d WHERE d.rank = r.rank) AS copies FROM r""",
    "q10_word_frequency": f"SELECT word, count(*) AS freq FROM (SELECT unnest({Q.words('text')}) AS word FROM documents) GROUP BY 1",
    "q10b_top_words": f"SELECT word, count(*) AS freq FROM (SELECT unnest({Q.words('text')}) AS word FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "q24_unstutter": f"WITH {Q.SEG}, {_FREQ} SELECT a.word, b.word AS fixed FROM freq a JOIN freq b ON b.word = substr(a.word, 2) WHERE length(a.word) >= 3 AND substr(a.word, 1, 1) = substr(a.word, 2, 1) AND a.freq <= 2 AND b.freq >= 20",
    "q25_glue_split": f"""WITH {Q.SEG}, {_FREQ}, c AS (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM freq
        WHERE length(word) >= 5 AND freq <= 2 AND NOT contains(word, '{T.ZWNJ}')))
        SELECT word, first, second FROM (SELECT c.word, c.a AS first, c.b AS second, row_number() OVER (PARTITION BY c.word ORDER BY least(fa.freq, fb.freq) DESC, i) AS rn FROM c JOIN freq fa ON fa.word = c.a JOIN freq fb ON fb.word = c.b
        WHERE fa.freq >= 20 AND fb.freq >= 20 AND c.b NOT IN ({Q.quoted(E.CLITIC_SUFFIXES)})) WHERE rn = 1""",
    "q31_dedupe_first": "SELECT id, call_id, channel FROM (SELECT *, row_number() OVER (PARTITION BY call_id, channel, text_whisper ORDER BY ingested_at, id, text) AS rn FROM segments WHERE coalesce(text_whisper, '') <> '' AND coalesce(text, '') <> '') WHERE rn = 1",
    "q32_dedupe_last": f"WITH {Q.WIN} SELECT window_id, built_at, split FROM win",
    "q33_antijoin_calls": f"WITH {Q.SEG} SELECT call_id, count(*) AS n FROM seg WHERE call_id NOT IN (SELECT call_id FROM train WHERE call_id IS NOT NULL) GROUP BY 1",
    "q57_composition": f"WITH {Q.SEG}, {Q.USABLE} SELECT coalesce(bucket_name, 'none') AS bucket, count(*) AS n, count(DISTINCT call_id) AS calls, round(avg(duration), 3) AS mean_duration, count(*) FILTER ({_ROUTE}) AS assembled FROM use GROUP BY 1",
    "q57b_histogram": f"WITH {Q.SEG}, {Q.USABLE} SELECT CAST(least(greatest(floor(len({Q.words('text_whisper')}) / 5.0), 0), 39) AS INTEGER) AS bin, count(*) AS n FROM use GROUP BY 1",
}
