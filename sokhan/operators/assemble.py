"""From segments, tokens and call records to transcripts and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sokhan.functions import text as T


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest(df: DataFrame, key: str, when: str, *ties: str) -> DataFrame:
    """The last delivered row of each key; equal times are settled by a hash of ``ties``, made before the shuffle, so that long texts travel only where they are asked for."""
    return keep_one(df.withColumn("_t", F.md5(F.concat_ws("\x1f", *ties))), [key], [F.desc(when), F.asc("_t")]).drop("_t")


def usable(segments: DataFrame) -> DataFrame:
    """Segments with a hypothesis that aren't unpaired; a null bucket is usable."""
    return segments.filter(~F.col("bucket_name").eqNullSafe("unpaired") & (F.coalesce("text_whisper", F.lit("")) != ""))


def route(calls: Column, seed: int, ratio: float) -> Column:
    """True for calls whose segments are assembled into transcripts, False for those kept as chunks."""
    return T.hash_fraction(F.concat(F.lit(f"{seed}:"), calls)) < F.lit(ratio)


def exact_mean(value: Column) -> Column:
    """Mean to 4 decimals over millionths as whole numbers, so it doesn't depend on the order in which tasks add; null if all are."""
    whole = F.sum(F.floor(value * 1e6 + 0.5))
    return F.floor(whole / F.count(value) / 1e6 * 1e4 + 0.5) / 1e4


def assemble_channels(segments: DataFrame) -> DataFrame:
    """One transcript per (call_id, channel): texts in order of start, then id, joined by spaces, with unweighted means of the segments' scores.

    The transcript is one row by its nature, so a call's channel must fit into one; only its own texts are gathered, and the scores are combined before the shuffle.
    """
    turn = F.struct("start_sec", "id", "text_whisper", "text_raw", "text")
    g = segments.groupBy("call_id", "channel").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.count("*").alias("n_turns"),
        exact_mean(F.col("conf_mean")).alias("conf_mean"),
        F.min("conf_min").alias("conf_min"),
        exact_mean(F.col("wer_whisper")).alias("wer_whisper"),
    )
    joined = lambda c: F.array_join(F.transform("turns", lambda t: F.coalesce(t[c], F.lit(""))), " ")
    return g.select("call_id", "channel", "n_turns", joined("text_whisper").alias("text_whisper"), joined("text_raw").alias("text_soniox"), joined("text").alias("text"), "conf_mean", "conf_min", "wer_whisper")


def word_metrics(df: DataFrame, a: str = "text_whisper", b: str = "text_raw") -> DataFrame:
    """``word_diff_pct`` and ``overlap_pct`` of ``a`` against ``b``, 2 decimals, half to even; both 0 for an ``a`` without words."""
    x, y = F.col("_x"), F.col("_y")
    with_words = df.withColumns({"_x": T.words(F.coalesce(F.col(a), F.lit(""))), "_y": T.words(F.coalesce(F.col(b), F.lit("")))})
    pct = lambda n: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.bround(n / F.size(x) * 100, 2))
    return with_words.withColumns({"word_diff_pct": pct(F.abs(F.size(x) - F.size(y))), "overlap_pct": pct(T.shared_words(x, y))}).drop("_x", "_y")


def token_stream(segments: DataFrame) -> DataFrame:
    """(call_id, channel, pos, token, conf): the sub-word tokens of usable segments, two per word of two letters or more, a blank before a word's first.

    Stands in for a recognizer's token files; a confidence is a hash, so it is the same in every engine.
    """
    w = segments.select("call_id", "channel", "start_sec", "id", F.posexplode(T.words(F.col("text_whisper"))).alias("i", "w"))
    half = F.greatest(F.lit(1), F.floor(F.length("w") / 2)).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.concat(F.lit(" "), F.substring("w", F.lit(1), half)).alias("t")), F.struct(F.lit(1).alias("k"), F.substring("w", half + 1, F.length("w")).alias("t")))
    p = w.select("call_id", "channel", "start_sec", "id", "i", F.explode(parts).alias("p")).filter("p.t != ''")
    conf = T.hash_fraction(F.concat_ws(":", F.lit("conf"), "id", "i", "p.k"))
    return p.select("call_id", "channel", F.struct("start_sec", "id", "i", "p.k").alias("pos"), F.col("p.t").alias("token"), conf.alias("conf"))


def word_confidence(tokens: DataFrame, threshold: float) -> DataFrame:
    """(call_id, channel, word, conf): words below the threshold; the last one counts where a word occurs again.

    A token with a leading blank opens a word, a word's confidence is the least of its tokens', punctuation at the ends is dropped.
    """
    # a segment opens a word, so words are numbered inside their segment, however long the call is
    keys = ["call_id", "channel", "start_sec", "id"]
    t = tokens.select("call_id", "channel", "pos.start_sec", "pos.id", "pos", "token", "conf")
    no = t.withColumn("word_no", F.sum(F.startswith("token", F.lit(" ")).cast("int")).over(Window.partitionBy(*keys).orderBy("pos")))
    word = no.groupBy(*keys, "word_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "").alias("w"), F.min("conf").alias("conf"))
    clean = word.withColumn("word", F.trim(F.trim("w"), F.lit(".,،؟!")))
    low = clean.filter((F.col("word") != "") & (F.col("conf") < threshold))
    return low.groupBy("call_id", "channel", "word").agg(F.max_by(F.round("conf", 4), F.struct("start_sec", "id", "word_no")).alias("conf"))


def lowest_confidence(confidences: DataFrame, k: int) -> DataFrame:
    """The ``k`` words of (call_id, channel, word, conf) with the least confidence (a top-k report)."""
    return confidences.orderBy("conf", "call_id", "channel", "word").limit(k)


def with_confidences(rows: DataFrame, confidences: DataFrame) -> DataFrame:
    """``rows`` (call_id, channel) with ``confidence``, a map from word to confidence, empty where there are none."""
    per = confidences.groupBy("call_id", "channel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "conf")))).alias("_c"))
    return rows.join(per, ["call_id", "channel"], "left").withColumn("confidence", F.coalesce("_c", F.create_map().cast("map<string,double>"))).drop("_c")


def call_records(calls: DataFrame) -> DataFrame:
    """(call_id, crm): readable records as they are, null for unreadable, filler and probe ones; the last delivered row of a call counts."""
    j = F.col("client_metadata_json")
    unreal = F.get_json_object(j, "$.filler").isNotNull() | F.coalesce(F.get_json_object(j, "$.call.request_id") == "probe-0000", F.lit(False))
    return latest(calls, "id", "synced_at", "client_metadata_json").select(F.col("id").alias("call_id"), F.when(F.try_parse_json(j).isNotNull() & ~unreal, j).alias("crm"))


def expected_counts(calls: DataFrame) -> DataFrame:
    """(call_id, channel, expected): segment counts by channel, null counts as 0."""
    last = latest(calls, "id", "synced_at", "client_metadata_json")
    return last.select(F.col("id").alias("call_id"), F.posexplode(F.array(F.coalesce("n_seg_c0", F.lit(0)), F.coalesce("n_seg_c1", F.lit(0)))).alias("channel", "expected"))


def name_words(crm: Column, least: int = 3) -> Column:
    """Distinct words of at least ``least`` letters of the customer's name and of the owner's, whose role in parentheses is removed."""
    name = lambda p: F.coalesce(F.get_json_object(crm, p), F.lit(""))
    both = F.concat(T.words(name("$.customer.name")), T.words(F.regexp_replace(name("$.crm.owner_name"), r"\(.*?\)", "")))
    return F.array_sort(F.array_distinct(F.filter(both, lambda w: F.length(w) >= least)))
