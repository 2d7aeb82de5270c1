"""Gates and resampling. Random draws follow hashes of keys, so sizes, ratios, caps and rows are the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sokhan.operators.ranking import hash_rank


def quality_gates(df: DataFrame, most_wer: float = 1.0, least_overlap: float = 30.0) -> DataFrame:
    """``df`` with ``gate``: wer, overlap or kept; nulls fail, and a row counts at the first gate it fails."""
    return df.withColumn("gate", F.when(~F.coalesce(F.col("wer_whisper") <= most_wer, F.lit(False)), F.lit("wer")).when(~F.coalesce(F.col("overlap_pct") >= least_overlap, F.lit(False)), F.lit("overlap")).otherwise("kept"))


def resample(df: DataFrame, keys: list[str], n: int, target: int, seed: str) -> DataFrame:
    """Exactly ``target`` rows with a ``copy`` number: fewer than ``n`` without repeats, else all plus draws with repeats."""
    ranked = hash_rank(df, seed, keys)
    if target <= n or n == 0:
        return ranked.filter(F.col("rank") <= target).withColumn("copy", F.lit(1)).drop("rank")
    draws = df.sparkSession.range(target - n).select(F.col("id").alias("_i"), (F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n)) + 1).alias("rank"))
    times = draws.groupBy("rank").agg(F.count("*").alias("_extra"))
    return ranked.join(times, "rank", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), (F.coalesce("_extra", F.lit(0)) + 1).cast("int")))).drop("rank", "_extra")


def capped_resample(df: DataFrame, keys: list[str], n: int, target: int, most: int, seed: str) -> DataFrame:
    """min(target, n * most) rows: whole cycles over all rows and a part of one, so copies differ by one at most."""
    target = min(target, n * most)
    ranked = hash_rank(df, seed, keys)
    if target <= n or n == 0:
        return ranked.filter(F.col("rank") <= target).withColumn("copy", F.lit(1)).drop("rank")
    extra = target - n
    copies = F.lit(1 + extra // n) + F.when(F.col("rank") <= extra % n, 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("rank")


def ratio_targets(n_a: int, n_b: int, share: float) -> tuple[int, int]:
    """How many rows of both sides stay so that ``a`` has ``share`` of all, taking away only."""
    if not n_a or not n_b:
        return n_a, n_b
    if share <= 0:
        return 0, n_b
    if share >= 1:
        return n_a, 0
    a = round(share / (1 - share) * n_b)
    return (a, n_b) if a <= n_a else (n_a, min(round((1 - share) / share * n_a), n_b))


#: Words so common that they are told from a table of this size, which is sent to the tasks.
HOT = 10_000


def row_rare_words(rows: DataFrame, key: str, words: Column, freq: DataFrame, common: int) -> DataFrame:
    """``rows`` with ``rare``, an array of those of the row's ``words`` that ``freq`` (word, freq) has no more than ``common`` times or not at all; keys are unique.

    The most frequent words, ``HOT`` of them, are set aside in the tasks, and only words that are rare at all are joined, so no hot word is shuffled row by row.
    """
    usual = freq.filter(F.col("freq") > common).select("word", "freq")
    hot = usual.orderBy(F.desc("freq"), "word").limit(HOT).select("word")
    said = rows.select(key, F.explode(F.array_distinct(words)).alias("word")).join(F.broadcast(hot), "word", "left_anti")
    rare = said.select("word").distinct().join(usual.select("word"), "word", "left_anti")
    per = said.join(rare, "word").groupBy(key).agg(F.collect_list("word").alias("rare"))
    return rows.join(per, key, "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))


def word_frequency(df: DataFrame, words: Column) -> DataFrame:
    """(word, freq) over all rows; counts are combined before the shuffle."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def train_fraction(df: DataFrame, keys: list[str], n: int, fraction: float, seed: str) -> DataFrame:
    """round(n * fraction) of the ``n`` rows, half to even, in hash order; all of them for a fraction of 1 or more."""
    return df if fraction >= 1 else hash_rank(df, seed, keys).filter(F.col("rank") <= round(n * fraction)).drop("rank")


def held_out(df: DataFrame, keys: list[str], n: int, fraction: float, seed: str) -> DataFrame:
    """``df`` with ``split``: the first ceil(n * fraction) of its ``n`` rows in hash order are validation, the others train."""
    most = -int(-n * fraction // 1)
    return hash_rank(df, seed, keys).withColumn("split", F.when(F.col("rank") <= most, F.lit("validation")).otherwise("train")).drop("rank")


def split_calls(df: DataFrame, call: str, fraction: float, seed: str) -> DataFrame:
    """``df`` with ``split``: round(calls * fraction) calls, half to even, in hash order are validation with all their rows; rows without a call are train."""
    calls = df.select(call).filter(F.col(call).isNotNull()).distinct()
    ranked = hash_rank(calls, seed, [call]).crossJoin(F.broadcast(calls.agg(F.count("*").alias("_all"))))
    drawn = ranked.select(F.col(call).alias("_call"), (F.col("rank") <= F.bround(F.col("_all") * fraction, 0)).alias("_out"))
    joined = df.join(drawn, F.col(call) == F.col("_call"), "left")
    return joined.withColumn("split", F.when(F.col("_out"), F.lit("validation")).otherwise("train")).drop("_call", "_out")


def shuffled(df: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """``df`` with ``position``, 1 to n, in hash order: a full shuffle that is the same on every run."""
    return hash_rank(df, seed, keys, name="position")


def head_in_order(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order that the caller fixes (a head limit; unlike a bare one it gives the same rows on every run)."""
    return df.orderBy(*order).limit(n)


def usable_pairs(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows with both texts, which is asked before any head limit."""
    return df.filter((F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != ""))


def pooled(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """All rows of several pools with the name of their ``pool``; columns that a pool lacks are null."""
    out = None
    for name, df in parts.items():
        one = df.select(*(c for c in columns if c in df.columns), F.lit(name).alias("pool"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
