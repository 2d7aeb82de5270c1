"""Threshold sweeps, AUC, bins, audits, run trends and rankings."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sokhan.materialize import materialize
from sokhan.operators.ranking import hash_order

# Lower edges of the score bins, which are uneven and half open; the last one takes in 1.
BINS = (0.0, 0.3, 0.5, 0.7, 0.8, 0.9)


def auc(scored: DataFrame, score: str = "score", positive: str = "positive", higher: bool = True) -> DataFrame:
    """One row (auc, positives, negatives): chance that a positive's score is above a negative's (below it unless ``higher``), ties half; null without both classes.

    Rows are first counted per score, then ranked over ranges of scores: each range counts for itself and starts from the sums of the ranges before it, so no task sorts all scores.
    """
    levels = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = running_sum(levels, "s", "n", higher)
    won = below.select("p", "n", (F.col("p") * (F.col("before") + F.col("n") / F.lit(2.0))).alias("w"))
    return won.agg(F.expr("try_divide(sum(w), cast(sum(p) as double) * sum(n))").alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def running_sum(rows: DataFrame, order: str, value: str, ascending: bool = True) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows before in the order of ``order`` (unique); range partitions, whose sums alone are gathered, a row each."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    way = F.asc(order) if ascending else F.desc(order)
    # cut before the ranges are numbered: sampled bounds of two runs of one plan need not be the same
    ranged = materialize(rows.repartitionByRange(parts, way).withColumn("_r", F.spark_partition_id()))
    sums = ranged.groupBy("_r").agg(F.sum(value).alias("_v"))
    upto = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("_r", F.coalesce(F.sum("_v").over(upto(Window.orderBy("_r"))), F.lit(0)).alias("_b"))
    own = F.coalesce(F.sum(value).over(upto(Window.partitionBy("_r").orderBy(way))), F.lit(0))
    return ranged.withColumn("_o", own).join(F.broadcast(start), "_r").withColumn("before", F.col("_o") + F.col("_b")).drop("_r", "_o", "_b")


def threshold_report(scored: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, accepted, precision, recall, accuracy). The thresholds are an array in each row's partial counts, not a join."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    compact = scored.groupBy("score", "positive").agg(F.count("*").alias("n"))
    hit = F.col("score") >= F.col("threshold")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = compact.select("score", "positive", "n", t).groupBy("threshold").agg(n(hit).alias("accepted"), n(hit & F.col("positive")).alias("tp"), n(F.col("positive")).alias("pos"), n(hit == F.col("positive")).alias("right"), F.sum("n").alias("all"))
    return g.select("threshold", "accepted", F.expr("try_divide(tp, accepted)").alias("precision"), F.expr("try_divide(tp, pos)").alias("recall"), (F.col("right") / F.col("all")).alias("accuracy"))


def bin_of(score: Column, edges: tuple[float, ...] = BINS) -> Column:
    """The number of the last edge that isn't above the score; null for a score below the first."""
    return F.when(score >= edges[0], sum(((score >= e).cast("int") for e in edges[1:]), F.lit(0)))


def score_bins(scored: DataFrame, edges: tuple[float, ...] = BINS) -> DataFrame:
    """(bin, n, fixes, breaks, neutral, net): candidates per score bin by their effect; empty bins appear."""
    g = scored.groupBy(bin_of(F.col("score"), edges).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("effect") > 0).alias("fixes"), F.count_if(F.col("effect") < 0).alias("breaks"), F.count_if(F.col("effect") == 0).alias("neutral"), F.sum("effect").alias("net"))
    bins = scored.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    return bins.join(g, "bin", "left").select("bin", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "fixes", "breaks", "neutral", "net")))


def bin_sample(scored: DataFrame, per_bin: int, seed: str, *keys: str, edges: tuple[float, ...] = BINS) -> DataFrame:
    """``scored`` with ``bin``: at most ``per_bin`` rows of each score bin, in hash order (a sampling operator)."""
    return stratified_sample(scored, bin_of(F.col("score"), edges), per_bin, seed, *keys).withColumnRenamed("stratum_key", "bin")


def judged_precision(scored: DataFrame, judged: DataFrame, edges: tuple[float, ...] = BINS) -> DataFrame:
    """(bin, candidates, sampled, accepted, rejected, bin_precision, precision_from, accepted_from) per score bin.

    ``judged``: (bin, decision accepted | rejected | undecided), a sample of each bin's candidates. A bin's precision is the accepted ones' share of those decided, null if none are.
    ``precision_from`` is that of all candidates at or above the bin's edge, each bin weighing as many as it has candidates, bins without a precision left out;
    ``accepted_from`` the number of them that would be right. The windows run over the bins, a fixed handful.
    """
    n = scored.groupBy(bin_of(F.col("score"), edges).alias("bin")).agg(F.count("*").alias("candidates"))
    j = judged.groupBy("bin").agg(F.count("*").alias("sampled"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") == "rejected").alias("rejected"))
    b = scored.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").join(j, "bin", "left")
    b = b.select("bin", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "sampled", "accepted", "rejected"))).withColumn("bin_precision", F.expr("try_divide(accepted, accepted + rejected)"))
    up = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    right = F.coalesce(F.sum(F.col("candidates") * F.col("bin_precision")).over(up), F.lit(0.0))
    known = F.sum(F.when(F.col("bin_precision").isNotNull(), F.col("candidates")).otherwise(0)).over(up)
    return b.withColumn("accepted_from", right).withColumn("_k", known).select("bin", "candidates", "sampled", "accepted", "rejected", "bin_precision", F.expr("try_divide(accepted_from, _k)").alias("precision_from"), "accepted_from")


def effect_by_decision(judged: DataFrame) -> DataFrame:
    """(effect, n, accepted, rejected, undecided) of judged candidates (effect number, decision) by what they do to the reference: fixes words, breaks words, neutral, and all."""
    kind = F.when(F.col("effect") > 0, F.lit("fixes words")).when(F.col("effect") < 0, F.lit("breaks words")).otherwise("neutral")
    each = judged.select(F.explode(F.array(kind, F.lit("all"))).alias("effect"), "decision")
    return each.groupBy("effect").agg(F.count("*").alias("n"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("accepted", "rejected", "undecided")))


def second_judge(sampled: DataFrame, levels: tuple[float, ...] = (0.2, 0.3), edges: tuple[float, ...] = BINS) -> DataFrame:
    """(bin, sampled, mean, at_least array): what a second judge's score ``second`` says of sampled candidates (bin, second), per bin of the first; null scores don't count."""
    g = sampled.filter("second is not null").groupBy("bin").agg(F.count("*").alias("sampled"), F.avg("second").alias("mean"), F.array(*(F.avg((F.col("second") >= x).cast("int")) for x in levels)).alias("at_least"))
    bins = sampled.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    return bins.join(g, "bin", "left").select("bin", F.coalesce("sampled", F.lit(0)).alias("sampled"), "mean", "at_least")


def quota_sample(df: DataFrame, quotas: dict[str, int], per_call: int, seed: str, key: str) -> DataFrame:
    """(key, call_id, stratum): of each stratum as many rows as its quota, at most ``per_call`` of a call in all strata together (a sampling operator).

    Strata are gone through in the order of ``quotas``, each in hash order, as a greedy choice would; calls that are full in earlier strata are passed over. A stratum is two ranks, inside its
    calls and over the first of them; the rows taken so far number no more than the quotas.
    """
    rows = df.select(key, "call_id", "stratum").filter(F.col("stratum").isin(*quotas)).withColumn("_h", hash_order(seed, key))
    taken = None
    for name, quota in quotas.items():
        pool = rows.filter(F.col("stratum") == name)
        pool = pool.withColumn("_r", F.row_number().over(Window.partitionBy("call_id").orderBy("_h", key)))
        if taken is None:
            pool = pool.filter(F.col("_r") <= per_call)
        else:
            used = taken.groupBy("call_id").agg(F.count("*").alias("_used"))
            pool = pool.join(used, "call_id", "left").filter(F.col("_r") <= per_call - F.coalesce("_used", F.lit(0))).drop("_used")
        picked = pool.orderBy("_h", key).limit(quota).select(key, "call_id", "stratum")
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


def stratified_sample(df: DataFrame, stratum: Column, k: int, seed: str, *keys: str) -> DataFrame:
    """At most ``k`` rows per stratum in hash order; rows without a stratum are left out."""
    w = Window.partitionBy("stratum_key").orderBy(hash_order(seed, *keys), *keys)
    return df.withColumn("stratum_key", stratum).filter("stratum_key is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def best_so_far(series: DataFrame, patience: int) -> DataFrame:
    """(run, step, value, best, improved, since, stop): strict improvements of the least value, readings since the last, early stop at ``patience``."""
    by = Window.partitionBy("run").orderBy("step")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    s = series.withColumn("improved", F.coalesce(F.col("value") < F.min("value").over(before), F.lit(True))).withColumn("best", F.min("value").over(upto))
    s = s.withColumn("_block", F.sum(F.col("improved").cast("int")).over(upto))
    s = s.withColumn("since", F.row_number().over(Window.partitionBy("run", "_block").orderBy("step")) - 1)
    return s.select("run", "step", "value", "best", "improved", "since", (F.col("since") >= patience).alias("stop"))


def trend(series: DataFrame, window: int = 3) -> DataFrame:
    """(run, step, trend, since) after each reading of (run, step, value), lower being better; null values are no readings.

    Fewer than two readings: not enough data. A reading that is or ties the best: improving. One not above the first of the last ``window``: plateaued. Else
    regressed. ``since``: readings since the best.
    """
    by = Window.partitionBy("run").orderBy("step")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    s = series.filter(v.isNotNull()).withColumn("_best", F.min("value").over(upto)).withColumn("_n", F.row_number().over(by))
    first = F.first("value").over(by.rowsBetween(1 - window, 0))
    at_best = F.max(F.when(v <= F.col("_best"), F.col("_n"))).over(upto)
    kind = F.when(F.col("_n") < 2, F.lit("not enough data")).when(v <= F.col("_best"), F.lit("improving")).when(v <= first, F.lit("plateaued")).otherwise("regressed")
    return s.select("run", "step", kind.alias("trend"), (F.col("_n") - at_best).alias("since"))


def rank_runs(runs: DataFrame) -> DataFrame:
    """(run, wer, loss, place, winner): by error rate, then loss, nulls last; the winner is the first with an error rate. ``runs`` has a row per run; ranges of them are ranked apart."""
    order = F.struct(F.col("wer").isNull().alias("a"), "wer", F.col("loss").isNull().alias("b"), "loss", "run")
    counted = running_sum(runs.select("run", "wer", "loss", order.alias("_k"), F.lit(1).alias("_one")), "_k", "_one")
    return counted.select("run", "wer", "loss", (F.col("before") + 1).cast("int").alias("place")).withColumn("winner", (F.col("place") == 1) & F.col("wer").isNotNull())


def rank_runs(runs: DataFrame) -> DataFrame:
    """(run, wer, loss, place, winner): by error rate, then loss, nulls last; the winner is the first with an error rate. ``runs`` has a row per run."""
    w = Window.orderBy(F.asc_nulls_last("wer"), F.asc_nulls_last("loss"), "run")
    place = F.row_number().over(w)
    return runs.select("run", "wer", "loss", place.alias("place")).withColumn("winner", (F.col("place") == 1) & F.col("wer").isNotNull())


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "contains": lambda a, b: F.contains(a, b),
}


def prediction_filter(df: DataFrame, rules: list[dict], fields: tuple[str, ...], limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows that meet all rules {field, op, value}; unknown fields and operators raise, a null field meets none. Values are literals, never SQL. With ``limit``, at most so many rows, in the order of ``order``."""
    for r in rules:
        if r["field"] not in fields or r["op"] not in _OPS:
            raise ValueError(f"unknown field or operator: {r}")
        df = df.filter(_OPS[r["op"]](F.col(r["field"]), F.lit(r["value"])))
    return df if limit is None else (df.orderBy(order) if order else df).limit(limit)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts in equal bins, ends included in the outer ones."""
    b = F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def compare_runs(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """(metric, a, b, change) of two runs in a table (run, metric, value)."""
    x, y = (metrics.filter(F.col("run") == r).select("metric", F.col("value").alias(n)) for r, n in ((a, "a"), (b, "b")))
    return x.join(y, "metric", "full").select("metric", "a", "b", (F.col("b") - F.col("a")).alias("change"))


def series_summary(series: DataFrame) -> DataFrame:
    """(run, tag, n, last, least, most)."""
    return series.groupBy("run", "tag").agg(F.count("*").alias("n"), F.max_by("value", "step").alias("last"), F.min("value").alias("least"), F.max("value").alias("most"))


def describe(df: DataFrame, value: Column) -> DataFrame:
    """One row: n, mean, least, most and the quartiles (approximate, one pass) of a number; nulls don't count."""
    q = F.percentile_approx("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    return df.select(value.alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), q.alias("quartiles"))


def no_edit_probability(windows: DataFrame) -> DataFrame:
    """One row (with_edits, without_edits, auc) of (p_none, has_edits): the mean chance that nothing is to be done where there are edits and where there are none, 0 for no window, and how often a window with edits has the smaller one."""
    mean = lambda c: F.sum(F.when(c, F.col("p_none")).otherwise(0.0)) / F.greatest(F.count_if(c), F.lit(1))
    means = windows.agg(mean(F.col("has_edits")).alias("with_edits"), mean(~F.col("has_edits")).alias("without_edits"))
    return means.crossJoin(auc(windows.select(F.col("p_none").alias("score"), F.col("has_edits").alias("positive")), higher=False).select("auc"))


def tags_of(series: DataFrame) -> DataFrame:
    """(run, tags): the sorted names of each run's series."""
    return series.groupBy("run").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def series_of(series: DataFrame, run, tag: str) -> DataFrame:
    """(step, value) of one series."""
    return series.filter((F.col("run") == run) & (F.col("tag") == tag)).select("step", "value")
