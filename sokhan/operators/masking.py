"""Training examples as token arrays: labels, weights, padding. The tokenizer is a plug-in; words stand in for it here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sokhan.functions import text as T

IGNORED = -100


def char_spans(ws: Column) -> Column:
    """(start, end) of each word in the text of the words joined by single spaces."""
    sums = F.aggregate(ws, F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + F.length(w) + 1)))
    bound = F.transform(F.array(sums), lambda at: F.transform(ws, lambda w, i: F.struct(F.get(at, i).alias("a"), (F.get(at, i) + F.length(w)).alias("z"))))
    return F.get(bound, F.lit(0))


def examples(rows: DataFrame, key: str, prompt: Column, target: Column, masked: Column, weighted: Column, most: int, weight: float, eos_weight: float = 1.0, short: int = 3) -> DataFrame:
    """(key, tokens, labels, weights, status) of an example: the prompt's labels are ignored, and so are those of target words in ``masked`` spans; words in ``weighted`` spans weigh ``weight``; the closing token of a target of at most ``short`` words weighs ``eos_weight``.

    ``masked`` and ``weighted``: arrays of (a, z) character spans of the target. Longer than ``most`` tokens: truncated; dropped if no target token is left. Tokens are words and a closing mark.
    """
    t = rows.select(key, T.words(F.coalesce(prompt, F.lit(""))).alias("p"), T.words(F.coalesce(target, F.lit(""))).alias("t"), masked.alias("m"), weighted.alias("w"))
    t = t.withColumn("spans", char_spans(F.col("t")))
    inside = lambda s, spans: F.exists(spans, lambda x: (s["a"] < x["z"]) & (s["z"] > x["a"]))
    tokens = F.concat("p", "t", F.array(F.lit("</s>")))
    labels = F.concat(
        F.transform("p", lambda _: F.lit(IGNORED)), F.transform("spans", lambda s, i: F.when(inside(s, F.col("m")), F.lit(IGNORED)).otherwise(F.size("p") + i)), F.array(F.size("p") + F.size("t")),
    )
    end = F.when(F.size("t") <= short, F.lit(float(eos_weight))).otherwise(F.lit(1.0))
    weights = F.concat(F.transform("p", lambda _: F.lit(1.0)), F.transform("spans", lambda s: F.when(inside(s, F.col("w")), F.lit(float(weight))).otherwise(1.0)), F.array(end))
    status = F.when(F.size(tokens) <= most, F.lit("ok")).when(F.size("p") < most, F.lit("truncated")).otherwise("dropped")
    cut = lambda c: F.slice(c, 1, most)
    return t.select(key, cut(tokens).alias("tokens"), cut(labels).alias("labels"), cut(weights).alias("weights"), status.alias("status"))


def pad_batches(ex: DataFrame, key: str, batch: Column) -> DataFrame:
    """(key, batch, n, width): arrays padded to the longest of their batch would have ``width`` tokens, ``n`` of them their own; ``batch`` is any batch number."""
    b = ex.select(key, F.size("tokens").alias("n"), batch.alias("batch"))
    return b.join(b.groupBy("batch").agg(F.max("n").alias("width")), "batch").select(key, "batch", "n", "width")



def token_totals(ex: DataFrame) -> DataFrame:
    """(status, examples, tokens, ignored_tokens, weighted_tokens, weighted_examples) of examples: what was cut, what a loss leaves out, what it weighs otherwise than 1."""
    ignored, weighted = F.size(F.filter("labels", lambda x: x == IGNORED)), F.size(F.filter("weights", lambda x: x != 1.0))
    return ex.groupBy("status").agg(
        F.count("*").alias("examples"), F.sum(F.size("tokens")).alias("tokens"), F.sum(ignored).alias("ignored_tokens"), F.sum(weighted).alias("weighted_tokens"), F.count_if(weighted > 0).alias("weighted_examples")
    )
