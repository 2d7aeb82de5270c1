"""Corrections scored against references: error rates, fix and keep rates, entity rates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sokhan.functions import align as A
from sokhan.functions import text as T

COUNTERS = ("n_ref", "dist_out", "dist_in", "dist_zwnj", "n_ref_zwnj", "fix_t", "fix_h", "keep_t", "keep_h", "fix_tl", "fix_hl", "keep_tl", "keep_hl", "fix_tc", "fix_hc", "keep_tc", "keep_hc", "fix_ts", "fix_hs", "fix_tr", "fix_hr", "unrecoverable")


def in_scope(source: str, ref: str, most: int = 4) -> set[int]:
    """Lenient reference positions in substitutions of at most ``most`` words that are no matter of style, filler or number."""
    s, r = A.lenient(source).split(), A.lenient(ref).split()
    out: set[int] = set()
    for op, a, b, c, d in A.chunks(r, s):
        o, n = tuple(s[c:d]), tuple(r[a:b])
        if op == "substitute" and max(len(o), len(n)) <= most and not (A.is_style(o, n) or A.is_filler(o, n) or A.changes_number(o, n)):
            out.update(range(a, b))
    return out


def categories(source: str, ref: str, usual: Callable[[str], bool] | None = None, least: float = 0.75) -> list[int]:
    """For each reference word 1: right in the source, 2: wrong, but to be recovered, 3: wrong without a clue.

    A wrong word can be recovered if it sounds like what the source has in the whole run, if it, or each of the parts that half-spaces make of it, is ``usual`` (not asked without
    that), or if the source has it anywhere.
    """
    s, r = source.split(), ref.split()
    out, given = [1] * len(r), set(s)

    def common(w: str) -> bool:
        return usual is not None and (usual(w) or T.ZWNJ in w and all(p and usual(p) for p in w.split(T.ZWNJ)))

    for op, a, b, c, d in A.chunks(r, s):
        if op in ("substitute", "delete"):
            for k in range(a, b):
                clue = A.sound_similarity(r[k], " ".join(s[c:d])) >= least or common(r[k]) or r[k] in given
                out[k] = 2 if clue else 3
    return out


def unrecoverable(source: str, ref: str, usual: Callable[[str], bool]) -> set[int]:
    """Lenient reference positions that the source gives no clue to."""
    return {k for k, c in enumerate(categories(A.lenient(source), A.lenient(ref), usual)) if c == 3}


def word_categories(rows: DataFrame, key: str) -> DataFrame:
    """(key, categories array) of (key, source, target, rare): the category of each target word; see ``categories``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "categories": [categories(s or "", t or "", _not_in(r)) for s, t, r in zip(b.source, b.target, b.rare)]})

    return rows.select(key, "source", "target", "rare").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, categories array<int>")


def category_spans(spans: Column, cats: Column, wanted: int) -> Column:
    """The character spans (array<struct<a, z>> per word, see ``masking.char_spans``) of the words of one category: what a loss leaves out (3) or weighs more (2)."""
    return F.transform(F.filter(F.arrays_zip(spans.alias("s"), cats.alias("c")), lambda x: x["c"] == wanted), lambda x: x["s"])


def _not_in(rare: Iterable[str]) -> Callable[[str], bool]:
    known = frozenset(rare)
    return lambda w: w not in known


def count_row(source: str, hyp: str, ref: str, usual: Callable[[str], bool] | None = None) -> tuple[int, ...]:
    """All counters of one row, in the order of COUNTERS."""
    s, h, r = source.split(), hyp.split(), ref.split()
    zw = [t.replace(T.ZWNJ, "").split() for t in (hyp, ref)]
    already, still = A.equal_positions(r, s), A.equal_positions(r, h) if h else set()
    target = set(range(len(r))) - already
    tl, al, sl = A.lenient_positions(source, hyp, ref)
    clitic = [" ".join(A.join_clitics([A.canonical(w) for w in t.split()])) for t in (source, hyp, ref)]
    tc, ac, sc = A.lenient_positions(*clitic)
    scope = in_scope(source, ref) & tl
    lost = unrecoverable(source, ref, usual) & tl if usual is not None else set()
    return (
        len(r), A.distance(r, h), A.distance(r, s), A.distance(zw[1], zw[0]), len(zw[1]), len(target), len(target & still), len(already), len(already & still),
        len(tl), len(tl & sl), len(al), len(al & sl), len(tc), len(tc & sc), len(ac), len(ac & sc), len(scope), len(scope & sl), len(tl - lost), len((tl - lost) & sl), len(lost),
    )


def row_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and COUNTERS for each row of (keys, source, hyp, ref) and, for the recoverable rates, rare (the reference's rare words); null texts count as empty.

    Every pair is aligned in one pass over its texts; frequencies come with the row, so no vocabulary is sent to the tasks.
    """
    with_rare = "rare" in rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            usual = map(_not_in, b.rare) if with_rare else [None] * len(b)
            got = [count_row(s or "", h or "", r or "", u) for s, h, r, u in zip(b.source, b.hyp, b.ref, usual)]
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(got, columns=COUNTERS)], axis=1)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "source", "hyp", "ref", *["rare"] * with_rare).mapInPandas(run, kinds + ", " + ", ".join(f"{c} long" for c in COUNTERS))


def rates(counted: DataFrame, by: list[str], weight: float = 0.5) -> DataFrame:
    """Micro rates per group; null where nothing counts."""
    g = counted.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in COUNTERS))
    div = lambda a, b: F.expr(f"try_divide({a}, {b})")
    fix, keep, fl, kl = div("fix_h", "fix_t"), div("keep_h", "keep_t"), div("fix_hl", "fix_tl"), div("keep_hl", "keep_tl")
    return g.select(
        *by, "n", div("dist_out", "n_ref").alias("wer"), div("dist_in", "n_ref").alias("wer_input"), div("dist_zwnj", "n_ref_zwnj").alias("wer_zwnj"),
        fix.alias("fix_rate"), keep.alias("keep_rate"), (weight * fix + (1 - weight) * keep).alias("targeted"),
        fl.alias("fix_rate_lenient"), kl.alias("keep_rate_lenient"), F.col("fix_hl").alias("fixed"), (F.col("keep_tl") - F.col("keep_hl")).alias("broken"),
        (F.col("fix_hl") - F.col("keep_tl") + F.col("keep_hl")).alias("net"), F.expr("try_divide(100 * (keep_tl - keep_hl), keep_tl)").alias("broken_per_100"),
        (F.col("fix_hc") - F.col("keep_tc") + F.col("keep_hc")).alias("net_clitic"), div("fix_hs", "fix_ts").alias("fix_rate_in_scope"), div("fix_hr", "fix_tr").alias("fix_rate_recoverable"), "unrecoverable",
    )


def row_flags(rows: DataFrame) -> DataFrame:
    """``rows`` (source, hyp, ref) with exact (equal but for white space at the ends), hallucinated (fewer than half the words come from the source), premature (30 words or more, and less than 0.3 of them) and changed; nulls count as empty."""
    s, h, r = (F.coalesce(F.col(c), F.lit("")) for c in ("source", "hyp", "ref"))
    n_in, n_out = F.size(T.words(s)), F.size(T.words(h))
    return rows.withColumns({"exact": T.strip(h) == T.strip(r), "hallucinated": T.overlap_pct(h, s) < 50, "premature": (n_in >= 30) & (n_out < 0.3 * n_in), "changed": T.words(h) != T.words(s)})


def entity_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keep rate of name spans that the source has and fix rate of those it lacks, over spans that the reference has; all by the lenient form. ``rows``: (by, source, hyp, ref, spans)."""
    form = lambda c: T.padded(T.normalize_lenient(F.coalesce(F.col(c), F.lit("")))).alias(c)
    e = rows.select(*by, form("source"), form("hyp"), form("ref"), F.explode(F.transform(F.array_distinct("spans"), lambda x: T.normalize_lenient(x))).alias("span"))
    e = e.filter(T.padded_has(F.col("ref"), F.col("span")))
    there, hit = T.padded_has(F.col("source"), F.col("span")), T.padded_has(F.col("hyp"), F.col("span"))
    g = e.groupBy(*by).agg(F.count_if(there).alias("right"), F.count_if(there & hit).alias("kept"), F.count_if(~there).alias("wrong"), F.count_if(~there & hit).alias("fixed"))
    return g.select(*by, "right", "kept", "wrong", "fixed", F.expr("try_divide(kept, right)").alias("entity_keep_rate"), F.expr("try_divide(fixed, wrong)").alias("entity_fix_rate"))


def weighted_loss(tokens: DataFrame, by: list[str], loss: Column, weight: Column, counts: Column) -> DataFrame:
    """(by, loss): mean of the counted tokens' losses by weight, the sum of weights at least 1e-8."""
    w = F.when(counts, weight).otherwise(0.0)
    return tokens.groupBy(*by).agg((F.sum(loss * w) / F.greatest(F.sum(w), F.lit(1e-8))).alias("loss"))


def reproduced(ours: DataFrame, logged: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(run, metric, ours, logged) of the logged metrics (run, metric, value) that the rescored ones don't come within ``tolerance`` of; a metric that was not logged isn't asked for, one that is missing counts as 0."""
    a, b = ours.select("run", "metric", F.col("value").alias("ours")), logged.filter("value is not null").select("run", "metric", F.col("value").alias("logged"))
    return b.join(a, ["run", "metric"], "left").filter(F.abs(F.coalesce("ours", F.lit(0.0)) - F.col("logged")) > tolerance).select("run", "metric", "ours", "logged")
