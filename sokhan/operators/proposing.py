"""Where edits come from without a model, how they are told apart, and how several proposers are combined."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sokhan.functions import align as A
from sokhan.functions import text as T
from sokhan.operators.editing import applied, fold_edits, glue_table, unstutter_table

MOST_WORDS = 4


def rule_table(freq: DataFrame, rare: int = 2, common: int = 200, extended: bool = False) -> DataFrame:
    """(word, fixed, rule): what the rules make of rare words, a doubled first letter before a glued pair; a row per distinct word, however often it is said."""
    stutter = unstutter_table(freq, rare, common).withColumn("rule", F.lit("rule_unstutter"))
    glued = glue_table(freq, rare, common, extended).select("word", F.concat_ws(" ", "first", "second").alias("fixed"), F.lit("rule_glue_split").alias("rule"))
    return stutter.unionByName(glued.join(stutter.select("word"), "word", "left_anti"))


def rule_edits(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """(key, start_word, end_word, original, replacement, proposer) of (key, source, names): the rules' edits; words among ``names`` are never touched.

    The table holds rare words only, so the join meets no hot word of the texts.
    """
    none = F.array().cast("array<string>")
    said = rows.select(key, F.coalesce("names", none).alias("names"), F.posexplode(T.words(F.coalesce("source", F.lit("")))).alias("start_word", "word"))
    hit = said.join(table, "word").filter(~F.array_contains("names", F.col("word")))
    return hit.select(key, "start_word", (F.col("start_word") + 1).alias("end_word"), F.col("word").alias("original"), F.col("fixed").alias("replacement"), F.col("rule").alias("proposer"))


def apply_edit_rows(rows: DataFrame, key: str, edits: DataFrame, rank: Column | None = None, allow_numbers: bool = True) -> DataFrame:
    """(key, corrected, n_edits, n_refused) of ``rows`` (key, source) and edit rows (key, start_word, end_word, original, replacement as texts).

    Edits are tried by ``rank``, then by their place; of those that overlap the first stays.
    """
    rank = F.lit(0) if rank is None else rank
    e = F.struct(rank.alias("p"), F.col("start_word").alias("s"), F.col("end_word").alias("e"), T.words(F.coalesce("original", F.lit(""))).alias("o"), T.words(F.coalesce("replacement", F.lit(""))).alias("r"))
    per = edits.groupBy(key).agg(F.array_sort(F.collect_list(e)).alias("es"))
    w = rows.select(key, T.words(F.coalesce("source", F.lit(""))).alias("w")).join(per, key, "left")
    plain = F.transform("es", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["o"].alias("o"), x["r"].alias("r")))
    done = w.withColumn("f", fold_edits(F.col("w"), plain, allow_numbers))
    return done.select(key, applied(F.col("w"), F.col("f.taken")).alias("corrected"), F.size("f.taken").alias("n_edits"), (F.size("f.reasons") - F.size("f.taken")).alias("n_refused"))


def annotate(edits: DataFrame, names: Column) -> DataFrame:
    """Edit rows (original, replacement as texts) with kind, style, similarity (0 for one-sided edits), span_words and crm_hit: a name that is new in the replacement."""
    o, r = T.words(F.col("original")), T.words(F.col("replacement"))
    both = (F.size(o) > 0) & (F.size(r) > 0)
    return edits.withColumns({
        "kind": T.edit_kind(o, r), "style": T.is_style(o, r), "span_words": F.greatest(F.size(o), F.size(r)),
        "similarity": F.when(both, F.round(T.span_similarity(F.array_join(o, " "), F.array_join(r, " ")), 3)).otherwise(0.0),
        "crm_hit": F.exists(r, lambda w: F.array_contains(names, w) & ~F.array_contains(o, w)),
    })


def sounds_like(least: float) -> Column:
    """Substitutions of up to MOST_WORDS words that are no matter of style and sound at least so much alike."""
    return ~F.col("style") & (F.col("kind") == "substitute") & (F.col("span_words") <= MOST_WORDS) & (F.col("similarity") >= least)


#: Named filters of annotated edits (see ``annotate`` and ``effects``): which of a rewrite's edits are kept.
FILTERS = {
    "none": lambda: F.lit(False),
    "rewrite": lambda: F.lit(True),
    "oracle": lambda: F.col("effect") > 0,
    "no_style": lambda: ~F.col("style"),
    "phonetic_50": lambda: sounds_like(0.5),
    "phonetic_67": lambda: sounds_like(0.67),
    "phonetic_80": lambda: sounds_like(0.8),
    "crm": lambda: F.col("crm_hit"),
}


def effects(rows: DataFrame, key: str, edits: DataFrame) -> DataFrame:
    """``edits`` with ``fixed``, ``broken`` and ``effect``: lenient reference words that each edit, done alone to its row's source, makes right and wrong.

    ``rows``: (key, source, ref). A row's edits are gathered, so its texts are aligned by one task and travel once.
    """
    numbered = edits.withColumn("_e", F.struct(F.col("start_word").alias("s"), F.col("end_word").alias("e"), F.coalesce("original", F.lit("")).alias("o"), F.coalesce("replacement", F.lit("")).alias("r")))
    per = numbered.select(key, "_e").distinct().groupBy(key).agg(F.collect_list("_e").alias("_es"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s, ref, es in zip(b[key], b.source, b.ref, b["_es"]):
                s, ref = s or "", ref or ""
                _, before, _ = A.lenient_positions(s, s, ref)
                for e in es:
                    one = A.Edit(e["s"], e["e"], tuple(e["o"].split()), tuple(e["r"].split()))
                    now = A.lenient_positions(s, A.apply(s, [one], allow_numbers=True), ref)[2] if A.fault(s.split(), one, True) is None else before
                    out.append((k, e["s"], e["e"], e["o"], e["r"], len(now - before), len(before - now)))
            yield pd.DataFrame(out, columns=["_k", "s", "e", "o", "r", "fixed", "broken"])

    told = rows.select(key, "source", "ref").join(per, key).mapInPandas(run, f"_k {kind}, s int, e int, o string, r string, fixed int, broken int")
    same = (F.col(key) == F.col("_k")) & (F.col("_e.s") == F.col("s")) & (F.col("_e.e") == F.col("e")) & (F.col("_e.o") == F.col("o")) & (F.col("_e.r") == F.col("r"))
    return numbered.join(told, same).drop("_k", "s", "e", "o", "r", "_e").withColumn("effect", F.col("fixed") - F.col("broken"))


def spacing_only(edits: DataFrame) -> DataFrame:
    """Substitutions of up to MOST_WORDS words that differ in spacing only: what the style filter drops before a model sees it."""
    o, r = T.words(F.col("original")), T.words(F.col("replacement"))
    same = T.squash(F.array_join(o, " ")) == T.squash(F.array_join(r, " "))
    return edits.filter((F.size(o) > 0) & (F.size(r) > 0) & (F.greatest(F.size(o), F.size(r)) <= MOST_WORDS) & (F.array_join(o, " ") != F.array_join(r, " ")) & same)


def candidate_rows(edits: DataFrame) -> DataFrame:
    """Edit rows worth scoring, also those of earlier runs: substitutions of up to MOST_WORDS words a side that are no matter of style, filler or number."""
    o, r = T.words(F.col("original")), T.words(F.col("replacement"))
    return edits.filter((T.edit_kind(o, r) == "substitute") & (F.greatest(F.size(o), F.size(r)) <= MOST_WORDS) & ~T.is_style(o, r) & ~T.is_filler(o, r) & ~T.changes_number(o, r))


def edits_by_key(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, start_word, end_word, span): where in (key, source) spans (squashed) stand, spacing aside, in one word or two neighbours. An equi-join on the squashed form."""
    ws = rows.select("key", T.words(F.coalesce("source", F.lit(""))).alias("ws")).select("key", "ws", F.posexplode("ws").alias("i", "w"))
    two = F.array(F.struct(F.lit(1).alias("n"), T.squash(F.col("w")).alias("q")), F.struct(F.lit(2).alias("n"), T.squash(F.concat("w", F.get("ws", F.col("i") + 1))).alias("q")))
    at = ws.select("key", "i", F.explode(two).alias("x")).filter("x.q is not null")
    hit = at.select("key", "i", "x.n", "x.q").join(spans.select("key", T.squash(F.col("span")).alias("q"), "span").distinct(), ["key", "q"])
    return hit.select("key", F.col("i").alias("start_word"), (F.col("i") + F.col("n")).alias("end_word"), "span")


def decode_choice(rows: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, key, output) of (key, p_none, greedy, blocked): where the chance that nothing is to be done is below the threshold, the answer that was made to edit."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    return rows.select("key", "p_none", "greedy", "blocked", t).select("threshold", "key", F.when(F.col("p_none") < F.col("threshold"), F.col("blocked")).otherwise(F.col("greedy")).alias("output"))


def best_threshold(scores: DataFrame, score: str = "score") -> DataFrame:
    """The one row (threshold, score ...) of the best score, of equal ones the lowest threshold."""
    return scores.orderBy(F.desc_nulls_last(score), "threshold").limit(1)
