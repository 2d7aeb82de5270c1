"""Edits as rows and arrays: kinds, flags, validation, application, contexts, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sokhan.functions import text as T


def edit_rows(windows: DataFrame) -> DataFrame:
    """(window_id, k, start_word, end_word, original, replacement arrays, stratum, decided_by) of (window_id, edits)."""
    e = windows.select("window_id", "call_id", F.posexplode("edits").alias("k", "e"))
    split = lambda c: T.words(F.coalesce(c, F.lit("")))
    return e.select("window_id", "call_id", "k", "e.start_word", "e.end_word", split(F.col("e.original")).alias("original"), split(F.col("e.replacement")).alias("replacement"), "e.stratum", "e.decided_by", "e.diff_id")


def flags(rows: DataFrame) -> DataFrame:
    """Kind, style, filler, number and similarity of each edit row."""
    o, r = F.col("original"), F.col("replacement")
    style = T.is_style(o, r)
    return rows.withColumns({
        "kind": T.edit_kind(o, r), "style": style, "filler": ~style & T.is_filler(o, r), "number": T.changes_number(o, r),
        "similarity": T.span_similarity(F.array_join(o, " "), F.array_join(r, " ")), "span_words": F.greatest(F.size(o), F.size(r)),
    })


_TAKEN = "array<struct<s:int,e:int,o:array<string>,r:array<string>>>"


def fold_edits(words: Column, edits: Column, allow_numbers: bool = False) -> Column:
    """struct<taken, reasons> of an array<struct<s, e, o, r>>: the edits that can be done to ``words``, and each edit's reason or "ok".

    A fold over the array, for whether an edit overlaps depends on which came before it; all of it stays in the JVM.
    """

    def reason(taken: Column, e: Column) -> Column:
        here = F.slice(words, F.greatest(e["s"], F.lit(0)) + 1, F.greatest(e["e"] - e["s"], F.lit(0)))
        numbers = F.lit(False) if allow_numbers else T.changes_number(e["o"], e["r"])
        return (
            F.when(~((e["s"] >= 0) & (e["s"] <= e["e"]) & (e["e"] <= F.size(words))), F.lit("out_of_range"))
            .when(here != e["o"], F.lit("original_mismatch"))
            .when(e["o"] == e["r"], F.lit("no_op"))
            .when(numbers, F.lit("touches_number"))
            .when(F.exists(taken, lambda t: (e["s"] < t["e"]) & (t["s"] < e["e"])), F.lit("overlap"))
            .otherwise("ok")
        )

    empty = F.struct(F.array().cast(_TAKEN).alias("taken"), F.array().cast("array<string>").alias("reasons"))

    def step(acc: Column, e: Column) -> Column:
        why = reason(acc["taken"], e)
        return F.struct(F.when(why == "ok", F.concat(acc["taken"], F.array(e))).otherwise(acc["taken"]).alias("taken"), F.concat(acc["reasons"], F.array(why)).alias("reasons"))

    return F.aggregate(F.coalesce(edits, F.array()).cast(_TAKEN), empty, step)


def applied(words: Column, taken: Column) -> Column:
    """The text of ``words`` with edits done that don't overlap. What is put in at a word comes before what the word becomes; of two insertions at one place the later comes first.

    A fold over the edits in order of place: the words up to the edit as they are, then what it puts there.
    """
    ordered = F.array_sort(F.transform(taken, lambda t, i: F.struct(t["s"].alias("s"), t["e"].alias("e"), (-i).alias("i"), t["r"].alias("r"))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    upto = lambda acc, end: F.slice(words, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0)))
    done = F.aggregate(ordered, start, lambda acc, t: F.struct(F.concat(acc["out"], upto(acc, t["s"]), t["r"]).alias("out"), t["e"].alias("at")), lambda acc: F.concat(acc["out"], upto(acc, F.size(words))))
    return F.array_join(F.when(F.size(taken) == 0, words).otherwise(done), " ")


def as_arrays(edits: Column) -> Column:
    """Stored edits (start_word, end_word, original, replacement as texts) in the form that ``fold_edits`` takes."""
    split = lambda c: T.words(F.coalesce(c, F.lit("")))
    return F.transform(edits, lambda e: F.struct(e["start_word"].alias("s"), e["end_word"].alias("e"), split(e["original"]).alias("o"), split(e["replacement"]).alias("r")))


def check_and_apply(windows: DataFrame, allow_numbers: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(window_id, keep, reasons, corrected) of (window_id, source, edits): each edit's reason or "ok", and the source with the valid edits done."""
    w = windows.select("window_id", *keep, T.words(F.coalesce("source", F.lit(""))).alias("w"), as_arrays(F.col("edits")).alias("es"))
    done = w.withColumn("f", fold_edits(F.col("w"), F.col("es"), allow_numbers))
    return done.select("window_id", *keep, F.col("f.reasons").alias("reasons"), applied(F.col("w"), F.col("f.taken")).alias("corrected"))


def contexts(windows: DataFrame, k: int) -> DataFrame:
    """(window_id, k, left_words, right_words): each edit of (window_id, source, edits) with up to ``k`` words left and right of it; the source goes along in the row, so nothing is joined."""
    e = windows.select("window_id", T.words(F.col("source")).alias("w"), F.posexplode("edits").alias("k", "e"))
    low = F.greatest(F.col("e.start_word") - k, F.lit(0))
    left = F.array_join(F.slice("w", low + 1, F.greatest(F.col("e.start_word") - low, F.lit(0))), " ")
    return e.select("window_id", "k", left.alias("left_words"), F.array_join(F.slice("w", F.col("e.end_word") + 1, k), " ").alias("right_words"))


def near_spans(spans: Column, start: Column, end: Column, reach: int = 3, a: str = "a", z: str = "z") -> Column:
    """How many of ``spans`` (array<struct<a, z>>), the span itself left out, are nearer than ``reach`` words to [start, end)."""
    return F.size(F.filter(spans, lambda x: (x[a] < end + reach) & (x[z] > start - reach) & ~((x[a] == start) & (x[z] == end))))


def neighbours(windows: DataFrame, reach: int = 3) -> DataFrame:
    """(window_id, k, neighbours): other edits of the window nearer than ``reach`` words; the window's spans are an array in the row, so nothing is joined."""
    e = windows.select("window_id", F.col("edits").alias("p"), F.posexplode("edits").alias("k", "e"))
    near = near_spans(F.col("p"), F.col("e.start_word"), F.col("e.end_word"), reach, "start_word", "end_word")
    return e.select("window_id", "k", near.cast("long").alias("neighbours"))


def gold_vs_predicted(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, n_gold, n_predicted, precision, recall of distinct edits, and the share of windows whose edits agree entirely."""
    g, p = gold.select("window_id", *keys).distinct().withColumn("g", F.lit(1)), predicted.select("window_id", *keys).distinct().withColumn("p", F.lit(1))
    both = g.join(p, ["window_id", *keys], "full")
    per = both.groupBy("window_id").agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), F.count("g").alias("n_gold"), F.count("p").alias("n_predicted"))
    return per.agg(
        F.sum("tp").alias("tp"), F.sum("n_gold").alias("n_gold"), F.sum("n_predicted").alias("n_predicted"),
        F.expr("try_divide(sum(tp), sum(n_predicted))").alias("precision"), F.expr("try_divide(sum(tp), sum(n_gold))").alias("recall"),
        F.avg(F.when((F.col("tp") == F.col("n_gold")) & (F.col("tp") == F.col("n_predicted")), 1.0).otherwise(0.0)).alias("exact_windows"),
    )


def unstutter_table(freq: DataFrame, rare: int, common: int) -> DataFrame:
    """(word, fixed): rare words that become common without their doubled first letter."""
    w = freq.filter((F.length("word") >= 3) & (F.substring("word", 1, 1) == F.substring("word", 2, 1)) & (F.col("freq") <= rare)).select("word", F.expr("substring(word, 2)").alias("fixed"))
    return w.join(freq.filter(F.col("freq") >= common).select(F.col("word").alias("fixed")), "fixed").select("word", "fixed")


# Second halves that a glued word is never cut before.
CLITIC_SUFFIXES = "شو شون تون مون مو تو و اتو اشو اش ات ام ها های هاشو هاتون هامون ای ی ه م ت ش".split()


def glue_table(freq: DataFrame, rare: int, common: int, extended: bool = False) -> DataFrame:
    """(word, first, second): rare words that are two common ones; the cut with the most frequent rarer half wins, the earliest of equals.

    ``extended``: words with a half-space are cut too, though not beside it, and a final و may be cut off. Distinct words are cut once, not each
    occurrence, and only both halves' frequencies are joined.
    """
    long = freq.filter((F.length("word") >= 5) & (F.col("freq") <= rare))
    if not extended:
        long = long.filter(~F.contains("word", F.lit(T.ZWNJ)))
    long = long.select("word", F.explode(F.expr(f"sequence(2, length(word) - {1 if extended else 2})")).alias("i"))
    cut = long.select("word", "i", F.expr("substring(word, 1, i)").alias("first"), F.expr("substring(word, i + 1)").alias("second"))
    plain = ~F.col("second").isin(*CLITIC_SUFFIXES) & (F.length("second") > 1)
    if extended:
        beside = F.endswith("first", F.lit(T.ZWNJ)) | F.startswith("second", F.lit(T.ZWNJ))
        plain = ~beside & (plain | (F.col("second") == "و"))
    known = freq.filter(F.col("freq") >= common)
    a, b = known.select(F.col("word").alias("first"), F.col("freq").alias("fa")), known.select(F.col("word").alias("second"), F.col("freq").alias("fb"))
    scored = cut.filter(plain).join(a, "first").join(b, "second").withColumn("score", F.least("fa", "fb"))
    return scored.groupBy("word").agg(F.max_by(F.struct("first", "second"), F.struct("score", -F.col("i"))).alias("x")).select("word", "x.first", "x.second")


def snap_names(rows: DataFrame, freq: DataFrame, least: float = 0.75, rare: int = 20, pair_rare: int = 500) -> DataFrame:
    """(key, start_word, end_word, original, replacement, similarity) of (key, source, names), ``names`` an array of words: parted names, and words that nearly are a name.

    Two neighbours, neither of them a name, that make a name when written together, the rarer said at most ``pair_rare`` times. A word of three letters or more, no name,
    said at most ``rare`` times, whose sound is at least ``least`` like that of a name it doesn't spell; the likeliest name, of equals the last. A parted name takes its two words.
    ``freq``: (word, freq) of the words said more than ``rare`` times; words that look like a name meet it in a join, all else stays in the row.
    """
    none = F.array().cast("array<string>")
    named = rows.select("key", T.words(F.coalesce("source", F.lit(""))).alias("ws"), F.array_distinct(F.coalesce("names", none)).alias("names")).filter(F.size("names") > 0)
    said = named.select("key", "ws", "names", F.posexplode("ws").alias("i", "word")).withColumn("next", F.get("ws", F.col("i") + 1)).drop("ws")
    # a later name of the same letters stands for the earlier
    both = T.squash(F.concat("word", "next"))
    whole = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter("names", lambda n: T.squash(n) == both)), -1)
    free = ~F.array_contains("names", F.col("word")) & ~F.array_contains("names", F.col("next"))
    alike = F.filter(F.transform("names", lambda n: F.struct(T.span_similarity(F.col("word"), n).alias("like"), n.alias("name"))), lambda x: T.squash(x["name"]) != T.squash(F.col("word")))
    best = F.array_max(F.transform(alike, lambda x: F.struct(x["like"].alias("like"), x["name"].alias("name"))))
    near = ~F.array_contains("names", F.col("word")) & (F.length("word") >= 3)
    said = said.select("key", "i", "word", "next", F.when(F.col("next").isNotNull() & free, whole).alias("pair"), F.when(near, best).alias("best"))
    # only what looks like a name is looked up, so no hot word reaches the joins
    said = said.withColumn("best", F.when(F.col("best.like") >= least, F.col("best"))).filter("pair is not null or best is not null")
    told = freq.select(F.col("word").alias("_w"), F.col("freq").alias("_f"))
    said = said.join(told, F.col("word") == F.col("_w"), "left").drop("_w").withColumnRenamed("_f", "f")
    said = said.join(told, F.col("next") == F.col("_w"), "left").withColumns({"f": F.coalesce("f", F.lit(0)), "g": F.coalesce("_f", F.lit(0))})
    hits = said.select("key", "i", "word", "next", F.when(F.least("f", "g") <= pair_rare, F.col("pair")).alias("pair"), F.when(F.col("f") <= rare, F.col("best")).alias("best")).filter("pair is not null or best is not null")
    # in a row of overlapping parted names every other one counts, and a word taken by one is no near miss
    by = Window.partitionBy("key").orderBy("i")
    run = hits.withColumn("fresh", F.coalesce(F.col("pair").isNotNull() & ~((F.lag("pair").over(by).isNotNull()) & (F.lag("i").over(by) == F.col("i") - 1)), F.lit(False)))
    run = run.withColumn("head", F.max(F.when(F.col("fresh"), F.col("i"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("takes", F.col("pair").isNotNull() & ((F.col("i") - F.col("head")) % 2 == 0))
    run = run.withColumn("taken", F.coalesce(F.lag("takes").over(by) & (F.lag("i").over(by) == F.col("i") - 1), F.lit(False)))
    kept = run.filter("takes or (not taken and best is not null)")
    pick = lambda yes, no: F.when(F.col("takes"), yes).otherwise(no)
    return kept.select(
        "key", F.col("i").alias("start_word"), (F.col("i") + pick(F.lit(2), F.lit(1))).alias("end_word"), pick(F.concat_ws(" ", "word", "next"), F.col("word")).alias("original"),
        pick(F.col("pair"), F.col("best.name")).alias("replacement"), pick(F.lit(1.0), F.round("best.like", 3)).alias("similarity"),
    )
