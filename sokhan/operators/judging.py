"""Judge logs: latest answers, labels, cascade decisions, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("A", "B", "either", "neither", "unsure")
LABELS = ("real_error", "soniox_wrong", "either_fine", "both_wrong", "uncertain")


def parse_verdict(verdict: Column) -> Column:
    """The verdict in its plain form, null if it is none."""
    v = F.lower(F.regexp_replace(verdict, r'[\s".]', ""))
    return F.when(v.isin("a", "b"), F.upper(v)).when(v.isin("either", "neither", "unsure"), v)


def a_is_whisper(item: Column) -> Column:
    """Which side A shows: the parity of the id's last hex digit."""
    return F.conv(F.substring(item, -1, 1), 16, 10).cast("int") % 2 == 0


def label_of(item: Column, verdict: Column) -> Column:
    """What a verdict means once it is known which side was A: the source's word is wrong, the other recognizer's is, either is fine, both are wrong, or uncertain."""
    whisper_right = ((verdict == "A") & a_is_whisper(item)) | ((verdict == "B") & ~a_is_whisper(item))
    return (
        F.when(verdict.isin("A", "B"), F.when(whisper_right, F.lit("soniox_wrong")).otherwise("real_error"))
        .when(verdict == "either", F.lit("either_fine"))
        .when(verdict == "neither", F.lit("both_wrong"))
        .when(verdict == "unsure", F.lit("uncertain"))
    )


def latest_answers(log: DataFrame, version: str | None = None) -> DataFrame:
    """(id, model, line_no, verdict, label, confidence): the last line with a verdict of each judge for each item, of one prompt version or of all."""
    lines = log if version is None else log.filter(F.col("prompt_version") == version)
    lines = lines.withColumn("v", parse_verdict(F.col("verdict"))).filter("v is not null")
    last = lines.groupBy("id", "model").agg(F.max_by(F.struct("line_no", "v", "confidence"), "line_no").alias("x"))
    return last.select("id", "model", "x.line_no", F.col("x.v").alias("verdict"), label_of(F.col("id"), F.col("x.v")).alias("label"), "x.confidence")


#: Labels that say there is nothing to mend.
REJECTS = ("either_fine", "soniox_wrong")
#: How a judge's reply ends when it ran out of room: asking again with no more room is in vain.
NO_ROOM = "hit max_tokens before answering"


def decide(items: DataFrame, cheap: DataFrame, main: DataFrame, human: DataFrame) -> DataFrame:
    """(id, decision, decided_by) of the items, by labels (id, label) of two judges and of people.

    A person's label settles it: a real error is accepted, a label of REJECTS rejected, any other leaves the item undecided. Else it is accepted if the main judge
    sees a real error that the cheap one doesn't reject, rejected if either judge rejects, undecided otherwise. How sure a judge says it is doesn't matter.
    """
    side = lambda df, n: df.select("id", F.col("label").alias(n))
    j = items.select("id").distinct()
    for df, n in ((cheap, "cheap"), (main, "main"), (human, "human")):
        j = j.join(side(df, n), "id", "left")
    said = lambda n: F.coalesce(n, F.lit("missing"))
    rejects = lambda n: said(n).isin(*REJECTS)
    status = lambda yes, no: F.when(yes, F.lit("accepted")).when(no, F.lit("rejected")).otherwise("undecided")
    judges = status((said("main") == "real_error") & ~rejects("cheap"), rejects("cheap") | rejects("main"))
    people = status(F.col("human") == "real_error", rejects("human"))
    by = F.concat(F.lit("judges ("), said("cheap"), F.lit(" / "), said("main"), F.lit(")"))
    person = F.col("human").isNotNull()
    return j.select("id", F.when(person, people).otherwise(judges).alias("decision"), F.when(person, F.lit("hand label")).otherwise(by).alias("decided_by"))


def route_items(items: DataFrame, cheap: DataFrame, main: DataFrame) -> DataFrame:
    """(id, ask): whom to ask next, cheap first and the main judge only where the cheap one doesn't reject; settled items are left out."""
    j = items.select("id").distinct().join(cheap.select("id", F.col("label").alias("c")), "id", "left").join(main.select("id", F.col("label").alias("m")), "id", "left")
    ask = F.when(F.col("c").isNull(), F.lit("cheap")).when(~F.col("c").isin(*REJECTS) & F.col("m").isNull(), F.lit("main"))
    return j.select("id", ask.alias("ask")).filter("ask is not null")


def final_failures(log: DataFrame, version: str, room: int, most: str | None = None) -> DataFrame:
    """(id, model) of failures by lack of room under ``version`` at ``room`` tokens or more, if the log has them in the column ``most``: a resumed run leaves them out."""
    failed = log.filter((F.col("prompt_version") == version) & (F.col("error") == NO_ROOM))
    return (failed if most is None else failed.filter(F.coalesce(F.col(most), F.lit(0)) >= room)).select("id", "model").distinct()


def parse_reply(reply: Column) -> Column:
    """struct<verdict, confidence> of a judge's reply, the JSON object from its first brace to its last; null if there is none or its verdict isn't one of VERDICTS."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    got = F.from_json(body, "verdict string, confidence string")
    return F.when((body != "") & F.try_parse_json(body).isNotNull() & got["verdict"].isin(*VERDICTS), got)


def shown_spans(item: Column, whisper: Column, soniox: Column) -> Column:
    """struct<a, b>: the two spans in the order in which judges see them; an empty one is shown as a sign."""
    shown = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("∅")).otherwise(c)
    pick = lambda x, y: F.when(a_is_whisper(item), x).otherwise(y)
    return F.struct(pick(shown(whisper), shown(soniox)).alias("a"), pick(shown(soniox), shown(whisper)).alias("b"))


def judge_prompt(item: Column, whisper: Column, soniox: Column, left: Column, right: Column, names: Column) -> Column:
    """What a judge is asked: known names, the context with the place marked, and the two versions."""
    known = F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, F.array_join(names, "، ")).otherwise("(none)")
    spans = shown_spans(item, whisper, soniox)
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Known names: "), known, F.lit("\n\nContext: "), text(left), F.lit(" ⟦ … ⟧ "), text(right), F.lit("\n\nA: "), spans["a"], F.lit("\nB: "), spans["b"])


def merge_labels(*files: DataFrame) -> DataFrame:
    """(id, verdict) of label files (id, verdict), a later file's answer before an earlier one's; empty answers don't count."""
    out = None
    for k, f in enumerate(files):
        one = f.select("id", "verdict", F.lit(k).alias("_k")).filter(F.coalesce("verdict", F.lit("")) != "")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id").agg(F.max_by("verdict", F.struct("_k", "verdict")).alias("verdict"))


def review_set(items: DataFrame, agreed: DataFrame, person: DataFrame) -> DataFrame:
    """(id, agreed, person, why): items (id) that need another look: without a person's label, or with one that differs from what all judges say together (``agreed``, (id, label))."""
    j = items.select("id").distinct().join(agreed.select("id", F.col("label").alias("agreed")), "id", "left").join(person.select("id", F.col("label").alias("person")), "id", "left")
    why = F.when(F.col("person").isNull(), F.lit("unlabelled")).when(F.col("agreed") != F.col("person"), F.lit("disagrees with judges"))
    return j.withColumn("why", why).filter("why is not null")


def filter_effect(items: DataFrame, current: DataFrame, person: DataFrame) -> DataFrame:
    """(now, label, n): what people said of earlier items (id) that filters now leave out by stratum, that are split (not among ``current``, (id, stratum)) or that are still judged."""
    j = items.select("id").distinct().join(person.select("id", "label"), "id").join(current.select("id", "stratum"), "id", "left")
    now = F.when(F.col("stratum").isNull(), F.lit("split")).when(F.col("stratum").isin("style", "filler", "garbled"), F.col("stratum")).otherwise("still judged")
    return j.groupBy(now.alias("now"), "label").agg(F.count("*").alias("n"))


def agreement_by_stratum(person: DataFrame, judge: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, items, agreement) of the items that both labelled; ``strata``: (id, stratum)."""
    both = person.select("id", F.col("label").alias("p")).join(judge.select("id", F.col("label").alias("j")), "id").join(strata.select("id", "stratum"), "id")
    return both.groupBy("stratum").agg(F.count("*").alias("items"), F.avg((F.col("p") == F.col("j")).cast("int")).alias("agreement"))


def confusion(person: DataFrame, judge: DataFrame) -> DataFrame:
    """Counts of the judge's labels by the person's label, for items both labelled."""
    both = person.select("id", F.col("label").alias("person")).join(judge.select("id", F.col("label").alias("judge")), "id")
    return both.groupBy("person").agg(*(F.count_if(F.col("judge") == lab).alias(lab) for lab in LABELS))


def agreement(person: DataFrame, judge: DataFrame) -> DataFrame:
    """One row: items, agreement, precision and recall of real errors, share of uncertain labels of the judge."""
    both = person.select("id", F.col("label").alias("p")).join(judge.select("id", F.col("label").alias("j")), "id")
    return both.agg(
        F.count("*").alias("items"), F.expr("try_divide(count_if(p = j), count(*))").alias("agreement"),
        F.expr("try_divide(count_if(p = 'real_error' and j = 'real_error'), count_if(j = 'real_error'))").alias("real_error_precision"),
        F.expr("try_divide(count_if(p = 'real_error' and j = 'real_error'), count_if(p = 'real_error'))").alias("real_error_recall"),
        F.expr("try_divide(count_if(j = 'uncertain'), count(*))").alias("uncertain_share"),
    )


def unanimous(answers: DataFrame, n_models: int, mixed: str | None = "uncertain") -> DataFrame:
    """(id, label): the label all ``n_models`` judges agree on, else ``mixed``; only items that all judged. ``answers`` has a row per judge and item."""
    g = answers.groupBy("id").agg(F.count("*").alias("n"), F.min("label").alias("l"), F.max("label").alias("h")).withColumn("k", F.when(F.col("l") == F.col("h"), 1).otherwise(2))
    return g.filter(F.col("n") == n_models).select("id", F.when(F.col("k") == 1, F.col("l")).otherwise(F.lit(mixed)).alias("label"))


def judge_stats(log: DataFrame) -> DataFrame:
    """(model, lines, items, failed, distinct errors, cost)."""
    ok = parse_verdict(F.col("verdict")).isNotNull()
    return log.groupBy("model").agg(
        F.count("*").alias("lines"), F.count_distinct("id").alias("items"), F.count_if(~ok).alias("failed"), F.count("error").alias("errors"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd")
    )


def pending(items: DataFrame, answers: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Ids of items without an answer and, if given, without a final failure: what a resumed run still has to ask."""
    left = items.select("id").distinct().join(answers.select("id"), "id", "left_anti")
    return left if failures is None else left.join(failures.select("id"), "id", "left_anti")


def split_of(call: Column, share: float, known: Column | None = None) -> Column:
    """validation for calls whose SHA-1 fraction is below ``share``, else train; a known split stays."""
    fraction = F.conv(F.substring(F.sha1(call), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    drawn = F.when(fraction < share, F.lit("validation")).otherwise("train")
    return drawn if known is None else F.coalesce(known, drawn)
