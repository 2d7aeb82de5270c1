"""Evaluation slices: entity rows, typo rows, tagged unions, publication checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sokhan.functions import align as A
from sokhan.functions import text as T

# Kinds of named entities (group, category, subtype) that are kept from an entity file.
ENTITY_TYPES = (
    ("people_org", "personal_info", "family"), ("people_org", "personal_info", "name"), ("people_org", "business", "brand"), ("people_org", "business", "shop_name"),
    ("commerce", "business", "brand"), ("commerce", "product", "name"), ("commerce", "product", "model"), ("commerce", "product", "service"), ("commerce", "product", "plan"),
    ("context", "place", "city"), ("context", "place", "neighborhood"),
)
ENTITY_SCHEMA = "call_id string, groups map<string, struct<group_name: string, entities: array<struct<span: string, category: string, subtype: string, confidence: string>>>>"


def read_entities(spark, path: str, typed: bool = True, least: int = 3) -> DataFrame:
    """(call_id, span) from a folder of one JSON file per call; the file's name stands for a missing call_id. ``typed``: only kinds in ENTITY_TYPES and spans of ``least`` letters or more."""
    files = spark.read.schema(ENTITY_SCHEMA).option("multiLine", True).json(path).withColumn("_f", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    g = files.select(F.coalesce("call_id", "_f").alias("call_id"), F.explode(F.map_values("groups")).alias("g")).select("call_id", "g.group_name", F.explode("g.entities").alias("e"))
    rows = g.select("call_id", "group_name", "e.category", "e.subtype", F.trim("e.span").alias("span")).filter("span != ''")
    if typed:
        kinds = spark.createDataFrame(ENTITY_TYPES, "group_name string, category string, subtype string")
        rows = rows.filter(F.length("span") >= least).join(F.broadcast(kinds), ["group_name", "category", "subtype"], "left_semi")
    return rows.select("call_id", "span").distinct()


def entity_slice(rows: DataFrame, source: str, target: str, names: Column, least: int = 3) -> DataFrame:
    """Rows whose target has a name word, with entity_words (sorted) and whether the source lacks one of them."""
    target_words, source_words = T.words(F.coalesce(F.col(target), F.lit(""))), T.words(F.coalesce(F.col(source), F.lit("")))
    asked = F.array_distinct(F.filter(F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), T.words)), lambda w: F.length(w) >= least))
    out = rows.withColumn("entity_words", F.array_sort(F.array_intersect(asked, target_words)))
    return out.filter(F.size("entity_words") > 0).withColumn("missing_from_source", F.size(F.array_except("entity_words", source_words)) > 0)


def row_classes(rows: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, row_class) of (key, source, target): typo, entity, both or neither.

    A target word in a substitution is a typo if at least ``least`` of its letters occur in what the source has in the whole substitution, else an entity.
    Null texts count as empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    r = rows.select(key, T.words(text("source")).alias("s"), T.words(text("target")).alias("t"), A.align_words(text("target"), text("source")).alias("runs"))
    part = lambda ws, a, z: F.slice(F.col(ws), a + 1, z - a)
    changed = F.filter("runs", lambda c: c["op"] == "substitute")
    shares = F.flatten(F.transform(changed, lambda c: F.transform(part("t", c["ref_start"], c["ref_end"]), lambda w: T.character_overlap(w, F.array_join(part("s", c["hyp_start"], c["hyp_end"]), " ")))))
    typo, entity = F.exists("x", lambda v: v >= least), F.exists("x", lambda v: v < least)
    kind = F.when(typo & entity, F.lit("both")).when(typo, F.lit("typo")).when(entity, F.lit("entity")).otherwise("neither")
    return r.select(key, shares.alias("x")).select(key, kind.alias("row_class"))


def eligibility(least_words: int = 40):
    """Why a window (source, edits) is kept out of training, or "kept": short, or an edit with an empty side. Windows without edits stay, they teach to leave alone."""
    one_sided = F.coalesce(F.exists("edits", lambda e: (F.coalesce(e["original"], F.lit("")) == "") | (F.coalesce(e["replacement"], F.lit("")) == "")), F.lit(False))
    return F.when(T.n_words(F.col("source")) < least_words, F.lit("short")).when(one_sided, F.lit("one-sided edit")).otherwise("kept")


def tagged_union(parts: dict[str, DataFrame], shared: list[str]) -> DataFrame:
    """All parts under each other, their shared columns and ``row_type``; a part without rows raises."""
    out = None
    for name, df in parts.items():
        if df.isEmpty():
            raise ValueError(f"{name} has no rows")
        one = df.select(*shared, F.lit(name).alias("row_type"))
        out = one if out is None else out.unionByName(one)
    return out


def publication_checks(windows: DataFrame) -> DataFrame:
    """(problem, key): window ids that occur twice and calls that are in more than one split."""
    twice = windows.groupBy("window_id").count().filter("count > 1").select(F.lit("duplicate window").alias("problem"), F.col("window_id").alias("key"))
    both = windows.filter("call_id is not null").groupBy("call_id").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    return twice.unionByName(both.select(F.lit("call in two splits").alias("problem"), F.col("call_id").alias("key")))


def published_windows(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """All parts under each other, ready to be published; raises if a window id occurs twice or a call is in two splits."""
    out = None
    for df in parts:
        one = df.select(*columns)
        out = one if out is None else out.unionByName(one)
    problems = publication_checks(out).limit(5).collect()
    if problems:
        raise ValueError("not to be published: " + "; ".join(f"{r.problem} {r.key}" for r in problems))
    return out


def entity_spans(rows: DataFrame, key: str, spans: DataFrame, reference: str, names: Column) -> DataFrame:
    """(key, spans): for each of ``rows`` (key, call_id, reference) the ``names`` words and its call's entity spans (call_id, span) that stand in the reference, leniently; of spans that differ in spacing only the least."""
    per_call = spans.groupBy("call_id").agg(F.collect_set("span").alias("_e"))
    none = F.array().cast("array<string>")
    # the reference's lenient form is made once a row, before the spans part it
    joined = rows.join(per_call, "call_id", "left").select(key, T.padded(T.normalize_lenient(F.coalesce(reference, F.lit("")))).alias("ref"), F.explode(F.array_distinct(F.concat(F.coalesce(names, none), F.coalesce("_e", none)))).alias("span"))
    there = joined.filter(T.padded_has(F.col("ref"), T.normalize_lenient(F.col("span"))))
    one = there.groupBy(key, T.squash(F.col("span")).alias("_k")).agg(F.min("span").alias("span"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list("span")).alias("spans"))


def by_slice(counted: DataFrame, members: dict[str, Column]) -> DataFrame:
    """``counted`` once for each slice that it is in, with the slice's name: a row may be in several."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in members.items())))
    return counted.withColumn("slice", F.explode(named))


def mean_or_all(counted: DataFrame, by: list[str], value: str, slice_name: str, least: int) -> DataFrame:
    """(by, mean, n, used): per group the mean of ``value`` in the slice ``slice_name``, or over all the group's rows if the slice has fewer than ``least``."""
    in_slice = F.col("slice") == slice_name
    g = counted.groupBy(*by).agg(F.count_if(in_slice).alias("k"), F.avg(F.when(in_slice, F.col(value))).alias("a"), F.count("*").alias("m"), F.avg(value).alias("b"))
    enough = F.col("k") >= least
    return g.select(*by, F.when(enough, F.col("a")).otherwise(F.col("b")).alias("mean"), F.when(enough, F.col("k")).otherwise(F.col("m")).alias("n"), F.when(enough, F.lit(slice_name)).otherwise("all").alias("used"))


def lookup_call(rows: DataFrame, call: str) -> DataFrame:
    """All rows of a call."""
    return rows.filter(F.col("call_id") == call)


def lookup_word(rows: DataFrame, text: str, word: str) -> DataFrame:
    """Rows whose text has the word whole."""
    return rows.filter(F.array_contains(T.words(F.coalesce(text, F.lit(""))), word))
