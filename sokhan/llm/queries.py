"""The queries of the ten training-data problems, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sokhan.llm.canonical import canonical_changes
from sokhan.llm.consensus import Consensus
from sokhan.llm.defects import Defects
from sokhan.llm.grouping import call_groups, call_splits
from sokhan.llm.mixing import Mixture
from sokhan.llm.names import link_names, mentions
from sokhan.llm.overlap import Overlaps
from sokhan.llm.packing import pack_all, pack_report
from sokhan.llm.reading import ReadingLevels
from sokhan.llm.splitting import split_oversized
from sokhan.llm.tokens import sized
from sokhan.sources.tables import table


def _keyed(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.lit(source).alias("source"), F.col(text).alias("text"))


def _overlaps(spark: SparkSession, d: str) -> Overlaps:
    windows, answers = table(spark, d, "train"), table(spark, d, "predictions")
    evaluation = _keyed(windows.filter("split = 'validation'"), "window_id", "validation", "source").unionByName(_keyed(answers, "pred_id", "predictions", "input"))
    return Overlaps(evaluation, _keyed(windows.filter("split = 'train'"), "window_id", "train", "source"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train window and an evaluation record that are the same or nearly so."""
    a, b = F.col("train_key"), F.col("eval_key")
    return _overlaps(spark, d).pairs().select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).distinct()


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each evaluation record by passages found in training texts."""
    return _overlaps(spark, d).coverage()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs per split and source."""
    return _overlaps(spark, d).report()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus verdict of each item."""
    return Consensus(table(spark, d, "judge_items")).items().select("id", "verdict")


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    """Consensus, confidence and agreement per item."""
    return Consensus(table(spark, d, "judge_items")).items()


def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of each registered judge; those without a usable label have none."""
    return table(spark, d, "judge_registry").select("model", "kind").join(Consensus(table(spark, d, "judge_items")).annotators(), "model", "left")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken answers with their first defect."""
    return Defects(table(spark, d, "predictions")).first()


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    """All defects of all answers."""
    return Defects(table(spark, d, "predictions")).labels()


def _long_fields(spark: SparkSession, d: str) -> DataFrame:
    field = lambda name, t, key, text: t.select(F.lit(name).alias("field_name"), F.col(key).alias("item_id"), F.col(text).alias("text"))
    return field("segments.text_whisper", table(spark, d, "segments"), "id", "text_whisper").unionByName(field("train.source", table(spark, d, "train"), "window_id", "source"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be split."""
    return split_oversized(_long_fields(spark, d), table(spark, d, "size_limits")).select("field_name", "item_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all oversized items."""
    return split_oversized(_long_fields(spark, d), table(spark, d, "size_limits"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored values that aren't in the consistent form."""
    return canonical_changes(table(spark, d, "segments"), "id", ["text", "text_whisper"]).select("id", "field_name").distinct()


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Changed values with their consistent form."""
    return canonical_changes(table(spark, d, "segments"), "id", ["text", "text_whisper"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Calls in groups of two or more."""
    return call_groups(table(spark, d, "call_meta"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every call with its group and split."""
    targets = [(r.split, r.target_share) for r in table(spark, d, "split_targets").collect()]
    return call_splits(table(spark, d, "call_meta"), table(spark, d, "train"), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of registered people and firms."""
    return link_names(mentions(table(spark, d, "call_meta"), table(spark, d, "train")), table(spark, d, "crm_people"))


def _capacities(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r.pack_name, r.capacity_tokens) for r in table(spark, d, "pack_sizes").orderBy("capacity_tokens").collect()]


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every document in packs of each capacity."""
    return pack_all(sized(table(spark, d, "documents")), _capacities(spark, d))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Packs and used room per capacity."""
    return pack_report(p8_packs(spark, d), _capacities(spark, d))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    targets = [(r.source_name, r.target_share, r.max_repeats) for r in table(spark, d, "mix_targets").collect()]
    return Mixture(sized(table(spark, d, "documents")), targets)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Drawn documents with their number of copies."""
    return _mixture(spark, d).draw()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares per source."""
    return _mixture(spark, d).report()


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Raked and actual shares of sources, languages and topics."""
    return _mixture(spark, d).marginals()


def _levels(spark: SparkSession, d: str) -> ReadingLevels:
    return ReadingLevels(table(spark, d, "documents"), table(spark, d, "grade_samples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The grade of every Persian document of at least 20 words."""
    return _levels(spark, d).levels().select("doc_id", "grade")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Grade, mean level and certainty per document."""
    return _levels(spark, d).levels()


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean level per grade."""
    return _levels(spark, d).profile()


def p1_equal(spark: SparkSession, d: str) -> DataFrame:
    """Those pairs of p1_found whose stored texts are equal."""
    w, p = table(spark, d, "train"), table(spark, d, "predictions")
    texts = w.select(F.col("window_id").alias("k"), F.xxhash64("source").alias("h"), F.md5("source").alias("m")).unionByName(p.select(F.col("pred_id").alias("k"), F.xxhash64("input").alias("h"), F.md5("input").alias("m"))).distinct()
    a, b = (texts.select(F.col("k").alias(f"id_{x}"), "h", "m") for x in "ab")
    return p1_found(spark, d).join(a, "id_a").join(b, ["id_b", "h", "m"]).select("id_a", "id_b").distinct()


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Labels and agreement per item."""
    return Consensus(table(spark, d, "judge_items")).items().select("id", "n_labels", F.round("agreement", 9).alias("agreement"))


def p2_judges(spark: SparkSession, d: str) -> DataFrame:
    """Usable labels of each registered judge, none for those without, and whether a reliability came out."""
    return p2_annotators(spark, d).select("model", "kind", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce(F.col("reliability").between(0, 1), F.lit(False)).alias("rated"))


def p3_empty(spark: SparkSession, d: str) -> DataFrame:
    """Answers without a letter or digit, refusals among them."""
    return Defects(table(spark, d, "predictions")).labels().filter("defect = 'empty'").select("pred_id").distinct()


def p4_whole(spark: SparkSession, d: str) -> DataFrame:
    """Per field the items cut, the characters of their pieces without overlaps, and the pieces over the limit: none."""
    limits = table(spark, d, "size_limits").select("field_name", "max_chars")
    p = p4_pieces(spark, d).join(F.broadcast(limits), "field_name")
    return p.groupBy("field_name").agg(F.count_distinct("item_id").alias("items"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"), F.count_if(F.length("piece") > F.col("max_chars")).alias("over"))


def p5_arabic_digits(spark: SparkSession, d: str) -> DataFrame:
    """Those values of p5_found that hold an Arabic digit, and that none does in its consistent form."""
    c = p5_canonical(spark, d).filter(F.col("value").rlike("[٠-٩]"))
    return c.groupBy("id", "field_name").agg(F.count_if(F.col("canonical").rlike("[٠-٩]")).alias("kept"))


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """One row: calls with a split, their windows, and groups in more than one split: none."""
    s = p6_splits(spark, d)
    torn = s.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    return s.agg(F.count("call_id").alias("calls"), F.sum("n_windows").alias("windows")).crossJoin(torn)


def p7_exact(spark: SparkSession, d: str) -> DataFrame:
    """Those mentions of p7_found that are spelled as in the register."""
    m, register = mentions(table(spark, d, "call_meta"), table(spark, d, "train")), table(spark, d, "crm_people")
    found = link_names(m, register).join(m, ["record_id", "mention_no"])
    return found.join(register.select("person_id", F.col("full_name").alias("name")), ["person_id", "name"]).select("record_id", "mention_no", "person_id").distinct()


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity the documents packed, packs over it, documents divided though they'd fit, pieces missing or twice: all none."""
    sizes = spark.createDataFrame(_capacities(spark, d), "pack_name string, capacity int")
    p = p8_packs(spark, d).join(F.broadcast(sizes), "pack_name")
    full = p.groupBy("pack_name", "pack_id").agg(F.sum("length").alias("used"), F.first("capacity").alias("capacity"))
    over = full.groupBy("pack_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("over"))
    docs = p.groupBy("pack_name", "doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("t"), F.max(F.col("start") + F.col("length")).alias("end"), F.first("capacity").alias("capacity"))
    each = docs.groupBy("pack_name").agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("divided"), F.count_if(F.col("t") != F.col("end")).alias("odd"))
    return each.join(over, "pack_name").select("pack_name", "documents", "over", "divided", "odd")


def p9_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per target whether its share was reached to two points among those with documents, and the documents repeated too often: none."""
    m = _mixture(spark, d)
    top = spark.createDataFrame([(n, r) for n, _, r in m.targets], "source_name string, most int")
    many = m.draw().join(F.broadcast(top), "source_name").groupBy("source_name").agg(F.count_if(F.col("copies") > F.col("most")).alias("too_many"))
    r = m.report()
    there = r.filter("available_tokens > 0").agg(F.sum("target_share").alias("whole"))
    near = (F.col("available_tokens") > 0) & (F.abs(F.col("actual_share") - F.col("target_share") / F.col("whole")) <= 0.02)
    return r.crossJoin(F.broadcast(there)).join(many, "source_name", "left").select("source_name", near.alias("reached"), F.coalesce("too_many", F.lit(0)).alias("too_many"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_coverage, p1_report, p2_found, p2_items, p2_annotators, p3_found, p3_labels, p4_found, p4_pieces, p5_found, p5_canonical, p6_found, p6_splits, p7_found, p8_packs, p8_report, p9_mix, p9_report, p9_marginals, p10_found, p10_levels, p10_profile, p1_equal, p2_agreement, p2_judges, p3_empty, p4_whole, p5_arabic_digits, p6_sound, p7_exact, p8_sound, p9_sound)
}

_CODE = lambda path: f"upper(regexp_replace(translate(json_extract_string(j, '{path}'), '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
_DIGITS = lambda c, k: f"len(list_distinct(string_split(substr({c}, {k}), ''))) > 1"

_VERDICT = "lower(regexp_replace(verdict, '[^\\p{L}]', '', 'g'))"
_LABELS = f"""lab AS (SELECT id, model, arg_max(v, line_no) AS v FROM (SELECT id, model, line_no, {_VERDICT} AS v FROM judge_items) WHERE v IN ('a', 'b', 'either', 'neither', 'unsure') AND id IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2),
    use AS (SELECT * FROM lab WHERE v <> 'unsure')"""
_MENTIONS = """m AS (SELECT DISTINCT record_id, mention_no, name FROM (
        SELECT id AS record_id, 0 AS mention_no, json_extract_string(client_metadata_json, '$.customer.name') AS name FROM call_meta WHERE json_valid(client_metadata_json)
        UNION ALL SELECT id, 1, json_extract_string(client_metadata_json, '$.crm.owner_name') FROM call_meta WHERE json_valid(client_metadata_json)
        UNION ALL SELECT window_id, generate_subscripts(crm_names, 1) - 1, unnest(crm_names) FROM train))"""
_FIELDS = "f AS (SELECT DISTINCT 'segments.text_whisper' AS field_name, id AS item_id, text_whisper AS t FROM segments UNION SELECT DISTINCT 'train.source', window_id, source FROM train)"

SQL: dict[str, str] = {
    "p6_found": f"""
        WITH RECURSIVE raw AS (SELECT DISTINCT id, CASE WHEN json_valid(client_metadata_json) THEN client_metadata_json END AS j FROM call_meta),
        flag AS (SELECT id, j, j IS NOT NULL AND (json_extract(j, '$.filler') IS NOT NULL OR coalesce(starts_with(json_extract_string(j, '$.call.request_id'), 'probe'), false)) AS unreal FROM raw),
        k AS (SELECT id, unreal, {_CODE('$.customer.account')} AS a, {_CODE('$.crm.case_no')} AS c, lower(trim(json_extract_string(j, '$.call.parent_id'))) AS p FROM flag),
        r AS (SELECT * FROM k WHERE NOT unreal),
        e AS (SELECT x.id AS u, y.id AS v FROM r x JOIN r y ON x.a = y.a WHERE regexp_full_match(x.a, 'AC[0-9]{{4,}}') AND {_DIGITS('x.a', 3)}
              UNION SELECT x.id, y.id FROM r x JOIN r y ON x.c = y.c WHERE regexp_full_match(x.c, 'CS[0-9]{{8,}}') AND {_DIGITS('x.c', 7)}
              UNION SELECT x.id, y.id FROM r x JOIN k y ON x.p = lower(trim(y.id)) UNION SELECT y.id, x.id FROM r x JOIN k y ON x.p = lower(trim(y.id))),
        reach AS (SELECT DISTINCT u AS id, u AS root FROM e UNION SELECT e.v, reach.root FROM reach JOIN e ON reach.id = e.u)
        SELECT id AS call_id, min(root) AS group_id FROM reach GROUP BY id HAVING count(*) > 1""",
    "p4_found": """
        SELECT DISTINCT l.field_name, i.item_id
        FROM (SELECT 'segments.text_whisper' AS field_name, id AS item_id, text_whisper AS t FROM segments
              UNION ALL SELECT 'train.source', window_id, source FROM train) i
        JOIN size_limits l USING (field_name) WHERE length(i.t) > l.max_chars""",
    "p1_equal": """
        WITH tr AS (SELECT DISTINCT window_id AS k, source AS t FROM train WHERE split = 'train'), ev AS (SELECT DISTINCT window_id AS k, source AS t FROM train WHERE split = 'validation' UNION SELECT DISTINCT pred_id, input FROM predictions)
        SELECT DISTINCT least(tr.k, ev.k) AS id_a, greatest(tr.k, ev.k) AS id_b FROM tr JOIN ev ON tr.t = ev.t WHERE regexp_matches(tr.t, '[\\p{L}\\p{N}]')""",
    "p2_agreement": f"""
        WITH {_LABELS}, n AS (SELECT id, v, count(*) AS c FROM use GROUP BY 1, 2)
        SELECT id, sum(c)::BIGINT AS n_labels, round(sum(c * (c - 1)) / nullif(sum(c) * (sum(c) - 1), 0), 9)::DOUBLE AS agreement FROM n GROUP BY 1""",
    "p2_judges": f"""
        WITH {_LABELS}, n AS (SELECT model, count(*) AS c FROM use GROUP BY 1) SELECT r.model, r.kind, coalesce(c, 0) AS n_labels, c IS NOT NULL AS rated FROM judge_registry r LEFT JOIN n ON r.model = n.model""",
    "p3_empty": "SELECT DISTINCT pred_id FROM predictions WHERE pred_id IS NOT NULL AND NOT regexp_matches(coalesce(output, ''), '[\\p{L}\\p{N}]')",
    "p4_whole": f"""
        WITH {_FIELDS} SELECT l.field_name, count(DISTINCT item_id) AS items, sum(length(t))::BIGINT AS chars, 0 AS over FROM f JOIN size_limits l USING (field_name) WHERE length(t) > max_chars GROUP BY 1""",
    "p5_arabic_digits": """
        SELECT DISTINCT id, unnest(['text', 'text_whisper']) AS field_name, 0 AS kept FROM segments WHERE false
        UNION SELECT DISTINCT id, 'text', 0 FROM segments WHERE regexp_matches(text, '[٠-٩]') UNION SELECT DISTINCT id, 'text_whisper', 0 FROM segments WHERE regexp_matches(text_whisper, '[٠-٩]')""",
    "p6_sound": """
        SELECT (SELECT count(DISTINCT id) FROM call_meta) AS calls, (SELECT count(*) FROM (SELECT DISTINCT window_id, call_id FROM train WHERE call_id IN (SELECT id FROM call_meta))) AS windows, 0 AS torn""",
    "p7_exact": f"WITH {_MENTIONS} SELECT DISTINCT record_id, mention_no, person_id FROM m JOIN crm_people ON name = full_name WHERE record_id IS NOT NULL",
    "p8_sound": "SELECT pack_name, (SELECT count(*) FROM documents WHERE coalesce(text, '') <> '') AS documents, 0 AS over, 0 AS divided, 0 AS odd FROM pack_sizes",
    "p9_sound": """
        WITH s AS (SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS n FROM documents WHERE coalesce(text, '') <> '') SELECT source_name, source_name IN (SELECT n FROM s WHERE n IS NOT NULL) AS reached, 0 AS too_many FROM mix_targets""",
}
