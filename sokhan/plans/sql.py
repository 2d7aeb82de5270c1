"""Pieces of SQL that several queries' SQL share."""

from __future__ import annotations

from sokhan.functions import text as T

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{_SPACE}'), lambda w: w <> '')"


def fraction(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE)"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def last_delivered(name: str, table: str, key: str, when: str, ties: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {when} DESC, md5(concat_ws(chr(31), {ties}))) AS rn FROM {table}) WHERE rn = 1)"


SEG = last_delivered("seg", "segments", "id", "ingested_at", "text_whisper, text_raw, text")
USABLE = "use AS (SELECT * FROM seg WHERE bucket_name IS DISTINCT FROM 'unpaired' AND coalesce(text_whisper, '') <> '')"
CALLS = last_delivered("calls", "call_meta", "id", "synced_at", "client_metadata_json")
WIN = last_delivered("win", "train", "window_id", "built_at", "source")
PRED = last_delivered("pred", "predictions", "pred_id", "created_at", "output")
SHARED = "list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w)))))"
NUMBER = f"(regexp_matches(w, '[0-9۰-۹]') OR list_contains([{quoted(T.NUMBER_WORDS)}], trim(w, '{T.ZWNJ}')))"


def squash(t: str) -> str:
    return f"replace(replace({t}, ' ', ''), '{T.ZWNJ}', '')"


EDITS = f"""ed AS (SELECT window_id, call_id, k - 1 AS k, e.start_word AS start_word, e.end_word AS end_word, {words("coalesce(e.original, '')")} AS original,
    {words("coalesce(e.replacement, '')")} AS replacement, e.stratum AS stratum, e.decided_by AS decided_by, e.diff_id AS diff_id
  FROM (SELECT window_id, call_id, unnest(edits) AS e, generate_subscripts(edits, 1) AS k FROM win))"""

VERDICT = r"""regexp_replace(verdict, '[\s".]', '', 'g')"""
PARSED = f"CASE WHEN lower({VERDICT}) IN ('a', 'b') THEN upper({VERDICT}) WHEN lower({VERDICT}) IN ('either', 'neither', 'unsure') THEN lower({VERDICT}) END"
EVEN = "CAST('0x' || right(id, 1) AS INTEGER) % 2 = 0"
LABEL = f"""CASE WHEN v IN ('A', 'B') THEN CASE WHEN (v = 'A') = ({EVEN}) THEN 'soniox_wrong' ELSE 'real_error' END
  WHEN v = 'either' THEN 'either_fine' WHEN v = 'neither' THEN 'both_wrong' WHEN v = 'unsure' THEN 'uncertain' END"""
ANSWERS = f"""ans AS (SELECT id, model, line_no, v AS verdict, {LABEL} AS label, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY id, model ORDER BY line_no DESC) AS rn FROM (SELECT *, {PARSED} AS v FROM judge_items) WHERE v IS NOT NULL) WHERE rn = 1)"""
SCORED = f"""scored AS (SELECT l.line_no, l.id, l.model, {fraction("'score:' || l.id || ':' || l.model || ':' || l.line_no")} AS score, l.v = 'A' AS positive,
    CASE WHEN l.v = 'A' THEN 1 WHEN l.v = 'B' THEN -1 ELSE 0 END AS effect FROM (SELECT *, {PARSED} AS v FROM judge_items) l WHERE l.v IS NOT NULL)"""
SERIES = "series AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value, event_type AS tag FROM events)"
