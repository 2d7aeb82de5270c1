"""Models as plug-ins, and the correction pipeline over their answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sokhan.functions import align as A
from sokhan.functions import text as T

#: A predictor takes a batch of prompts and gives a text for each.
Predictor = Callable[[list[str]], list[str]]


def predict(df: DataFrame, prompt: str, make: Callable[[], Predictor], batch: int = 32) -> DataFrame:
    """``df`` with ``output``: a model's answer to each prompt. ``make`` builds the predictor once per task; prompts go to it longest first, rows keep their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            order = b[prompt].fillna("").str.len().sort_values(ascending=False, kind="stable").index
            out = pd.Series(index=b.index, dtype=object)
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                out[part] = model(b.loc[part, prompt].fillna("").tolist())
            yield b.assign(output=out)

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", output string")


def from_table(df: DataFrame, answers: DataFrame, prompt: str, order: str) -> DataFrame:
    """``df`` with ``output`` from a table (prompt, output, order) of earlier answers; of several to one prompt the last counts, unknown prompts have null."""
    last = answers.groupBy("prompt").agg(F.max_by("output", order).alias("output"))
    return df.join(last.withColumnRenamed("prompt", prompt), prompt, "left")


def yes_share(yes: Column, no: Column) -> Column:
    """P(yes) / (P(yes) + P(no)), 0 if both are 0."""
    return F.when(yes + no > 0, yes / (yes + no)).otherwise(0.0)


#: A judge of first words takes a batch of prompts and gives for each the chances of two answers, yes and no, or nothing and something.
FirstWord = Callable[[list[str]], list[tuple[float, float]]]


def first_word(df: DataFrame, prompt: str, make: Callable[[], FirstWord], batch: int = 32) -> DataFrame:
    """``df`` with ``yes`` and ``no``, the chances of a model's first word, and ``score``, the share of yes; the model is built once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            prompts = b[prompt].fillna("").tolist()
            got = [pair for i in range(0, len(prompts), batch) for pair in model(prompts[i : i + batch])]
            yield b.assign(yes=[float(y) for y, _ in got], no=[float(n) for _, n in got])

    told = df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", yes double, no double")
    return told.withColumn("score", yes_share(F.col("yes"), F.col("no")))


def ask(df: DataFrame, key: str, prompt: str, make: Callable[[], Predictor], tries: int = 3, wait: float = 0.0) -> DataFrame:
    """(key, reply, error, tries): a judge's reply to each prompt, asked one by one and again after a failure, ``wait`` seconds later and twice as long each time; after the last the error is kept, no row is lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        judge = make()
        for b in batches:
            out = []
            for k, text in zip(b[key], b[prompt]):
                reply, error, n = None, None, 0
                while reply is None and n < tries:
                    if n and wait:
                        time.sleep(wait * 2 ** (n - 1))
                    n += 1
                    try:
                        reply, error = judge([text or ""])[0], None
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                out.append((k, reply, error, n))
            yield pd.DataFrame(out, columns=[key, "reply", "error", "tries"])

    return df.select(key, prompt).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, reply string, error string, tries int")


def change_prompt(original: Column, proposed: Column, left: Column, right: Column, names: Column) -> Column:
    """What a verifier is asked: known names if there are any, the context with the words in question marked, and the change."""
    shown = F.when(F.coalesce(original, F.lit("")) == "", F.lit("∅")).otherwise(original)
    known = F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Known names: "), F.array_join(names, "، "), F.lit("\n"))).otherwise("")
    return F.concat(known, F.lit("Context: "), left, F.lit(" ⟦"), shown, F.lit("⟧ "), right, F.lit("\nProposed change: ⟦"), shown, F.lit("⟧ → ⟦"), proposed, F.lit("⟧"))


def as_item(call: Column, start: Column, end: Column, original: Column, proposed: Column) -> Column:
    """struct<id, call_id, whisper_span, soniox_span, kind, stratum>: a candidate in the form of a difference to be judged."""
    item = T.stable_id(F.lit("audit"), call, start, end, proposed)
    return F.struct(item.alias("id"), call.alias("call_id"), original.alias("whisper_span"), proposed.alias("soniox_span"), F.lit("substitute").alias("kind"), F.lit("audit").alias("stratum"))


def candidates(source: str, rewrite: str, most: int = 4) -> list[A.Edit]:
    """Edits of a rewrite worth scoring: substitutions of at most ``most`` words a side that are no matter of style, filler or number; none if the rewrite stopped early."""
    s, r = source.split(), rewrite.split()
    if len(s) >= 30 and len(r) < 0.3 * len(s):
        return []
    return [
        e for e in A.extract_edits(source, rewrite)
        if e.kind == "substitute" and max(len(e.original), len(e.replacement)) <= most
        and not A.is_style(e.original, e.replacement) and not A.is_filler(e.original, e.replacement) and not A.changes_number(e.original, e.replacement)
    ]


def correct(rows: DataFrame, key: str, score: Callable[[str, A.Edit], float], threshold: float) -> DataFrame:
    """(key, corrected, n_candidates, n_accepted) of (key, source, rewrite): the rewrite's candidates that score at least ``threshold`` are applied."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, s, r in zip(b[key], b.source, b.rewrite):
                found = candidates(s or "", r or "")
                good, _ = A.validate((s or "").split(), [e for e in found if score(k, e) >= threshold])
                out.append((k, A.apply(s or "", good), len(found), len(good)))
            yield pd.DataFrame(out, columns=[key, "corrected", "n_candidates", "n_accepted"])

    return rows.select(key, "source", "rewrite").mapInPandas(run, f"{key} string, corrected string, n_candidates int, n_accepted int")


def trim_loops(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, trimmed, looped): texts whose end repeats one unit of words eight times or more, cut to one copy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [A.trim_loop((t or "").split()) for t in b[text]]
            yield pd.DataFrame({key: b[key], "trimmed": [" ".join(g[0]) for g in got], "looped": [g[1] for g in got]})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, trimmed string, looped boolean")
