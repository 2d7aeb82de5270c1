import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from sokhan import settings
from sokhan.operators import assemble, predict, reports
from sokhan.sources import files
from sokhan.streaming import digest


def test_shards_and_splits(spark, tmp_path):
    for name in ("train-b", "train-a", "validation-a"):
        spark.createDataFrame([(name, 1)], "x string, y int").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    pattern = f"{tmp_path}/train*.parquet"
    assert [p.rsplit("/", 1)[1] for p in files.shard_paths(spark, pattern)] == ["train-a.parquet", "train-b.parquet"]
    assert files.read_shards(spark, pattern, ["x"]).columns == ["x"] and files.read_shards(spark, pattern, most=1).first().x == "train-a"
    assert {k: v.count() for k, v in files.read_splits(spark, str(tmp_path)).items()} == {"train": 2, "validation": 1}
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, f"{tmp_path}/none*.parquet")


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2)], "x string, y int")
    files.write_jsonl(df, f"{tmp_path}/out")
    assert sorted(map(tuple, files.read_jsonl(spark, f"{tmp_path}/out", df.schema).collect())) == [("a", None), ("b", 2)]
    (tmp_path / "in.jsonl").write_text('{"x": "q", "z": {"deep": [1]}}\n\n{"x": null}\n')
    assert [r.x for r in files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "x string, z string", ["x"]).collect()] == ["q", None]
    (tmp_path / "bad.jsonl").write_text('{"x": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "x string").collect()


def test_publication_never_overwrites(spark, tmp_path):
    files.publish(spark.range(3), f"{tmp_path}/new")
    with pytest.raises(Exception):
        files.publish(spark.range(4), f"{tmp_path}/new")
    assert spark.read.parquet(f"{tmp_path}/new").count() == 3


def test_metrics_are_replaced_whole(spark, tmp_path):
    for value in (1, 2):
        files.write_metrics(spark, f"{tmp_path}/m.json", {"wer": value, "نام": None})
    assert files.read_metrics(spark, f"{tmp_path}/m.json") == {"wer": 2, "نام": None}
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["m.json"]


def test_token_files(spark, tmp_path):
    token = lambda t, c: {"text": t, "conf": c}
    rec = {"call_id": "c", "channels": {"0": {"tokens": [token("کا", 0.9), token("ویان", 0.2), token(" ،", 0.1), token(" خوب.", 0.3), token(" خوب", 0.41239)]}, "1": {"tokens": []}}}
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        f.write(json.dumps(rec, ensure_ascii=False) + "\n" + json.dumps({"call_id": "d", "channels": {}}) + "\n")
    got = assemble.word_confidence(files.read_tokens(spark, str(tmp_path / "t.json.gz")), 0.5).collect()
    assert {(r.call_id, r.channel, r.word, r.conf) for r in got} == {("c", 0, "کاویان", 0.2), ("c", 0, "خوب", 0.4124)}


def test_rows_for_correction(spark):
    df = spark.createDataFrame([("b", " "), ("a", "x"), ("c", None), ("d", "y")], "k string, t string")
    assert files.load_for_correction(df, "t").count() == 2 and [r.k for r in files.load_for_correction(df, "t", 1, "k").collect()] == ["a"]


def test_settings_precedence_and_types():
    s = settings.load({"data": {"train_fraction": "1e-1", "punctuated": "false"}, "seed": "7"}, data={"seed": 1, "most_repeats": 5}, overrides={"windows": {"window_words": "60"}, "eval": {"thresholds": [0.1]}})
    assert (s.seed, s.most_repeats, s.train_fraction, s.punctuated, s.window_words, s.thresholds) == (7, 5, 0.1, False, 60, (0.1,))
    for bad in ({"data": {"seed": 1}}, {"nothing": 1}, {"punctuated": "maybe"}):
        with pytest.raises(ValueError):
            settings.load(bad)


def test_punctuation_flag_is_checked():
    with pytest.warns(UserWarning):
        settings.load({"target_column": "text_raw"})
    assert settings.check(settings.Settings()) == [] and settings.check(settings.Settings(punctuated=True, target_column="text_raw")) == []


def test_judges_are_asked_again_and_no_row_is_lost(spark):
    def make():
        seen = {}

        def judge(prompts):
            seen[prompts[0]] = seen.get(prompts[0], 0) + 1
            if prompts[0] == "never" or prompts[0] == "later" and seen["later"] < 2:
                raise TimeoutError("no answer")
            return ["ok " + prompts[0]]

        return judge

    df = spark.createDataFrame([("a", "now"), ("b", "later"), ("c", "never"), ("d", None)], "k string, p string").coalesce(1)
    got = {r.k: (r.reply, r.error, r.tries) for r in predict.ask(df, "k", "p", make).collect()}
    assert got == {"a": ("ok now", None, 1), "b": ("ok later", None, 2), "c": (None, "TimeoutError: no answer", 3), "d": ("ok ", None, 1)}


def test_first_word_scores(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", None)], "k string, p string")
    got = {r.k: r.score for r in predict.first_word(df, "p", lambda: lambda ps: [(0.3, 0.1) if p else (0.0, 0.0) for p in ps]).collect()}
    assert got["a"] == pytest.approx(0.75) and got["b"] == 0.0


def test_router_asks_once(spark, tmp_path):
    schema = "id string, label string"
    items = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    for rows in ([("a", "real_error"), ("b", "either_fine"), ("z", "real_error")], [("a", "uncertain"), ("c", "uncertain")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        digest.route_answers(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), items, ("either_fine", "soniox_wrong"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.id, r.asked_in) for r in digest.read_latest(spark, str(tmp_path / "out")).collect()} == {("a", 0), ("c", 1)}


def test_progress_and_probability(spark):
    log = spark.createDataFrame([("2024-01-01 00:00:00", 0.5), ("2024-01-01 00:00:10", 0.1)], "t string, c double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    r = digest.progress(log, 5, "t", "c").first()
    assert (r.done, r.share, r.eta_seconds) == (2, 0.4, 30.0) and r.projected_cost == pytest.approx(1.5)
    assert digest.progress(log.limit(0), 5, "t", "c").first().eta_seconds is None
    w = spark.createDataFrame([(0.2, True), (0.9, False), (0.4, False)], "p_none double, has_edits boolean")
    p = reports.no_edit_probability(w).first()
    assert p.with_edits == pytest.approx(0.2) and p.without_edits == pytest.approx(0.65) and p.auc == 1.0
    assert reports.no_edit_probability(w.filter("has_edits")).first().without_edits == 0.0
    d = reports.describe(w, F.col("p_none")).first()
    assert (d.n, d.least, d.most) == (3, 0.2, 0.9) and d.quartiles[1] == 0.4
