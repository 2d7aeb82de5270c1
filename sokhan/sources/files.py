"""Files in and out: shards, JSON lines, recognizers' tokens, publication into a new folder, small metric files written whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TOKENS = "call_id string, channels map<string, struct<tokens: array<struct<text: string, conf: double>>>>"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shard_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that meet a glob pattern, in order."""
    fs, p = _fs(spark, pattern)
    return sorted(str(s.getPath()) for s in fs.globStatus(p) or [])


def read_shards(spark: SparkSession, pattern: str, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Parquet shards of a glob pattern, ``columns`` only; of the first ``most`` shards in order, if given. Raises if there are none."""
    paths = shard_paths(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    df = spark.read.parquet(*(paths if most is None else paths[:most]))
    return df if columns is None else df.select(*columns)


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> dict[str, DataFrame]:
    """The splits of a folder of shards, told by how their names begin; splits without shards are left out."""
    found = {s: shard_paths(spark, f"{folder}/{s}*.parquet") for s in splits}
    return {s: spark.read.parquet(*paths) for s, paths in found.items() if paths}


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, columns: list[str] | None = None) -> DataFrame:
    """JSON lines with a given schema, so that nothing is guessed from the data; blank lines are passed over, fields that a line lacks are null, a line that is no JSON raises."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    df = spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    return df if columns is None else df.select(*columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines into a new folder, nulls written out."""
    df.write.option("ignoreNullFields", "false").json(path)


def publish(df: DataFrame, path: str) -> None:
    """Parquet into a folder that must not be there yet: what is published is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def write_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    """A small JSON file, written beside its place and then moved there, so that a reader sees the old one or the new one."""
    fs, p = _fs(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(json.dumps(metrics, ensure_ascii=False, indent=1, sort_keys=True).encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(aside, p):
        raise OSError(f"{aside} could not be moved to {path}")


def read_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, channel, pos, token, conf) of a recognizer's token files, a JSON record per call, gzipped or not. ``pos`` is as ``assemble.word_confidence`` takes it; a channel's first token opens a word."""
    calls = spark.read.schema(TOKENS).json(path)
    per = calls.select("call_id", F.explode("channels").alias("channel", "c")).select("call_id", F.col("channel").cast("int").alias("channel"), F.posexplode("c.tokens").alias("i", "t"))
    opens = F.when(F.col("i") == 0, F.concat(F.lit(" "), F.ltrim("t.text"))).otherwise(F.col("t.text"))
    pos = F.struct(F.lit(0.0).alias("start_sec"), F.lit("").alias("id"), F.col("i"), F.lit(0).alias("k"))
    return per.select("call_id", "channel", pos.alias("pos"), opens.alias("token"), F.col("t.conf").alias("conf"))


def load_for_correction(rows: DataFrame, text: str, most: int | None = None, order: str | None = None) -> DataFrame:
    """Rows with something in ``text``; with ``most``, so many of them in the order of ``order`` (a head limit)."""
    kept = rows.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    return kept if most is None else kept.orderBy(order or text).limit(most)
