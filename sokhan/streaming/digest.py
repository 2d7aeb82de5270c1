"""Incremental readings: metric files that arrive one by one, and an append-only answer log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, path: str, schema: str, time: str, late: str = "1 hour") -> DataFrame:
    """A stream over the files of a folder, with a watermark on event time."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def window_digest(stream: DataFrame, time: str, width: str, *by: str) -> DataFrame:
    """(window_start, by, n, mean, least) per tumbling window; state is dropped once the watermark passes a window."""
    g = stream.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", "mean", "least")


def first_answers(stream: DataFrame, key: str) -> DataFrame:
    """Each key once, in the order answers arrive, however late a repeat comes: the answers' log is the memory, so its keys are kept in the state store, spread over its partitions."""
    return stream.dropDuplicates([key])


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a query over everything that is there into a parquet folder, exactly once, and stops; a later call goes on where it ended."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)) if fs.exists(p) else []


def _keep_versions(stream: DataFrame, path: str, checkpoint: str, mode: str, merged) -> None:
    """Runs a stream to its end; each batch and the version before it become a new version (``merged(batch, old or None)``). A batch run again writes its own version again."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        done = [v for v in _versions(spark, path) if v < epoch]
        old = spark.read.parquet(f"{path}/version={done[-1]}") if done else None
        merged(batch, old).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a folder of versions."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def latest_windows(windows: DataFrame, keys: list[str], path: str, checkpoint: str) -> None:
    """Keeps every window of an aggregation with its latest figures, those that the watermark hasn't closed included."""

    def merged(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        return batch if old is None else batch.unionByName(old.join(batch.select(*keys), keys, "left_anti"))

    _keep_versions(windows, path, checkpoint, "update", merged)


def best_per_run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Keeps (run, best, at_step) of a stream (run, step, value) in a folder, one new version per batch; the last version holds all."""

    def merged(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        new = batch.groupBy("run").agg(F.min(F.struct("value", "step")).alias("b"))
        if old is not None:
            new = new.unionByName(old.select("run", F.struct(F.col("best").alias("value"), F.col("at_step").alias("step")).alias("b"))).groupBy("run").agg(F.min("b").alias("b"))
        return new.select("run", F.col("b.value").alias("best"), F.col("b.step").alias("at_step"))

    _keep_versions(stream, path, checkpoint, "append", merged)


def route_answers(stream: DataFrame, items: DataFrame, rejects: tuple[str, ...], path: str, checkpoint: str) -> None:
    """A cascade as a stream: each batch of the cheap judge's answers (id, label) sends the items it doesn't reject on to the main judge, in a folder of versions (id, asked_in).

    An item is sent once, whatever is answered later; ``items``: (id), what may be asked at all.
    """

    def merged(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        fresh = batch.filter(~F.col("label").isin(*rejects)).select("id").distinct().join(items.select("id").distinct(), "id", "left_semi")
        if old is None:
            return fresh.withColumn("asked_in", F.lit(0))
        return old.unionByName(fresh.join(old.select("id"), "id", "left_anti").crossJoin(F.broadcast(old.agg((F.max("asked_in") + 1).alias("asked_in")))))

    _keep_versions(stream, path, checkpoint, "append", merged)


def progress(log: DataFrame, total: int, time: str, cost: str) -> DataFrame:
    """One row (done, total, share, cost, seconds, eta_seconds, projected_cost) of an answer log so far; nothing is foretold before the second answer."""
    g = log.agg(F.count("*").alias("done"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), (F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))).alias("us"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    each = lambda c: F.when(F.col("done") > 1, F.col(c) / F.col("done"))
    return g.withColumn("seconds", F.coalesce(F.col("us"), F.lit(0)) / 1e6).select(
        "done", F.lit(total).alias("total"), (F.col("done") / F.lit(max(total, 1))).alias("share"), "cost", "seconds",
        F.when(F.col("done") > 1, F.col("seconds") / (F.col("done") - 1) * left).alias("eta_seconds"), (F.col("cost") + each("cost") * left).alias("projected_cost"),
    )
