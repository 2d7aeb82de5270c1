"""Ranks over groups of which one may hold most of the rows, and over whole tables, without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slices_of(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)


def hash_order(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *keys))


def ranked(df: DataFrame, slice_no: Column, order: list[Column | str], by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 ... inside each group of ``by``, by ``slice_no`` and in it by ``order``.

    Each slice numbers its own rows; they are shifted by the sizes of the slices before it, a row per group and slice.
    """
    sliced = df.withColumn("_s", slice_no)
    sizes = sliced.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*by, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by] + [F.col("a._s") == F.col("b._s")]
    joined = sliced.withColumn("_o", own).alias("a").join(shift.alias("b") if by else F.broadcast(shift).alias("b"), keys)
    return joined.select(*(f"a.{c}" for c in df.columns), (F.col("_o") + F.col("_b")).alias(name))


def hash_rank(df: DataFrame, seed: str, keys: list[str], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of its rows in the order of a hash of ``keys``, in each group of ``by``; slices are ranges of the hash."""
    parts = slices_of(df)
    hashed = df.withColumn("_h", hash_order(seed, *keys))
    slice_no = (F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * parts / 65536).cast("int")
    return ranked(hashed, slice_no, ["_h", *keys], by or [], name).drop("_h")


def rank_within(df: DataFrame, group: str, key: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... inside each ``group``, in an order fixed by the hash of ``key`` (unique in the group)."""
    slice_no = F.pmod(F.xxhash64(key), F.lit(slices_of(df))).cast("int")
    return ranked(df, slice_no, [F.xxhash64(key, F.lit(1)), key], [group], name).withColumn(name, F.col(name) - 1)
