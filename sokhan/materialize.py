"""Cutting lineage into the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_PATH = "_cut_path"
_own: dict[str, str] = {}
_ours: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where it is unset, a session on one machine gets a temporary one; on a cluster, whose executors wouldn't share that, it raises."""
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"{_KEY} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="sokhan-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        where = f"file://{_own[app]}"
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _ours:
        atexit.register(_sweep)
    _ours.add(path)
    return path


def _delete(path: str, spark: SparkSession | None) -> None:
    if path.startswith("file:"):
        shutil.rmtree(re.sub(r"^file:/*", "/", path), ignore_errors=True)
    elif spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    """Deletes what is left of this process's cuts; results may read them until then."""
    for path in _ours:
        try:
            _delete(path, SparkSession.getActiveSession())
        except Exception:  # noqa: BLE001  the session may be gone
            pass


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back.

    The copy is on storage that all executors share, so a lost executor costs a re-read, never a recomputation, and plans
    that use ``df`` more than once compute it once. ``discard`` deletes it, or else the end of the process.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def discard(*cuts: DataFrame | None) -> None:
    """Deletes what ``materialize`` wrote for ``cuts``; nothing that reads them may run after. Nulls and other tables are passed over."""
    for df in cuts:
        path = getattr(df, _PATH, None)
        if path:
            _delete(path, df.sparkSession)
            _ours.discard(path)
