"""All queries of the transcript operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sokhan.plans import editing, files, judging, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**transcripts.QUERIES, **editing.QUERIES, **judging.QUERIES, **files.QUERIES}
SQL: dict[str, str] = {**transcripts.SQL, **editing.SQL, **judging.SQL, **files.SQL}
