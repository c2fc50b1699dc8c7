"""Structured Streaming over arriving files: the same tables, row by row and without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators import tables
from quire.sources.pdf import stream_pdfs


def stream_table(spark: SparkSession, path: str, kind: str = "info", **options) -> DataFrame:
    """A streaming table of the documents that arrive in a folder; write it with any sink and a checkpoint location."""
    files = stream_pdfs(spark, path).select("path", "content")
    return tables.table(files, kind, keys=["path"], **options)
