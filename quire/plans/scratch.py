"""Written intermediate tables, below the shared checkpoint folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def write_table(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quire_scratch", None)
    if not folder:  # only where none is set, as in tests
        folder = spark._quire_scratch = "file://" + tempfile.mkdtemp(prefix="quire-")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
