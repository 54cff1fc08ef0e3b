"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which a cluster shares; where that is unset a temporary
    one on a single machine, and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _local["top"] = _local.get("top") or tempfile.mkdtemp(prefix="sluice-")
    return f"{top.rstrip('/')}/sluice-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to scratch and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

