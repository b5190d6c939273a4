"""Scratch tables: lineage is cut by a written table in the folder all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and read again.  The folder is ``spark.checkpoint.dir``; a temporary one is
    made only where that is unset, on a single machine; on a cluster that is an error."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|\Z)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quillspark-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    path = f"{base.rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
