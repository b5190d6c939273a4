"""Shared scratch tables, per-worker caches and small column helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``.  Only where that is
    unset on a single machine (tests) is a temporary folder made; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|\Z)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quillspark-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a scratch table and return a reader of it: lineage ends here,
    and an executor lost later costs only the tasks that read the table."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def worker_cache(key: str, build: Callable[[], object]) -> object:
    """Build something once per Python worker process (tokenizers, tables)."""
    store = sys.modules.setdefault("_quillspark_worker", types.ModuleType("_quillspark_worker"))
    if not hasattr(store, key):
        setattr(store, key, build())
    return getattr(store, key)


def lean(run: Callable) -> Callable:
    """A function over Arrow batches that hands memory back when its task ends.

    Spark keeps Python workers for later tasks; what they have freed but still hold would
    add up over the stages of a job.
    """

    def wrapped(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_enough(df: DataFrame, rows: int, size: int = 32_000_000) -> bool:
    """Whether a table has at most ``rows`` rows of at most ``size`` bytes in all, read no further
    than those rows.  An array's entry counts 32 bytes."""
    each = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        each += F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 32 if kind.startswith("array") else F.lit(0), F.lit(0)) + 8
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and total <= size
