"""File sources and sinks: one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.scratch import materialize

#: Folders never searched: any whose path holds one of these.
SKIPPED = ("vendor", "build", ".git", "node_modules")


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(doc_id, text)`` of given files; doc_id is the path."""
    rows = spark.read.text(sorted(paths), wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``(doc_id, text)`` of all matching files below a folder, but for skipped folders."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    parent = F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*\z", "")
    inner = F.substring(parent, F.length(F.lit(folder.rstrip("/"))) + 1, F.length(parent))
    keep = ~inner.rlike("|".join(s.replace(".", r"\.") for s in SKIPPED))
    return rows.filter(keep).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def looks_like_paths(first_line: str) -> bool:
    """Whether a stream's first line names a file rather than being text."""
    from pathlib import Path

    line = first_line.strip()
    return bool(line) and ("/" in line or "\\" in line or line.endswith(".md") or Path(line).exists())


def read_stream_text(spark: SparkSession, text: str) -> DataFrame:
    """Paths, one a line, or else the text itself as one document."""
    lines = text.split("\n")
    if looks_like_paths(lines[0]):
        return read_paths(spark, [x.strip() for x in lines if x.strip()])
    return spark.createDataFrame([("-", text)], "doc_id string, text string")


def overwrite_files(result: DataFrame) -> DataFrame:
    """Rewrite the files of changed documents, whose ``doc_id`` is their path, in any file system
    that Arrow knows; give back how many and, sorted, which.

    A text is written beside its file and then moved over it, so a reader sees the old or the new
    one whole, and a task that runs again writes the same.  The result is read from a scratch
    table: a file must not be read again once it is being rewritten."""
    import pyarrow as pa

    def run(batches):
        from urllib.parse import unquote

        from pyarrow import fs

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, local = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                local = unquote(local)
                with where.open_output_stream(local + ".new") as out:
                    out.write(text.encode())
                where.move(local + ".new", local)
            yield pa.RecordBatch.from_arrays([b.column(0)], ["doc_id"])

    changed = materialize(result.filter("changed").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "changed")
    done = materialize(changed.mapInArrow(run, "doc_id string"), "overwritten")
    return done.agg(F.count(F.lit(1)).alias("modified"), F.sort_array(F.collect_list("doc_id")).alias("documents"))


def write_changed(result: DataFrame, path: str) -> DataFrame:
    """Write changed documents; give back how many and, sorted, which."""
    changed = result.filter("changed")
    changed.select("doc_id", "text").write.mode("overwrite").parquet(path)
    return changed.agg(F.count(F.lit(1)).alias("modified"), F.sort_array(F.collect_list(F.col("doc_id").cast("string"))).alias("documents"))
