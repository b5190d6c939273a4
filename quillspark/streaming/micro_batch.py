"""Normalization of arriving documents.

A document arrives whole, so a batch needs no state: windows over its lines run in
``foreachBatch`` as on a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.plans.normalize import normalize
from quillspark.plans.options import Options


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``(doc_id, text)``, one row per new file."""
    rows = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def normalize_stream(docs: DataFrame, out: str, checkpoint: str, options: Options | None = None, once: bool = True) -> StreamingQuery:
    """Append every batch's changed documents to Parquet, each batch in a folder of its
    own, so that a batch run again replaces what it wrote.  Texts that share an id all stay."""

    def batch(df: DataFrame, number: int) -> None:
        normalize(df, options).filter("changed").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
