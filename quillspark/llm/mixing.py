"""Mixing sources to target weights by systematic sampling.

Sources share the corpus's words by weight, each up to a multiple of what it has.  Within a
source every document expects ``target / source_size`` copies.  Documents are put in order
of size, expected copies are summed along that order, one random offset per source is
added, and a document is emitted once for every integer that its step crosses.  Sorting by
size first keeps the words taken within about one document's size of the target.

The running sum over a source of any size needs no task that sees the whole source: rows
are range-partitioned by (source, size, ...), positions inside a partition come from
``monotonically_increasing_id`` and only per-partition counts are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, small_enough, stored, table, word_count

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: words that each should give.

    Weights repeat along sources in code-point order, null last.  All words are shared by
    weight; a share stops at ``cap`` times the source's size and its excess is shared
    again.  In order of cap per weight, the sources before some place are all at their
    cap, those from it on get one common rate, so two running sums replace the rounds.
    One row per source is all that this ever sorts.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("limit_rate", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    order = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    s = sources.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), order + 1))
    s = s.withColumn("most", cap * F.col("source_size")).withColumn("limit_rate", F.col("most") / F.col("w"))
    s = s.withColumn("open", F.sum("source_size").over(every) - F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most"))
    s = s.withColumn("w_open", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("free", F.col("open") * F.col("w") <= F.col("most") * F.col("w_open"))
    first = F.min(F.when(F.col("free"), F.struct("limit_rate", F.col("source").isNull(), "source", "open", "w_open"))).over(every)
    s = s.withColumn("first", first)
    past = (F.col("limit_rate") > F.col("first.limit_rate")) | ((F.col("limit_rate") == F.col("first.limit_rate")) & (F.col("source").isNull() | (F.col("source") >= F.col("first.source"))))
    share = (F.col("first.open") * F.col("w")).cast("double") / F.col("first.w_open")
    return s.select("source", "source_size", F.when(F.coalesce(past, F.lit(False)), share).otherwise(F.col("most").cast("double")).alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """The source's one random offset in [0, 1), from a hash of the seed and its name."""
    head = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, carry: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` and, in a struct ``row``, the ``carry``
    columns, whatever their names.

    Within a source all documents expect the same number of copies, ``target / source_size``, so
    that the prefix sum of expected copies is a document's place times that rate.

    A null or empty text has size 0; a source without words has target 0 and its rows get
    no copies; a null source is a source of its own, last in order; equal rows are each
    placed; other columns do not matter.  The order within a source is size, doc_id (null
    first), then the text's hash, so that reruns agree.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.md5(F.coalesce("text", F.lit(""))).alias("_tie"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []))
    base = stored(base, "mix_sizes")
    keys = [F.col("_source").asc_nulls_first(), "_size", "_id", "_tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.drop("_tie"), "mix_order").withColumn("_part", F.shiftright("_at", 33))
    discard(base)
    held = ranged.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.sum("_size").alias("words"))
    held = stored(held, "mix_parts")
    sizes = held.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    share = targets(sizes, weights, cap).withColumnRenamed("source", "s_source")
    upto = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    place = held.withColumn("before", F.sum("n").over(upto) - F.col("n")).join(share, F.col("_source").eqNullSafe(F.col("s_source")))
    place = place.select(F.col("_source").alias("p_source"), F.col("_part").alias("p_part"), "first", "before", "source_size", "target")
    if small_enough(held, 100_000):  # a row per partition and per source
        place = F.broadcast(place)
    out = ranged.join(place, F.col("_source").eqNullSafe(F.col("p_source")) & (F.col("_part") == F.col("p_part")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("before") + F.col("_at") - F.col("first") + 1
    u = offset(F.col("_source"), seed)
    copies = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"), *(["row"] if carry else []))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of ``documents``: the words taken of each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS tie FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS w FROM d GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS most, 3 * source_size / w AS rate,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS open,
    (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_open,
    row_number() OVER o AS place
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST)
), f AS (
  SELECT min(place) AS place, arg_min(open, place) AS open, arg_min(w_open, place) AS w_open FROM c WHERE open * w <= most * w_open
), t AS (
  SELECT c.source, c.source_size, CASE WHEN c.place >= f.place THEN (f.open * c.w)::DOUBLE / f.w_open ELSE c.most::DOUBLE END AS target,
    ('0x' || substr(md5('mix-1:' || coalesce(c.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM c LEFT JOIN f ON true
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST, d.tie) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(k * rate + u) - floor((k - 1) * rate + u)))::BIGINT AS taken FROM r
"""
