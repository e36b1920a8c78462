"""Contiguous shards of near-equal bytes from global prefix sums.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import delete, new_path, temporary, unused, written

#: Bytes that every record takes beside its text.
OVERHEAD = 8


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32); a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def byte_shards(rows: DataFrame, shards: int, key: str = "doc_id", size: str = "size") -> DataFrame:
    """Adds shard (0 to shards-1) and slot (gapless from 0) to ``rows``.

    Rows are ordered by ``key`` (nulls first; rows of one key in the order
    read) and dealt to range partitions. The partitions' totals give each one
    the bytes and rows before it; a running sum inside it makes these global.
    The byte scale is cut at equal targets: a row belongs to the shard that
    its middle byte falls into, so a shard's size is off the mean by less than
    its two outermost rows. The read order is part of the range key, so a key
    or text that fills a third of the table still spreads over partitions.

    Repeated rows are rows of their own, an empty table gives no rows, one row
    may outgrow its shard (shards then stay empty), and columns of ``rows`` of
    any name but shard and slot are kept.
    """
    seq, part, before, ahead, total = (unused(rows, x) for x in ("seq", "part", "before", "ahead", "total"))
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range sampling reads its input twice, and row numbers must agree: only measured rows are read again
    with temporary(spark) as keep:
        numbered, _ = written(rows.withColumn(seq, F.monotonically_increasing_id()), "measured")
        dealt = numbered.repartitionByRange(n, F.col(key).asc_nulls_first(), seq)
        dealt, p = written(dealt.withColumn(part, F.spark_partition_id()), "ranges")
        keep(p)
    # one row per partition: their number is set by the session, not the data
    over = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(F.sum(size).alias("b"), F.count("*").alias("r"))
    totals = totals.select(
        part,
        F.coalesce(F.sum("b").over(over), F.lit(0)).alias(before),
        F.coalesce(F.sum("r").over(over), F.lit(0)).alias(ahead),
        F.sum("b").over(Window.partitionBy()).alias(total),
    )
    inside = Window.partitionBy(part).orderBy(F.col(key).asc_nulls_first(), seq).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.join(F.broadcast(totals), part)
        .withColumn(before, F.col(before) + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn(ahead, F.col(ahead) + F.count("*").over(inside))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * `{before}` + `{size}`) * {int(shards)}L div (2 * `{total}`)")).cast("int"))
        .drop(total, before, part, seq)
    )
    placed, _ = written(placed, "placed")
    delete(spark, p)
    # at most one row per shard
    first = placed.groupBy("shard").agg(F.min(ahead).alias(before))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col(ahead) - F.col(before)).select(*rows.columns, "shard", "slot")


def write_shards(docs: DataFrame, placed: DataFrame, path: str | None = None, id_col: str = "doc_id") -> str:
    """Writes ``docs`` as one Parquet folder per shard, in slot order; returns the path."""
    path = path or new_path(docs.sparkSession, "shards")
    out = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
