"""The stateless operators on streams, and windowed word statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import tokens


def windowed_counts(events: DataFrame, ts: str = "ts", keys: list[str] | None = None, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window start, keys, n) of a stream or table; rows later than ``late`` are dropped by a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, size), *(keys or [])).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *(keys or []), "n")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n) of runs of events less than ``gap`` apart."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def token_stream(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Tokens of a stream of texts; the same plan as for a table."""
    return tokens(lines, text_col, positions=False)


def run_available(df: DataFrame, spark: SparkSession, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet in ``path``, and reads it back."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")
