"""An extension of ours: the daily usage rollup over a stream, equal to the batch rollup once days are closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """``day, model, requests, tokens`` of a stream ``ts, model, tokens``; a day closes ``lateness`` after its end."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "model")
    return w.agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select(F.to_date("window.start").alias("day"), "model", "requests", "tokens")
