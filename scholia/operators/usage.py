"""Rollups of model usage: requests, success, response times, cost, quotas and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(requests: DataFrame) -> DataFrame:
    """AGG14: counters of each day, provider and model (an average equals the running mean)."""
    return requests.groupBy("day", "provider", "model").agg(
        F.count("*").alias("requests"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.avg("response_time").alias("avg_response_time"))


def with_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """AGG18: cost by ``prices(model, free, input, output, flat)``: free models cost nothing; with both prices
    (input + output) * tokens / 2000; else the flat price a request; unknown models nothing."""
    cost = F.when(F.col("free"), 0.0).when(F.col("input").isNotNull() & F.col("output").isNotNull(), (F.col("input") + F.col("output")) * F.col("tokens") / 2000).otherwise(F.coalesce("flat", F.lit(0.0)))
    return rows.join(prices, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("free", "input", "output", "flat")


def daily_report(requests: DataFrame) -> DataFrame:
    """AGG15: requests, success in percent and each model's share of the day."""
    by = requests.groupBy("day", "model").agg(F.count("*").alias("requests"), F.count_if("success").alias("ok"))
    day = Window.partitionBy("day")
    return by.select("day", "model", "requests", (F.col("ok") * 100.0 / F.col("requests")).alias("success_percent"), (F.col("requests") * 100.0 / F.sum("requests").over(day)).alias("share_percent"))


def first_errors(requests: DataFrame, k: int = 5) -> DataFrame:
    """AGG15: the first k failures of each day."""
    w = Window.partitionBy("day").orderBy("event_id")
    return requests.where(~F.col("success")).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("day", "nth", "event_id", "model")


def weekly_report(costed: DataFrame, end: str) -> DataFrame:
    """AGG16: models of the seven days up to ``end``: requests, tokens, cost, their shares and daily averages, most used first."""
    last = F.to_date(F.lit(end))
    rows = costed.where(F.col("day").between(F.date_sub(last, 6), last))
    by = rows.groupBy("model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    every = by.agg(F.sum("cost").alias("all_cost"))
    return by.crossJoin(F.broadcast(every)).select(
        "model", "requests", "tokens", "cost", (F.col("requests") / 7).alias("requests_per_day"),
        F.when(F.col("all_cost") > 0, F.col("cost") * 100 / F.col("all_cost")).otherwise(0.0).alias("cost_percent"), (F.col("cost") / F.col("requests")).alias("cost_per_request"))


def status(used: Column, limit: Column, warn: float) -> Column:
    """AGG17: ok, warning from the share ``warn`` of the limit, exceeded from the limit (null: no limit)."""
    return F.when(limit.isNull(), "ok").when(used >= limit, "exceeded").when(used >= limit * warn, "warning").otherwise("ok")


def choose_model(tasks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """TOP11: for ``tasks(task, preferred, fallback, avoid)`` the first candidate that is available, within
    quota and not avoided (``catalogue(model, available, quota_ok)``)."""
    cand = tasks.select("task", "avoid", F.posexplode(F.concat("preferred", "fallback")).alias("pos", "model"))
    ok = cand.join(catalogue, "model").where("available AND quota_ok").where(~F.array_contains(F.coalesce("avoid", F.array().cast("array<string>")), F.col("model")))
    return ok.groupBy("task").agg(F.min_by("model", "pos").alias("model"))


def suggest_switch(performance: DataFrame) -> DataFrame:
    """TOP11: the reason to leave a model: quota, then cost, then a success rate under a half over more than five requests."""
    reason = F.when(F.col("quota") == "exceeded", "quota").when(F.col("cost_status") == "exceeded", "cost").when((F.col("requests") > 5) & (F.col("successful") < 0.5 * F.col("requests")), "failures")
    return performance.withColumn("reason", reason).where("reason IS NOT NULL")
