"""Event-log analytics: groups, percentiles, funnels, repeats and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(col: Column, digits: int = 0) -> Column:
    """Rounding of non-negative numbers, halves up, the same in every engine."""
    k = 10.0**digits
    return F.floor(col * k + 0.5) / k


def nearest_rank(p: float, col: str) -> Column:
    """The value at position ceil(p n) of the sorted values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").cast("double")


def rounded_median(col: str) -> Column:
    """The median; of an even number of values the mean of the middle two, rounded half up."""
    return F.floor(F.median(col) + 0.5).cast("long")


def enum_or_other(col: Column) -> Column:
    """A short plain value as it is, any other as ``other``; empty stays empty."""
    return F.when(col.isNull() | (col == ""), "").when(col.rlike(r"^[A-Za-z0-9][A-Za-z0-9_:./-]{0,31}$"), col).otherwise("other")


def tool_metrics(events: DataFrame, *keys: str, latency: str = "elapsed", error: str = "is_error", cached: str = "is_cached") -> DataFrame:
    """Calls, latency percentiles over executed calls, error and cache rates in thousandths, per key."""
    done = ~F.col(cached)
    return (
        events.withColumn("_ms", F.when(done, F.col(latency)))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col(cached)).alias("cached"),
            nearest_rank(0.5, "_ms").alias("p50"),
            nearest_rank(0.95, "_ms").alias("p95"),
            F.max("_ms").alias("longest"),
            half_up(F.coalesce(F.count_if(F.col(error) & done) / F.nullif(F.count_if(done), F.lit(0)), F.lit(0.0)), 3).alias("error_rate"),
            half_up(F.count_if(F.col(cached)) / F.count(F.lit(1)), 3).alias("cache_rate"),
        )
    )


def repeated_calls(events: DataFrame, session: str, order: list[str], same: list[str], millis: str, within: int = 60_000) -> DataFrame:
    """Calls that equal the session's previous call in ``same`` and follow within the time."""
    w = Window.partitionBy(session).orderBy(*order)
    gap = F.col(millis) - F.lag(millis).over(w)
    alike = F.lit(True)
    for c in same:
        alike = alike & (F.col(c) == F.lag(c).over(w))
    return events.withColumn("gap_ms", gap).withColumn("_alike", alike).where("_alike and gap_ms <= %d" % within).drop("_alike")


def next_call_funnel(events: DataFrame, session: str, order: list[str], tool: str, expected: Column) -> DataFrame:
    """Per tool: calls, those with a next call, and those whose next call is an expected one."""
    w = Window.partitionBy(session).orderBy(*order)
    nxt = events.withColumn("next_tool", F.lead(tool).over(w)).withColumn("expected", expected)
    return nxt.groupBy(tool).agg(
        F.count(F.lit(1)).alias("emitted"),
        F.count("next_tool").alias("followed"),
        F.count_if(F.array_contains("expected", F.col("next_tool"))).alias("taken"),
    )


def best_candidates(candidates: DataFrame, key: str, impact: str, *ties: str) -> DataFrame:
    """Of each key the candidate with the greatest impact."""
    w = Window.partitionBy(key).orderBy(F.col(impact).desc(), *ties)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
