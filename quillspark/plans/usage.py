"""Queries over the event log: user_id is the session, event_type the tool, value the latency, props the arguments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators import usage as U
from .base import table


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.unix_millis(e["ts"].cast("timestamp")).alias("ms"), F.col("ts"), F.col("user_id").alias("session"), F.col("event_type").alias("tool"),
        F.col("value").alias("elapsed"), F.get_json_object("props", "$.k").cast("long").alias("args"),
        (F.col("event_type") == "error").alias("is_error"), (F.col("event_id") % 7 == 0).alias("is_cached"),
    )


def usage_by_tool(spark, sf):
    return _events(spark, sf).groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("args").alias("tokens"), U.half_up(F.round(F.avg("elapsed"), 6)).cast("long").alias("avg_ms"),
        U.half_up(F.avg("args")).cast("long").alias("avg_tokens"), F.count_distinct("session").alias("sessions"),
    )


def usage_by_session(spark, sf):
    """Sessions as repositories: the twenty with most calls."""
    per = _events(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("tool").alias("tools"))
    return R.top(per, 20, "calls", "session")


def usage_daily(spark, sf):
    return _events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("session").alias("sessions"), U.half_up(F.count(F.lit(1)) / F.count_distinct("session"), 1).alias("calls_per_session")
    )


def tool_day_percentiles(spark, sf):
    return U.tool_metrics(_events(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "tool", "day")


def repeated_calls_60s(spark, sf):
    """A call with the tool and arguments of the session's previous one, within a minute."""
    return U.repeated_calls(_events(spark, sf), "session", ["ms", "event_id"], ["tool", "args"], "ms", 60_000).select("session", "event_id", "tool", "gap_ms")


def repeated_calls_hour(spark, sf):
    """A call with the tool of the session's previous one, within an hour: sessions of this table call seldom."""
    return U.repeated_calls(_events(spark, sf), "session", ["ms", "event_id"], ["tool"], "ms", 3_600_000).select("session", "event_id", "tool", "gap_ms")


#: Which tools should follow a tool.
EXPECTED = {"view": ["click", "purchase"], "click": ["purchase"], "error": ["view", "error"], "signup": ["view"]}


def next_call_funnel(spark, sf):
    wanted = F.array().cast("array<string>")
    for tool, after in EXPECTED.items():
        wanted = F.when(F.col("tool") == tool, F.array(*[F.lit(x) for x in after])).otherwise(wanted)
    return U.next_call_funnel(_events(spark, sf), "session", ["ms", "event_id"], "tool", wanted)


def session_trace(spark, sf):
    w = Window.partitionBy("session").orderBy("ms", "event_id")
    return _events(spark, sf).withColumn("step", F.row_number().over(w) - 1).select("session", "step", "event_id", "tool")


def usage_hotspots(spark, sf):
    """Argument values as tools: at least three calls, the fifteen slowest."""
    per = _events(spark, sf).groupBy("args").agg(F.count(F.lit(1)).alias("calls"), R.rounded(F.avg("elapsed")).alias("avg_ms")).where("calls >= 3")
    return R.top(per, 15, "avg_ms", "args")


def retro_medians(spark, sf):
    buckets = _events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), U.enum_or_other(F.col("tool")).alias("tool"))
    return buckets.agg(F.count(F.lit(1)).alias("n"), U.rounded_median("args").alias("median_args"), F.count_if("is_cached").alias("gate_ran"))


def optimization_candidates(spark, sf):
    """Usage and retro proposals by session, the one with more impact for each."""
    e = _events(spark, sf)
    slow = e.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.avg("elapsed").alias("v"), F.avg("args").alias("t")).select("session", F.lit("usage").alias("source"), R.rounded(F.least(F.lit(100.0), 2.0 * F.col("n") + F.col("v") / 100 + F.col("t") / 100)).alias("impact"))
    bad = e.where("is_error").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("args").alias("turns")).select("session", F.lit("retro").alias("source"), F.least(F.lit(100.0), (12 * F.col("n") + 8 * F.col("turns")).cast("double")).alias("impact"))
    return U.best_candidates(slow.unionByName(bad), "session", "impact", "source").select("session", "source", "impact")


def hint_counters(spark, sf):
    """Per session: runs of three equal calls, repeated arguments, and whether it has over fifty calls."""
    w = Window.partitionBy("session").orderBy("ms", "event_id")
    same = (F.col("tool") == F.lag("tool", 1).over(w)) & (F.col("tool") == F.lag("tool", 2).over(w))
    flagged = _events(spark, sf).withColumn("run3", same)
    return flagged.groupBy("session").agg(
        F.count_if("run3").alias("runs"), (F.count("args") - F.count_distinct("args")).alias("repeated_args"), (F.count(F.lit(1)) > 50).alias("long_session")
    )


def negative_evidence(spark, sf):
    """Errors as searches without result: stale after two hours, or once the session views something."""
    w = Window.partitionBy("session").orderBy("ms", "event_id").rowsBetween(1, Window.unboundedFollowing)
    seen = F.min(F.when(F.col("tool") == "view", F.col("ms"))).over(w)
    last = F.max("ms").over(Window.partitionBy("session"))
    rows = _events(spark, sf).withColumn("viewed", seen).withColumn("last", last).where("tool = 'error'")
    until = F.least(F.coalesce("viewed", F.col("ms") + 7_200_000), F.col("ms") + 7_200_000)
    return rows.select("session", "event_id", until.alias("stale_from"), (until <= F.col("last")).alias("stale"))


def stream_usage_window(spark, sf):
    """The batch form of the streaming windows in ``streaming.usage``."""
    e = _events(spark, sf)
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "tool").agg(F.count(F.lit(1)).alias("calls"), R.rounded(F.sum("elapsed"), 2).alias("elapsed")).select(
        F.unix_millis(F.col("w.start").cast("timestamp")).alias("start_ms"), "tool", "calls", "elapsed"
    )


QUERIES = {f.__name__: f for f in [
    usage_by_tool, usage_by_session, usage_daily, tool_day_percentiles, repeated_calls_60s, repeated_calls_hour, next_call_funnel, session_trace, usage_hotspots,
    retro_medians, optimization_candidates, hint_counters, negative_evidence, stream_usage_window,
]}

_E = """WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, ts, user_id AS session, event_type AS tool, value AS elapsed, (props->>'$.k')::bigint AS args, event_type = 'error' AS is_error, event_id % 7 = 0 AS is_cached FROM events)"""

SQL = {
    "usage_by_tool": f"{_E} SELECT tool, count(*) AS calls, sum(args)::bigint AS tokens, floor(round(avg(elapsed), 6) + 0.5)::bigint AS avg_ms, floor(avg(args) + 0.5)::bigint AS avg_tokens, count(DISTINCT session) AS sessions FROM e GROUP BY tool",
    "usage_by_session": f"{_E} SELECT session, count(*) AS calls, count(DISTINCT tool) AS tools FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "usage_daily": f"{_E} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(DISTINCT session) AS sessions, floor(count(*) / count(DISTINCT session) * 10 + 0.5) / 10 AS calls_per_session FROM e GROUP BY 1",
    "tool_day_percentiles": f"""{_E} SELECT tool, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, count(*) FILTER (is_cached) AS cached,
        quantile_disc(elapsed, 0.5) FILTER (NOT is_cached) AS p50, quantile_disc(elapsed, 0.95) FILTER (NOT is_cached) AS p95, max(elapsed) FILTER (NOT is_cached) AS longest,
        floor(coalesce(count(*) FILTER (is_error AND NOT is_cached) / nullif(count(*) FILTER (NOT is_cached), 0), 0) * 1000 + 0.5) / 1000 AS error_rate,
        floor(count(*) FILTER (is_cached) / count(*) * 1000 + 0.5) / 1000 AS cache_rate FROM e GROUP BY 1, 2""",
    "repeated_calls_60s": f"{_E}, l AS (SELECT *, lag(tool) OVER w AS t, lag(args) OVER w AS g, ms - lag(ms) OVER w AS gap_ms FROM e WINDOW w AS (PARTITION BY session ORDER BY ms, event_id)) SELECT session, event_id, tool, gap_ms FROM l WHERE t = tool AND g = args AND gap_ms <= 60000",
    "repeated_calls_hour": f"{_E}, l AS (SELECT *, lag(tool) OVER w AS t, ms - lag(ms) OVER w AS gap_ms FROM e WINDOW w AS (PARTITION BY session ORDER BY ms, event_id)) SELECT session, event_id, tool, gap_ms FROM l WHERE t = tool AND gap_ms <= 3600000",
    "next_call_funnel": f"""{_E}, l AS (SELECT *, lead(tool) OVER (PARTITION BY session ORDER BY ms, event_id) AS nx FROM e), x(tool, want) AS (VALUES {', '.join(f"('{t}', {a})" for t, a in EXPECTED.items())})
        SELECT l.tool, count(*) AS emitted, count(nx) AS followed, count(*) FILTER (list_contains(want, nx)) AS taken FROM l LEFT JOIN x USING (tool) GROUP BY 1""",
    "session_trace": f"{_E} SELECT session, (row_number() OVER (PARTITION BY session ORDER BY ms, event_id) - 1)::int AS step, event_id, tool FROM e",
    "usage_hotspots": f"{_E} SELECT args, count(*) AS calls, round(avg(elapsed), 6) AS avg_ms FROM e GROUP BY 1 HAVING count(*) >= 3 ORDER BY 3 DESC, 1 LIMIT 15",
    "retro_medians": f"{_E} SELECT strftime(ts, '%Y-%m-%d') AS day, tool, count(*) AS n, floor(median(args) + 0.5)::bigint AS median_args, count(*) FILTER (is_cached) AS gate_ran FROM e GROUP BY 1, 2",
    "optimization_candidates": f"""{_E}, c AS (SELECT session, 'usage' AS source, round(least(100.0, 2.0 * count(*) + avg(elapsed) / 100 + avg(args) / 100), 6) AS impact FROM e GROUP BY 1
        UNION ALL SELECT session, 'retro', least(100.0::double, (12 * count(*) + 8 * count(DISTINCT args))::double) FROM e WHERE is_error GROUP BY 1)
        SELECT session, source, impact FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY impact DESC, source) = 1""",
    "hint_counters": f"""{_E}, l AS (SELECT *, tool = lag(tool, 1) OVER w AND tool = lag(tool, 2) OVER w AS r FROM e WINDOW w AS (PARTITION BY session ORDER BY ms, event_id))
        SELECT session, count(*) FILTER (r) AS runs, count(args) - count(DISTINCT args) AS repeated_args, count(*) > 50 AS long_session FROM l GROUP BY 1""",
    "negative_evidence": f"""{_E}, l AS (SELECT *, min(CASE WHEN tool = 'view' THEN ms END) OVER (PARTITION BY session ORDER BY ms, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS viewed, max(ms) OVER (PARTITION BY session) AS last FROM e),
        u AS (SELECT *, least(coalesce(viewed, ms + 7200000), ms + 7200000) AS stale_from FROM l WHERE tool = 'error') SELECT session, event_id, stale_from, stale_from <= last AS stale FROM u""",
    "stream_usage_window": f"{_E} SELECT epoch_ms(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start_ms, tool, count(*) AS calls, round(sum(elapsed), 2) AS elapsed FROM e GROUP BY 1, 2",
}
