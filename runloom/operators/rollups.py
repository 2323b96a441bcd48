"""Usage over runs. Every rollup takes extra grouping columns, such as a user or a host, in ``by``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.config import ALL_WORKSPACES, Range, UsageFilter
from runloom.functions import times, tokens
from runloom.functions.formatting import hours_of
from runloom.operators.ranks import first_of

#: Presets that are summed in one pass.
TOTALS = ("today", "last7", "last30", "last90", "all")


def filter_runs(runs: DataFrame, workspace_id: str, span: Range) -> DataFrame:
    """Runs of a workspace (or all) that start in a range. A persisted table is asked for the range's months only."""
    held = runs if workspace_id == ALL_WORKSPACES else runs.where(F.col("workspace_id") == workspace_id)
    if span.bounded and "start_month" in runs.columns:
        held = held.where(times.in_months(F.col("start_month"), span))
    return held.where(times.in_range(F.col("start_time"), span)) if span.bounded else held


def sum_breakdown() -> Column:
    """Summed counts, unknown ones as 0, their cache-hit rate, and the reason if any run has one."""
    sums = {p: F.coalesce(F.sum(F.coalesce(F.col(f"token_breakdown.{p}"), F.lit(0))), F.lit(0)) for p in tokens.PARTS}
    rate = tokens.cache_hit_rate(sums["input"], sums["cached"])
    return F.struct(*(c.alias(p) for p, c in sums.items()), rate.alias("cache_hit_rate"), F.max("token_breakdown.unavailable_reason").alias("unavailable_reason"))


def active_days() -> Column:
    return F.count_distinct(F.to_date("start_time"))


def workspace_summary(runs: DataFrame, threads_n: DataFrame) -> DataFrame:
    """Every visible workspace of the threads with all its runs: counts are zero where it has none.

    Ordered by tokens plus milliseconds, as the score of a workspace; ties by id. A workspace's name
    and paths are those of its thread with the smallest id.
    """
    known = threads_n.groupBy("workspace_id").agg(F.min_by(F.struct("workspace_name", "workspace_path", "cwd", "hidden"), "id").alias("w"))
    used = runs.groupBy("workspace_id").agg(
        F.count("*").alias("runs"), F.sum("total_tokens").alias("all_time_tokens"), F.sum("duration_ms").alias("all_time_agent_time_ms"),
        active_days().alias("active_days"), F.max("start_time").alias("last_activity"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "all_time_tokens", "all_time_agent_time_ms", "active_days")]
    held = known.where("not w.hidden").join(used, "workspace_id", "left")
    held = held.select("workspace_id", "w.workspace_name", "w.workspace_path", F.col("w.cwd").alias("raw_path"), *counts, "last_activity")
    return held.orderBy((F.col("all_time_tokens") + F.col("all_time_agent_time_ms")).desc(), "workspace_id")


def usage_buckets(runs: DataFrame, weekly: bool, by: Sequence[str] = ()) -> DataFrame:
    """Days or weeks with runs, in order: runs, tokens, time, workspaces, the top workspace, breakdown, and first and last start.

    One shuffle by bucket and workspace, whose sums are then rolled up: a busy day is spread over its
    workspaces. The top workspace has most tokens plus milliseconds; ties go to the smaller name.
    """
    held = runs.withColumn("key", times.bucket_key(F.col("start_time"), weekly))
    each = held.groupBy("key", *by, "workspace_id").agg(
        F.count("*").alias("runs"), F.sum("total_tokens").alias("tokens"), F.sum("duration_ms").alias("agent_time_ms"), F.min("workspace_name").alias("name"),
        F.min("start_time").alias("start"), F.max("start_time").alias("end"), sum_breakdown().alias("b"),
    )
    top = F.min_by("name", F.struct((-F.col("tokens") - F.col("agent_time_ms")).alias("low"), "name"))
    parts = {p: F.sum(f"b.{p}") for p in tokens.PARTS}
    out = each.groupBy("key", *by).agg(
        F.sum("runs").alias("runs"), F.sum("tokens").alias("tokens"), F.sum("agent_time_ms").alias("agent_time_ms"), F.count("*").alias("active_projects"),
        top.alias("top_workspace"), F.min("start").alias("start"), F.max("end").alias("end"), *(c.alias(p) for p, c in parts.items()),
        F.max("b.unavailable_reason").alias("unavailable_reason"),
    )
    rate = tokens.cache_hit_rate(F.col("input"), F.col("cached"))
    nested = F.struct(*tokens.PARTS, rate.alias("cache_hit_rate"), "unavailable_reason").alias("token_breakdown")
    label = times.bucket_label(F.col("key"), weekly).alias("label")
    return out.select("key", *by, label, "start", "end", "runs", "tokens", "agent_time_ms", "active_projects", "top_workspace", nested).orderBy("key", *by)


def preset_totals(runs: DataFrame, now: datetime, by: Sequence[str] = ()) -> DataFrame:
    """Tokens, milliseconds and runs of today, the last 7, 30 and 90 days, and all time, in one pass."""
    sums = []
    for preset in TOTALS:
        inside = times.in_range(F.col("start_time"), UsageFilter(preset=preset).resolve(now))
        for name, column in (("tokens", F.col("total_tokens")), ("agent_time_ms", F.col("duration_ms")), ("runs", F.lit(1))):
            sums.append(F.coalesce(F.sum(F.when(inside, column)), F.lit(0)).cast("long").alias(f"{preset}_{name}"))
    return runs.groupBy(*by).agg(*sums)


def longest_streak(runs: DataFrame, by: Sequence[str] = (), time: str = "start_time") -> DataFrame:
    """Most consecutive days with runs. Works on distinct days, a day's date minus its rank being constant within a streak."""
    days = runs.select(*by, F.to_date(time).alias("day")).where("day is not null").distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy("day"))
    streaks = days.select(*by, F.date_sub("day", rank).alias("island")).groupBy(*by, "island").agg(F.count("*").alias("n"))
    return streaks.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest_streak_days"))


def chart_points(buckets: DataFrame, span: Range | None = None) -> DataFrame:
    """key, tokens and hours of each bucket for a chart; with a range, its days without runs are zero."""
    points = buckets.select("key", "tokens", hours_of(F.col("agent_time_ms")).alias("hours"))
    if span is None:
        return points.orderBy("key")
    days = buckets.sparkSession.range(span.days).select(F.date_format(F.date_add(F.lit(span.start), F.col("id").cast("int")), "yyyy-MM-dd").alias("key"))
    return days.join(points, "key", "left").na.fill(0, ["tokens"]).na.fill(0.0, ["hours"]).orderBy("key")


def visible_runs(runs: DataFrame, threads_n: DataFrame) -> DataFrame:
    """Runs of workspaces that are not hidden. Totals count hidden ones too unless this is applied first."""
    hidden = threads_n.where("hidden").select("workspace_id").distinct()
    return runs.join(hidden, "workspace_id", "left_anti")


def top_workspaces(summary: DataFrame, k: int = 8) -> DataFrame:
    """The first k workspaces by score; this limit is the report's feature."""
    return summary.orderBy((F.col("all_time_tokens") + F.col("all_time_agent_time_ms")).desc(), "workspace_id").limit(k)


def peak_bucket(buckets: DataFrame, metric: str) -> DataFrame:
    """The bucket with most of a metric, the earliest of several."""
    return buckets.agg(F.min_by(F.struct("key", metric), F.struct((-F.col(metric)).alias("low"), "key")).alias("p")).select("p.key", f"p.{metric}")


def range_summary(runs: DataFrame, span: Range) -> DataFrame:
    """One row for runs already filtered: totals, averages by run, active day and calendar day, and the breakdown. Without runs, all is zero."""
    held = runs.agg(
        F.count("*").alias("runs"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("agent_time_ms"),
        active_days().alias("active_days"), sum_breakdown().alias("token_breakdown"),
    )

    def per(total: str, count: Column) -> Column:
        return F.when(count > 0, F.col(total) / count).otherwise(F.lit(0.0))

    days, runs_, active = F.lit(span.days), F.col("runs"), F.col("active_days")
    return held.withColumns({
        "calendar_days": days, "tokens_per_run": per("tokens", runs_), "tokens_per_day": per("tokens", days), "time_per_run_ms": per("agent_time_ms", runs_),
        "time_per_active_day_ms": per("agent_time_ms", active), "time_per_day_ms": per("agent_time_ms", days), "runs_per_day": per("runs", days),
    })


def model_usage(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tokens and runs of each model over all runs given, most tokens first."""
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))
    return runs.groupBy(*by, model.alias("model")).agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("runs")).orderBy(F.desc("tokens"), "model", *by)


def recent_runs(runs: DataFrame, n: int = 250) -> DataFrame:
    """The newest runs; this limit is the report's feature."""
    return runs.orderBy(F.desc("start_time"), "id").limit(n)


def recent_runs_by(runs: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The newest ``n`` runs of every key in one pass; the limit is the report's feature."""
    return first_of(runs, keys, [F.desc("start_time"), F.col("id")], n)


def day_bitmaps(runs: DataFrame, by: Sequence[str] = (), time: str = "start_time") -> DataFrame:
    """start_month and days of each key: a number with a bit for every day of the month that has runs, the first day's lowest. Bitmaps of other runs are or-ed to these by merged_bitmaps()."""
    bit = F.expr(f"shiftleft(1L, dayofmonth(`{time}`) - 1)")
    return runs.where(F.col(time).isNotNull()).groupBy(*by, F.date_format(time, "yyyy-MM").alias("start_month")).agg(F.bit_or(bit).alias("days"))


def merged_bitmaps(*tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bitmaps of several tables or of keys that ``by`` leaves out, as one."""
    held = tables[0]
    for table in tables[1:]:
        held = held.unionByName(table)
    return held.groupBy(*by, "start_month").agg(F.bit_or("days").alias("days"))


def bitmap_active_days(bitmaps: DataFrame, span: Range, by: Sequence[str] = ()) -> DataFrame:
    """Days with runs of each key within a range, from bitmaps alone."""
    first = F.to_date(F.concat("start_month", F.lit("-01")))
    one = F.lit(1).cast("long")

    def below(day: date) -> Column:
        """The bits of the month's days before a day."""
        return F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(F.lit(31), F.date_diff(F.lit(day), first)))).cast("long") - one

    held = bitmaps.where(times.in_months(F.col("start_month"), span)) if span.bounded else bitmaps
    days = F.col("days").bitwiseAND(below(span.end)).bitwiseAND(F.bitwise_not(below(span.start))) if span.bounded else F.col("days")
    one_each = held.groupBy(*by, "start_month").agg(F.bit_or(days).alias("days"))
    return one_each.groupBy(*by).agg(F.sum(F.bit_count("days")).cast("long").alias("active_days"))


def bitmap_weeks(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """week (its Monday) and days of each key: a bit for every day with runs, Monday's lowest. A week across two months is or-ed out of both."""
    first = F.to_date(F.concat("start_month", F.lit("-01")))
    mondays = F.sequence(F.to_date(F.date_trunc("WEEK", first)), F.last_day(first), F.expr("interval 7 days"))
    held = bitmaps.withColumn("week", F.explode(mondays)).withColumn("_shift", F.date_diff("week", first))
    days = F.when(F.col("_shift") >= 0, F.expr("shiftright(days, _shift)")).otherwise(F.expr("shiftleft(days, -_shift)")).bitwiseAND(F.lit(127).cast("long"))
    return held.groupBy(*by, "week").agg(F.bit_or(days).alias("days")).where("days != 0")


def bitmap_streaks(bitmaps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most consecutive days with runs of each key, from bitmaps alone.

    Each month gives its longest run of days, and those at its beginning and end; months are then
    folded in order, a run going on where one month ends and the next begins with days. A key has
    twelve of these a year.
    """
    held = bitmaps.groupBy(*by, "start_month").agg(F.bit_or("days").alias("days")).where("days != 0")
    first = F.to_date(F.concat("start_month", F.lit("-01")))
    length = F.dayofmonth(F.last_day(first))
    month = F.struct(
        (F.year(first) * 12 + F.month(first)).alias("at"), length.alias("length"),
        F.expr("bit_count(days ^ (days + 1)) - 1").alias("begins"),  # its lowest bits that are set
        (length - F.length(F.bin(F.expr("days ^ (shiftleft(1L, day(last_day(to_date(concat(start_month, '-01'))))) - 1)"))) + F.when(F.expr("days = shiftleft(1L, day(last_day(to_date(concat(start_month, '-01'))))) - 1"), 1).otherwise(0)).alias("ends"),
        F.expr("aggregate(sequence(1, 31), struct(days as x, 0 as n), (a, i) -> struct(a.x & shiftleft(a.x, 1) as x, a.n + if(a.x != 0, 1, 0) as n), a -> a.n)").alias("best"),
    )
    fold = """aggregate(_months, struct(-1 as at, 0 as open, 0 as best), (a, m) -> struct(m.at as at,
      if(m.begins = m.length, if(m.at = a.at + 1, a.open, 0) + m.length, m.ends) as open, greatest(a.best, m.best, if(m.at = a.at + 1, a.open, 0) + m.begins) as best), a -> a.best)"""
    return held.groupBy(*by).agg(F.array_sort(F.collect_list(month)).alias("_months")).select(*by, F.expr(fold).cast("long").alias("longest_streak_days"))


def bounds(runs: DataFrame) -> DataFrame:
    """First and last moment of all runs."""
    return runs.agg(F.min(F.least("start_time", "end_time")).alias("first"), F.max(F.greatest("start_time", "end_time")).alias("last"))
