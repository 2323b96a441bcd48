"""Dashboards: several rollups over one filter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.config import Range, UsageFilter
from runloom.functions import formatting as fmt
from runloom.functions import tokens
from runloom.operators import rollups


def resolved(runs: DataFrame, wanted: UsageFilter, now: datetime) -> Range:
    """The filter's range; "all" asks the table for its bounds, one row."""
    if wanted.preset != "all":
        return wanted.resolve(now)
    first, last = rollups.bounds(runs).first()
    return wanted.resolve(now, first, last)


def cards(summary: DataFrame, totals: DataFrame, streak: DataFrame, view: str) -> DataFrame:
    """id, value and args of the view's metric cards."""
    row = summary.crossJoin(totals).crossJoin(streak)  # three tables of one row
    b = F.col("token_breakdown")
    none = F.expr("cast(map() as map<string,string>)")

    def args(**values) -> F.Column:
        return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))

    days = args(count=F.col("calendar_days"))
    time = [
        ("selected-time", fmt.as_duration(F.col("agent_time_ms")), none), ("runs", fmt.as_integer(F.col("runs")), none),
        ("avg-day-time", fmt.as_duration(F.col("time_per_day_ms")), days), ("active-days", fmt.as_integer(F.col("active_days")), args(count=F.col("longest_streak_days"))),
        ("all-time", fmt.as_duration(F.col("all_agent_time_ms")), none),
    ]
    rate = tokens.cache_hit_rate(b["input"], b["cached"])
    used = [
        ("selected-tokens", fmt.as_tokens(F.col("tokens")), none), ("avg-day-tokens", fmt.as_tokens(F.col("tokens_per_day")), days),
        ("token-cache-hit-rate", F.when(rate.isNotNull(), fmt.as_percent(rate)).otherwise("Unavailable"), args(cached=fmt.as_tokens(b["cached"]), input=fmt.as_tokens(b["input"]))),
        ("avg-tokens", fmt.as_tokens(F.col("tokens_per_run")), none), ("all-tokens", fmt.as_tokens(F.col("all_tokens")), none),
    ]
    listed = F.array(*(F.struct(F.lit(i).alias("id"), v.alias("value"), a.alias("args")) for i, v, a in (time if view == "time" else used)))
    return row.select(F.explode(listed).alias("c")).select("c.*")


def snapshot(runs: DataFrame, workspaces: DataFrame, wanted: UsageFilter, now: datetime, newest: int = 250) -> dict[str, DataFrame]:
    """Tables of a dashboard: workspaces, summary, totals, streak, buckets, peaks, cards, models and the newest runs."""
    span = resolved(runs, wanted, now)
    every = UsageFilter(preset="all").resolve(now)
    scope = rollups.filter_runs(runs, wanted.workspace_id, every)
    held = rollups.filter_runs(runs, wanted.workspace_id, span)
    buckets, summary = rollups.usage_buckets(held, span.weekly), rollups.range_summary(held, span)
    totals, streak = rollups.preset_totals(scope, now), rollups.longest_streak(held)
    return {
        "workspaces": workspaces, "summary": summary, "totals": totals, "streak": streak, "buckets": buckets,
        "peak_by_time": rollups.peak_bucket(buckets, "agent_time_ms"), "peak_by_tokens": rollups.peak_bucket(buckets, "tokens"),
        "cards": cards(summary, totals, streak, wanted.view), "models": rollups.model_usage(held), "runs": rollups.recent_runs(held, newest),
    }


def project_detail(runs: DataFrame, workspaces: DataFrame, workspace_id: str, wanted: UsageFilter, now: datetime, recent: int = 10) -> dict[str, DataFrame]:
    """Tables of one workspace; the workspace table is empty if the id is unknown. Models cover all its runs in the range."""
    own = UsageFilter(workspace_id, wanted.view, wanted.preset, wanted.start, wanted.end, wanted.weekly)
    tables = snapshot(runs, workspaces.where(F.col("workspace_id") == workspace_id), own, now)
    average = tables["summary"].select("calendar_days", "tokens_per_day", "time_per_day_ms", "runs_per_day")
    return {"workspace": tables["workspaces"], "buckets": tables["buckets"], "runs": tables["runs"], "models": tables["models"], "average": average, "recent": rollups.recent_runs(tables["runs"], recent)}
