"""The fact table: one run for each thread, with times and tokens from its session and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.config import UsageConfig
from runloom.functions import paths, tokens
from runloom.functions.times import from_epoch, millis
from runloom.sources.readers import threads

# What stands for missing fields.
UNTITLED, UNNAMED = "Untitled run", "unknown"
NO_BREAKDOWN = "Breakdown unavailable for this run."


def _filled(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def normalize_threads(df: DataFrame, config: UsageConfig) -> DataFrame:
    """Threads with defaults filled in, times, and their workspace. A thread without id is named by a hash of its row."""
    held = threads(df)
    path = F.col("workspace_path")
    return (
        paths.with_path(held, "cwd", "workspace_path", config.aliases)
        .select(
            F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("thread-"), F.lower(F.hex(F.xxhash64(*held.columns))))).alias("id"),
            _filled("title", UNTITLED).alias("title"), _filled("model", UNNAMED).alias("model"), _filled("model_provider", UNNAMED).alias("model_provider"),
            F.nullif("rollout_path", F.lit("")).alias("rollout_path"), _filled("cwd", paths.UNKNOWN).alias("cwd"),
            F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), (F.coalesce("archived", F.lit(0)) != 0).alias("archived"),
            from_epoch(F.col("created_at_ms"), F.col("created_at")).alias("created_at"), from_epoch(F.col("updated_at_ms"), F.col("updated_at")).alias("updated_at"),
            "workspace_path", paths.workspace_id(path).alias("workspace_id"), paths.display_name(path).alias("workspace_name"),
            paths.is_ignored(path, config.ignored).alias("hidden"),
        )
    )


def two_key_lookup(rows: DataFrame, by_id: DataFrame, by_stem: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` (id, rollout_path) with a struct ``found``: the fields of the session of its id, else of its file stem. A match by id counts whole, nulls included."""
    first = by_id.select(F.col("id"), F.struct(*fields).alias("_by_id"))
    second = by_stem.select(F.col("stem").alias("_stem"), F.struct(*fields).alias("_by_stem"))
    held = rows.withColumn("_stem", paths.file_stem(F.col("rollout_path"))).join(first, "id", "left").join(second, "_stem", "left")
    return held.withColumn("found", F.coalesce("_by_id", "_by_stem")).drop("_stem", "_by_id", "_by_stem")


def resolved_breakdown(first: Column, second: Column) -> Column:
    """Counts of the first breakdown, filled from the second. If neither knows any, only the reason is set."""
    parts = {p: F.coalesce(first[p], second[p]) for p in tokens.PARTS}
    known = F.coalesce(*parts.values()).isNotNull()
    rate = tokens.cache_hit_rate(parts["input"], parts["cached"])
    return F.struct(*(c.cast("long").alias(p) for p, c in parts.items()), rate.alias("cache_hit_rate"), F.when(~known, F.lit(NO_BREAKDOWN)).alias("unavailable_reason"))


def build_runs(threads_n: DataFrame, by_id: DataFrame, by_stem: DataFrame, logs: DataFrame, config: UsageConfig) -> DataFrame:
    """Runs of normalised threads. Sessions are unique by id and by stem; logs (thread_id and counts) are unique by thread."""
    held = threads_n if config.include_archived else threads_n.where("not archived")
    held = two_key_lookup(held, by_id, by_stem, ["start_time", "end_time", "active_ms", "breakdown"])
    log = logs.select(F.col("thread_id").alias("id"), F.struct(*(F.col(p).cast("long").alias(p) for p in tokens.PARTS)).alias("log"))
    held = held.join(log, "id", "left")
    by_events = F.coalesce(F.col("found.active_ms"), F.lit(0)) > 0
    start, end = F.coalesce("found.start_time", "created_at"), F.coalesce("found.end_time", "updated_at")
    held = held.withColumns({"start_time": start, "end_time": end, "duration_method": F.when(by_events, "jsonl-events").otherwise("thread-span")})
    span = F.least(F.greatest(millis(F.col("end_time")) - millis(F.col("start_time")), F.lit(0)), F.lit(config.span_cap_ms))
    return held.select(
        "id", "title", "workspace_id", "workspace_name", "workspace_path", "start_time", "end_time",
        F.when(by_events, F.col("found.active_ms")).otherwise(span).cast("long").alias("duration_ms"), "duration_method", "model", "model_provider",
        F.col("tokens_used").alias("total_tokens"), resolved_breakdown(F.col("found.breakdown"), F.col("log")).alias("token_breakdown"), "rollout_path", "archived",
    )
