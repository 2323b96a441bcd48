"""Queries over the given tables, one for each group of operators.

Orders stand in for threads, customers' nations for workspaces, line items for token logs, and
events for session events (a user is a session).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.config import AliasRule, UsageConfig, UsageFilter
from runloom.functions import formatting as fmt
from runloom.functions import paths, times, tokens
from runloom.operators import diagnostics, privacy, refresh, rollups, sessions
from runloom.operators import runs as fact
from runloom.plans import report
from runloom.plans.usage import Sources, Usage
from runloom.sources import readers, sinks
from runloom.sources.scratch import discard, saved, shared_folder
from runloom.sources.snapshots import Change, SnapshotSet
from runloom.streaming import usage as stream

CAP_MS = 180 * 60_000
EVENTS_NOW = datetime(2024, 1, 30, 13, 30)
RUNS_NOW = datetime(2001, 8, 1, 13, 30)
CONFIG = UsageConfig(ignored=())
#: Line items that one task folds, about; their slices are some 600 bytes each in its memory.
TASK_ROWS = 500_000
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents", "embeddings", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def order_facts(spark: SparkSession, sf_dir: str, watch: diagnostics.Observed | None = None) -> DataFrame:
    """What line items say of each order, from one scan and one shuffle: its tokens, its log counts, and ship dates as events of a session."""
    items = table(spark, sf_dir, "lineitem")
    tasks = ceil(items.count() / TASK_ROWS)  # of the files' footers; Spark would deal any number of rows to as many tasks as there are cores, up to its size of a partition
    q, columns = F.col("l_quantity").cast("long"), items.columns
    items = items.select("l_orderkey", "l_quantity", "l_linenumber", "l_returnflag", "l_shipdate")
    items = watch.watch("lineitem", items, "l_shipdate", columns) if watch else items
    count = (max(tasks, spark.sparkContext.defaultParallelism),) if tasks > 1 else ()
    dealt = items.withColumn("t", F.col("l_shipdate").cast("timestamp")).repartition(*count, "l_orderkey")  # slices and sessions of an order are then folded where they are
    sums = {"tokens_used": q, "input": q * 10, "output": F.col("l_linenumber").cast("long"), "cached": F.when(F.col("l_returnflag") == "R", q * 4).otherwise(0)}
    return saved(sessions.active_time(dealt, ["l_orderkey"], "t", CONFIG.idle_cap_ms, sums))


def thread_table(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None, watch: diagnostics.Observed | None = None) -> DataFrame:
    """Orders as threads: the nation's folder as cwd, and an end up to 36 half hours after the start."""

    def read(name: str, columns: list[str], time: str | None = None) -> DataFrame:
        held = table(spark, sf_dir, name)
        return watch.watch(name, held.select(*columns), time, held.columns) if watch else held

    orders = read("orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"], "o_orderdate")
    customer = read("customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation, region = read("nation", ["n_nationkey", "n_name", "n_regionkey"]), read("region", ["r_regionkey", "r_name"])
    used = (order_facts(spark, sf_dir) if facts is None else facts).select("l_orderkey", "tokens_used")
    held = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    held = held.join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return held.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("/data/rollout-"), F.col("o_orderkey").cast("string"), F.lit(".jsonl")).alias("rollout_path"),
        start.alias("created_at_ms"), (start + F.col("o_orderkey") % 37 * 1_800_000).alias("updated_at_ms"),
        F.concat(F.lit("c:/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit("/")).alias("cwd"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("c_mktsegment").alias("model_provider"), F.col("o_orderpriority").alias("model"), "tokens_used", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("archived"),
    )


def token_logs(facts: DataFrame) -> DataFrame:
    """Log counts of threads; those of every third order name a thread that is not there."""
    key = F.col("l_orderkey")
    thread = F.concat(F.when(key % 3 == 0, F.lit("gone-")).otherwise(F.lit("")), key.cast("string"))
    return facts.select(thread.alias("thread_id"), "input", "output", "cached", F.lit(None).cast("long").alias("reasoning"))


def order_sessions(facts: DataFrame, known: Column, name: str, prefix: str = "") -> DataFrame:
    """Sessions of orders, named by their order where ``known``, else by an order that is not there."""
    own = F.concat(F.lit(prefix), F.when(known, F.lit("")).otherwise(F.lit("gone-")), F.col("l_orderkey").cast("string"))
    return facts.select(own.alias(name), "start_time", "end_time", "active_ms", F.lit(None).cast(tokens.BREAKDOWN).alias("breakdown"))


def built(spark: SparkSession, sf_dir: str, config: UsageConfig = CONFIG, watch: diagnostics.Observed | None = None) -> tuple[DataFrame, DataFrame]:
    """Threads and runs from the same facts. A fifth of the orders have sessions by id, these and another fifth by stem."""
    facts, fifth = order_facts(spark, sf_dir, watch), F.col("l_orderkey") % 5
    threads = fact.normalize_threads(thread_table(spark, sf_dir, facts, watch), config)
    return threads, fact.build_runs(threads, order_sessions(facts, fifth == 0, "id"), order_sessions(facts, fifth < 2, "stem", "rollout-"), token_logs(facts), config)


def runs(spark: SparkSession, sf_dir: str, config: UsageConfig = CONFIG) -> DataFrame:
    return built(spark, sf_dir, config)[1]


def plain_times(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def flat(df: DataFrame) -> DataFrame:
    """token_breakdown as columns of its own."""
    rate = F.round("token_breakdown.cache_hit_rate", 6).alias("cache_hit_rate")
    return df.select(*(c for c in df.columns if c != "token_breakdown"), *(F.col(f"token_breakdown.{p}").alias(p) for p in tokens.PARTS), rate, "token_breakdown.unavailable_reason")


# sessions


def session_active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(sessions.active_time(events(spark, sf_dir), ["user_id"], "ts", CAP_MS))


def session_last_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = events(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("value") > 50, F.col("event_type")).alias("model"))
    return held.groupBy("user_id").agg(sessions.last_known("model", "at").alias("model"))


def session_best_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = events(spark, sf_dir).withColumn("score", F.floor("value").cast("long"))
    held = held.select("user_id", F.when(F.col("event_type") != "view", F.col("event_id")).alias("b"), F.struct("score", "ts", "event_id").alias("best"))
    return held.groupBy("user_id").agg(sessions.last_known("b", "best").alias("best_event"))


def _session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("s"), F.col("event_id") % 700).alias("stem"), (F.col("event_type") == "purchase").alias("archived"), F.format_string("f%09d", "event_id").alias("file"), "event_id")


def session_dedup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.by_id(_session_rows(spark, sf_dir)).select("id", "event_id", "archived")


def session_dedup_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.by_stem(_session_rows(spark, sf_dir)).select("stem", "event_id", "archived")


# runs


def runs_two_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(runs(spark, sf_dir).select("id", "start_time", "end_time", "duration_ms", "duration_method", "total_tokens"))


def run_breakdown_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(runs(spark, sf_dir).select("id", "token_breakdown"))


def epoch_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    ms, s = F.when(n % 3 == 0, n * 1_000_003).otherwise(0), F.when(n % 3 < 2, n * 1000).otherwise(0)
    return e.select("event_id", times.from_epoch(ms, s).cast("timestamp_ntz").alias("created_at"))


def schema_drift_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("model"))
    return fact.normalize_threads(o, CONFIG).select("id", "title", "model", "model_provider", "cwd", "workspace_path", "workspace_name", "workspace_id", "tokens_used", "archived", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


# rollups


def _buckets(df: DataFrame) -> DataFrame:
    return plain_times(flat(df))


def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(rollups.usage_buckets(runs(spark, sf_dir), weekly=False))


def weekly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(rollups.usage_buckets(runs(spark, sf_dir), weekly=True))


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("workspace_id"), F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"), F.floor("value").cast("long").alias("total_tokens"))


def preset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.preset_totals(_event_runs(spark, sf_dir), EVENTS_NOW, by=["workspace_id"])


def range_summary_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = UsageFilter(preset="custom", start="1996-02-20", end="1997-03-05").resolve(RUNS_NOW)
    return flat(rollups.range_summary(rollups.filter_runs(runs(spark, sf_dir), "all", span), span)).withColumns({c: F.round(c, 4) for c in ("tokens_per_run", "tokens_per_day", "time_per_run_ms", "time_per_active_day_ms", "time_per_day_ms", "runs_per_day")})


def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = UsageFilter(preset="custom", start="1996-02-20", end="1997-03-05").resolve(RUNS_NOW)
    held = rollups.filter_runs(runs(spark, sf_dir), "all", span)
    return rollups.chart_points(rollups.usage_buckets(held, weekly=False), span)


def visible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads, held = built(spark, sf_dir, UsageConfig(ignored=("C:/asia",)))
    return rollups.visible_runs(held, threads).groupBy("model").agg(F.count("*").alias("runs"), F.sum("total_tokens").alias("tokens"))


def top_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads, held = built(spark, sf_dir)
    return rollups.top_workspaces(rollups.workspace_summary(held, threads)).select("workspace_name", "runs", "all_time_tokens", "all_time_agent_time_ms")


def orphan_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all orders, held against the runs of unarchived threads."""
    found = order_sessions(order_facts(spark, sf_dir), F.lit(True), "id").withColumn("stem", F.concat(F.lit("rollout-"), F.col("id")))
    made = runs(spark, sf_dir, UsageConfig(ignored=(), include_archived=False))
    return plain_times(diagnostics.orphan_sessions(found, made).select("id", "start_time", "end_time"))


def peak_bucket_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.peak_bucket(rollups.usage_buckets(runs(spark, sf_dir), weekly=False), "agent_time_ms")


def peak_bucket_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.peak_bucket(rollups.usage_buckets(runs(spark, sf_dir), weekly=True), "tokens")


def longest_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.longest_streak(events(spark, sf_dir), by=["user_id"], time="ts")


def all_time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(rollups.bounds(runs(spark, sf_dir)))


def workspace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = UsageConfig(ignored=("C:/asia",), include_archived=False)
    threads, held = built(spark, sf_dir, config)
    return plain_times(rollups.workspace_summary(held, threads))


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.model_usage(runs(spark, sf_dir), by=["workspace_name"])


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(rollups.recent_runs(runs(spark, sf_dir), 250).select("id", "workspace_name", "start_time", "total_tokens"))


def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(spark, sf_dir).where(F.col("workspace_id") == paths.workspace_id(F.lit("C:\\EUROPE\\NATION_3")))
    return plain_times(rollups.recent_runs(found, 10).select("id", "workspace_name", "start_time", "total_tokens"))


def recent_runs_by_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(rollups.recent_runs_by(runs(spark, sf_dir), ["workspace_id"], 10).select("id", "workspace_name", "start_time", "total_tokens"))


def day_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.day_bitmaps(events(spark, sf_dir), ["user_id"], "ts")


def bitmap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a range, active weeks and longest streak of users, from the bitmaps of two halves of the events, merged."""
    halves = [rollups.day_bitmaps(events(spark, sf_dir).where(F.col("event_id") % 2 == k), ["user_id"], "ts") for k in (0, 1)]
    held, by = saved(rollups.merged_bitmaps(*halves, by=["user_id"])), ["user_id"]
    span = UsageFilter(preset="custom", start="2024-01-10", end="2024-02-03").resolve(EVENTS_NOW)
    weeks = rollups.bitmap_weeks(held, by).groupBy(*by).agg(F.count("*").alias("active_weeks"), F.sum(F.bit_count("days")).cast("long").alias("days_by_week"))
    days, every = rollups.bitmap_active_days(held, span, by), rollups.bitmap_streaks(held, by)
    return every.join(weeks, "user_id").join(days, "user_id", "left").na.fill(0, ["active_days"])


def bitmap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active days and longest streak of all runs in ranges, or-ed from the bitmaps of workspaces."""
    held = saved(rollups.day_bitmaps(runs(spark, sf_dir), ["workspace_id"]))
    made = []
    for name, wanted in (("custom", UsageFilter(preset="custom", start="1996-02-20", end="1997-03-05")), ("all", UsageFilter(preset="all"))):
        span = wanted.resolve(RUNS_NOW)
        made.append(rollups.bitmap_active_days(held, span).crossJoin(rollups.bitmap_streaks(held)).select(F.lit(name).alias("range"), "active_days", "longest_streak_days"))  # two tables of one row
    return made[0].unionByName(made[1])


def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(runs(spark, sf_dir).groupBy("workspace_name").agg(rollups.sum_breakdown().alias("token_breakdown")))


# paths


def _page_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return table(spark, sf_dir, "pages"), F.concat(F.lit("  \\\\?\\c:/"), F.regexp_replace("url", "^https?://", ""), F.lit("/ "))


def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, raw = _page_paths(spark, sf_dir)
    return pages.select("page_id", paths.normalize(raw).alias("path"))


def workspace_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, raw = _page_paths(spark, sf_dir)
    return pages.select("page_id", paths.workspace_id(paths.normalize(raw)).alias("workspace_id"))


def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, raw = _page_paths(spark, sf_dir)
    return pages.select("page_id", paths.display_name(paths.normalize(raw)).alias("name"))


def alias_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (AliasRule("c:/asia/nation_2", "d:/east/one"), AliasRule("D:/EAST/ONE/", "e:/east/two"), AliasRule("c:/europe/nation_3", "f:/never", enabled=False), AliasRule("c:/america/nation_1", ""))
    return fact.normalize_threads(thread_table(spark, sf_dir), UsageConfig(aliases=rules)).groupBy("workspace_path", "workspace_name").agg(F.count("*").alias("threads"))


def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty chains of two rules, more than an expression holds."""
    rules = tuple(AliasRule(f"c:/asia/nation_{i}", f"d:/moved/{i}") for i in range(40)) + tuple(AliasRule(f"D:/MOVED/{i}", f"e:/last/{i}/") for i in range(40))
    return fact.normalize_threads(thread_table(spark, sf_dir), UsageConfig(aliases=rules)).groupBy("workspace_path").agg(F.count("*").alias("threads"))


def alias_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of fifty rules for every nation, as a table; a third of the chains has a rule switched off, whose path a later rule takes up; others come too late."""
    n, k = F.col("n_name"), F.col("k")
    steps = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k"))
    moved = F.when(k == 0, F.concat(F.lit("C:/"), "r_name", F.lit("/"), n)).otherwise(F.concat(F.lit("d:/moved/"), n, F.lit("/"), k.cast("string"), F.lit("/")))
    chain = steps.select((F.col("n_nationkey") * 1000 + k).cast("long").alias("ordinal"), moved.alias("source"), F.concat(F.lit("D:\\MOVED\\"), n, F.lit("\\"), (k + 1).cast("string")).alias("target"), ((F.col("n_nationkey") % 3 != 0) | (k != 20)).alias("enabled"))
    late = steps.select((F.col("n_nationkey") * 1000 + 500 + k).cast("long").alias("ordinal"), moved.alias("source"), F.lit("e:/late").alias("target"), F.lit(True).alias("enabled"))
    held = paths.with_path_by(thread_table(spark, sf_dir), "cwd", "workspace_path", chain.unionByName(late))
    return held.groupBy("workspace_path").agg(F.count("*").alias("threads"))


def ignored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with an even key and one nation as a table of ignored paths."""
    regions = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("c:/"), "r_name", F.lit("/"))).otherwise(F.lit("C:\\AMERICA\\nation_1")).alias("path"))
    held = fact.normalize_threads(thread_table(spark, sf_dir), CONFIG).drop("hidden")
    return paths.hidden_by(held, "workspace_path", regions).groupBy("workspace_path", "hidden").agg(F.count("*").alias("threads"))


def hidden_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignored = ("C:/Africa", "c:\\asia\\", "C:/EUROPE/NATION_1", "c:/america/nation_1")
    held = fact.normalize_threads(thread_table(spark, sf_dir), UsageConfig(ignored=ignored))
    return held.groupBy("workspace_path", "hidden").agg(F.count("*").alias("threads"))


# privacy


def anonymize_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.anonymize_runs(runs(spark, sf_dir)).select("id", "title", "workspace_id", "workspace_name", "workspace_path", "rollout_path")


def anonymize_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads, held = built(spark, sf_dir)
    return privacy.anonymize_workspaces(rollups.workspace_summary(held, threads), privacy.workspace_numbers(held)).select("workspace_id", "workspace_name", "workspace_path", "raw_path", "runs")


def anonymize_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.anonymize_buckets(rollups.usage_buckets(runs(spark, sf_dir), weekly=True)).select("key", "label", "runs", "top_workspace")


# session files


def _session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of 40 session files, by user: what a session is, token counts, blank and broken lines."""
    e, n = events(spark, sf_dir), F.col("event_id")
    bucket, kind, at = F.col("user_id") % 40, n % 7, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    meta = F.struct(F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.concat(F.lit("/w/"), F.col("event_type")).alias("cwd"), F.when(F.col("value") > 50, F.col("event_type")).alias("model"))
    total = F.struct(F.floor("value").alias("input_tokens"), (n % 90).alias("output_tokens"), (n % 50).alias("cached_input_tokens"))
    info = F.struct(total.alias("total_token_usage"), F.struct((n % 100).alias("input_tokens")).alias("last_token_usage"))
    count = F.struct(F.lit("token_count").alias("type"), info.alias("info"))
    line = F.when(kind == 1, F.lit("{broken")).when(kind == 2, F.lit("  ")).when(kind == 0, F.to_json(F.struct(at, F.lit("session_meta").alias("type"), meta.alias("payload")))).otherwise(F.to_json(F.struct(at, F.lit("event_msg").alias("type"), count.alias("payload"))))
    return e.select(F.format_string("s%02d", bucket).alias("file"), (bucket % 4 == 0).alias("archived"), n.alias("at"), line.alias("line"))


def _session_folders(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The lines as .jsonl files in a folder of live sessions and one of archived ones."""
    lines, folder = _session_lines(spark, sf_dir), shared_folder(spark)
    for name, wanted in (("live", ~F.col("archived")), ("archived", F.col("archived"))):
        sinks.write_session_files(lines.where(wanted), f"{folder}/{name}")
    return f"{folder}/live", f"{folder}/archived"


def _session_columns(found: DataFrame) -> DataFrame:
    parts = [F.col(f"breakdown.{p}").alias(p) for p in tokens.PARTS]
    return plain_times(found.select("stem", "id", "archived", "cwd", "model", "start_time", "end_time", "active_ms", *parts, "parse_warnings"))


def session_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session files, scanned and read back: one row a session."""
    return _session_columns(sessions.by_id(sessions.session_files(readers.session_events(readers.session_lines(spark, *_session_folders(spark, sf_dir))), CAP_MS)))


def session_odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with times and numbers of every form that is let pass: mail dates, days alone, started_at, repeated keys, numbers beyond any long."""
    e, n = events(spark, sf_dir), F.col("event_id")
    iso, day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyy-MM-dd")
    count = '"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{'
    line = (
        F.when(n % 6 == 0, F.format_string('{"timestamp":"%s","type":"session_meta","payload":{"id":"a","id":"u%d"}}', F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.col("user_id")))
        .when(n % 6 == 1, F.format_string('{"timestamp":"%s",' + count + '"input_tokens":%d}}}}', day, n % 100))
        .when(n % 6 == 2, F.format_string('{"type":"event_msg","payload":{"started_at":"%s"}}', iso))
        .when((n % 6 == 3) & (n % 5 == 0), F.format_string('{"timestamp":"%s",' + count + '"input_tokens":1e20,"output_tokens":99999999999999999999}}}}', iso))
        .when(n % 6 == 4, F.format_string('{"timestamp":"12:30",' + count + '"input_tokens":5,"input_tokens":%d}}}}', n % 90))
        .otherwise(F.format_string('{"timestamp":1700000000,"type":"event_msg","n":%d}', n))
    )
    lines = e.select(F.concat(F.lit("u"), F.col("user_id") % 50).alias("file"), F.lit(False).alias("archived"), F.struct(F.lit(0).cast("long").alias("block"), n.alias("row")).alias("at"), line.alias("line"))
    found = sessions.session_files(readers.session_events(lines), CAP_MS)
    return plain_times(found.select("stem", "id", "start_time", "end_time", "active_ms", *(F.col(f"breakdown.{p}").alias(p) for p in ("input", "output")), "parse_warnings"))


def session_jsonl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by file, of live sessions only."""
    lines = readers.session_lines(spark, *_session_folders(spark, sf_dir), include_archived=False)
    stem = paths.file_stem(F.col("file")).alias("stem")
    return readers.session_events(lines).groupBy(stem).agg(F.count("*").alias("lines"), F.count_if("broken").alias("broken"), F.count("breakdown").alias("counts"))


def session_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.file_count(readers.session_lines(spark, *_session_folders(spark, sf_dir)))


def stream_session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all session files as a stream: lines, broken ones and times by file."""
    live, archived = _session_folders(spark, sf_dir)
    found = stream.session_events(spark, live).unionByName(stream.session_events(spark, archived, archived=True))
    stem = paths.file_stem(F.col("file")).alias("stem")
    return stream.drained(found.groupBy(stem).agg(F.count("*").alias("lines"), F.count_if("broken").alias("broken"), F.sum(F.size("times").cast("long")).alias("times")), "stem", "update")


def _warnings(spark: SparkSession, sf_dir: str, use_logs: bool) -> DataFrame:
    threads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("tokens_used"))
    bodies = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread_id"), F.concat(F.lit("no counts here, "), F.col("event_type")).alias("feedback_log_body"))
    found = sessions.session_files(readers.session_events(_session_lines(spark, sf_dir).withColumn("at", F.struct(F.lit(0).cast("long").alias("block"), F.col("at").alias("row")))), CAP_MS)
    missing = {"threads": readers.missing_columns(threads, readers.REQUIRED), "orders": []}
    return diagnostics.warnings(spark, found, missing, use_logs, sessions.log_breakdowns(readers.log_bodies(bodies)))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("code", "severity", "message", F.coalesce(F.array_join(F.array_sort(F.map_values("args")), ","), F.lit("")).alias("args"), F.coalesce("source", F.lit("")).alias("source"))


def usage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_warnings(spark, sf_dir, True))


def actionable_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(diagnostics.actionable(_warnings(spark, sf_dir, False)))


# logs


def log_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    body = F.format_string("tool Input_Tokens: %d response input-tokens=%d cached_tokens: %d output_token %d", n % 7, n % 1000, n % 50, n % 90)
    held = e.select(F.col("user_id").cast("string").alias("thread_id"), F.when(n % 4 == 0, F.lit("no counts here")).otherwise(body).alias("feedback_log_body"))
    return sessions.log_breakdowns(readers.log_bodies(held))


def log_json_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    usage = F.format_string('{"input_tokens": %d, "output_tokens": %d, "input_tokens_details": {"cached_tokens": %d}, "output_tokens_details": {"reasoning_tokens": %d}}', n % 1000, n % 90, n % 50, n % 11)
    body = F.when(n % 3 == 0, F.concat(F.lit('event: {"response": {"usage": '), usage, F.lit("}}"))).when(n % 3 == 1, F.concat(F.lit('{"usage": '), usage, F.lit("}"))).otherwise(F.concat(F.lit('{"usage": '), usage, F.lit("} and more")))
    return sessions.log_breakdowns(readers.log_bodies(e.select(F.col("user_id").cast("string").alias("thread_id"), body.alias("feedback_log_body"))))


def log_recursive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    body = F.format_string('x {"a": [{"cached_input_tokens": %d}, {"b": "{\\"output_token_count\\": %d}"}], "Reasoning_Tokens": %d, "tokens": 5}', n % 50, n % 90, n % 11)
    return sessions.log_breakdowns(readers.log_bodies(e.select(F.col("user_id").cast("string").alias("thread_id"), body.alias("feedback_log_body"))))


def log_large_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with numbers that no long holds, as values and as sums, and with repeated keys."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    body = (
        F.when(n % 24 == 0, F.lit('{"usage": {"input_tokens": 1e20}}')).when(n % 24 == 1, F.lit('{"a": {"input_tokens": 1e400, "output_tokens": 3}}')).when(n % 24 == 2, F.lit('{"a": {"cached_input_tokens": 99999999999999999999}}'))
        .when(n % 24 == 3, F.lit("output_tokens: 9223372036854775807, output_tokens: 9223372036854775807")).when(n % 24 == 4, F.lit("reasoning_tokens: 123456789012345678901234567890"))
        .when(n % 3 == 0, F.format_string('{"usage": {"input_tokens": 5, "input_tokens": %d}, "usage": {"output_tokens": 1, "input_tokens": %d, "input_tokens": 2.9}}', n, n))
        .otherwise(F.format_string('{"usage": {"input_tokens": %d}}', n % 1000))
    )
    return sessions.log_breakdowns(readers.log_bodies(e.select((F.col("user_id") % 40).cast("string").alias("thread_id"), body.alias("feedback_log_body"))))


# reports


def format_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = runs(spark, sf_dir).groupBy("workspace_name").agg(F.sum("total_tokens").alias("tokens"), F.sum("duration_ms").alias("ms"), F.count("*").alias("n"))
    share = F.col("n") % 1000 / 1000.0
    return held.select("workspace_name", fmt.as_tokens(F.col("tokens")).alias("tokens"), fmt.as_duration(F.col("ms")).alias("agent_time"), fmt.as_integer(F.col("tokens")).alias("exact_tokens"), fmt.as_percent(share).alias("share"))


def metric_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads, held = built(spark, sf_dir)
    made = [report.snapshot(held, rollups.workspace_summary(held, threads), UsageFilter(view=v, preset="last90"), RUNS_NOW)["cards"] for v in ("time", "tokens")]
    return made[0].unionByName(made[1]).select("id", "value")


def project_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads, held = built(spark, sf_dir)
    wanted = spark.range(1).select(paths.workspace_id(F.lit("C:\\EUROPE\\NATION_3"))).first()[0]
    return report.project_detail(held, rollups.workspace_summary(held, threads), wanted, UsageFilter(preset="all"), RUNS_NOW)["models"]


def project_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other tables of project_detail(): workspace, average, buckets, and the newest runs, a row for each with its numbers."""
    threads, held = built(spark, sf_dir)
    wanted = spark.range(1).select(paths.workspace_id(F.lit("C:\\EUROPE\\NATION_3"))).first()[0]
    tables = report.project_detail(held, rollups.workspace_summary(held, threads), wanted, UsageFilter(preset="custom", start="1996-02-20", end="1997-03-05"), RUNS_NOW)
    made = [
        tables["workspace"].select(F.lit("workspace").alias("part"), F.col("workspace_name").alias("key"), F.col("all_time_tokens").cast("double").alias("value")),
        tables["average"].select(F.lit("average").alias("part"), F.lit("tokens_per_day").alias("key"), F.round("tokens_per_day", 4).alias("value")),
        tables["buckets"].select(F.lit("bucket").alias("part"), "key", F.col("tokens").cast("double").alias("value")),
        tables["recent"].select(F.lit("recent").alias("part"), F.col("id").alias("key"), F.col("total_tokens").cast("double").alias("value")),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def snapshot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, streak, peak and newest runs of a snapshot, a row for each with its number."""
    threads, held = built(spark, sf_dir)
    return _snapshot_rows(report.snapshot(held, rollups.workspace_summary(held, threads), UsageFilter(preset="custom", start="1996-02-20", end="1997-03-05"), RUNS_NOW))


def _snapshot_rows(tables: dict[str, DataFrame]) -> DataFrame:
    made = [
        tables["totals"].select(F.lit("totals").alias("part"), F.lit("all").alias("key"), F.col("all_tokens").alias("value")),
        tables["streak"].select(F.lit("streak").alias("part"), F.lit("days").alias("key"), F.col("longest_streak_days").cast("long").alias("value")),
        tables["peak_by_tokens"].select(F.lit("peak").alias("part"), "key", F.col("tokens").alias("value")),
        tables["runs"].select(F.lit("run").alias("part"), F.col("id").alias("key"), F.col("total_tokens").alias("value")),
    ]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def observed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the sources of runs, counted while these are persisted."""
    watch = diagnostics.Observed()
    SnapshotSet(spark, shared_folder(spark)).commit({"runs": Change(_dated(built(spark, sf_dir, CONFIG, watch)[1]), "start_month")})
    return watch.profile(spark).select("source", "found", "rows", "n_columns", "columns", F.substring("earliest", 1, 19).alias("earliest"), F.substring("latest", 1, 19).alias("latest"))


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    found = diagnostics.source_profile(spark, {name: (table(spark, sf_dir, name), ends.get(name)) for name in TABLES} | {"threads": (None, None)})
    return found.select("source", "found", "rows", "n_columns", "columns", F.substring("earliest", 1, 19).alias("earliest"), F.substring("latest", 1, 19).alias("latest"))


def parse_warnings_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    line = F.when(n % 5 == 0, F.lit("{broken")).when(n % 11 == 0, F.lit("null")).otherwise(F.format_string('{"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "n": %d}', n))
    lines = e.select(F.format_string("f%05d", n % 250).alias("file"), F.lit(False).alias("archived"), F.struct(F.lit(0).cast("long").alias("block"), n.alias("row")).alias("at"), line.alias("line"))
    found = diagnostics.parse_warnings(sessions.session_files(readers.session_events(lines), CAP_MS))
    return found.select("code", "severity", "message", F.col("args")["count"].alias("n"), F.coalesce("source", F.lit("")).alias("source"))


# exports


def daily_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = sinks.daily_csv(rollups.usage_buckets(runs(spark, sf_dir), weekly=False)), shared_folder(spark)
    sinks.write_csv(rows, path)
    return sinks.read_csv(rows, path)


def runs_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = sinks.runs_csv(runs(spark, sf_dir), full_paths=False), shared_folder(spark)
    sinks.write_csv(rows, path)
    return sinks.read_csv(rows, path)


def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, span = runs(spark, sf_dir), UsageFilter(preset="all").resolve(RUNS_NOW)
    made = sinks.summary_json(rollups.range_summary(held, span), rollups.usage_buckets(held, True), rollups.model_usage(held))
    v = F.parse_json("json")
    return made.select(*(F.variant_get(v, f"$.{c}", "long").alias(c) for c in ("runs", "tokens", "agent_time_ms", "active_days")), F.size(F.from_json("json", "daily array<struct<key: string>>")["daily"]).alias("weeks"))


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds with and without full paths, written and read back: rows, tokens and names of workspaces."""
    held, span = saved(runs(spark, sf_dir)), UsageFilter(preset="all").resolve(RUNS_NOW)  # six exports and the numbers of workspaces read them
    weeks = saved(rollups.usage_buckets(held, weekly=True))
    buckets = weeks.orderBy("key")  # files are read in any order
    tables, made = {"buckets": buckets, "runs": held, "summary": rollups.range_summary(held, span), "models": rollups.model_usage(held)}, []
    likes = {"daily-csv": (sinks.daily_csv(buckets), "top_workspace"), "runs-csv": (sinks.runs_csv(held), "workspace")}
    for full in (True, False):
        for kind in ("daily-csv", "runs-csv", "summary-json"):
            sinks.export(kind, path := shared_folder(spark), tables, full)
            if kind in likes:
                like, name = likes[kind]
                back = sinks.read_csv(like, path).select(F.col("tokens").cast("long").alias("tokens"), F.col(name).alias("name"))
            else:
                daily = F.from_json("value", "daily array<struct<tokens: bigint, top_workspace: string>>")["daily"]
                back = spark.read.text(path).select(F.explode(daily).alias("d")).select("d.tokens", F.col("d.top_workspace").alias("name"))
            made.append(back.agg(F.lit(kind).alias("kind"), F.lit(full).alias("full_paths"), F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.count_distinct("name").alias("names")))
    discard(held, weeks)
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def materialized_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sinks.materialize_runs(runs(spark, sf_dir), shared_folder(spark))
    return kept.groupBy("start_date").agg(F.count("*").alias("runs"), F.sum("total_tokens").alias("tokens"))


def _dated(runs: DataFrame) -> DataFrame:
    return runs.withColumn("start_month", refresh.session_month())


def _committed(spark: SparkSession, sf_dir: str) -> SnapshotSet:
    """Two versions of runs, workspaces and warnings: of unarchived threads, then of all."""
    store, found = SnapshotSet(spark, shared_folder(spark)), _warnings(spark, sf_dir, True)
    for archived in (False, True):
        threads, held = built(spark, sf_dir, UsageConfig(ignored=(), include_archived=archived))
        tables = {"runs": Change(_dated(held), "start_month"), "workspaces": Change(rollups.workspace_summary(held, threads))}
        version = store.commit(tables | ({} if archived else {"warnings": Change(found)}), {"archived": str(archived)})
    assert version.number == 2
    return store


def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of a snapshot set, read after the second was committed: rows and tokens of each table. Warnings were committed with the first and taken over."""
    store, made = _committed(spark, sf_dir), []
    for number in store.versions():
        for name, used in (("runs", "total_tokens"), ("workspaces", "all_time_tokens")):
            made.append(store.read(name, store.version(number)).agg(F.lit(number).cast("long").alias("version"), F.lit(name).alias("part"), F.count("*").alias("rows"), F.sum(used).alias("tokens")))
        made.append(store.read("warnings", store.version(number)).agg(F.lit(number).cast("long").alias("version"), F.lit("warnings").alias("part"), F.count("*").alias("rows"), F.lit(None).cast("long").alias("tokens")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def cached_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard of snapshot_tables() and the workspaces, out of the tables of a version alone."""
    store = _committed(spark, sf_dir)
    tables = report.snapshot(store.read("runs"), store.read("workspaces"), UsageFilter(preset="custom", start="1996-02-20", end="1997-03-05"), RUNS_NOW)
    return _snapshot_rows(tables).unionByName(tables["workspaces"].select(F.lit("workspace").alias("part"), F.col("workspace_name").alias("key"), F.col("all_time_tokens").alias("value")))


def persisted_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range's summary from a persisted table, of which only the range's months are read."""
    span = UsageFilter(preset="custom", start="1996-02-20", end="1997-03-05").resolve(RUNS_NOW)
    store = SnapshotSet(spark, shared_folder(spark))
    store.commit({"runs": Change(_dated(runs(spark, sf_dir)), "start_month")})
    return flat(rollups.range_summary(rollups.filter_runs(store.read("runs"), "all", span), span)).withColumns({c: F.round(c, 4) for c in ("tokens_per_run", "tokens_per_day", "time_per_run_ms", "time_per_active_day_ms", "time_per_day_ms", "runs_per_day")})


def _changing_files(spark: SparkSession, sf_dir: str) -> tuple[str, Callable[[], None]]:
    """A folder of session files, and what changes them: one is new, one longer, one gone, one moved to the archive."""
    lines, folder = _session_lines(spark, sf_dir), shared_folder(spark)
    early = lines.where("file != 's03' and not (file = 's05' and at % 3 = 0)").withColumn("archived", F.col("archived") & (F.col("file") != "s08"))
    early = early.unionByName(lines.where("file = 's07'").withColumn("file", F.lit("s99")))
    for name, wanted in (("live", ~F.col("archived")), ("archived", F.col("archived"))):
        sinks.write_session_files(early.where(wanted), f"{folder}/{name}")

    def change() -> None:
        for name in ("s99", "s05", "s08"):
            sinks.remove(spark, f"{folder}/live/{name}.jsonl")
        sinks.write_session_files(lines.where("file in ('s03', 's05')"), f"{folder}/live/late")
        sinks.write_session_files(lines.where("file = 's08'"), f"{folder}/archived/late")

    return folder, change


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after a second refresh, which reads no other files than those that changed since the first."""
    folder, change = _changing_files(spark, sf_dir)
    store = SnapshotSet(spark, f"{folder}/store")
    refresh.refresh(store, f"{folder}/live", f"{folder}/archived", cap_ms=CAP_MS)
    change()
    done = refresh.refresh(store, f"{folder}/live", f"{folder}/archived", cap_ms=CAP_MS)
    assert (done.added, done.changed, done.removed) == (3, 0, 3)
    return _session_columns(sessions.by_id(store.read("sessions")))


def refreshed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of users as threads after a second refresh: session files have changed, and some threads are new, gone, or have other tokens."""
    folder, change = _changing_files(spark, sf_dir)
    n, user = F.col("event_id"), F.col("user_id")
    users = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.sum(F.floor("value").cast("long")).alias("tokens_used"), F.sum(n % 7).alias("input"), F.sum(n % 5).alias("output"))

    def threads(wanted: Column, tokens_used: Column) -> refresh.Threads:
        named = F.concat(F.lit("u"), user)
        held = users.where(wanted).select(
            named.alias("id"), F.format_string("/x/s%02d.jsonl", user % 40).alias("rollout_path"), F.unix_millis("a").alias("created_at_ms"), F.unix_millis("b").alias("updated_at_ms"), tokens_used.alias("tokens_used"), "user_id", "input", "output"
        )
        logs = held.where(user % 2 == 0).select(F.col("id").alias("thread_id"), "input", "output", F.lit(0).cast("long").alias("cached"), F.lit(None).cast("long").alias("reasoning"))
        return refresh.Threads(fact.normalize_threads(held, CONFIG), logs, CONFIG)

    store, used = SnapshotSet(spark, f"{folder}/store"), F.col("tokens_used")
    refresh.refresh(store, f"{folder}/live", f"{folder}/archived", cap_ms=CAP_MS, threads=threads(user % 13 != 5, F.when(user % 11 == 3, -1).otherwise(used)))
    change()
    refresh.refresh(store, f"{folder}/live", f"{folder}/archived", cap_ms=CAP_MS, threads=threads(user % 13 != 6, used))
    return plain_times(flat(store.read("runs").select("id", "start_time", "end_time", "duration_ms", "duration_method", "total_tokens", "token_breakdown")))


def usage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: sources, a refresh, changes, another refresh, and reports of the newest version and of the one before."""
    folder, change = _changing_files(spark, sf_dir)
    n, user = F.col("event_id"), F.col("user_id")
    users = events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.sum(F.floor("value").cast("long")).alias("tokens_used"))
    threads = users.select(
        F.concat(F.lit("u"), user).alias("id"), F.format_string("/x/s%02d.jsonl", user % 40).alias("rollout_path"), F.unix_millis("a").alias("created_at_ms"), F.unix_millis("b").alias("updated_at_ms"),
        F.concat(F.lit("c:/team/"), (user % 5).cast("string")).alias("cwd"), "tokens_used",
    )
    bodies = events(spark, sf_dir).where(user % 2 == 0).select(F.concat(F.lit("u"), user).alias("thread_id"), F.format_string('{"usage": {"input_tokens": %d}}', n % 7).alias("feedback_log_body"))
    held = {"threads": threads.where(user % 13 != 5)}
    job = Usage(spark, f"{folder}/store", Sources(f"{folder}/live", lambda: held["threads"], f"{folder}/archived", lambda: bodies), UsageConfig(idle_gap_minutes=180, ignored=()))
    assert job.cached_snapshot(UsageFilter(preset="all"), EVENTS_NOW) is None
    job.refresh()
    change()
    held["threads"] = threads
    job.refresh()
    tables, made = job.cached_snapshot(UsageFilter(preset="all"), EVENTS_NOW), []
    made.append(tables["totals"].select(F.lit("totals").alias("part"), F.lit("tokens").alias("key"), F.col("all_tokens").alias("value")))
    made.append(job.snapshot(UsageFilter(preset="all"), EVENTS_NOW, 1)["totals"].select(F.lit("before").alias("part"), F.lit("tokens").alias("key"), F.col("all_tokens").alias("value")))
    made.append(tables["workspaces"].select(F.lit("workspace").alias("part"), F.col("workspace_name").alias("key"), F.col("all_time_tokens").alias("value")))
    made.append(job.diagnostics()["warnings"].groupBy("code").count().select(F.lit("warnings").alias("part"), F.col("code").alias("key"), F.col("count").alias("value")))
    made.append(tables["summary"].select(F.lit("summary").alias("part"), F.lit("agent_time_ms").alias("key"), F.col("agent_time_ms").alias("value")))
    made.append(job.store.read("files").agg(F.lit("files").alias("part"), F.lit("archived").alias("key"), F.count_if("archived").alias("value")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


# streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_active_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.drained(stream.active_time(_event_stream(spark, sf_dir), "user_id", "ts", CAP_MS, "40 days"), "user_id", "update")


def stream_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _event_stream(spark, sf_dir).withColumn("n", F.floor("value").cast("long"))
    return stream.drained(stream.usage_buckets(held, "ts", "40 days", {"tokens": "n"}), "key", "update")


def stream_week_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _event_stream(spark, sf_dir).withColumn("n", F.floor("value").cast("long"))
    return stream.drained(stream.usage_buckets(held, "ts", "40 days", {"tokens": "n"}, weekly=True), "key", "update")


QUERIES = {
    f.__name__: f
    for f in (
        session_active_time, session_last_meta, session_best_breakdown, session_dedup_by_id, session_dedup_by_stem, runs_two_key_lookup, run_breakdown_coalesce,
        epoch_fallback, schema_drift_defaults, daily_usage, weekly_usage, preset_totals, range_summary_custom, chart_points, visible_runs, top_workspaces, orphan_sessions,
        peak_bucket_time, peak_bucket_tokens, longest_streak,
        all_time_bounds, workspace_summary, model_usage, recent_runs, recent_sessions, cache_hit_rate, path_normalize, workspace_id, display_name, alias_rewrite, alias_table, ignored_table,
        hidden_workspaces, anonymize_runs, anonymize_workspaces, anonymize_buckets, log_text_tokens, log_json_tokens, log_recursive_tokens, format_metrics,
        metric_cards, project_detail, project_tables, snapshot_tables, source_profile, parse_warnings_capped, session_jsonl, session_jsonl_live, session_file_count, usage_warnings, actionable_warnings, exports, stream_session_lines, daily_csv_roundtrip, runs_csv_roundtrip, summary_json, materialized_runs,
        stream_active_time, stream_buckets, stream_week_buckets, snapshot_versions, cached_snapshot, persisted_range, incremental_refresh, refreshed_runs, usage_reports, session_odd_lines, observed_profile, recent_runs_by_workspace,
        day_bitmaps, bitmap_summary, bitmap_range, alias_rule_table, log_large_numbers,
    )
}
