"""Exports: CSV, JSON and the persisted fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.formatting import minutes_of
from runloom.operators import privacy

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def write_csv(df: DataFrame, path: str) -> None:
    """A header, quotes only where needed, quotes doubled, null as nothing, white space kept."""
    options = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).csv(path)


def read_csv(df_like: DataFrame, path: str) -> DataFrame:
    """The rows of an export, all columns as text, empty for null."""
    spark = df_like.sparkSession
    schema = ", ".join(f"`{c}` string" for c in df_like.columns)
    return spark.read.options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).schema(schema).csv(path).na.fill("")


def daily_csv(buckets: DataFrame, full_paths: bool = True) -> DataFrame:
    held = buckets if full_paths else privacy.anonymize_buckets(buckets)
    return held.select(F.col("key").alias("date"), "runs", "tokens", minutes_of(F.col("agent_time_ms")).alias("agent_time_minutes"), "active_projects", F.coalesce("top_workspace", F.lit("")).alias("top_workspace"))


def _iso(time: str):
    return F.date_format(F.to_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()), ISO)


def runs_csv(runs: DataFrame, full_paths: bool = True) -> DataFrame:
    """All runs given; the caller may cap them with recent_runs()."""
    held = runs if full_paths else privacy.anonymize_runs(runs)
    return held.select(
        "id", "title", F.col("workspace_name").alias("workspace"), "workspace_path", _iso("start_time").alias("start_time"), _iso("end_time").alias("end_time"),
        minutes_of(F.col("duration_ms")).alias("duration_minutes"), "model", F.col("total_tokens").alias("tokens"), "archived", F.coalesce("rollout_path", F.lit("")).alias("rollout_path"),
    )


def summary_json(summary: DataFrame, buckets: DataFrame, models: DataFrame) -> DataFrame:
    """One row, json: the summary row with its days and models nested. Both lists are as long as the range has days and models; runs and workspaces are exported on their own."""
    days = buckets.agg(F.array_sort(F.collect_list(F.struct("key", "runs", "tokens", "agent_time_ms", "active_projects", "top_workspace"))).alias("daily"))
    by_model = models.agg(F.array_sort(F.collect_list(F.struct("model", "tokens", "runs"))).alias("models"))
    return summary.crossJoin(days).crossJoin(by_model).select(F.to_json(F.struct(*summary.columns, "daily", "models")).alias("json"))  # three tables of one row


def write_session_files(lines: DataFrame, folder: str) -> None:
    """Lines (file, at, line) as <folder>/<file>.jsonl, each in order. A file is written by one task; the driver only renames files."""
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(folder)
    context = lines.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    for status in system.globStatus(path(f"{folder}/file=*/part-*")) or ():
        name = status.getPath().getParent().getName().removeprefix("file=")
        system.rename(status.getPath(), path(f"{folder}/{name}.jsonl"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)


def materialize_runs(runs: DataFrame, path: str) -> DataFrame:
    """The fact table by start month, in order of time within its files: a range reads its months only, and of these the row groups of its days."""
    held = runs.withColumns({"start_date": F.to_date("start_time"), "start_month": F.date_format("start_time", "yyyy-MM")})
    dealt = held.repartition("start_month", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("start_month", "start_time")
    dealt.write.mode("overwrite").partitionBy("start_month").parquet(path)
    return runs.sparkSession.read.parquet(path)


def export(kind: str, path: str, tables: dict[str, DataFrame], full_paths: bool = True) -> None:
    """Writes "daily-csv", "runs-csv" or "summary-json" from the tables of a report. Spark's errors are raised."""
    if kind == "daily-csv":
        write_csv(daily_csv(tables["buckets"], full_paths), path)
    elif kind == "runs-csv":
        write_csv(runs_csv(tables["runs"], full_paths), path)
    elif kind == "summary-json":
        buckets = tables["buckets"] if full_paths else privacy.anonymize_buckets(tables["buckets"])
        summary_json(tables["summary"], buckets, tables["models"]).select("json").write.text(path)
    else:
        raise ValueError(f"unknown export: {kind}")
