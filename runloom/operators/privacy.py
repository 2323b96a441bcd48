"""Reports without names and paths of workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.paths import UNKNOWN
from runloom.operators.ranks import numbered


def workspace_numbers(runs: DataFrame) -> DataFrame:
    """workspace_id and number, from 1 by the workspace's first place in runs, newest first. Workspaces, not runs, are ranked, in ranges that many tasks sort."""
    newest = runs.groupBy("workspace_id").agg(F.min(F.struct((-F.unix_micros(F.col("start_time").cast("timestamp"))).alias("age"), "id")).alias("first"))
    return numbered(newest, [F.col(c).asc() for c in ("first.age", "first.id", "workspace_id")]).select("workspace_id", "number")


def _label(path: Column, number: Column) -> Column:
    return F.when(path == UNKNOWN, path).otherwise(F.concat(F.lit("Workspace "), number.cast("string")))


def _masked_id(workspace_id: Column) -> Column:
    """Ids are reversible codes of paths, so they are hashed."""
    return F.substring(F.sha2(workspace_id, 256), 1, 16)


def anonymize_runs(runs: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Runs with numbered workspaces and without rollout paths; titles stay. An unknown workspace keeps its label and takes a number."""
    held = runs.join(numbers if numbers is not None else workspace_numbers(runs), "workspace_id", "left")
    label = _label(F.col("workspace_path"), F.col("number"))
    return held.withColumns({"workspace_name": label, "workspace_path": label, "rollout_path": F.lit(None).cast("string"), "workspace_id": _masked_id(F.col("workspace_id"))}).select(*runs.columns)


def anonymize_workspaces(workspaces: DataFrame, numbers: DataFrame) -> DataFrame:
    """The workspace list with the numbers that anonymize_runs() uses; workspaces without runs are numbered after them."""
    last = numbers.agg(F.coalesce(F.max("number"), F.lit(0)).alias("_last"))  # one row
    fresh = numbered(workspaces.join(numbers, "workspace_id", "left_anti"), [F.col("workspace_id").asc()]).crossJoin(F.broadcast(last))
    held = workspaces.join(numbers, "workspace_id").unionByName(fresh.withColumn("number", F.col("number") + F.col("_last")).drop("_last"))
    label = _label(F.col("workspace_path"), F.col("number"))
    return held.withColumns({c: label for c in ("workspace_name", "workspace_path", "raw_path")}).withColumn("workspace_id", _masked_id(F.col("workspace_id"))).select(*workspaces.columns)


def anonymize_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets that only tell that there was a top workspace."""
    return buckets.withColumn("top_workspace", F.when(F.col("top_workspace").isNotNull(), F.lit("Workspace")))
