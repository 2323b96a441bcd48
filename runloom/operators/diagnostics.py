"""What was read, and what was wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runloom.functions.paths import file_stem

WARNING = "code string, severity string, message string, args map<string,string>, source string"


def source_profile(spark: SparkSession, sources: dict[str, tuple[DataFrame | None, str | None]]) -> DataFrame:
    """One row for each source (table or None, time column or None): found, rows, n_columns, columns, earliest and latest."""
    out = None
    for name, (df, time) in sources.items():
        if df is None:
            row = spark.range(1).select(F.lit(False).alias("found"), F.lit(0).cast("long").alias("rows"), F.lit("").alias("columns"), *(F.lit(None).cast("string").alias(c) for c in ("earliest", "latest")))
        else:
            ends = [(f(time).cast("string") if time else F.lit(None).cast("string")).alias(c) for f, c in ((F.min, "earliest"), (F.max, "latest"))]
            row = df.agg(F.count("*").alias("rows"), *ends).select(F.lit(True).alias("found"), "rows", F.lit(",".join(df.columns)).alias("columns"), "earliest", "latest")
        row = row.withColumn("n_columns", F.when(F.col("columns") == "", 0).otherwise(F.size(F.split("columns", ",")))).select(F.lit(name).alias("source"), "found", "rows", "n_columns", "columns", "earliest", "latest")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "source string, found boolean, rows long, n_columns int, columns string, earliest string, latest string")


class Observed:
    """Counts of sources taken while something else is made from them, so that a profile costs no scan of its own.

    watch() gives the table to read on with; what is read of it must be selected before, as Spark prunes
    no column beyond the counter. profile() waits until an action has read every watched table to its end.
    """

    def __init__(self) -> None:
        self._held: dict[str, tuple[Observation, list[str]]] = {}

    def watch(self, name: str, df: DataFrame, time: str | None = None, columns: list[str] | None = None) -> DataFrame:
        moment = F.col(time) if time else F.lit(None)
        seen = Observation(name)
        self._held[name] = (seen, columns or df.columns)
        return df.observe(seen, F.count("*").alias("rows"), F.min(moment).cast("string").alias("earliest"), F.max(moment).cast("string").alias("latest"))

    def profile(self, spark: SparkSession) -> DataFrame:
        """The rows of source_profile() for the watched sources."""
        rows = []
        for name, (seen, columns) in self._held.items():
            got = seen.get
            rows.append((name, True, got["rows"], len(columns), ",".join(columns), got["earliest"], got["latest"]))
        return spark.createDataFrame(rows, "source string, found boolean, rows long, n_columns int, columns string, earliest string, latest string")


def file_count(lines: DataFrame) -> DataFrame:
    """Number of session files with lines."""
    return lines.agg(F.count_distinct("file").alias("files"))


def parse_warnings(sessions: DataFrame, first: int = 20) -> DataFrame:
    """Warnings of the first files with broken lines, and one row that counts the rest; the limit is the report's feature."""
    broken = sessions.where("parse_warnings > 0")
    shown = broken.orderBy("file").limit(first)
    shown = shown.select(F.lit("parse_warning").alias("code"), F.lit("warning").alias("severity"), F.lit("jsonl lines could not be parsed").alias("message"), F.create_map(F.lit("count"), F.col("parse_warnings").cast("string")).alias("args"), F.col("file").alias("source"))
    rest = broken.agg((F.count("*") - first).alias("n")).where("n > 0")
    rest = rest.select(F.lit("parse_warning").alias("code"), F.lit("warning").alias("severity"), F.lit("more files with warnings").alias("message"), F.create_map(F.lit("count"), F.col("n").cast("string")).alias("args"), F.lit(None).cast("string").alias("source"))
    return shown.unionByName(rest)


def _warning(spark: SparkSession, code: str, severity: str, message: str, args: dict[str, str] | None = None, source: str | None = None) -> DataFrame:
    return spark.createDataFrame([(code, severity, message, args or {}, source)], WARNING)


def warnings(spark: SparkSession, sessions: DataFrame | None, missing: dict[str, list[str]], use_logs: bool, logs: DataFrame | None, first: int = 20) -> DataFrame:
    """All warnings: missing columns by source, logs switched off or without tokens, broken session lines, and the privacy note."""
    rows = [_warning(spark, "privacy", "info", "conversation text is not read")]
    rows += [_warning(spark, "missing_source", "warning", "columns are missing", {"columns": ",".join(columns)}, source) for source, columns in missing.items() if columns]
    if not use_logs:
        rows.append(_warning(spark, "logs_disabled", "info", "log bodies are not read"))
    elif logs is not None:
        none = logs.agg(F.count("*").alias("n")).where("n = 0")
        rows.append(none.select(F.lit("no_log_tokens").alias("code"), F.lit("info").alias("severity"), F.lit("no log row has tokens").alias("message"), F.expr("cast(map() as map<string,string>)").alias("args"), F.lit(None).cast("string").alias("source")))
    if sessions is not None:
        rows.append(parse_warnings(sessions, first))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def actionable(found: DataFrame) -> DataFrame:
    return found.where("severity != 'info'")


def orphan_sessions(sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """Sessions that no run refers to by id or file stem."""
    stems = runs.select(file_stem(F.col("rollout_path")).alias("stem")).where("stem is not null").distinct()
    return sessions.join(runs.select("id"), "id", "left_anti").join(stems, "stem", "left_anti")
