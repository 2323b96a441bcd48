"""Input tables: session event lines, threads and log bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import tokens
from runloom.functions.paths import trimmed

#: Columns of the thread table with what stands for an absent one.
THREAD_TEXT = ("id", "rollout_path", "cwd", "title", "model_provider", "model")
THREAD_NUMBERS = ("created_at", "updated_at", "created_at_ms", "updated_at_ms", "tokens_used", "archived")
REQUIRED = ("id", "created_at", "updated_at", "cwd", "tokens_used")


#: Names of session files.
SESSION_FILES = "*.[jJ][sS][oO][nN][lL]"


def lines_of(spark: SparkSession, paths: str | list[str], archived: bool) -> DataFrame:
    """file, archived, at (order within the file) and line of every line of some files, or of all session files below some folders."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", SESSION_FILES).text(paths)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return read.select(F.col("_metadata.file_path").alias("file"), F.lit(archived).alias("archived"), at.alias("at"), F.col("value").alias("line"))


def no_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file string, archived boolean, at struct<block: bigint, row: bigint>, line string")


def session_lines(spark: SparkSession, live: str, archived: str | None = None, include_archived: bool = True) -> DataFrame:
    """The lines of all session files below the two folders."""
    found = lines_of(spark, live, False)
    return found.unionByName(lines_of(spark, archived, True)) if archived and include_archived else found


def event_time(text: Column) -> Column:
    """The time that a text names, else null. A date alone, or its year and month, or its year, is midnight in UTC; "Thu, 23 Apr 2026 01:00:00 GMT" is read too."""
    day = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d\d$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d\d-\d\d$"), text)
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3,9}, *", ""), r" (GMT|UTC|Z)$", " +0000")
    iso = F.when(text.rlike(r"^[+-]?\d{4,6}-"), F.try_to_timestamp(text))
    mailed = F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))
    return F.when(day.isNotNull(), F.try_to_timestamp(F.concat(day, F.lit("T00:00:00Z")))).otherwise(F.coalesce(iso, mailed))


def session_events(lines: DataFrame) -> DataFrame:
    """What a session's lines say: file, archived, at, broken, times, id, cwd, model, breakdown. Blank lines are dropped.

    A line that is no JSON, or JSON null, is broken. Only times, types and the named fields of the
    payload are read, never a text of the conversation. Of a repeated key the last counts; the session
    is set to accept such lines.
    """
    tokens.accept_repeated_keys(lines.sparkSession)
    held = lines.withColumn("line", trimmed(F.col("line"))).where("line != ''").withColumn("v", tokens.strict_json(F.col("line")))
    v = F.col("v")
    type_, meta = tokens.text_at(v, "$.type"), F.col("type") == "session_meta"
    event = F.col("type") == "event_msg"
    started = F.when(event, event_time(tokens.text_at(v, "$.payload.started_at", only_text=True)))
    counted = event & (tokens.text_at(v, "$.payload.type") == "token_count")
    held = held.withColumn("type", type_)
    return held.select(
        "file", "archived", "at", F.coalesce(v.isNull() | F.is_variant_null(v), F.lit(True)).alias("broken"),
        F.array_compact(F.array(event_time(tokens.text_at(v, "$.timestamp", only_text=True)), started)).alias("times"),
        *(F.when(meta, tokens.text_at(v, f"$.payload.{c}")).alias(c) for c in ("id", "cwd", "model")),
        F.when(counted, tokens.session_breakdown(v)).alias("breakdown"),
    )


def threads(df: DataFrame) -> DataFrame:
    """The thread table with all its columns: absent text is empty, an absent number 0."""
    text = [(F.col(c).cast("string") if c in df.columns else F.lit("")).alias(c) for c in THREAD_TEXT]
    numbers = [(F.col(c).cast("long") if c in df.columns else F.lit(0).cast("long")).alias(c) for c in THREAD_NUMBERS]
    return df.select(*text, *numbers)


def log_bodies(df: DataFrame) -> DataFrame:
    """thread_id and body of log rows that have both; no rows if the columns are missing. Of a repeated key in a body the last counts, see session_events()."""
    if not {"thread_id", "feedback_log_body"} <= set(df.columns):
        return df.sparkSession.createDataFrame([], "thread_id string, body string")
    tokens.accept_repeated_keys(df.sparkSession)
    return df.select(F.col("thread_id").cast("string").alias("thread_id"), F.col("feedback_log_body").alias("body")).dropna()


def missing_columns(df: DataFrame | None, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if df is None or c not in df.columns]
