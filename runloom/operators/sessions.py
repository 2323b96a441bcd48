"""Sessions out of events: active time, last metadata, best breakdown, and one session per id or file stem."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.functions import tokens
from runloom.functions.paths import file_stem
from runloom.functions.times import millis


def _slice(time: Column, cap_ms: int) -> Column:
    return F.floor(millis(time) / max(1, cap_ms))


def _active(slices: DataFrame, session: list[str], cap_ms: int) -> tuple[DataFrame, Column]:
    """Slices (_slice, _first, _last) with their gap to the slice before, and the aggregate of a session's active milliseconds."""
    before = F.lag("_last").over(W.partitionBy(*session).orderBy("_slice"))
    gap = F.when(before.isNotNull(), F.least(millis(F.col("_first")) - millis(before), F.lit(cap_ms)))
    within = F.sum(millis(F.col("_last")) - millis(F.col("_first")))
    return slices.withColumn("_gap", F.when(F.col("_slice").isNotNull(), gap)), F.coalesce(within, F.lit(0)) + F.coalesce(F.sum("_gap"), F.lit(0))


def active_time(events: DataFrame, session: list[str], time: str, cap_ms: int, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Per session: start_time, end_time, events and active_ms, the sum of gaps between its events, each up to the cap.

    Time is cut into slices as long as the cap. No gap within a slice reaches it, so they add up to
    the slice's last time less its first, whatever lies between: events are never sorted, but folded
    by slice before they are shuffled. Each slice then meets the one before it. ``sums`` are added up
    by session on the way, over events without time too; sessions without any time then stay.
    """
    named = {name: column.alias(name) for name, column in (sums or {}).items()}
    held = events if named else events.where(F.col(time).isNotNull())
    held = held.select(*session, F.col(time).alias("_t"), *named.values()).withColumn("_slice", _slice(F.col("_t"), cap_ms))
    folded = held.groupBy(*session, "_slice").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count("_t").alias("_n"), *(F.sum(c).alias(c) for c in named))
    slices, active = _active(folded, session, cap_ms)
    return slices.groupBy(*session).agg(F.min("_first").alias("start_time"), F.max("_last").alias("end_time"), F.sum("_n").alias("events"), active.alias("active_ms"), *(F.sum(c).alias(c) for c in named))


def last_known(value: str, order: str) -> Column:
    """The last value, in order, that is not null."""
    return F.expr(f"max_by({value}, {order}) FILTER (WHERE {value} IS NOT NULL)")


def session_files(events: DataFrame, cap_ms: int) -> DataFrame:
    """One row for each file of session events: id, file, stem, archived, cwd, model, start_time, end_time, active_ms, breakdown, parse_warnings.

    Lines are folded twice: by file and slice of time (see active_time()), before the shuffle and
    after it, then by file. So a file with a third of all lines is the work of many tasks, and what
    one task gets of it is a row for each slice. The last known value of each kind travels with its
    place in the file.
    """
    held = events.select("*", F.posexplode_outer("times").alias("nth", "time")).withColumn("once", F.coalesce(F.col("nth"), F.lit(0)) == 0)
    latest = {c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("v")))) for c in ("id", "cwd", "model")}
    best = F.max(F.when(F.col("breakdown").isNotNull(), F.struct(tokens.score(F.col("breakdown")).alias("score"), "at", F.col("breakdown").alias("v"))))
    slices = held.groupBy("file", "archived", _slice(F.col("time"), cap_ms).alias("_slice")).agg(
        F.min("time").alias("_first"), F.max("time").alias("_last"), F.count_if(F.col("broken") & F.col("once")).alias("_broken"), best.alias("breakdown"), *(v.alias(c) for c, v in latest.items()),
    )
    slices, active = _active(slices, ["file", "archived"], cap_ms)
    found = slices.groupBy("file", "archived").agg(
        *(F.max(c)["v"].alias(f"last_{c}") for c in ("id", "cwd", "model")), F.min("_first").alias("start_time"), F.max("_last").alias("end_time"), active.alias("active_ms"),
        F.max("breakdown")["v"].alias("breakdown"), F.sum("_broken").alias("parse_warnings"),
    )
    stem = file_stem(F.col("file"))
    found = found.withColumns({"stem": stem, "id": F.coalesce("last_id", stem), "cwd": F.col("last_cwd"), "model": F.col("last_model")})
    return found.select("file", "archived", "cwd", "model", "start_time", "end_time", "active_ms", "breakdown", "parse_warnings", "stem", "id")


def by_id(sessions: DataFrame) -> DataFrame:
    """One session for each id: an archived one before live ones, then the first file. An aggregate, so each task sends one row for an id at most."""
    first = F.min_by(F.struct(*sessions.columns), F.struct((~F.col("archived")).alias("live"), "file"))
    return sessions.groupBy(F.col("id").alias("_key")).agg(first.alias("_s")).select("_s.*")


def by_stem(sessions: DataFrame) -> DataFrame:
    """One session for each file stem: the last file, archived ones coming last. An aggregate as by_id()."""
    last = F.max_by(F.struct(*sessions.columns), F.struct("archived", "file"))
    return sessions.groupBy(F.col("stem").alias("_key")).agg(last.alias("_s")).select("_s.*")


def log_breakdowns(bodies: DataFrame) -> DataFrame:
    """Per thread: input, output, cached and reasoning summed over its log rows, and rows, the number of rows with tokens. Counts and sums stop at the largest long.

    A body's counts come from response.usage, else usage, else a scan of the whole JSON, else the
    text. Only bodies that the first two leave empty go through the scan, the one Python function.
    """
    v = F.col("v")
    held = bodies.withColumn("v", tokens.body_json(F.col("body")))

    def counts(path: str, rest: Column) -> Column:
        return tokens.once(tokens.usage_breakdown(v, path), lambda b: F.when(~tokens.is_zero(b), b).otherwise(rest))

    held = held.withColumn("usage", counts("$.response.usage", counts("$.usage", F.lit(None).cast(tokens.BREAKDOWN))))
    open_ = F.col("usage").isNull() & v.isNotNull() & F.col("body").rlike("(?i)token")
    bare = F.regexp_replace(F.col("body"), r"(?U)^\s+|\s+$", "")
    json_text = F.when(bare.rlike(r"^[\[{]"), bare).otherwise(F.substring(F.col("body"), F.instr("body", "{"), F.length("body")))
    held = held.withColumn("scan", tokens.scan_breakdown(F.when(open_, json_text)))
    scanned = tokens.once(F.col("scan"), lambda b: F.when(~tokens.is_zero(b), b))  # null where nothing was scanned
    held = held.select("thread_id", F.coalesce("usage", scanned, tokens.text_breakdown(F.col("body"))).alias("b"))
    sums = [tokens.total(F.coalesce(f"b.{p}", F.lit(0))).alias(p) for p in tokens.PARTS]
    return held.groupBy("thread_id").agg(*sums, F.count_if(~tokens.is_zero(F.col("b"))).alias("rows")).where("rows > 0")
