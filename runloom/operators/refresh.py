"""Incremental refresh of sessions and runs: only changed files are parsed, only changed runs are built, only touched months are written."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.config import UsageConfig
from runloom.functions import paths, tokens
from runloom.operators import runs as fact
from runloom.operators import sessions
from runloom.sources import readers
from runloom.sources.scratch import discard, saved
from runloom.sources.snapshots import Change, SnapshotSet, Version

MONTH = "start_month"
#: The month of a session without times.
NO_MONTH = "none"
#: Up to so many changed files are read by name; beyond that all files are listed again and those that did not change are left out by a join.
NAMED_FILES = 10_000

_FILES = "file string, archived boolean, length long, modified timestamp"


@dataclass(frozen=True)
class Refreshed:
    """What a refresh found; ``months`` are those it has written anew."""

    version: Version
    added: int
    changed: int
    removed: int
    months: Sequence[str]


def listed(spark: SparkSession, live: str, archived: str | None = None, include_archived: bool = True) -> DataFrame:
    """file, archived, length and modified of every session file, without reading any."""

    def below(path: str, flag: bool) -> DataFrame:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", readers.SESSION_FILES).load(path)
        return read.select(F.col("_metadata.file_path").alias("file"), F.lit(flag).alias("archived"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))

    found = below(live, False)
    return found.unionByName(below(archived, True)) if archived and include_archived else found


def file_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that were added, removed or changed (in place, size or time) since ``before``, which also has their month: file, archived, length, modified, status and month (of old)."""
    same = F.col("n.length").eqNullSafe(F.col("b.length")) & F.col("n.modified").eqNullSafe(F.col("b.modified")) & F.col("n.archived").eqNullSafe(F.col("b.archived"))
    status = F.when(F.col("b.file").isNull(), "added").when(F.col("n.file").isNull(), "removed").when(~same, "changed")
    joined = now.alias("n").join(before.alias("b"), F.col("n.file") == F.col("b.file"), "full").withColumn("status", status).where("status is not null")
    return joined.select(F.coalesce("n.file", "b.file").alias("file"), "n.archived", "n.length", "n.modified", "status", F.col(f"b.{MONTH}").alias("month"))


def session_month(time: str = "start_time") -> F.Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(NO_MONTH))


def _lines(spark: SparkSession, wanted: DataFrame, live: str, archived: str | None) -> DataFrame:
    """Lines of the wanted files (file, archived)."""
    named = wanted.limit(NAMED_FILES + 1).collect()
    if len(named) > NAMED_FILES:
        return readers.session_lines(spark, live, archived).join(wanted.select("file"), "file", "left_semi")

    def some(flag: bool) -> DataFrame | None:
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r["file"])) for r in named if r["archived"] == flag]
        return readers.lines_of(spark, paths, flag) if paths else None

    found = [df for df in (some(False), some(True)) if df is not None]
    if not found:
        return readers.no_lines(spark)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


Derived = Callable[[Callable[[str], DataFrame]], Mapping[str, Change]]


@dataclass(frozen=True)
class Threads:
    """What runs are built from beside sessions: threads as normalised, log counts (thread_id and counts), and how."""

    rows: DataFrame
    logs: DataFrame
    config: UsageConfig


def _renewed(store: SnapshotSet, base: Version | None, name: str, rows: DataFrame, gone: DataFrame, key: str, touched: Sequence[str]) -> Change:
    """``rows`` and what the touched months of the version before keep: all but those whose key is gone."""
    if base is None or name not in base.tables:
        return Change(rows, MONTH)
    kept = store.read(name, base, touched).join(gone, key, "left_anti")
    return Change(kept.unionByName(rows), MONTH, touched)


def _months(*rows: DataFrame) -> list[str]:
    """The distinct months of some tables; as many as there are months reach the driver."""
    held = rows[0].select(MONTH)
    for more in rows[1:]:
        held = held.union(more.select(MONTH))
    return sorted(r[0] for r in held.where(F.col(MONTH).isNotNull()).distinct().collect())


def _run_changes(store: SnapshotSet, base: Version | None, threads: Threads, gone: DataFrame, new: DataFrame, old_sessions: DataFrame | None) -> tuple[dict[str, Change], Sequence[str]]:
    """Changes of tables ``runs`` and ``threads`` (a hash of each thread and its logs).

    A run is built anew if its thread or logs differ from before, or if a session of its id or file
    stem has changed or is gone; other sessions of that id or stem are looked up in the persisted table.
    """
    spark, held = store.spark, threads.rows.withColumn("_stem", paths.file_stem(F.col("rollout_path")))
    counts = threads.logs.select(F.col("thread_id").alias("id"), F.struct(*tokens.PARTS).alias("_log"))
    marks = saved(held.join(counts, "id", "left").select("id", F.xxhash64(*(c for c in held.columns if c != "_stem"), "_log").alias("mark")))
    if base is None or "runs" not in base.tables:
        affected, before = saved(marks.select("id")), None
    else:
        before = store.read("threads", base)
        differ = marks.alias("n").join(before.alias("b"), "id", "full").where(~F.col("n.mark").eqNullSafe(F.col("b.mark"))).select("id")
        sessions_ = new.select("id", "stem") if old_sessions is None else new.select("id", "stem").union(old_sessions.join(gone, "file", "left_semi").select("id", "stem"))
        met = held.join(sessions_.select("id").distinct(), "id", "left_semi").select("id").union(held.join(sessions_.select(F.col("stem").alias("_stem")).distinct(), "_stem", "left_semi").select("id"))
        affected = saved(differ.union(met).distinct())
        if affected.isEmpty():
            return {}, ()
    every = new if old_sessions is None else old_sessions.join(gone, "file", "left_anti").drop(MONTH).unionByName(new.drop(MONTH))
    own = saved(held.join(affected, "id", "left_semi"))
    by_id = sessions.by_id(every.join(own.select("id").distinct(), "id", "left_semi"))
    by_stem = sessions.by_stem(every.join(own.select(F.col("_stem").alias("stem")).distinct(), "stem", "left_semi"))
    logs = threads.logs.join(own.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    made = saved(fact.build_runs(own.drop("_stem"), by_id, by_stem, logs, threads.config).withColumn(MONTH, session_month()))
    old = [] if before is None else [store.read("runs", base).join(affected, "id", "left_semi")]
    touched = _months(made, *old)
    return {"runs": _renewed(store, base, "runs", made, affected, "id", touched), "threads": Change(marks)}, touched


def refresh(store: SnapshotSet, live: str, archived: str | None = None, include_archived: bool = True, cap_ms: int = 1_800_000, force: bool = False, threads: Threads | None = None, derived: Derived | None = None) -> Refreshed:
    """Brings tables ``files`` and ``sessions`` of a snapshot set, and ``runs`` if there are threads, up to date, as one new version.

    A file counts as changed if its size or time of modification is not what it was. Only added and
    changed files are read. A month is written anew if it loses or gets a row: what it keeps is read
    from the version before, all other months are taken over as they are. Another idle cap or
    configuration, or ``force``, makes every file and thread a changed one. Without any change no
    version is made. ``derived`` is given each table as it will be in the new version, and returns
    further changes that belong to it.
    """
    spark, base = store.spark, store.version()
    known = base is not None and "files" in base.tables
    settings = {"idle_cap_ms": str(cap_ms)} | ({"config": repr(threads.config)} if threads else {})
    fresh = force or not known or any(base.properties.get(k) != v for k, v in settings.items())
    now = saved(listed(spark, live, archived, include_archived))
    before = store.read("files", base) if known else spark.createDataFrame([], f"{_FILES}, {MONTH} string")
    changes = saved(file_changes(now, before.withColumn("length", F.lit(-1).cast("long")) if fresh else before))
    counts = dict(changes.groupBy("status").count().collect())
    added, changed, removed = (counts.get(s, 0) for s in ("added", "changed", "removed"))
    if known and not counts and threads is None:
        discard(now, changes)
        return Refreshed(base, 0, 0, 0, ())
    wanted = changes.where("status != 'removed'")
    events = readers.session_events(_lines(spark, wanted.select("file", "archived"), live, archived))
    new = saved(sessions.session_files(events, cap_ms).withColumn(MONTH, session_month()))
    stamps = wanted.select("file", "archived", "length", "modified").join(new.select("file", MONTH), "file", "left").na.fill(NO_MONTH, [MONTH])  # a file of blank lines has no session
    touched = _months(changes.select(F.col("month").alias(MONTH)), stamps)
    gone = changes.where("status != 'added'").select("file")
    made = {name: _renewed(store, base if known else None, name, rows, gone, "file", touched) for name, rows in (("files", stamps), ("sessions", new))} if counts or not known else {}
    months: Sequence[str] = ()
    if threads is not None:
        old = store.read("sessions", base) if known else None
        more, months = _run_changes(store, None if fresh else base, threads, gone, new, old)
        made |= more

    def after(name: str) -> DataFrame:
        change = made.get(name)
        if change is None or change.replaced is None:
            return store.read(name, base) if change is None else change.rows
        rest = [p.value for p in base.tables[name].parts if p.value not in set(change.replaced)]
        return store.read(name, base, rest).unionByName(change.rows)

    version = store.commit(made | (derived(after) if derived else {}), settings, base) if made else base
    discard(now, changes, new)
    return Refreshed(version, added, changed, removed, tuple(sorted({*touched, *months})))
