"""The whole job over one snapshot set: refresh, and the reports that are read from a version of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from runloom.config import DEFAULTS, UsageConfig, UsageFilter
from runloom.operators import diagnostics, refresh, rollups, sessions
from runloom.operators import runs as fact
from runloom.plans import report
from runloom.sources import readers, sinks
from runloom.sources.snapshots import Change, SnapshotSet, Version


@dataclass(frozen=True)
class Sources:
    """Folders of session files, and what reads the thread table and the log rows when a refresh wants them."""

    live: str
    threads: Callable[[], DataFrame]
    archived: str | None = None
    logs: Callable[[], DataFrame] | None = None


class Usage:
    """Usage of one set of sources. Reports need no source once a version is there; refresh() makes the next."""

    def __init__(self, spark: SparkSession, root: str, sources: Sources, config: UsageConfig = DEFAULTS) -> None:
        self.store, self.sources, self.config = SnapshotSet(spark, root), sources, config

    def refresh(self, force: bool = False) -> refresh.Refreshed:
        """Reads what has changed, and commits sessions, runs, workspaces and warnings as one version; none if nothing has."""
        spark, config = self.store.spark, self.config
        raw = self.sources.threads()
        threads = fact.normalize_threads(raw, config)
        bodies = self.sources.logs() if self.sources.logs and config.use_logs else None
        logs = sessions.log_breakdowns(readers.log_bodies(bodies)) if bodies is not None else spark.createDataFrame([], "thread_id string, input long, output long, cached long, reasoning long, rows long")

        def derived(after: Callable[[str], DataFrame]) -> dict[str, Change]:
            missing = {"threads": readers.missing_columns(raw, readers.REQUIRED)}
            found = diagnostics.warnings(spark, after("sessions"), missing, config.use_logs, logs if bodies is not None else None)
            return {"workspaces": Change(rollups.workspace_summary(after("runs"), threads)), "warnings": Change(found)}

        wanted = refresh.Threads(threads, logs.drop("rows"), config)
        return refresh.refresh(self.store, self.sources.live, self.sources.archived, config.include_archived, config.idle_cap_ms, force, wanted, derived)

    def version(self, number: int | None = None) -> Version:
        """A version by number, else the newest; a first one is made if there is none."""
        return self.store.version(number) or self.refresh().version

    def snapshot(self, wanted: UsageFilter, now: datetime, number: int | None = None) -> dict[str, DataFrame]:
        """The dashboard's tables, from a version alone."""
        version = self.version(number)
        return report.snapshot(self.store.read("runs", version), self.store.read("workspaces", version), wanted, now)

    def cached_snapshot(self, wanted: UsageFilter, now: datetime) -> dict[str, DataFrame] | None:
        """As snapshot(), but None where no version is there yet; never reads a source."""
        return self.snapshot(wanted, now) if self.store.version() else None

    def project_detail(self, workspace_id: str, wanted: UsageFilter, now: datetime) -> dict[str, DataFrame]:
        version = self.version()
        return report.project_detail(self.store.read("runs", version), self.store.read("workspaces", version), workspace_id, wanted, now)

    def diagnostics(self) -> dict[str, DataFrame]:
        """Warnings of the version, those that ask for something, and its files."""
        version = self.version()
        found = self.store.read("warnings", version)
        return {"warnings": found, "actionable": diagnostics.actionable(found), "files": self.store.read("files", version)}

    def export(self, kind: str, path: str, wanted: UsageFilter, now: datetime, full_paths: bool = True) -> None:
        """Writes an export of the newest version; see sinks.export()."""
        sinks.export(kind, path, self.snapshot(wanted, now), full_paths)
