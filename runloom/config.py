"""Job parameters: how runs are built, and which of them a report covers."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date, datetime, timedelta

# Names of ranges, and limits and defaults of settings.
PRESETS = ("today", "last7", "last30", "last90", "all", "custom")
#: Days before today at which the rolling presets begin.
ROLLING = {"today": 0, "last7": 6, "last30": 29, "last90": 89}
ALL_WORKSPACES = "all"


def _clamped(value: float | None, default: int, low: int, high: int) -> int:
    """A zero, missing or undefined value means the default, not the lower limit."""
    if not value or math.isnan(value):
        return default
    return int(min(high, max(low, value)))


@dataclass(frozen=True)
class AliasRule:
    source: str
    target: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class UsageConfig:
    idle_gap_minutes: float = 30
    include_archived: bool = True
    use_logs: bool = True
    refresh_seconds: float = 60
    aliases: tuple[AliasRule, ...] = ()
    ignored: tuple[str, ...] = ("C:\\Windows\\System32",)

    def __post_init__(self) -> None:
        object.__setattr__(self, "idle_gap_minutes", _clamped(self.idle_gap_minutes, 30, 1, 180))
        object.__setattr__(self, "refresh_seconds", _clamped(self.refresh_seconds, 60, 10, 3600))

    @property
    def idle_cap_ms(self) -> int:
        return self.idle_gap_minutes * 60_000

    @property
    def span_cap_ms(self) -> int:
        """Longest duration of a run that only has its thread's times."""
        return self.idle_cap_ms * 24


@dataclass(frozen=True)
class Range:
    """Days [start, end); without bounds, all days."""

    start: date
    end: date
    weekly: bool
    bounded: bool = True

    @property
    def days(self) -> int:
        return max(1, (self.end - self.start).days)


@dataclass(frozen=True)
class UsageFilter:
    workspace_id: str = ALL_WORKSPACES
    view: str = "time"
    preset: str = "last7"
    start: str | None = None
    end: str | None = None
    weekly: bool | None = None

    def __post_init__(self) -> None:
        if self.preset not in PRESETS or self.view not in ("time", "tokens"):
            raise ValueError(f"unknown preset or view: {self.preset}, {self.view}")

    def resolve(self, now: datetime, first: datetime | None = None, last: datetime | None = None) -> Range:
        """The range at a moment; first and last bound all runs and matter to "all" only."""
        today, tomorrow = now.date(), now.date() + timedelta(1)
        if self.preset == "all":
            begin, end = (first.date() if first else today), (last.date() + timedelta(1) if last else tomorrow)
        elif self.preset == "custom":
            begin = day_of(self.start, today)
            end = max(day_of(self.end, today), begin) + timedelta(1)
        else:
            begin, end = today - timedelta(ROLLING[self.preset]), tomorrow
        weekly = (end - begin).days > 45 if self.weekly is None else self.weekly
        return Range(begin, end, weekly, self.preset != "all")


def day_of(text: str | None, default: date) -> date:
    """The day of year-month-day numbers; months and days beyond the calendar carry over. Anything else means the default."""
    try:
        year, month, day = map(int, (text or "").split("-"))
        months = year * 12 + month - 1
        return date(months // 12, months % 12 + 1, 1) + timedelta(day - 1)
    except (ValueError, OverflowError):
        return default


DEFAULTS = UsageConfig()
