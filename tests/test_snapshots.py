"""Versions of tables, refreshes that read only what changed, and what passes for a time or a number."""

from __future__ import annotations

import json
import os
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runloom.config import AliasRule, UsageConfig, UsageFilter
from runloom.functions import paths
from runloom.operators import diagnostics, privacy, ranks, refresh, rollups, sessions
from runloom.operators import runs as fact
from runloom.sources import readers
from runloom.sources.snapshots import Change, CommitConflict, SnapshotSet


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotSet(spark, f"file://{tmp_path}/set")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def months(spark, *rows):
    return spark.createDataFrame(rows, "month string, n int")


def test_versions(spark, store):
    assert store.version() is None
    assert store.versions() == []
    one = store.commit({"a": Change(months(spark, ("2024-01", 1), ("2024-02", 2)), "month"), "b": Change(months(spark, ("x", 9)))}, {"made": "first"})
    two = store.commit({"a": Change(months(spark, ("2024-02", 3), ("2024-02", 4)), "month", ["2024-02"])}, {"more": "second"})
    assert (one.number, two.number, store.versions()) == (1, 2, [1, 2])
    assert dict(store.version().properties) == {"made": "first", "more": "second"}
    assert rows_of(store.read("a", store.version(1))) == [("2024-01", 1), ("2024-02", 2)]
    assert rows_of(store.read("a")) == [("2024-01", 1), ("2024-02", 3), ("2024-02", 4)]
    assert rows_of(store.read("b")) == [("x", 9)]
    assert rows_of(store.read("a", parts=["2024-01"])) == [("2024-01", 1)]
    three = store.commit({"a": Change(months(spark).limit(0), "month", ["2024-02"])})
    assert rows_of(store.read("a")) == [("2024-01", 1)]
    store.commit({"a": Change(months(spark).limit(0), "month")})
    assert rows_of(store.read("a")) == []
    assert store.read("a").columns == ["month", "n"]
    assert rows_of(store.read("a", three)) == [("2024-01", 1)]
    with pytest.raises(ValueError, match="no table"):
        store.read("c")


def test_a_failed_write_leaves_the_old_version(spark, store):
    store.commit({"a": Change(months(spark, ("2024-01", 1)), "month"), "b": Change(months(spark, ("x", 9)))})
    broken = months(spark, ("2024-01", 5)).withColumn("n", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        store.commit({"b": Change(months(spark, ("y", 1))), "a": Change(broken, "month")})
    assert store.versions() == [1]
    assert rows_of(store.read("a")) == [("2024-01", 1)]
    assert rows_of(store.read("b")) == [("x", 9)]
    with pytest.raises(ValueError, match="outside"):
        store.commit({"a": Change(months(spark, ("2024-03", 5)), "month", ["2024-01"])})
    assert store.versions() == [1]


def test_orphans(spark, store, tmp_path):
    store.commit({"a": Change(months(spark, ("2024-01", 1)), "month")})
    with pytest.raises(Exception, match="no"):
        store.commit({"b": Change(months(spark, ("y", 1))), "a": Change(months(spark, ("2024-01", 5)).withColumn("n", F.raise_error(F.lit("no")).cast("int")), "month")})
    assert store.remove_orphans() == []
    assert len(store.remove_orphans(0)) == 1
    assert not list((tmp_path / "set/data/b").glob("commit_id=*"))
    assert rows_of(store.read("a")) == [("2024-01", 1)]


def test_two_commits_on_one_version(spark, store):
    base = store.commit({"a": Change(months(spark, ("2024-01", 1)), "month")})
    store.commit({"a": Change(months(spark, ("2024-01", 2)), "month")}, base=base)
    with pytest.raises(CommitConflict):
        store.commit({"a": Change(months(spark, ("2024-01", 3)), "month")}, base=base)
    assert rows_of(store.read("a")) == [("2024-01", 2)]


def test_expire(spark, store, tmp_path):
    for n in range(4):
        store.commit({"a": Change(months(spark, ("2024-02", n)), "month", ["2024-02"]) if n else Change(months(spark, ("2024-01", 7), ("2024-02", 0)), "month")})
    assert store.expire(2) == [1, 2]
    assert store.versions() == [3, 4]
    assert rows_of(store.read("a", store.version(3))) == [("2024-01", 7), ("2024-02", 2)]
    assert len([f for f in (tmp_path / "set/data/a").rglob("*.parquet")]) == 3


def test_a_range_reads_its_months_only(spark, store):
    held = spark.range(400).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("start_time")).withColumn("start_month", refresh.session_month())
    store.commit({"runs": Change(held, "start_month")})
    span = UsageFilter(preset="custom", start="2024-03-05", end="2024-04-02").resolve(datetime(2024, 5, 1))
    found = rollups.filter_runs(store.read("runs"), "all", span)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_month" in plan and ">= 2024-03" in plan and "<= 2024-04" in plan
    assert found.count() == 29
    assert len(found.inputFiles()) >= 2
    read = {f.split("start_month=")[1][:7] for f in found.select("id").inputFiles()}
    assert read >= {"2024-03", "2024-04"}


# refresh


def line(at, **payload):
    kind = "session_meta" if "id" in payload or "cwd" in payload else "event_msg"
    return json.dumps({"timestamp": at, "type": kind, "payload": payload or {"type": "x"}})


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def everything(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_refresh_equals_a_rebuild(spark, store, tmp_path):
    live, archived = tmp_path / "live", tmp_path / "old"
    for i in range(6):
        write(live / f"d{i % 2}/s {i}%.jsonl", line(f"2024-0{i % 3 + 1}-10T00:00:00Z", id=f"t{i}"), line(f"2024-0{i % 3 + 1}-10T00:05:00Z"), "{broken")
    write(live / "blank.jsonl", "", "  ")
    write(live / "timeless.JSONL", '{"type": "x"}')
    write(archived / "a[1].jsonl", line("2023-12-31T23:00:00Z", id="a"))
    write(live / "notes.txt", "no session")
    first = refresh.refresh(store, str(live), str(archived))
    assert (first.added, first.changed, first.removed) == (9, 0, 0)
    assert first.months == ("2023-12", "2024-01", "2024-02", "2024-03", "none")
    again = refresh.refresh(store, str(live), str(archived))
    assert (again.version.number, again.months) == (1, ())

    write(live / "d1/new.jsonl", line("2024-02-20T00:00:00Z", id="new"))
    write(live / "d0/s 0%.jsonl", line("2024-01-10T00:00:00Z", id="t0"), line("2024-04-11T00:05:00Z"), line("2024-04-11T00:06:00Z"))
    (live / "d1/s 3%.jsonl").unlink()
    untouched = live / "d0/s 2%.jsonl"  # its text is lost, but size and time are as they were, so nothing may read it
    kept = os.stat(untouched)
    untouched.write_text("x" * kept.st_size)
    os.utime(untouched, ns=(kept.st_atime_ns, kept.st_mtime_ns))
    before = {(p.commit, p.value) for p in store.version().tables["sessions"].parts}
    second = refresh.refresh(store, str(live), str(archived))
    assert (second.added, second.changed, second.removed) == (1, 1, 1)
    assert second.months == ("2024-01", "2024-02")
    after = {(p.commit, p.value) for p in store.version().tables["sessions"].parts}
    assert {v for _, v in before & after} == {"2023-12", "2024-03", "none"}

    write(untouched, line("2024-03-10T00:00:00Z", id="t2"), line("2024-03-10T00:05:00Z"), "{broken")
    os.utime(untouched, ns=(kept.st_atime_ns, kept.st_mtime_ns))
    assert untouched.stat().st_size == kept.st_size
    other = SnapshotSet(spark, f"file://{tmp_path}/other")
    refresh.refresh(other, str(live), str(archived))
    for name in ("sessions", "files"):
        assert everything(store.read(name)) == everything(other.read(name))
    plain = sessions.session_files(readers.session_events(readers.session_lines(spark, str(live), str(archived))), 1_800_000)
    assert everything(store.read("sessions").drop("start_month")) == everything(plain)
    assert everything(SnapshotSet(spark, store.root).read("sessions", store.version(1)).select("id")) != everything(store.read("sessions").select("id"))


def test_refreshed_runs_are_those_of_a_rebuild(spark, store, tmp_path):
    """Only runs whose thread, logs or sessions changed are built anew, and only their months are written."""
    config = UsageConfig()
    live = tmp_path / "live"
    for i in range(6):
        write(live / f"s{i}.jsonl", line(f"2024-0{i % 3 + 1}-10T00:00:00Z", id=f"t{i}"), line(f"2024-0{i % 3 + 1}-10T00:05:00Z"))

    def threads(rows, logs=(("t1", 5),)):
        made = spark.createDataFrame(rows, "id string, rollout_path string, created_at long, updated_at long, tokens_used long")
        counts = spark.createDataFrame([(t, n, n, 0, None) for t, n in logs], "thread_id string, input long, output long, cached long, reasoning long")
        return refresh.Threads(fact.normalize_threads(made, config), counts, config)

    def rebuilt(rows, logs=(("t1", 5),)):
        other = SnapshotSet(spark, f"file://{tmp_path}/other{random.random()}")
        refresh.refresh(other, str(live), threads=threads(rows, logs))
        return everything(other.read("runs"))

    rows = [(f"t{i}", f"/x/s{i}.jsonl", 1_700_000_000 + i * 3_000_000, 1_700_000_100 + i * 3_000_000, i) for i in range(9)]
    refresh.refresh(store, str(live), threads=threads(rows))
    assert everything(store.read("runs")) == rebuilt(rows)
    again = refresh.refresh(store, str(live), threads=threads(rows))
    assert (again.version.number, again.months) == (1, ())

    rows[8] = (*rows[8][:4], 99)
    (live / "s1.jsonl").unlink()
    before = {(p.commit, p.value) for p in store.version().tables["runs"].parts}
    done = refresh.refresh(store, str(live), threads=threads(rows))
    assert done.removed == 1
    assert everything(store.read("runs")) == rebuilt(rows)
    kept = {v for _, v in before & {(p.commit, p.value) for p in store.version().tables["runs"].parts}}
    assert {"2024-01", "2024-03"} <= kept
    assert not {"2024-02", "2024-08"} & kept

    rows = rows[:4] + rows[5:] + [("new", "/y/s0.jsonl", 1_700_000_000, 1_700_000_500, 3)]
    write(live / "deep/s0.jsonl", line("2023-02-01T00:00:00Z", cwd="/w"), line("2023-02-01T00:09:00Z"))
    refresh.refresh(store, str(live), threads=threads(rows, [("t1", 5), ("t7", 8)]))
    assert everything(store.read("runs")) == rebuilt(rows, [("t1", 5), ("t7", 8)])
    assert {r["id"]: r["token_breakdown"]["input"] for r in store.read("runs").collect()}["t7"] == 8
    assert len(store.versions()) == 3


def test_refresh_with_many_changes_and_other_settings(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "NAMED_FILES", 2)
    live = tmp_path / "live"
    for i in range(5):
        write(live / f"s{i}.jsonl", line("2024-01-10T00:00:00Z", id=f"t{i}"), line("2024-01-10T01:00:00Z"))
    refresh.refresh(store, str(live))
    assert {r["active_ms"] for r in store.read("sessions").collect()} == {1_800_000}
    changed = refresh.refresh(store, str(live), cap_ms=3_000_000)
    assert changed.changed == 5
    assert {r["active_ms"] for r in store.read("sessions").collect()} == {3_000_000}
    assert len(store.read("sessions").collect()) == 5
    for i in range(5):
        (live / f"s{i}.jsonl").unlink()
    write(live / "only.jsonl", line("2024-06-10T00:00:00Z", id="only"))
    refresh.refresh(store, str(live), cap_ms=3_000_000)
    assert [r["id"] for r in store.read("sessions").collect()] == ["only"]


# numbers, times


BODIES = [
    ('{"usage": {"input_tokens": 1e20}}', (2**63 - 1, 0, 0, 0)), ('{"a": {"input_tokens": 1e400}}', (2**63 - 1, 0, 0, 0)), ('{"a": {"input_tokens": 99999999999999999999}}', (2**63 - 1, 0, 0, 0)),
    (f"input_tokens: {2**63 - 1} input_tokens: {2**63 - 1}", (2**63 - 1, 0, 0, 0)), ('{"usage": {"input_tokens": 5, "input_tokens": 7}}', (7, 0, 0, 0)),
    ('{"a": {"output_tokens": -1e30, "cached_tokens": 4}}', (0, -(2**63 - 1), 4, 0)), ("output_tokens: 00000000000000000000000000000000000000007", (0, 7, 0, 0)),
]


def test_bodies_with_large_numbers(spark):
    made = spark.createDataFrame([(str(i), b) for i, (b, _) in enumerate(BODIES)], "thread_id string, feedback_log_body string")
    got = {int(r["thread_id"]): tuple(r)[1:5] for r in sessions.log_breakdowns(readers.log_bodies(made)).collect()}
    assert got == {i: b for i, (_, b) in enumerate(BODIES)}
    twice = made.where("thread_id = 0").union(made.where("thread_id = 0"))
    assert sessions.log_breakdowns(readers.log_bodies(twice)).first()["input"] == 2**63 - 1


def test_lines_with_large_numbers(spark):
    texts = ['{"timestamp":"2024-01-01T00:00:00Z","type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":%s}}}}' % n for n in ("1e20", "99999999999999999999", "1e400", "3")]
    lines = spark.createDataFrame([("f", False, (0, i), x) for i, x in enumerate(texts)], "file string, archived boolean, at struct<block: bigint, row: bigint>, line string")
    got = [r["breakdown"]["input"] for r in readers.session_events(lines).orderBy("at").collect()]
    assert got[0] == got[1] == 2**63 - 1
    assert got[3] == 3
    assert sessions.session_files(readers.session_events(lines), 1000).first()["breakdown"]["input"] == 2**63 - 1


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2026-04-23T01:00:00.000Z", datetime(2026, 4, 23, 1)), ("2026-04-23T01:00:00+02:00", datetime(2026, 4, 22, 23)), ("Thu, 23 Apr 2026 01:00:00 GMT", datetime(2026, 4, 23, 1)), ("23 Apr 2026 01:00:00 +0100", datetime(2026, 4, 23)),
        ("2026-04-23", datetime(2026, 4, 23)), ("2026-04", datetime(2026, 4, 1)), ("2026", datetime(2026, 1, 1)), ("12:30", None), ("soon", None), ("", None), (None, None), ("2026-13-45", None),
    ],
)
def test_times(spark, text, expected):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.range(1).select(F.unix_seconds(readers.event_time(F.lit(text).cast("string")))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == (None if expected is None else int(expected.replace(tzinfo=UTC).timestamp()))


# ranks, aliases, bitmaps, observed counts


def test_numbers_without_one_task(spark):
    rng = random.Random(3)
    values = [(rng.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    made = ranks.numbered(df, [F.col("a").desc(), F.col("b")])
    assert {(r["a"], r["b"]): r["number"] for r in made.collect()} == {v: n for n, v in enumerate(sorted(values, key=lambda v: (-v[0], v[1])), 1)}
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    assert ranks.numbered(df.limit(0), [F.col("a")]).collect() == []


def test_workspace_numbers(spark):
    runs = spark.createDataFrame([(f"w{i % 5}", datetime(2024, 1, 1) + timedelta(hours=i // 2), f"r{i}") for i in range(40)], "workspace_id string, start_time timestamp, id string")
    order = []
    for r in sorted(runs.collect(), key=lambda r: (-r["start_time"].timestamp(), r["id"])):
        if r["workspace_id"] not in order:
            order.append(r["workspace_id"])
    numbers = privacy.workspace_numbers(runs)
    assert {r["workspace_id"]: r["number"] for r in numbers.collect()} == {w: n for n, w in enumerate(order, 1)}
    spaces = spark.createDataFrame([(f"w{i}", f"C:\\w{i}", f"C:\\w{i}", f"w{i}") for i in range(8)], "workspace_id string, workspace_path string, raw_path string, workspace_name string")
    assert sorted(int(r["workspace_name"].split()[1]) for r in privacy.anonymize_workspaces(spaces, numbers).collect()) == list(range(1, 9))


def test_first_of_each_key(spark):
    rng = random.Random(1)
    values = [(rng.choice("aab"), rng.randint(0, 9), i) for i in range(500)]
    got = rows_of(ranks.first_of(spark.createDataFrame(values, "k string, v int, i int"), ["k"], [F.desc("v"), F.col("i")], 10))
    assert got == sorted(x for k in "ab" for x in sorted((v for v in values if v[0] == k), key=lambda v: (-v[1], v[2]))[:10])


def test_alias_table_equals_the_list(spark):
    rng = random.Random(4)
    for _ in range(4):
        rules = [AliasRule(rng.choice(["c:/a", "C:\\b\\", "d:/c", "E:/d", " ", "e:/é"]), rng.choice(["C:/A", "c:/b", "D:\\C", "e:/d/", "", "F:/x"]), rng.random() < 0.8) for _ in range(25)]
        made = spark.createDataFrame([(i, r.source, r.target, r.enabled) for i, r in enumerate(rules)], "ordinal long, source string, target string, enabled boolean").repartition(3)
        assert {r["_source"]: r["_target"] for r in paths.alias_ends(made).collect()} == paths.resolved(rules)


def test_a_hundred_thousand_rules(spark):
    """Chains of fifty, in an order that a join by ordinal cannot use."""
    n = F.col("id")
    rules = spark.range(100_000).select(n.alias("ordinal"), F.concat(F.lit("c:/"), (n % 2000).cast("string"), F.lit("/"), F.floor(n / 2000).cast("string")).alias("source"), F.concat(F.lit("C:/"), (n % 2000).cast("string"), F.lit("/"), (F.floor(n / 2000) + 1).cast("string")).alias("target"), F.lit(True).alias("enabled"))
    ends = paths.alias_ends(rules)
    assert ends.where(F.col("_target").endswith("\\50")).count() == 100_000
    df = spark.range(2000).select(F.concat(F.lit("C:\\"), n.cast("string"), F.lit("\\0\\")).alias("cwd"))
    assert paths.with_path_by(df, "cwd", "path", rules).where(F.col("path").endswith("\\50")).count() == 2000


def streak(days):
    best = 0
    for d in days:
        n = 1
        while d + timedelta(n) in days:
            n += 1
        best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_bitmaps(spark, seed):
    rng = random.Random(seed)
    held = {k: {date(2023, 11, 20) + timedelta(rng.randint(0, 150)) for _ in range(n)} for k, n in (("a", 12), ("b", 90), ("c", 400), ("d", 1))}
    rows = [(k, datetime(d.year, d.month, d.day, rng.randint(0, 23))) for k, days in held.items() for d in days for _ in range(2)]
    runs = spark.createDataFrame(rows, "k string, start_time timestamp")
    maps = rollups.merged_bitmaps(rollups.day_bitmaps(runs.where("hour(start_time) % 2 = 0"), ["k"]), rollups.day_bitmaps(runs.where("hour(start_time) % 2 = 1"), ["k"]), by=["k"])
    assert dict(rows_of(rollups.bitmap_streaks(maps, ["k"]))) == {k: streak(days) for k, days in held.items()}
    for start, end in (("2023-12-31", "2024-02-29"), ("2024-01-05", "2024-01-05"), ("2023-01-01", "2025-01-01")):
        span = UsageFilter(preset="custom", start=start, end=end).resolve(datetime(2024, 5, 1))
        got = dict(rows_of(rollups.bitmap_active_days(maps, span, ["k"])))
        assert {k: got.get(k, 0) for k in held} == {k: sum(span.start <= d < span.end for d in days) for k, days in held.items()}
        assert rollups.bitmap_active_days(maps, span).first()["active_days"] in (None, sum(span.start <= d < span.end for d in set().union(*held.values())))
    weeks = {(r["k"], r["week"]): r["days"] for r in rollups.bitmap_weeks(maps, ["k"]).collect()}
    wanted = {}
    for k, days in held.items():
        for d in days:
            monday = d - timedelta(d.weekday())
            wanted[k, monday] = wanted.get((k, monday), 0) | 1 << d.weekday()
    assert weeks == wanted


def test_observed_counts_cost_no_scan(spark, store, tmp_path):
    spark.range(1000).select("id", F.timestamp_seconds("id").alias("t"), F.lit("x").alias("unused")).write.parquet(f"{tmp_path}/source")
    held, watch = spark.read.parquet(f"{tmp_path}/source"), diagnostics.Observed()
    read = watch.watch("source", held.select("id", "t"), "t", held.columns)
    rest = watch.watch("other", spark.range(5))
    made = read.join(rest, "id").groupBy("t").count()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    store.commit({"made": Change(made)})
    assert rows_of(watch.profile(spark)) == [("other", True, 5, 1, "id", None, None), ("source", True, 1000, 3, "id,t,unused", "1970-01-01 00:00:00", "1970-01-01 00:16:39")]
