from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runloom.config import AliasRule, UsageConfig, UsageFilter, day_of
from runloom.functions import formatting as fmt
from runloom.functions import paths, times, tokens
from runloom.operators import diagnostics, privacy, rollups, sessions
from runloom.operators import runs as fact
from runloom.sources import readers, sinks
from runloom.streaming import usage as stream

NOW = datetime(2026, 4, 21, 13, 30)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("raw", "expected"), [("\\\\?\\c:/base/project/", "C:\\base\\project"), ("", "(unknown)"), (None, "(unknown)"), (" \u00a0D:\\x\\\\ ", "D:\\x"), ("/home/a/b/", "\\home\\a\\b"), ("///", "(unknown)")])
def test_normalize(spark, raw, expected):
    assert value(spark, paths.normalize(F.lit(raw).cast("string"))) == expected
    assert paths.plain_path(raw or "") == expected


def test_aliases_chain(spark):
    rules = [AliasRule("C:\\base", "D:\\work\\base"), AliasRule("d:/WORK/base", "E:\\x"), AliasRule("e:\\x", "F:\\y", enabled=False)]
    assert value(spark, paths.normalize(F.lit("\\\\?\\C:\\base\\"), rules[:1])) == "D:\\work\\base"
    assert value(spark, paths.normalize(F.lit("c:/BASE"), rules)) == "E:\\x"


def test_ids_and_names(spark):
    long = "D:\\repo\\" + "é" * 100
    code = value(spark, paths.workspace_id(F.lit(long)))
    assert code.replace("-", "").replace("_", "").isalnum() and "\n" not in code
    assert value(spark, paths.workspace_id(F.lit(long.upper()))) == code
    assert value(spark, paths.display_name(F.lit("D:\\repo\\app"))) == "app"
    assert value(spark, paths.display_name(F.lit("(unknown)"))) == "Unknown workspace"
    ignored = ["C:\\tmp\\a"]
    assert [value(spark, paths.is_ignored(F.lit(p), ignored)) for p in ("c:\\TMP\\A", "C:\\tmp\\a\\b", "C:\\tmp\\ab")] == [True, True, False]
    assert value(spark, paths.file_stem(F.lit("/x/rollout-1.jsonl"))) == "rollout-1"
    assert value(spark, paths.file_stem(F.lit("C:\\x\\r.JSONL"))) == "r.JSONL"


def test_ranges():
    assert UsageFilter(preset="today").resolve(NOW).start == date(2026, 4, 21)
    week = UsageFilter(preset="last7").resolve(NOW)
    assert (week.start, week.end, week.days, week.weekly) == (date(2026, 4, 15), date(2026, 4, 22), 7, False)
    assert UsageFilter(preset="all").resolve(NOW, datetime(2026, 1, 1), datetime(2026, 4, 21)).weekly
    back = UsageFilter(preset="custom", start="2026-04-10", end="2026-04-01").resolve(NOW)
    assert (back.start, back.days) == (date(2026, 4, 10), 1)
    assert UsageFilter(preset="custom", start="x", end=None).resolve(NOW).start == date(2026, 4, 21)
    assert day_of("2026-13-32", NOW.date()) == date(2027, 2, 1)
    assert [UsageFilter(preset="custom", start="2026-01-01", end=e).resolve(NOW).weekly for e in ("2026-02-14", "2026-02-15")] == [False, True]


def test_config():
    assert UsageConfig(idle_gap_minutes=0).idle_gap_minutes == 30
    assert UsageConfig(idle_gap_minutes=999, refresh_seconds=1).idle_cap_ms == 180 * 60_000
    assert UsageConfig(refresh_seconds=float("nan")).refresh_seconds == 60
    with pytest.raises(ValueError, match="unknown"):
        UsageFilter(preset="never")


def test_week_keys(spark):
    got = [value(spark, times.week_key(F.lit(d).cast("timestamp"))) for d in ("2026-04-19 23:00:00", "2026-04-20 00:00:00")]
    assert got == ["2026-04-13", "2026-04-20"]
    assert value(spark, times.bucket_label(F.lit("2026-04-20"), True)) == "Week of 04-20"


@pytest.mark.parametrize(("ms", "text"), [(0, "0m"), (29_999, "0m"), (30_000, "1m"), (3_600_000, "1h"), (3_900_000, "1h 5m"), (-5, "0m")])
def test_durations(spark, ms, text):
    assert value(spark, fmt.as_duration(F.lit(ms))) == text


def test_numbers(spark):
    assert [value(spark, fmt.as_tokens(F.lit(x))) for x in (999, 1000, 1250, 3_400_000)] == ["999", "1.0K", "1.3K", "3.4M"]
    assert value(spark, fmt.as_percent(F.lit(0.75))) == "75%"
    assert value(spark, fmt.as_percent(F.lit(0.0857))) == "8.6%"
    assert value(spark, fmt.as_integer(F.lit(1234567.5))) == "1,234,568"
    assert value(spark, fmt.as_date_time(F.lit(None).cast("timestamp"))) == "Unavailable"


@pytest.mark.parametrize(("line", "ok"), [('{"a":1}', True), ('{"a":1} junk', False), ("null", True), ("{'a':1}", False), ("1,2", False), ("", False), ('{"a":1,"a":2}', True)])
def test_strict_json(spark, line, ok):
    assert value(spark, tokens.strict_json(F.lit(line)).isNotNull()) is ok


BODIES = {
    "ws": 'session_loop: websocket event: {"tool_usage": {"image_gen": {"input_tokens": 0, "output_tokens": 0}}, "response": {"usage": {"input_tokens": 28370, "input_tokens_details": {"cached_tokens": 2432}, "output_tokens": 91, "output_tokens_details": {"reasoning_tokens": 53}}}}',
    "zero_cached": '{"response": {"usage": {"input_tokens": 15434, "input_tokens_details": {"cached_tokens": 0}, "output_tokens": 144, "output_tokens_details": {"reasoning_tokens": 124}}}}',
    "text": "tool input_tokens: 0 response input_tokens: 100 cached_tokens: 25 output_tokens: 5",
    "direct": '{"usage": {"input_tokens": 7, "output_tokens": "8"}}',
    "array": '[{"cached_input_tokens": 3}, {"x": {"output_tokens": 4}}]',
    "nested": 'note {"body": "{\\"input_tokens\\": 11}"}',
    "trailing": '{"usage": {"input_tokens": 7}} and input_tokens=9',
    "nothing": "no counts",
}


def test_log_bodies(spark):
    df = spark.createDataFrame([*BODIES.items(), ("ws", None), (None, BODIES["text"])], "thread_id string, feedback_log_body string")
    got = {r["thread_id"]: (r["input"], r["cached"], r["output"], r["reasoning"]) for r in sessions.log_breakdowns(readers.log_bodies(df)).collect()}
    assert got == {
        "ws": (28370, 2432, 91, 53), "zero_cached": (15434, 0, 144, 124), "text": (100, 25, 5, 0), "direct": (7, 0, 0, 0),
        "array": (3, 3, 4, 0), "nested": (11, 0, 0, 0), "trailing": (16, 0, 0, 0),
    }
    assert readers.log_bodies(df.drop("thread_id")).count() == 0


def _event(t, kind, **payload):
    return json.dumps({"timestamp": t, "type": kind, "payload": payload})


def _usage(i, c, o, r):
    return {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}


def test_session_files(spark, tmp_path):
    live, old = tmp_path / "live" / "a", tmp_path / "old"
    live.mkdir(parents=True)
    old.mkdir()
    (live / "rollout-1.jsonl").write_text("\n".join([
        _event("2026-04-23T01:00:00.000Z", "session_meta", id="thread-1", cwd="C:\\base", model="m"), "",
        _event("2026-04-23T01:00:20.000Z", "event_msg", type="token_count", info={"total_token_usage": _usage(1500, 900, 80, 20), "last_token_usage": _usage(200, 100, 10, 5)}),
        _event("2026-04-23T01:00:10.000Z", "event_msg", type="token_count", info={"total_token_usage": _usage(1000, 600, 50, 15)}), "{broken", "null", '{"a":1} x',
        _event("2026-04-23T03:00:20.000Z", "event_msg", started_at="2026-04-23T01:00:05.000Z"), _event(5, "event_msg", started_at=7),
    ]))
    (live / "two.JSONL").write_text(_event("2026-04-23T01:00:00Z", "session_meta", id="thread-1"))
    (old / "old.jsonl").write_text(_event("2026-04-22T01:00:00Z", "session_meta", id="thread-1"))
    (old / "empty.txt").write_text("x")
    found = sessions.session_files(readers.session_events(readers.session_lines(spark, str(tmp_path / "live"), str(old))), 1_800_000)
    rows = {r["stem"]: r for r in found.collect()}
    one = rows["rollout-1"]
    assert set(rows) == {"rollout-1", "two.JSONL", "old"}
    assert (one["id"], one["cwd"], one["model"], one["parse_warnings"]) == ("thread-1", "C:\\base", "m", 3)
    assert tuple(one["breakdown"]) == (1500, 80, 900, 20)
    assert one["active_ms"] == 20_000 + 1_800_000
    assert [r["stem"] for r in sessions.by_id(found).collect()] == ["old"]
    assert {r["stem"] for r in sessions.by_stem(found).collect()} == set(rows)
    assert {r["code"] for r in diagnostics.actionable(diagnostics.warnings(spark, found, {"threads": ["cwd"]}, True, None)).collect()} == {"parse_warning", "missing_source"}


def test_active_time_against_loop(spark):
    rng, rows = random.Random(3), []
    for s in range(20):
        rows += [(s, datetime(2026, 1, 1) + timedelta(milliseconds=rng.randrange(10**rng.randrange(1, 9)))) for _ in range(rng.randrange(1, 40))]
    got = {r["s"]: r["active_ms"] for r in sessions.active_time(spark.createDataFrame(rows, "s int, t timestamp"), ["s"], "t", 60_000).collect()}
    for s, ms in got.items():
        t = sorted(x for k, x in rows if k == s)
        assert ms == sum(min((b - a) // timedelta(milliseconds=1), 60_000) for a, b in zip(t, t[1:], strict=False))


def test_runs_fallbacks(spark):
    config = UsageConfig()
    threads = spark.createDataFrame([("a", "/r/x.jsonl", 100, 200), ("b", "/r/y.jsonl", 100, 90), ("c", "", 0, 10**7), (None, None, None, None)], "id string, rollout_path string, created_at long, updated_at long")
    normal = fact.normalize_threads(threads, config)
    kind = "start_time timestamp, end_time timestamp, active_ms long, breakdown struct<input: bigint, output: bigint, cached: bigint, reasoning: bigint>"
    ids = spark.createDataFrame([("a", None, None, 0, None)], f"id string, {kind}")
    stems = spark.createDataFrame([("x", datetime(2026, 1, 1), datetime(2026, 1, 2), 5, (1, 2, 3, 4)), ("y", datetime(2026, 1, 1), datetime(2026, 1, 2), 5, (None, 2, None, 4))], f"stem string, {kind}")
    logs = spark.createDataFrame([("b", 9, 9, 0, 9)], "thread_id string, input long, output long, cached long, reasoning long")
    got = {r["id"]: r for r in fact.build_runs(normal, ids, stems, logs, config).collect()}
    assert (got["a"]["duration_ms"], got["a"]["duration_method"], got["a"]["token_breakdown"]["unavailable_reason"]) == (100_000, "thread-span", fact.NO_BREAKDOWN)
    assert (got["b"]["duration_ms"], tuple(got["b"]["token_breakdown"])[:5]) == (5, (9, 2, 0, 4, 0.0))
    assert got["c"]["duration_ms"] == config.span_cap_ms
    assert sum(k.startswith("thread-") for k in got) == 1


def test_empty_runs(spark):
    config = UsageConfig()
    normal = fact.normalize_threads(spark.createDataFrame([], "id string"), config)
    kind = "start_time timestamp, end_time timestamp, active_ms long, breakdown struct<input: bigint, output: bigint, cached: bigint, reasoning: bigint>"
    none = [spark.createDataFrame([], f"{k} string, {kind}") for k in ("id", "stem")]
    runs = fact.build_runs(normal, *none, spark.createDataFrame([], "thread_id string, input long, output long, cached long, reasoning long"), config)
    span = UsageFilter(preset="last7").resolve(NOW)
    assert rollups.usage_buckets(runs, False).count() == 0
    row = rollups.range_summary(runs, span).first()
    assert (row["runs"], row["tokens"], row["tokens_per_run"], row["token_breakdown"]["cache_hit_rate"]) == (0, 0, 0.0, None)
    assert rollups.longest_streak(runs).first()[0] == 0
    assert rollups.recent_runs(runs).count() == 0


def test_csv_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a"b', " x,y ", None), ("line\nbreak", "", "z")], "a string, b string, c string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part*")).read_text()
    assert text == 'a,b,c\n"a""b"," x,y ",\n"line\nbreak",,z\n'


def test_privacy_of_one_run(spark):
    row = ("r", "Title", "id", "C:\\secret", "secret", datetime(2026, 1, 1), "/x/y.jsonl")
    df = spark.createDataFrame([row], "id string, title string, workspace_id string, workspace_path string, workspace_name string, start_time timestamp, rollout_path string")
    got = privacy.anonymize_runs(df).first()
    assert (got["title"], got["workspace_path"], got["rollout_path"]) == ("Title", "Workspace 1", None)
    assert got["workspace_id"] != "id"


def test_stream_in_batches_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 3, datetime(2026, 1, 1) + timedelta(minutes=i * 7 + rng.randrange(60))) for i in range(300)]
    schema = "s int, t timestamp"
    for n in range(4):
        spark.createDataFrame(rows[n * 75 : (n + 1) * 75], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["s"]: (r["events"], r["active_ms"]) for r in stream.drained(stream.active_time(read, "s", "t", 1_800_000, "2 hours"), "s", "update").collect()}
    batch = {r["s"]: (r["events"], r["active_ms"]) for r in sessions.active_time(spark.createDataFrame(rows, schema), ["s"], "t", 1_800_000).collect()}
    assert got == batch


def test_stream_keeps_few_rows_of_state(spark, tmp_path):
    rows = [(i % 3, datetime(2026, 1, 1) + timedelta(hours=i)) for i in range(300)]
    spark.createDataFrame(rows, "s int, t timestamp").write.parquet(str(tmp_path / "in"))
    held = stream.active_time(spark.readStream.schema("s int, t timestamp").parquet(str(tmp_path / "in")), "s", "t", 1_800_000, "400 days")
    query = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]
    assert 0 < max(kept) <= 30  # each row is a message to the JVM and back; there are 100 slices a session


def test_stream_drops_what_comes_late_and_settles_blocks(spark, tmp_path):
    rng, schema, cap, mark, kept = random.Random(7), "s string, t timestamp", 1000, 0, {}
    for n in range(5):
        rows = [(rng.choice(["a", "b", None]), datetime(2026, 1, 1) + timedelta(milliseconds=n * 1_500_000 + rng.randrange(3_000_000))) for _ in range(200)]
        spark.createDataFrame([*rows, ("a", None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ms = [(s, round((t - datetime(1970, 1, 1)).total_seconds() * 1000)) for s, t in rows]
        for s, at in ms:
            kept.setdefault(s, []).extend([at] if at >= mark else [])
        mark = max(mark, *(at - 600_000 for _, at in ms))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["s"]: (r["events"], r["active_ms"]) for r in stream.drained(stream.active_time(read, "s", "t", cap, "10 minutes"), "s", "update").collect()}
    wanted = {s: (len(at), sum(min(b - a, cap) for a, b in zip(sorted(at), sorted(at)[1:], strict=False))) for s, at in kept.items()}
    assert got == wanted
    assert sum(n for n, _ in got.values()) < 950  # some were late
