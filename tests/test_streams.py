"""Streams with their restarts, digests with marks, versioned metrics, text items."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import maintenance, notes, pages
from lectern.sources import files
from lectern.streaming import reading

AT = dt.datetime(2024, 1, 1, 12)
SHOT = "url string, html string, captured_at timestamp"


def minute(n):
    return AT + dt.timedelta(minutes=n)


def put(spark, rows, kind, path):
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(path))


def test_captures_that_return_to_an_earlier_form(spark, tmp_path):
    def run():
        stream = spark.readStream.schema(SHOT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        taken = reading.captures(spark, f"{tmp_path}/out")
        taken.run(reading.hashed(stream), f"{tmp_path}/marks")
        return {(r.url, r.html, r.captured_at, r.first_seen) for r in reading.current_captures(taken).collect()}

    put(spark, [("u", "a", minute(0)), ("u", "a", minute(1)), ("v", None, minute(0))], SHOT, f"{tmp_path}/in/1")
    assert run() == {("u", "a", minute(0), minute(0)), ("v", None, minute(0), minute(0))}
    put(spark, [("u", "b", minute(2))], SHOT, f"{tmp_path}/in/2")
    put(spark, [("u", "a", minute(3)), ("u", "b", minute(1))], SHOT, f"{tmp_path}/in/3")
    for _ in range(2):  # a run without news changes nothing
        assert run() == {("u", "a", minute(3), minute(0)), ("v", None, minute(0), minute(0))}
    written = reading.captures(spark, f"{tmp_path}/out").results()
    assert Counter(r.html for r in written.where("url = 'u'").collect()) == {"a": 2, "b": 1}


def slow_jobs(events):
    state, illegal = {}, Counter()
    for job, seq, new, told in sorted(events, key=lambda e: e[:2]):
        status, last, progress, attempts, retries = state.get(job, ("", -1, 0, 0, 0))
        if new in reading.FOLLOWS.get(status, ()):
            attempts += new == "running"
            retries = 0 if status == "failed" else retries + (status == "running" and new == "queued")
            progress = {"completed": 100, "running": max(progress, 1)}.get(new, 0 if status == "failed" else progress)
            state[job] = (new, seq, progress, attempts, retries)
        elif new == status == "running":
            state[job] = (status, seq, min(max(told, 0), 99), attempts, retries)
        else:
            illegal[job] += 1
            state.setdefault(job, (status, last, progress, attempts, retries))
    return state, illegal


def test_job_states_survive_a_restart(spark, tmp_path):
    rng = random.Random(3)
    kind = "job_id string, seq long, status string, progress int"
    events = [(f"j{j}", n, rng.choice(["queued", "running", "running", "completed", "failed"]), rng.randint(-5, 120)) for j in range(12) for n in range(30)]

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        jobs = reading.job_states(spark, f"{tmp_path}/out")
        jobs.often = 2  # all states together after every second batch
        jobs.run(stream, f"{tmp_path}/marks")
        now = {r.job_id: (r.status, r.seq, r.progress, r.attempts, r.retries) for r in jobs.current().where("status <> ''").collect()}
        return now, Counter(r.job_id for r in reading.illegal_events(jobs).collect())

    put(spark, [e for e in events if e[1] < 10], kind, f"{tmp_path}/in/1")
    run()
    put(spark, [e for e in events if 10 <= e[1] < 20], kind, f"{tmp_path}/in/2")
    put(spark, [e for e in events if e[1] >= 20], kind, f"{tmp_path}/in/3")
    want, illegal = slow_jobs(events)
    for _ in range(2):
        now, side = run()
        assert now == {j: s for j, s in want.items() if s[0]} and side == illegal
    # an event that is known already, or comes late, changes nothing
    put(spark, [("j1", 3, "queued", 0), ("j1", 29, "running", 5)], kind, f"{tmp_path}/in/4")
    now, side = run()
    assert now == {j: s for j, s in want.items() if s[0]} and side["j1"] == illegal["j1"] + 2


def test_late_rows_are_set_apart(spark, tmp_path):
    kind = "owner_id string, ts timestamp, value double"
    rng = random.Random(5)
    parts = [[(rng.choice("ab"), AT + dt.timedelta(days=d, minutes=rng.randint(0, 600)), rng.uniform(-5, 40)) for d in days for _ in range(20)] for days in ([0, 1], [5, 1], [9, 4, 1, 7])]

    def run():
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        reading.daily_activity(stream, f"{tmp_path}/out", f"{tmp_path}/marks")
        days = {(r.owner_id, r.local_day): (r.ticks, r.seconds) for r in reading.days_of(spark, f"{tmp_path}/out").collect()}
        return days, Counter((r.owner_id, r.ts, r.value) for r in reading.late_rows(spark, f"{tmp_path}/out").collect())

    kept, late, mark = {}, Counter(), None
    for n, part in enumerate(parts):
        put(spark, part, kind, f"{tmp_path}/in/{n}")
        for owner, ts, value in part:
            if mark and ts < mark - dt.timedelta(days=2):
                late[owner, ts, value] += 1
                continue
            ticks, seconds = kept.get((owner, ts.date()), (0, 0))
            kept[owner, ts.date()] = ticks + 1, seconds + min(max(int(value + 0.5) if value > 0 else 0, 0), 20)
        mark = max([mark or AT, *(ts for _, ts, _ in part)])
        for _ in range(2):
            assert run() == (kept, late)
    assert sum(late.values()) + sum(t for t, _ in kept.values()) == sum(map(len, parts)) and late


def test_sessions_are_given_out_and_forgotten(spark, tmp_path):
    kind = "user_id string, ts timestamp"
    days = [[(u, AT + dt.timedelta(days=d, seconds=s)) for u in "abc" for s in (0, 60, 119, 300)] for d in range(4)]
    for n, rows in enumerate(days):
        put(spark, rows, kind, f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = reading.sessions(stream, late="1 hour").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/marks").format("memory").queryName("given_out").trigger(availableNow=True).start()
    run.awaitTermination()
    got = Counter((r.owner_id, r.started_at, r.last_active_at, r.ticks) for r in spark.table("given_out").collect())
    want = Counter()
    for rows in days[:3]:  # the last day is open yet
        for u in "abc":
            first = min(ts for o, ts in rows if o == u)
            want[u, first, first + dt.timedelta(seconds=119), 3] += 1
            want[u, first + dt.timedelta(seconds=300), first + dt.timedelta(seconds=300), 1] += 1
    assert got == want
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert held[-1] <= 6 and max(held) <= 12


def test_totals_stop_at_a_day(spark, tmp_path):
    kind = "session_id long, seq long, local_day string, total long"
    put(spark, [(1, 1, "d", 80_000), (1, 2, "e", 500_000), (1, 3, "f", 600_000)], kind, f"{tmp_path}/in/1")
    days = reading.reading_days(spark, f"{tmp_path}/out")
    days.run(spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/marks")
    assert {(r.local_day, r.seconds) for r in days.results().collect()} == {("d", 80_000), ("e", 6_400)}


def note(target, turn, text, n):
    return (target, turn, text, minute(n))


def test_digests_and_their_mark_move_together(spark, tmp_path, monkeypatch):
    kind = "target_id string, turn int, note_text string, updated_at timestamp_ntz"
    rows = [note("a", 1, "first line\nwhat is it?", 0), note("a", 2, " ", 1), note("b", 1, "other line", 10), note("c", 1, "x", 20)]
    table = spark.createDataFrame(rows, kind)
    runs = notes.Digests(spark, str(tmp_path))
    assert runs.mark() is None
    one = runs.run(table, "2024-01-01 12:05:00")
    assert [(r.target_id, r.notes, r.lines, r.questions, r.period_start) for r in one.collect()] == [("a", 1, 2, 1, None)]
    with monkeypatch.context() as m:  # a run that fails leaves the mark
        m.setattr(maintenance.Snapshots, "_point", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            runs.run(table, "2024-01-01 12:15:00")
    assert runs.mark() == "2024-01-01 12:05:00"
    two = runs.run(table, "2024-01-01 12:15:00")
    assert [(r.target_id, r.first_line) for r in two.collect()] == [("b", "other line")]
    assert runs.run(table, "2024-01-01 12:15:00") is None and runs.run(table, "2024-01-01 12:16:00") is None
    assert runs.mark() == "2024-01-01 12:16:00"
    assert [(r.target_id, r.lines) for r in runs.run(table, "2024-01-02 00:00:00").collect()] == [("c", 0)]
    assert Counter(r.target_id for r in runs.digests().collect()) == {"a": 1, "b": 1, "c": 1}


def test_of_two_publishers_one_fails(spark, tmp_path, monkeypatch):
    store = maintenance.Snapshots(spark, str(tmp_path))
    first = store.publish(spark.range(3), note="n")
    monkeypatch.setattr(maintenance.Snapshots, "number", lambda self: 0)  # what a slower one saw
    with pytest.raises(Exception, match="(?i)exist"):
        store.publish(spark.range(5))
    monkeypatch.undo()
    assert store.number() == 1 and store.read().count() == 3 and store.note() == "n"
    assert [r.version for r in store.versions().collect()] == [first]


def test_metrics_of_an_older_version_alone_are_taken_anew(spark, tmp_path, monkeypatch):
    good, poor = "<h1>a</h1><img ><p>x</p>", "<h1>a</h1><p>x</p>"
    rows = [("1", good, good, "ready", "auto"), ("2", good, poor, "ready", "auto"), ("3", good, " ", "ready", "auto"), ("4", good, poor, "ready", "manual"), ("5", good, poor, "open", "auto"), ("6", good, good, "ready", "auto")]
    papers = spark.createDataFrame(rows, "id string, source_html string, translation_html string, status string, validation string")
    ids = spark.createDataFrame([(x,) for x in ("1", " 2", "2", "3", "4", "5", "", "9")], "id string")
    store = maintenance.Snapshots(spark, str(tmp_path))
    assert pages.revalidate_structures(store, papers, ids.where("false")).count() == 0 and store.number() == 0
    got = pages.revalidate_structures(store, papers, ids)
    assert {tuple(r) for r in got.collect()} == {("1", "unknown", "complete"), ("2", "unknown", "degraded")}
    assert tuple(pages.revalidation_summary(got).first()) == (2, 1, 1)
    seen = []
    monkeypatch.setattr(pages, "translation_fidelity", lambda *a, real=pages.translation_fidelity: seen.append(1) or real(*a))
    again = pages.revalidate_structures(store, papers.where("id <> '3'"), ids)
    assert again.count() == 0 and not seen and store.number() == 1
    newer = pages.revalidate_structures(store, papers.withColumn("translation_html", F.col("source_html")), ids, version=4)
    assert {tuple(r) for r in newer.collect()} == {("1", "complete", "complete"), ("2", "degraded", "complete"), ("3", "unknown", "complete")}
    assert {(r.id, r.metric_version) for r in store.read().collect()} == {("1", 4), ("2", 4), ("3", 4)}


def test_text_items_with_broken_rows(spark, tmp_path):
    lines = ['{"doc": "d", "page": 1, "x": 1.5, "y": 2, "width": 3, "height": 4, "str": "a"}', '{"doc": "d", "page": 1, "x": 1, "y": 3}', '{"doc": "d", "page": 1, "y": 3, "str": "no place"}', '{"doc": "d", "page": "one", "x": 1, "y": 1}', "{broken", '{"page": 2, "x": 0, "y": 0, "str": null}']
    (tmp_path / "items.json").write_text("\n".join(lines))
    items, bad = files.read_text_items(spark, str(tmp_path / "items.json"))
    assert {tuple(r) for r in items.collect()} == {("d", 1, 1.5, 2.0, 3.0, 4.0, "a"), ("d", 1, 1.0, 3.0, 0.0, 0.0, ""), (None, 2, 0.0, 0.0, 0.0, 0.0, "")}
    assert {r.line for r in bad.collect()} == {lines[3], lines[4]}
    put(spark, [("d", 1, 1.0, float("nan"), 1.0, 1.0, "a"), ("d", 1, 1.0, 2.0, None, 1.0, "b")], files.TEXT_ITEMS, tmp_path / "items.parquet")
    items, bad = files.read_text_items(spark, str(tmp_path / "items.parquet"))
    assert [r.str for r in items.collect()] == ["b"] and bad.count() == 0
    spark.range(1).write.parquet(str(tmp_path / "other.parquet"))
    with pytest.raises(ValueError, match="missing"):
        files.read_text_items(spark, str(tmp_path / "other.parquet"))


def test_a_batch_that_is_tried_again_changes_nothing(spark, tmp_path):
    kind = "job_id string, seq long, status string, progress int"
    jobs = reading.job_states(spark, f"{tmp_path}/out")
    put(spark, [("j", 1, "queued", 0), ("j", 2, "running", 0)], kind, f"{tmp_path}/in/1")
    jobs.run(spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/marks")
    more = spark.createDataFrame([("j", 3, "queued", 0), ("k", 1, "completed", 0)], kind)
    for _ in range(3):
        jobs._put(more, 1)
        assert {tuple(r) for r in jobs.current().collect()} == {("j", "queued", 3, 1, 1, 1), ("k", "", -1, 0, 0, 0)}
        assert [r.job_id for r in reading.illegal_events(jobs).collect()] == ["k"]
