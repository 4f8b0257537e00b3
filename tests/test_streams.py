"""Streams: closed windows, late rows, touched keys only, timers, restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from galley.sources.versions import Tables
from galley.streaming import jobs

START = datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp_ntz, event_type string, user_id long"


def put(spark, path, rows, schema=EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def event(i, hours, kind="view", user=1):
    return (i, START + timedelta(hours=hours), kind, user)


def counts(spark, out):
    return {(r["start"].day, r["action"]): r["n"] for r in spark.read.parquet(out).collect()}


def test_windows_close_once_and_late_rows_are_counted_apart(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("events", "out", "check"))
    put(spark, source, [event(1, 1), event(2, 2), event(3, 3, "edit"), event(4, 30)])
    put(spark, source, [event(2, 2), event(5, 5)])  # a repeated id, and one that is out of order but not late
    put(spark, source, [event(6, 60)])
    query = jobs.activity_stream(spark, source, out, check)
    query.awaitTermination()
    assert counts(spark, out) == {(1, "view"): 3, (1, "edit"): 1} and jobs.late_rows(query) == 0
    put(spark, source, [event(7, 4), event(8, 61)])  # day 1 has been closed
    put(spark, source, [event(9, 200, None)])
    query = jobs.activity_stream(spark, source, out, check)  # goes on from its checkpoint
    query.awaitTermination()
    assert counts(spark, out) == {(1, "view"): 3, (1, "edit"): 1, (2, "view"): 1, (3, "view"): 2} and jobs.late_rows(query) == 1
    held = [o.numRowsTotal for o in query.recentProgress[-1].stateOperators]
    assert max(held) <= 2  # of ten events
    query = jobs.activity_stream(spark, source, out, check)
    query.awaitTermination()
    assert sum(counts(spark, out).values()) == 7


def test_states_of_touched_keys_only(spark, tmp_path):
    source, changes, check = (f"file://{tmp_path}/{n}" for n in ("events", "state", "check"))
    put(spark, source, [event(u, u, "open", u) for u in range(200)])
    run = lambda: jobs.latest_state_stream(spark, source, changes, check, files_per_batch=1).awaitTermination()
    run()
    put(spark, source, [event(1000, 500, "closed", 7), event(1001, 1, "older", 8)])
    put(spark, source, [event(1002, 600, "open", 7), event(1003, 600, "new", 900)])
    run()
    tables = Tables(spark, changes)
    written = [spark.read.parquet(f"{changes}/{f}").count() for f in tables.current().tables["state"]["folders"][""]]
    assert [n for n in written if n] == [200, 2, 2]  # not 200, 201, 201
    batch = {tuple(r) for r in jobs.latest_state(spark.read.parquet(source)).collect()}
    assert {tuple(r) for r in jobs.current_states(spark, changes).collect()} == batch
    jobs.compact_states(spark, changes)
    assert tables.read("state").count() == 201 and {tuple(r) for r in jobs.current_states(spark, changes).collect()} == batch
    put(spark, source, [event(1004, 700, "gone", 7)])
    run()
    assert {tuple(r) for r in jobs.current_states(spark, changes).collect()} == {tuple(r) for r in jobs.latest_state(spark.read.parquet(source)).collect()}


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        jobs.append_batch(tables, "state", spark.range(3), "check/0")
    jobs.append_batch(tables, "state", spark.range(2), "check/1")
    assert tables.numbers() == [0, 1] and tables.read("state").count() == 5


STATUS = "file_uid string, at timestamp_ntz, seq long, status_code int, articles string"


def status(uid, minutes, seq, code, articles="[]"):
    return (uid, START + timedelta(minutes=minutes), seq, code, articles)


def test_files_that_get_stuck_are_told_once(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("status", "progress", "check"))
    run = lambda: jobs.progress_stream(spark, source, out, check, "1 hour", "1 minute", files_per_batch=1).awaitTermination()
    put(spark, source, [status("a", 0, 1, 1, '[{"uid": "x", "n": 1}]'), status("b", 0, 2, 1), status("c", 0, 3, 1)], STATUS)
    put(spark, source, [status("a", 5, 4, 2, '[{"uid": "y", "n": 2}]'), status("b", 10, 5, 3)], STATUS)
    run()
    kinds = lambda: sorted((r["file_uid"], r["kind"], r["status_code"]) for r in Tables(spark, out).read("progress").filter("kind = 'stuck'").collect())
    assert kinds() == []
    put(spark, source, [status("z", 80, 6, 4)], STATUS)  # time goes on: a and c have waited for over an hour, b is done
    run()
    assert kinds() == [("a", "stuck", 2), ("c", "stuck", 1)]
    put(spark, source, [status("a", 85, 7, 3, '[{"uid": "x", "n": 9}]'), status("z", 300, 8, 4)], STATUS)
    run()
    assert kinds() == [("a", "stuck", 2), ("c", "stuck", 1)]
    found = {r["file_uid"]: (r["status_code"], r["articles"], r["stuck"]) for r in jobs.current_progress(spark, out).collect()}
    assert found == {"a": (3, '[{"uid": "x", "n": 9}, {"uid": "y", "n": 2}]', False), "b": (3, "[]", False), "c": (1, "[]", True), "z": (4, "[]", False)}
