"""Streams of change records: windowed counts that a watermark closes, latest states of touched keys, progress with timers, snapshot diffs.

State is kept in RocksDB and holds what the watermark hasn't passed, or one row a key. Sinks are idempotent: a batch that runs again
after a crash is recognised by its writer's name, or writes rows that change nothing.
"""

from __future__ import annotations

import contextlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from galley.functions.scalars import escape_html, fit_digest
from galley.operators.joins import snapshot_diff
from galley.sources.exports import latest_snapshot, snapshot_commit
from galley.sources.versions import Change, Conflict, Tables

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started meanwhile keep their state in RocksDB, on the executors' disks and in the checkpoint, not in their heaps."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def append_batch(tables: Tables, name: str, rows: DataFrame, writer: str, tries: int = 5) -> None:
    """Rows of a batch added to a table under the batch's name, which is not done twice in a row; after a conflict it is tried again."""
    for left in reversed(range(tries)):
        base = tables.current()
        if base and base.writer == writer:
            return
        try:
            tables.commit({name: Change(rows, append=True)}, base.number if base else -1, writer)
            return
        except Conflict:
            if not left:
                raise


def activity_counts(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, action, n): events per window and action; with `late`, a watermark drops what comes later than that."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("action")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def activity_stream(spark: SparkSession, path: str, out: str, checkpoint: str, late: str = "1 day", width: str = "1 day", files_per_batch: int = 1):
    """A query over a folder of event files that appends (start, action, n) of every window that the watermark has passed to Parquet files.

    An event_id that comes again within `late` counts once. Events behind the watermark change no count; late_rows tells how many there
    were. State holds open windows and the ids of that time only. The file sink's log makes each batch's files count once.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    events = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    with rocksdb(spark):
        return activity_counts(events, width).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query) -> int:
    """Events that came behind the watermark, as the query's progress reports them."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators if o.operatorName.startswith("dedupe"))


def latest_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, state, at, event_id): the newest event of each key."""
    newest = F.max_by(F.struct(F.col("event_type").alias("state"), F.col("ts").alias("at"), "event_id"), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(newest.alias("m")).select(key, "m.*")


def newest_states(changes: DataFrame, key: str = "user_id") -> DataFrame:
    """The newest of all the states that were ever written of each key."""
    return changes.groupBy(key).agg(F.max_by(F.struct("state", "at", "event_id"), F.struct("at", "event_id")).alias("m")).select(key, "m.*")


def latest_state_stream(spark: SparkSession, path: str, changes: str, checkpoint: str, key: str = "user_id", files_per_batch: int = 1000):
    """A query that keeps the newest event of each key as state and adds the states of the keys that a batch touches to the table `state` in `changes`."""
    schema = spark.read.parquet(path).schema
    states = latest_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path), key)
    tables = Tables(spark, changes)
    write = lambda batch, number: append_batch(tables, "state", batch, f"{checkpoint}/{number}")
    with rocksdb(spark):
        return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, changes: str, key: str = "user_id") -> DataFrame:
    """The states as of the newest version of a latest_state_stream's table."""
    return newest_states(Tables(spark, changes).read("state"), key)


def compact_states(spark: SparkSession, changes: str, key: str = "user_id") -> None:
    """The table with one row a key. To be called now and then, while a stream goes on or not: what is written meanwhile makes it fail with Conflict."""
    tables = Tables(spark, changes)
    base = tables.current()
    tables.commit({"state": Change(newest_states(tables.read("state", base), key))}, base.number, "compaction")


def watch_batch(spark: SparkSession, snapshot: DataFrame, path: str, version: int, deliver, writer: str = "watch") -> DataFrame | None:
    """One check: the diff to the snapshot before is delivered, then the snapshot committed; the first one is the baseline.

    The state advances only after delivery, so a failed delivery is repeated (at least once), with the same diff.
    """
    diff = None
    if version:
        diff = snapshot_diff(latest_snapshot(spark, path, version - 1), snapshot)
        deliver(diff)
    snapshot_commit(snapshot, path, version, writer)
    return diff


def watch_stream(spark: SparkSession, source: str, schema, state: str, checkpoint: str, deliver):
    """A stream of snapshots (path, size, mtime): what was written since the last run, in any number of files, is one snapshot and one check."""

    def check(batch: DataFrame, number: int) -> None:
        watch_batch(spark, batch, state, number, deliver, checkpoint)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest(groups: DataFrame, latest: DataFrame, limit: int = 3500) -> DataFrame:
    """(text): one message of a check: a line per journal and issue, then the latest issues; escaped and cut at a line's end.

    Lines beyond the first `limit` ones can't be in the text, so only those are gathered.
    """
    count = lambda c: F.when(F.col(c) > 0, F.concat(F.lit(f"{c} "), F.col(c).cast("string")))
    one = groups.select(F.concat_ws(" ", "journal", "issue", F.concat_ws(", ", count("added"), count("changed"), count("removed"))).alias("line"), F.lit(0).alias("part"))
    two = latest.select(F.concat(F.lit("latest: "), F.concat_ws(" ", "journal", "issue")).alias("line"), F.lit(1).alias("part"))
    listed = one.unionByName(two).orderBy("part", "line").limit(limit).agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("l"))
    return listed.select(fit_digest(escape_html(F.array_join(F.transform("l", lambda x: x["line"]), "\n")), limit).alias("text"))


def processing_progress(status: DataFrame) -> DataFrame:
    """(file_uid, status_code, articles): newest status of each file with its articles merged by uid, the newest flags of each.

    status: file_uid, at, status_code, articles array<struct<uid, has_pdf, errors>>.
    """
    newest = status.groupBy("file_uid").agg(F.max_by("status_code", "at").alias("status_code"))
    each = status.select("file_uid", "at", F.explode("articles").alias("a")).groupBy("file_uid", F.col("a.uid").alias("uid")).agg(F.max_by("a", "at").alias("a"))
    return newest.join(each.groupBy("file_uid").agg(F.array_sort(F.collect_list("a")).alias("articles")), "file_uid", "left")


#: Statuses after which a file is done with.
FINAL = (3, 4)
PROGRESS = "file_uid string, kind string, at timestamp, seq long, status_code int, articles string"


def progress_stream(spark: SparkSession, path: str, out: str, checkpoint: str, stuck_after: str = "1 hour", late: str = "10 minutes", files_per_batch: int = 1000):
    """A query over files of status messages (file_uid, at, seq, status_code, articles: a JSON array of objects with uid) that adds rows
    (PROGRESS) to the table `progress` in `out`.

    A file's state is its newest status and the newest object of each article's uid. Each batch adds a row of kind `progress` for the
    files it touches. A file that is in no final status and of which nothing comes for `stuck_after` of the messages' own time gets one row of kind `stuck`.
    """
    schema = spark.read.parquet(path).schema
    status = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    status = status.select("file_uid", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "status_code", "articles").withWatermark("at", late)
    limit = int(pd.Timedelta(stuck_after).total_seconds() * 1000)

    def advanced(key, frames, state: GroupState):
        at, seq, code, kept = state.get if state.exists else (None, None, None, "{}")
        if state.hasTimedOut:
            state.update((at, seq, code, kept))  # without a timer until something comes
            yield progress_row(key[0], "stuck", at, seq, code, kept)
            return
        articles = json.loads(kept)
        for frame in frames:
            for row in frame.itertuples(index=False):
                moment = (row.at.timestamp(), int(row.seq))
                if at is None or moment >= (at.timestamp(), seq):
                    at, seq, code = row.at, int(row.seq), None if pd.isna(row.status_code) else int(row.status_code)
                for article in json.loads(row.articles or "[]"):
                    if article["uid"] not in articles or [*moment] >= articles[article["uid"]][:2]:
                        articles[article["uid"]] = [*moment, article]
        kept = json.dumps(articles)
        state.update((at, seq, code, kept))
        if code not in FINAL:
            state.setTimeoutTimestamp(max(int(at.timestamp() * 1000) + limit, state.getCurrentWatermarkMs() + 1))
        yield progress_row(key[0], "progress", at, seq, code, kept)

    rows = status.groupBy("file_uid").applyInPandasWithState(advanced, PROGRESS, "at timestamp, seq long, status_code int, articles string", "update", GroupStateTimeout.EventTimeTimeout)
    tables = Tables(spark, out)
    write = lambda batch, number: append_batch(tables, "progress", batch, f"{checkpoint}/{number}")
    with rocksdb(spark):
        return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_row(uid: str, kind: str, at, seq: int, code: int | None, kept: str) -> pd.DataFrame:
    listed = [article for _, (*_, article) in sorted(json.loads(kept).items())]
    return pd.DataFrame({"file_uid": [uid], "kind": [kind], "at": [at], "seq": [seq], "status_code": pd.array([code], "Int32"), "articles": [json.dumps(listed)]})


def current_progress(spark: SparkSession, out: str) -> DataFrame:
    """(file_uid, status_code, articles, at, seq, stuck): the newest state of each file, and whether the newest row is that it is stuck."""
    rows = Tables(spark, out).read("progress")
    newest = F.max_by(F.struct("status_code", "articles", "at", "seq", (F.col("kind") == "stuck").alias("stuck")), F.struct("at", "seq", F.length("articles"), F.col("kind") == "stuck"))
    return rows.groupBy("file_uid").agg(newest.alias("m")).select("file_uid", "m.*")


def comment_thread(comment: DataFrame) -> DataFrame:
    """(article_id, thread): comments in their order, as structs."""
    return comment.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("seq", "user_name", "text"))).alias("thread"))
