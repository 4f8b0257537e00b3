"""Commits of versions: killed writers, two writers, repeated batches, untouched parts."""

import os

import pytest
from pyspark.sql import functions as F

from galley.operators import maintenance as m
from galley.sources import versions
from galley.sources.exports import latest_snapshot, snapshot_commit
from galley.sources.versions import Change, Conflict, Tables, changed_parts


def snapshot(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("size"))


def test_a_killed_write_is_invisible(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    snapshot_commit(snapshot(spark, 3), path, 0)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(Tables, "_put", killed)
        with pytest.raises(KeyboardInterrupt):
            snapshot_commit(snapshot(spark, 9), path, 1)
    assert latest_snapshot(spark, path).count() == 3
    broken = snapshot(spark, 9).withColumn("size", F.raise_error(F.lit("disk full")).cast("long"))
    with pytest.raises(Exception, match="disk full"):
        snapshot_commit(broken, path, 1)
    assert latest_snapshot(spark, path).count() == 3
    snapshot_commit(snapshot(spark, 5), path, 1)
    assert latest_snapshot(spark, path).count() == 5 and latest_snapshot(spark, path, 0).count() == 3


def test_of_two_writers_one_fails(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshot_commit(snapshot(spark, 3), path, 0, "a")
    first, second = Tables(spark, path), Tables(spark, path)
    base = first.current().number
    second.commit({"snapshot": Change(snapshot(spark, 4))}, base, "b")
    with pytest.raises(Conflict):
        first.commit({"snapshot": Change(snapshot(spark, 8))}, base, "a")
    assert latest_snapshot(spark, path).count() == 4


def test_the_pointer_is_put_once(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    tables._put(0, '{"writer": "a", "tables": {}}')
    with pytest.raises(Conflict):  # both have seen no version
        tables._put(0, '{"writer": "b", "tables": {}}')
    assert tables.current().writer == "a"
    assert os.listdir(tmp_path / "t" / versions.POINTERS) == ["0.json"] or sorted(os.listdir(tmp_path / "t" / versions.POINTERS)) == [".0.json.crc", "0.json"]


def test_a_repeated_batch_is_one_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshot_commit(snapshot(spark, 3), path, 0, "w")
    snapshot_commit(snapshot(spark, 7), path, 0, "w")
    assert Tables(spark, path).numbers() == [0] and latest_snapshot(spark, path).count() == 3


def test_readers_keep_their_version_and_vacuum_drops_the_rest(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for i in range(4):
        snapshot_commit(snapshot(spark, i + 1), path, i)
    tables = Tables(spark, path)
    old = tables.version(2)
    assert tables.read("snapshot", old).count() == 3
    assert len(tables.vacuum(keep=2, older_than_ms=-1)) == 2
    assert tables.numbers() == [2, 3] and tables.read("snapshot", old).count() == 3


def files(tables, name):
    return set(tables.read(name).inputFiles())


def test_changes_write_only_the_parts_they_touch(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    article = spark.range(2000).selectExpr("id", "id div 10 AS issue_id", "CASE WHEN id % 50 = 0 THEN timestamp_ntz'2000-01-01' END AS deleted_at")
    issue = spark.range(200).selectExpr("id", "cast(NULL AS timestamp_ntz) AS deleted_at")
    tables.commit({"article": Change(article, key="issue_id", parts=16), "issue": Change(issue, key="id", parts=16)}, -1, "load")
    before, base = {n: files(tables, n) for n in ("article", "issue")}, tables.current()
    ids, now = spark.createDataFrame([(7,), (8,)], "id long"), F.lit("2002-02-02").cast("timestamp_ntz")

    tables.commit({n: changed_parts(tables, n, ids, lambda t, k=k: m.soft_deleted(t, ids, now, k), base) for n, k in (("issue", "id"), ("article", "issue_id"))}, 0, "delete")
    touched = tables.parts_of("article", ids)
    assert 1 <= len(touched) <= 2
    for name in before:
        kept = before[name] & files(tables, name)
        untouched = set(tables.read(name, base, [p for p in range(16) if p not in touched]).inputFiles())
        assert kept == untouched and len(before[name] - kept) == len(touched)
    whole = m.soft_delete_cascade(issue, article, ids, now)
    assert sorted(map(tuple, tables.read("article").collect())) == sorted(map(tuple, whole[1].collect()))
    assert sorted(map(tuple, tables.read("issue").collect())) == sorted(map(tuple, whole[0].collect()))
