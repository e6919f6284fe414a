import datetime
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.streaming import flows, outbox

SCHEMA = "id string, aggregate_id long, topic string, payload string, created_at timestamp, sent_at timestamp"


def _rows(spark, ids, day=1):
    at = datetime.datetime(2026, 1, day)
    return spark.createDataFrame([(f"{i:03d}", i % 3, "t", f"p{i}", at, None) for i in ids], SCHEMA)


def _run(spark, folder, **options):
    outbox.published(spark, f"{folder}/box", f"{folder}/sink", f"{folder}/cp", **options).awaitTermination()
    return sorted((r.id, r.batch) for r in outbox.sent(spark, f"{folder}/sink").collect())


def test_each_row_is_sent_once_by_offset(spark, tmp_path):
    folder = str(tmp_path)
    assert outbox.sent(spark, f"{folder}/sink").count() == 0
    outbox.store(_rows(spark, range(20)), f"{folder}/box")
    first = [(f"{i:03d}", 0) for i in range(20)]
    assert _run(spark, folder) == first and _run(spark, folder) == first
    # rows of the same time but later ids, and of later times, lie after the offset
    outbox.store(_rows(spark, range(20, 25)).unionByName(_rows(spark, [7000], day=2)), f"{folder}/box")
    want = first + [(f"{i:03d}", 1) for i in range(20, 25)] + [("7000", 1)]
    assert _run(spark, folder) == want
    found = outbox.sent(spark, f"{folder}/sink")
    assert {(r.key, r.value, r.topic) for r in found.where("id = '004'").collect()} == {("1", "p4", "t")}
    assert found.where("created_at = timestamp'2026-01-02'").count() == 1 and found.where("sent_at is null").count() == 0
    assert flows.mark_sent(_rows(spark, range(26)), found, "2026-02-01 00:00:00").where("sent_at is null").select("id").collect() == [("025",)]


def test_restart_between_write_and_commit(spark, tmp_path):
    folder = str(tmp_path)
    outbox.store(_rows(spark, range(20)), f"{folder}/box")
    first = _run(spark, folder)
    for gone in (f"{folder}/cp/commits/0", f"{folder}/sink/commits/{0:020d}.json"):
        os.remove(gone)
    os.remove(f"{folder}/cp/commits/.0.crc")
    assert outbox.sent(spark, f"{folder}/sink").count() == 0  # written, not committed: not sent
    assert _run(spark, folder) == first
    # the sink has committed, the stream's own log hasn't: nothing is repeated, and the new files are gone
    os.remove(f"{folder}/cp/commits/0")
    os.remove(f"{folder}/cp/commits/.0.crc")
    files = set(os.listdir(f"{folder}/sink/data"))
    assert _run(spark, folder) == first and set(os.listdir(f"{folder}/sink/data")) == files


def test_young_rows_wait_and_rows_without_a_place_are_refused(spark, tmp_path):
    folder = str(tmp_path)
    now = datetime.datetime.now(datetime.timezone.utc)
    young = spark.createDataFrame([("y", 1, "t", "p", now, None)], SCHEMA)
    outbox.store(young.unionByName(_rows(spark, [1])), f"{folder}/box")
    assert _run(spark, folder, settled_after=3600) == [("001", 0)]
    assert _run(spark, folder, settled_after=0) == [("001", 0), ("y", 1)]
    outbox.store(_rows(spark, [2]).selectExpr("id", "aggregate_id", "topic", "payload", "created_at", "timestamp'2026-01-01' as sent_at"), f"{folder}/box")
    assert len(_run(spark, folder, settled_after=0)) == 2  # sent before
    for column in ("created_at", "id"):
        bad = _rows(spark, [3])
        with pytest.raises(Exception, match=f"no {column}"):
            outbox.store(bad.withColumn(column, F.lit(None).cast(bad.schema[column].dataType)), f"{folder}/bad")


def test_aborted_files_go_and_stray_ones_are_not_read(spark, tmp_path):
    folder = str(tmp_path)
    writer = outbox._Writer(f"{folder}/sink")
    batch = pa.RecordBatch.from_pydict({"id": ["x"], "key": ["k"], "value": ["v"], "topic": ["t"], "created_at": pa.array([0], pa.timestamp("us", tz="UTC"))})
    writer.write(iter([batch]))  # a task that was lost
    kept, gone = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.abort([gone, None], 0)
    writer.commit([kept, writer.write(iter([]))], 0)
    assert outbox.sent(spark, f"{folder}/sink").count() == 1 and len(os.listdir(f"{folder}/sink/data")) == 2
