import os
import threading

import pytest
from pyspark.sql import functions as F

from claimloom.operators.versions import Conflict, Table

ASK = "claim_id long, version long, to_status string, role string, reason string"


def _table(spark, path, n=40, **options):
    out = Table(spark, str(path), buckets=8, **options)
    out.create(spark.range(n).select(F.col("id").alias("claim_id"), F.lit("SUBMITTED").alias("status"), F.lit(0).cast("long").alias("version")))
    return out


def _ask(spark, *rows):
    return spark.createDataFrame([(c, v, to, role, None) for c, v, to, role in rows], ASK)


def _outcomes(found):
    return {r.claim_id: (r.outcome, r.new_version) for r in found.collect()}


def test_who_comes_second_gets_409(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    assert _outcomes(table.move(_ask(spark, (1, 0, "UNDER_REVIEW", "ADJUSTER"), (2, 0, "UNDER_REVIEW", "ADJUSTER")))) == {1: (200, 1), 2: (200, 1)}
    second = table.move(_ask(spark, (2, 0, "UNDER_REVIEW", "SYSTEM"), (3, 0, "UNDER_REVIEW", "ADJUSTER"), (4, 0, "APPROVED", "ADJUSTER"), (5, 0, "FLAGGED", "ADJUSTER"), (99, 0, "FLAGGED", "SYSTEM"), (6, None, "FLAGGED", "SYSTEM")))
    assert _outcomes(second) == {2: (409, 1), 3: (200, 1), 4: (409, 0), 5: (403, 0), 99: (404, None), 6: (409, 0)}
    assert _outcomes(table.move(_ask(spark, (2, 1, "DENIED", "ADJUSTER")))) == {2: (200, 2)}
    now = {r.claim_id: (r.status, r.version) for r in table.read().collect()}
    assert len(now) == 40 and now[2] == ("DENIED", 2) and now[3] == ("UNDER_REVIEW", 1) and now[4] == ("SUBMITTED", 0)
    assert table.version() == 4 and table.read(1).where("version > 0").count() == 0  # older versions stay readable
    with pytest.raises(Conflict):
        _table(spark, tmp_path / "t")


def test_two_requests_of_one_claim_in_a_batch(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    found = table.move(_ask(spark, (1, 0, "FLAGGED", "SYSTEM"), (1, 0, "UNDER_REVIEW", "ADJUSTER")))
    assert sorted(r.outcome for r in found.collect()) == [200, 409] and table.read().where("claim_id = 1").first().version == 1


def test_a_lost_race_is_judged_on_fresh_state(spark, tmp_path):
    table, other = _table(spark, tmp_path / "t"), Table(spark, str(tmp_path / "t"), buckets=8)
    put, raced = table._put, []

    def slow(version, manifest):
        if not raced:  # the other writer is first, between this one's reading and its manifest
            raced.append(_outcomes(other.move(_ask(spark, (1, 0, "FLAGGED", "SYSTEM")))))
        return put(version, manifest)

    table._put = slow
    found = _outcomes(table.move(_ask(spark, (1, 0, "UNDER_REVIEW", "ADJUSTER"), (2, 0, "UNDER_REVIEW", "ADJUSTER"))))
    assert raced == [{1: (200, 1)}] and found == {1: (409, 1), 2: (200, 1)}
    parts = [n for n in os.listdir(tmp_path / "t") if n.startswith("part-")]
    assert len(parts) == 3 and table.version() == 3  # the part of the lost try is gone


def test_one_of_many_wins_a_version(spark, tmp_path):
    table, won = _table(spark, tmp_path / "t"), []
    threads = [threading.Thread(target=lambda i=i: won.append(table._put(2, {"writer": i}))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 7 + [True] and [n for n in os.listdir(tmp_path / "t/versions") if n.startswith(".") and not n.endswith(".crc")] == []


def test_parts_are_merged_and_only_touched_buckets_are_written(spark, tmp_path):
    table = _table(spark, tmp_path / "t", most_parts=2)
    table.move(_ask(spark, (1, 0, "UNDER_REVIEW", "ADJUSTER")))
    part = table._manifest(2)["parts"][-1]
    assert len([n for n in os.listdir(tmp_path / "t" / part) if n.startswith("__bucket")]) == 1
    table.move(_ask(spark, (2, 0, "UNDER_REVIEW", "ADJUSTER")))
    assert len(table._manifest(table.version())["parts"]) == 1 and table.read().where("version = 1").count() == 2 and table.read().count() == 40
