import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, seals, workflow
from claimloom.plans.durable import cut

DEPTH = 2


@pytest.fixture(scope="module")
def chain(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(c, f"E{i}", at + datetime.timedelta(seconds=i)) for c in range(1, 60) for i in range(c % 5 + 1)]
    return cut(audit.append(workflow.event_rows(spark.createDataFrame(rows, "claim_id long, event_type string, occurred_at timestamp"))))


def _parts(chain):
    return [chain.where("seq <= 2"), chain.where("seq = 3"), chain.where("seq > 3")]


@pytest.fixture(scope="module")
def sealed(chain):
    tables = None
    for i, part in enumerate(_parts(chain)):
        assert seals.misplaced(part, tables).count() == 0
        one = seals.seal(part, tables, i, DEPTH)
        tables = one if tables is None else tables.unionByName(one)
    return tables


def _named(sealed, present):
    return sorted(tuple(r) for r in seals.problems(sealed, seals.recomputed(present, DEPTH), DEPTH).collect())


def test_batches_give_the_root_of_the_whole(chain, sealed):
    whole = seals.seal(chain, None, 0, DEPTH)
    assert seals.root(sealed) == seals.root(whole) == seals.root(seals.recomputed(chain, DEPTH))
    assert _named(sealed, chain) == []
    assert seals.seal(chain.limit(0), sealed, 9, DEPTH).count() == 0 and seals.root(whole.limit(0)) is None
    # a table has what its batch changed: the claims with a third event, not all
    second = sealed.where("batch = 1")
    assert second.where(F.col("level") == seals.CLAIM).count() == chain.where("seq = 3").count() < 59


def test_changed_lost_and_repeated_events_are_named(chain, sealed):
    at = lambda c, s: (F.col("claim_id") == c) & (F.col("seq") == s)
    changed = chain.withColumn("event_type", F.when(at(4, 2), "X").otherwise(F.col("event_type")))
    lost = changed.where(~at(9, 5) & ~at(13, 1))  # a last event too, which the chain itself can't notice
    assert _named(sealed, lost.unionByName(chain.where(at(18, 3)))) == [(4, 2, "changed"), (9, 5, "deleted"), (13, 1, "deleted"), (18, 3, "repeated")]
    assert _named(sealed, chain.where("claim_id <> 7")) == [(7, 1, "deleted"), (7, 2, "deleted"), (7, 3, "deleted")]
    assert len(_named(sealed, chain.limit(0))) == chain.count()


def test_a_chain_that_was_hashed_anew_is_found(chain, sealed):
    events = chain.where("claim_id = 14").drop("seq", "prev_hash", "hash")
    forged = audit.append(events.withColumn("reason", F.when(F.col("event_type") == "E2", "forged")))
    assert all(r.valid for r in audit.verify(forged).collect())
    assert _named(sealed, chain.where("claim_id <> 14").unionByName(forged)) == [(14, 3, "changed"), (14, 4, "changed"), (14, 5, "changed")]


def test_appended_events_and_new_claims_are_no_problem(spark, chain, sealed):
    rows = spark.createDataFrame([(14, "LATE", datetime.datetime(2027, 1, 1)), (500, "NEW", datetime.datetime(2027, 1, 1))], "claim_id long, event_type string, occurred_at timestamp")
    more = cut(audit.append(workflow.event_rows(rows), audit.latest(chain)))
    assert seals.misplaced(more, sealed).count() == 0 and _named(sealed, chain.unionByName(more)) == []
    longer = sealed.unionByName(seals.seal(more, sealed, 3, DEPTH))
    assert seals.root(longer) == seals.root(seals.recomputed(chain.unionByName(more), DEPTH)) != seals.root(sealed)


def test_events_that_continue_nothing_are_refused(chain, sealed):
    named = lambda rows, former=None: sorted(tuple(r) for r in seals.misplaced(rows, former).collect())
    assert named(chain.where("claim_id = 14 and seq > 1")) == [(14, 2)]  # nothing before it
    assert named(chain.where("claim_id = 14 and seq = 5"), sealed) == [(14, 5)]  # sealed already
    assert named(chain.where("claim_id = 13 and seq <= 2").unionByName(chain.where("claim_id = 13 and seq = 2"))) == [(13, 2)]
    assert named(chain.where("claim_id = 14").withColumn("reason", F.when(F.col("seq") == 2, "x"))) == [(14, 2)]


def test_depth():
    assert [seals.depth_for(n) for n in (0, 1600, 1601, 6_553_600)] == [1, 1, 2, 4]
