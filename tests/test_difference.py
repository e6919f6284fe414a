import random

from pyspark.sql import functions as F

from claimloom.operators import detect, graph
from claimloom.operators.difference import Network
from claimloom.operators.graph import ENTITY
from claimloom.plans.durable import cut

LIMITS = {"PHONE": 3, "ADDRESS": 1, "SHOP": 4}
SCHEMA = "claim_id long, claimant_phone string, claimant_address string, repair_shop_name string, claim_amount double, incident_date date"


def _claims(spark, rows):
    made = [(c, f"98765{p:05d}", f"{c} Long Road", None if s is None else f"Shop {chr(65 + s // 26)}{chr(65 + s % 26)}", 1.0) for c, p, s in rows]
    return cut(spark.createDataFrame([(*r, None) for r in made], SCHEMA))


def _same(spark, network, claims):
    of = cut(graph.edges(claims))
    whole = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert whole(network.rings().select("claim_id", "ring_id", "ring_size")) == whole(detect.rings(of, LIMITS))
    assert whole(network.degrees().select(*ENTITY, "degree")) == whole(of.select(*ENTITY, "degree").distinct())


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(7)
    ids = list(range(1, 121))
    rng.shuffle(ids)
    rows = [(c, rng.randrange(60), rng.choice([None, *range(45)])) for c in ids]
    network, seen = Network(spark, str(tmp_path / "n"), limits=LIMITS, buckets=4, most_parts=2), None
    for i in range(0, 120, 40):
        part = _claims(spark, rows[i : i + 40])
        assert network.add(part) == i // 40 + 1
        seen = part if seen is None else seen.unionByName(part)
        _same(spark, network, seen)


def test_a_group_falls_apart_when_an_entity_outgrows_its_limit(spark, tmp_path):
    network = Network(spark, str(tmp_path / "n"), limits=LIMITS, buckets=4)
    first = _claims(spark, [(5, 1, 1), (6, 1, 2), (7, 1, 3), (8, 2, 1), (9, 3, 1)])  # phone 1 holds 5, 6, 7; shop 1 holds 5, 8, 9
    network.add(first)
    assert {(r.claim_id, r.ring_id, r.ring_size) for r in network.rings().collect()} == {(c, "kcore-5", 5) for c in (5, 6, 7, 8, 9)}
    second = _claims(spark, [(2, 1, 9)])  # a fourth claim with phone 1
    network.add(second)
    assert {r.claim_id for r in network.rings().collect()} == {5, 8, 9}
    _same(spark, network, first.unionByName(second))
    network.add(second)  # a batch that is repeated adds nothing
    _same(spark, network, first.unionByName(second))
    third = _claims(spark, [(1, 2, 2), (3, 4, 3)])  # 1 joins 8's phone and 6's shop
    network.add(third)
    _same(spark, network, first.unionByName(second).unionByName(third))


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    network = Network(spark, str(tmp_path / "n"), limits=LIMITS, buckets=4)
    none = _claims(spark, [(1, 1, 1)]).where(F.col("claim_id") < 0)
    network.add(none)
    assert network.rings().count() == 0
    first = _claims(spark, [(1, 1, 1), (2, 1, 1), (3, 1, 1)])
    network.add(first)
    network.add(none)
    _same(spark, network, first)
