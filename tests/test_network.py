import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.operators import blocks, detect, entities, explain, features, graph, leiden, local_push
from claimloom.plans.durable import cut
from tests import one_task

D = datetime.date


def _claims(spark, rows):
    full = [(i, "A", "POL-1", float(a), d, p, ad, s) for i, a, d, p, ad, s in rows]
    return spark.createDataFrame(full, "claim_id long, claimant_name string, policy_number string, claim_amount double, incident_date date, claimant_phone string, claimant_address string, repair_shop_name string")


def _network(spark):
    """A phone ring of six claims, and sixty claims of one shop with another one on it."""
    rows = [(i, 100 + i, D(2026, 1, 1 + i), "9876500011", f"{i} A Road", None) for i in range(1, 7)]
    rows += [(100 + i, 500, D(2026, 2, 1 + i % 20), str(9000000000 + i), f"{100 + i} B Road", "Busy Garage") for i in range(61)]
    return _claims(spark, rows)


def test_links_entities_backlog(spark):
    claims = _claims(spark, [(1, 5, D(2026, 1, 1), "9876500011", "1 A Rd", ""), (2, 5, D(2026, 1, 1), "bad", "1 A Road", None), (3, 5, None, "098765 00011", "x", "Busy Ltd")])
    found = entities.links(claims)
    assert sorted((r.claim_id, r.entity_type, r.canonical_value) for r in found.collect()) == [(1, "ADDRESS", "1 a road"), (1, "PHONE", "+919876500011"), (2, "ADDRESS", "1 a road"), (3, "ADDRESS", "x"), (3, "PHONE", "+919876500011"), (3, "SHOP", "busy")]
    assert [r.claim_id for r in entities.bad_phones(claims).collect()] == [2]
    assert entities.resolve_backlog(claims, found).count() == 0
    assert entities.backlog(claims, found.where("claim_id <> 3")).count() == 1
    table = entities.entities(found)
    assert {(r.canonical_value, r.claim_count) for r in table.collect()} == {("1 a road", 2), ("+919876500011", 2), ("x", 1), ("busy", 1)}
    twice = entities.upserted(table, found)
    assert {r.claim_count for r in twice.where("entity_type = 'PHONE'").collect()} == {4}
    assert entities.claims_for_entity(claims, found, "PHONE", "+910000000000").count() == 0


def test_as_of_recounts_degrees(spark):
    claims = _network(spark)
    early = graph.edges(claims, "2026-01-04")
    assert {r.degree for r in early.where("entity_type = 'PHONE'").collect()} == {3}
    assert graph.edges(claims.limit(0)).count() == 0


def test_edges_make_and_normalise_claims_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def phone(x):
        seen.add(1)
        return x

    claims = _network(spark)
    graph.edges(claims.withColumn("claimant_phone", F.udf(phone)("claimant_phone"))).collect()
    assert seen.value == claims.count()


def test_evidence_joins_shared_entities_alone(spark, monkeypatch):
    of, asked, least = cut(graph.edges(_network(spark))), [], explain.least_claims
    monkeypatch.setattr(explain, "least_claims", lambda rows, top: asked.append(rows.count()) or least(rows, top))
    found = {(r.claim_id, r.entity_type): r for r in explain.shared_entity_evidence(of).collect()}
    assert asked == [67] and len(found) == of.count()
    assert found[1, "PHONE"].shared_with == [2, 3, 4, 5, 6] and found[1, "ADDRESS"].shared_with == []
    listed = {r.claim_id: r.shared for r in explain.shared_evidence(of).collect()}
    assert sorted((e.entity_type, e.shared_with_claim_ids) for e in listed[1]) == [("ADDRESS", []), ("PHONE", ["2", "3", "4", "5", "6"])]


def test_rings_and_verdicts(spark):
    of = cut(graph.edges(_network(spark)))
    rings = detect.rings(of)
    assert {(r.claim_id, r.ring_id, r.ring_size) for r in rings.collect()} == {(i, "kcore-1", 6) for i in range(1, 7)}
    found = {r.claim_id: r for r in detect.verdicts(of, rings).collect()}
    assert len(found) == 67
    assert all(found[i].fraud_score >= 0.75 and found[i].rung == "k_core" for i in range(1, 7))
    assert all(found[100 + i].fraud_score < 0.75 for i in range(61))
    pair = graph.edges(_claims(spark, [(1, 1, None, "9876500011", "a", None), (2, 1, None, "9876500011", "b", None)]))
    assert detect.rings(pair).count() == 0


def test_burstiness_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(g, D(2026, 1, 1) + datetime.timedelta(days=r.randrange(60)) if r.random() < 0.9 else None) for g in range(25) for _ in range(r.randint(1, 12))]
    rows += [(99, None), (98, D(2026, 1, 1)), (97, D(2026, 1, 1)), (97, D(2026, 1, 15)), (96, D(2026, 1, 1)), (96, D(2026, 1, 16))]
    want = {}
    for g in {x for x, _ in rows}:
        days = [d for x, d in rows if x == g and d is not None]
        want[g] = 0.0 if len(days) < 2 else max(sum(0 <= (e - d).days <= 14 for e in days) for d in days) / len(days)
    got = {x.g: x.burstiness for x in detect.burstiness(spark.createDataFrame(rows, "g int, incident_date date"), ["g"]).collect()}
    assert got == want


def test_pagerank_equals_dense_iteration(spark, monkeypatch):
    of = cut(graph.edges(_network(spark)))
    rows = [(f"c{x.claim_id}", f"e:{x.entity_type}:{x.canonical_value}", x.weight) for x in of.collect()]
    names = sorted({v for a, b, _ in rows for v in (a, b)})
    at = {v: i for i, v in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for a, b, x in rows:
        w[at[a], at[b]] = w[at[b], at[a]] = x
    seeds = spark.createDataFrame([(1,), (101,)], "claim_id long")
    start = np.zeros(len(names))
    start[[at["c1"], at["c101"]]] = 0.5
    rank = start
    for _ in range(200):
        rank = 0.85 * (rank @ (w / w.sum(1, keepdims=True))) + 0.15 * start
    for small, often in ((20_000, 60), (30, 5)):  # two blocks; more, with lineage cut often
        monkeypatch.setattr(blocks, "SMALL", small)
        monkeypatch.setattr(blocks, "SETTLE_EVERY", often)
        got = {x.claim_id: x.score for x in detect.pagerank(of, seeds).collect()}
        assert 1 not in got and len(got) == 65
        assert all(abs(got[c] - rank[at[f"c{c}"]] / rank.max()) < 1e-9 for c in got)
    assert detect.pagerank(of, seeds.limit(0)).count() == 0


def test_pagerank_rounds_send_shared_entities_alone(spark, monkeypatch):
    """Two entities are shared among 67 claims; neither claims nor what only one of them has travels."""
    of, sizes, step = cut(graph.edges(_network(spark))), [], blocks.Blocks.step

    def numbers(x):
        return x.size if isinstance(x, np.ndarray) else sum(map(numbers, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, tuple)) else 0

    def counted(self, now, act, *given):
        out = step(self, now, act, *given)
        if self.fixed is not None:
            sizes.append(sum(out.map(lambda x: numbers(x[1][2])).collect()))
        return out

    monkeypatch.setattr(blocks.Blocks, "step", counted)
    detect.pagerank(of, spark.createDataFrame([(1,), (101,)], "claim_id long"))
    assert len(sizes) > 10 and max(sizes[:-1]) < 67  # the last one makes the scores
    assert blocks.number_of_blocks(of, 50_000_000) >= 100


def test_communities_keep_their_promises(spark, monkeypatch):
    of = cut(graph.edges(_network(spark)))
    for small in (20_000, 30):
        monkeypatch.setattr(blocks, "SMALL", small)
        found = cut(detect.communities(of))
        assert found.count() == found.select("id").distinct().count() == cut(detect.both_ways(of)).select("v").distinct().count()
        alone, one = found.select("id", F.col("id").alias("community")), found.select("id", F.lit("x").alias("community"))
        score = detect.modularity(of, found)
        assert score > detect.modularity(of, alone) and score > detect.modularity(of, one)
        ring = {r.community for r in found.where("id in ('c1','c2','c3','c4','c5','c6')").collect()}
        assert len(ring) == 1
        assert _broken(of, {r.id: r.community for r in found.collect()}, 1.2) == (0, 0)
        assert all(r.broken == 0 for r in detect.community_faults(of, found).collect())
    judged = {r.claim_id: r for r in detect.community_verdicts(of, found).collect()}
    assert judged[1].ring_id == "comm-1" and judged[1].ring_size == 6


def _broken(of, community, resolution):
    """Communities in several parts, and single moves that would gain."""
    near, total = {}, 0.0
    for x in of.collect():
        a, b = f"c{x.claim_id}", f"e:{x.entity_type}:{x.canonical_value}"
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = x.weight
        total += x.weight
    k = {v: sum(o.values()) for v, o in near.items()}
    mass = {}
    for v, m in community.items():
        mass[m] = mass.get(m, 0.0) + k[v]
    gains = 0
    for v, m in community.items():
        to = {m: 0.0}
        for o, w in near[v].items():
            to[community[o]] = to.get(community[o], 0.0) + w
        worth = {c: w - resolution * k[v] * (mass[c] - (k[v] if c == m else 0.0)) / (2 * total) for c, w in to.items()}
        gains += max(worth.values()) > worth[m] + 1e-8
    seen, parts = set(), {}
    for v in community:
        if v in seen:
            continue
        parts[community[v]] = parts.get(community[v], 0) + 1
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [o for o in near[x] if community[o] == community[x]]
    return sum(n > 1 for n in parts.values()), gains


def test_communities_of_random_graphs(spark, monkeypatch):
    r = random.Random(12)
    monkeypatch.setattr(blocks, "SMALL", 60)
    for size in (90,):
        rows = {(r.randrange(size), r.randrange(size // 3)) for _ in range(size * 2)}
        of = spark.createDataFrame([(c, "PHONE", str(e), 1.0 + r.random()) for c, e in rows], "claim_id long, entity_type string, canonical_value string, weight double")
        found = {x.id: x.community for x in detect.communities(of).collect()}
        assert _broken(of, found, 1.2) == (0, 0)
        assert all(min(v for v in found if found[v] == m) == m for m in set(found.values()))


def test_local_push_on_paths(spark):
    def run(n):
        rows = [(f"v{i:05d}", f"v{i + 1:05d}", 1.0) for i in range(n)]
        both = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "v string, o string, weight double")
        return {x.v: x for x in local_push.local_push(both, spark.createDataFrame([("v00040",)], "v string"), epsilon=1e-2).collect()}

    short, long = run(80), run(3000)
    pushed = {v for v, x in short.items() if x.pushed}
    assert pushed == {v for v, x in long.items() if x.pushed} and 0 < len(pushed) < 50
    assert abs(sum(x.p + x.r for x in long.values()) - 1) < 1e-9 and max(long.values(), key=lambda x: x.p).v == "v00040"
    assert all(x.r <= 1e-2 * (1 if v == "v00000" else 2) + 1e-12 for v, x in long.items())
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "v string, o string, weight double")
    lone = local_push.local_push(links, spark.createDataFrame([("a",), ("z",)], "v string")).where("seed = 'z'").collect()
    assert [(x.v, x.p, x.r, x.pushed) for x in lone] == [("z", 0.0, 1.0, False)]
    assert local_push.local_push(links, spark.createDataFrame([], "v string")).count() == 0


def test_local_push_equals_one_task(spark):
    links = cut(detect.both_ways(cut(graph.edges(_network(spark)))))
    seeds = ["c1", "c101", "c2"]
    want = pd.concat(one_task.push_task(seeds, 0.15, 1e-4, 400)([links.toPandas()]))
    want = {(x.seed, x.v): (x.p, x.r, x.pushed) for x in want.itertuples()}
    got = {(x.seed, x.v): (x.p, x.r, x.pushed) for x in local_push.local_push(links, spark.createDataFrame([(s,) for s in seeds], "v string"), epsilon=1e-4).collect()}
    assert got.keys() == want.keys()
    for key, (p, r, pushed) in want.items():
        assert abs(got[key][0] - p) < 1e-12 and abs(got[key][1] - r) < 1e-12 and got[key][2] == pushed


def test_local_push_reads_what_it_pushes(spark, monkeypatch):
    """Rows read from the store don't grow with the graph."""
    monkeypatch.setattr(local_push, "BUCKET", 40)
    read = {}
    for n in (400, 8000):
        rows = [(f"v{i:05d}", f"v{i + 1:05d}", 1.0) for i in range(n)]
        store = local_push.adjacency(spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "v string, o string, weight double"))
        fetched, plain = [], local_push.Store.neighbours

        def counted(self, of, fetched=fetched, plain=plain):
            some = [r.bucket for r in of.select(self.bucket_of("v").alias("bucket")).distinct().collect()]
            fetched.append(self.rows.where(F.col("bucket").isin(some)).count())
            return plain(self, of)

        monkeypatch.setattr(local_push.Store, "neighbours", counted)
        local_push.local_push(store, spark.createDataFrame([("v00200",)], "v string"), epsilon=0.02).count()
        monkeypatch.setattr(local_push.Store, "neighbours", plain)
        assert sum(fetched) > 0 and "PartitionFilters: [" in store.rows.where("bucket in (1)")._jdf.queryExecution().toString()
        read[n] = sum(fetched)
    assert read[8000] < 2 * read[400]


def test_features_of_the_ring(spark):
    found = {x.claim_id: x for x in features.features(cut(graph.edges(_network(spark)))).collect()}
    one = found[1]
    assert len(found) == 67 and set(features.ALL) < set(one.asDict())
    assert (one.day_of_week, one.is_weekend, one.two_hop_claim_count, one.component_size, one.burstiness_2hop) == (4.0, 0.0, 5.0, 6.0, 1.0)
    assert one.claimants_per_entity_2hop == 6 / one.one_hop_entity_count and one.ppr_score == 0.0
    lone = found[100]
    assert lone.two_hop_claim_count == 0 and lone.component_size == 1 and lone.entity_degree_max == 61


def test_evidence_and_scores(spark):
    of = cut(graph.edges(_network(spark)))
    scores = cut(explain.claim_scores(of, detect.verdicts(of, detect.rings(of))))
    one = scores.where("claim_id = 1").first()
    assert one.decision_hint == "FLAG" and one.explanation.summary == "Part of a 6-claim cluster (kcore-1) detected via k_core."
    phone = next(x for x in one.explanation.evidence if x.entity_type == "PHONE")
    assert phone.shared_with_claim_ids == ["2", "3", "4", "5", "6"] and phone.entity_value == "+9*********11"
    shop = next(x for x in scores.where("claim_id = 100").first().explanation.evidence if x.entity_type == "SHOP")
    assert shop.shared_with_claim_ids == [str(i) for i in range(101, 111)]
    told = explain.narratives(scores, lambda p: p.map(lambda t: "Claim 12345678-1234-1234-1234-1234567890ab" if "[claim 1]" in t else "A ring." if "[claim 2]" in t else None), "small")
    said = {x.claim_id: x for x in told.where("claim_id < 4").collect()}
    assert said[1].model_version == "template" and said[2].narrative == "A ring." and said[3].model_version == "template"


def test_grounded(spark):
    a, b = "12345678-1234-1234-1234-1234567890ab", "12345678-1234-1234-1234-1234567890ac"
    texts = [f"see {a}", f"see {b}", f"{a} and {b}", f"SEE {a.upper()}", "", None, "no id"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.g for r in frame.orderBy("i").select(explain.grounded(F.col("t"), F.array(F.lit(a))).alias("g")).collect()]
    assert got == [True, False, False, True, False, False, True]


def test_the_last_stage_moves_many_vertices_of_a_community_in_one_round(spark, monkeypatch):
    stars = spark.createDataFrame([(f"c{s}-{i}", f"e:SHOP:{s}", 1.0) for s in range(4) for i in range(30)], "c string, e string, weight double")
    rounds, accept = [], leiden._carry_out
    step = leiden.Blocks.step
    monkeypatch.setattr(leiden._Level, "moved", lambda self, now, rounds: now)  # nothing is left to it but single vertices
    monkeypatch.setattr(leiden.Blocks, "step", lambda self, now, act, *given: (rounds.append(1) if act is accept else None) or step(self, now, act, *given))
    found = leiden.communities(stars, 1.2, levels=0).collect()
    assert len({r.label for r in found}) == 4 and len(found) == 124
    assert len(rounds) <= 6


def test_parts_of_a_long_path_meet_in_few_rounds(spark, monkeypatch):
    links = [(f"c{i}", f"e{i}", 1.0) for i in range(400)] + [(f"c{i + 1}", f"e{i}", 1.0) for i in range(399)]
    random.Random(7).shuffle(links)  # so that numbers don't follow the path, where the least would pass on a vertex a round
    path = spark.createDataFrame(links, "c string, e string, weight double")
    rounds, step = [], leiden.Blocks.step

    def all_one(i, g, s, mail):
        s = {"m": np.zeros_like(s["m"]), "K": s["K"]}
        yield i, "state", s
        for holder, route in g["routes"].items():
            yield holder, "label", (s["m"][route], s["K"][route])

    monkeypatch.setattr(leiden.Blocks, "step", lambda self, now, act, *given: (rounds.append(1) if act is leiden._lower else None) or step(self, now, act, *given))
    monkeypatch.setattr(leiden._Level, "moved", lambda self, now, rounds: self.step(now, all_one))
    monkeypatch.setattr(leiden._Level, "polished", lambda self, now: (now, False))
    found = leiden.communities(cut(path), 1.0, levels=0).collect()
    assert len(found) == 800 and len({r.label for r in found}) == 1
    assert len(rounds) <= 16


def test_settled_rounds_let_go_of_those_before(spark):
    level = blocks.Blocks(None, 2, spark)
    now = level.start()
    level.steps = blocks.SETTLE_EVERY
    kept = level.settle(now)
    assert kept.partitioner == now.partitioner and not hasattr(kept, "prev") and kept.count() == now.count()
    level.release()


def test_whole_numbers_travel_in_as_few_bits_as_they_need():
    a, b = blocks.narrowed((np.arange(3), {"x": np.array([1 << 40]), "y": np.array([0.5])}))
    assert a.dtype == np.int32 and b["x"].dtype == np.int64 and b["y"].dtype == float


def test_burstiness_reads_its_dates_once(spark):
    day = D(2026, 1, 1)
    dated = spark.createDataFrame([("a", day), ("a", None), ("a", day + datetime.timedelta(20)), ("b", None), ("b", None), (None, day), (None, day)], "g string, incident_date date")
    found = detect.burstiness(dated, ["g"])
    assert {r.g: r.burstiness for r in found.where("g is not null").collect()} == {"a": 0.5, "b": 0.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_rows_of_a_seed_stay_short(spark, monkeypatch):
    """Readers and Arrow take thousands of rows at once, so what a seed knows must not be one row."""
    links = cut(detect.both_ways(cut(graph.edges(_network(spark)))))
    seeds, longest, plain = spark.createDataFrame([("c1",), ("c101",)], "v string"), [], local_push.cut
    whole = {(x.seed, x.v): (x.p, x.r) for x in local_push.local_push(links, seeds, epsilon=1e-4).collect()}

    def looked(df):
        out = plain(df)
        for name, kind in out.dtypes:
            if kind == "binary" or kind.startswith("array"):
                longest.append(out.agg(F.max(F.length(name) if kind == "binary" else 8 * F.size(name))).first()[0] or 0)
        return out

    monkeypatch.setattr(local_push, "PART", 100, raising=False)
    monkeypatch.setattr(local_push, "cut", looked)
    found = {(x.seed, x.v): (x.p, x.r) for x in local_push.local_push(links, seeds, epsilon=1e-4).collect()}
    assert found.keys() == whole.keys() and all(abs(a - b) < 1e-12 for k in found for a, b in zip(found[k], whole[k], strict=True))
    assert longest and 0 < max(longest) <= 100


def test_rings_read_shared_edges_alone(spark, monkeypatch):
    of, given, plain = graph.edges(_network(spark)), [], detect.claim_components
    monkeypatch.setattr(detect, "claim_components", lambda rows: given.append(rows) or plain(rows))
    found = {(r.claim_id, r.ring_id, r.ring_size) for r in detect.rings(of).collect()}
    assert given[0].count() == graph.pruned(of).where("degree > 1").count() < graph.pruned(of).count()
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
    every = {(r.claim_id, r.ring_id, r.ring_size) for r in detect.rings(of, least=1).collect()}
    assert found == {x for x in every if x[2] >= detect.MIN_RING} and len(every) == graph.pruned(of).select("claim_id").distinct().count()


def test_two_hop_counts_partners_over_every_entity(spark, monkeypatch):
    """All partners, also over entities beyond the limits, as pairs give them; claims of few entities, without dates and of several entities of a type."""
    monkeypatch.setattr(features, "CELL", 500)
    draw = random.Random(4)
    kinds = [("SHOP", 3), ("ADDRESS", 8), ("PHONE", 20), ("PHONE", 20)]
    have = {i: {(k, str(draw.randrange(n))) for k, n in kinds if draw.random() < 0.8} for i in range(150)} | {200: {("SHOP", "alone")}}
    day = {i: None if i % 11 == 0 else D(2026, 1, 1) + datetime.timedelta(days=draw.randrange(90)) for i in have}
    degree = pd.Series([e for es in have.values() for e in es]).value_counts().to_dict()
    rows = [(i, *e, day[i], degree[e]) for i, es in have.items() for e in es]
    of = spark.createDataFrame(rows, "claim_id long, entity_type string, canonical_value string, incident_date date, degree long")
    assert max(degree.values()) > 30
    for limits in (None, {"SHOP": 30, "ADDRESS": 1}):
        found = {r.claim_id: (r.two_hop_claim_count, r.burstiness_2hop) for r in features.two_hop(of, limits).collect()}
        near = lambda e: limits is None or degree[e] <= limits.get(e[0], graph.OTHER_MAX_DEGREE)
        assert found.keys() == {i for i in have if have[i]}
        for i, (count, burst) in found.items():
            others = {j for j in have if j != i and any(near(e) for e in have[i] & have[j])}
            days = [day[j] for j in others | {i} if day[j]]
            want = max(sum(0 <= (b - a).days <= detect.WINDOW_DAYS for b in days) for a in days) / len(days) if len(days) > 1 else 0.0
            assert count == len(others) and burst == pytest.approx(want)
    whole = {r.claim_id: r for r in features.features(cut(graph.edges(_network(spark))), limits=None).collect()}
    assert whole[100].two_hop_claim_count == 60 and whole[100].claimants_per_entity_2hop == 61 / whole[100].one_hop_entity_count


def test_lineage_is_cut_by_size(spark, monkeypatch):
    """Large graphs cut lineage every few supersteps, on each level too, and find what small ones find."""
    assert blocks.settle_every(1000) == blocks.SETTLE_EVERY and blocks.settle_every(10**9) == blocks.SETTLE_LEAST
    of = cut(graph.edges(_network(spark)))
    plain = {(r.id, r.community) for r in detect.communities(of).collect()}
    waited, settle = [], blocks.Blocks.settle

    def watched(self, now):
        waited.append(self.steps)
        return settle(self, now)

    monkeypatch.setattr(blocks, "KEPT", 1)
    monkeypatch.setattr(blocks.Blocks, "settle", watched)
    assert {(r.id, r.community) for r in detect.communities(of).collect()} == plain
    assert max(waited) <= 2 * blocks.SETTLE_LEAST + 8  # refining begins with eight supersteps
