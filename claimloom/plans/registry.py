"""Registered queries over the claims network, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import normalize
from claimloom.operators import audit, detect, difference, entities, explain, features, generate, graph, local_push, metrics, scoring, seals, training, versions, workflow
from claimloom.plans import oracle
from claimloom.plans.durable import cut, shared_dir
from claimloom.sources import claims as source
from claimloom.sources.tables import table
from claimloom.streaming import flows, keyed, outbox

AS_OF, TRAIN_END, VAL_END = "1998-04-15", "1998-04-15", "1999-05-20"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The most shared entities of the claims network."""
    return shared_entities(spark, folder)


_claims = source.claims_of_orders


def _edges(spark: SparkSession, folder: str, as_of: str | None = None) -> DataFrame:
    return graph.edges(_claims(spark, folder), as_of)


def _text(c: str):
    return F.col(c).cast("string").alias(c)


GRAPH = f"WITH {oracle.graph()}"
RINGED = f"WITH RECURSIVE {oracle.graph()}, {oracle.RINGS}"
RANKED = f"{RINGED}, {oracle.pagerank()}"
JUDGED = f"{RANKED}, {oracle.VERDICTS}"
CLAIMED = f"WITH {oracle.CLAIMS}"
SCORED = f"WITH {oracle.SCORED}"


# --- sources and sinks


@query(f"{CLAIMED} SELECT CAST(claim_id AS VARCHAR) AS claim_id, claimant_name, policy_number, claim_amount, incident_date, claimant_phone, claimant_address, repair_shop_name FROM claims")
def claims_csv_scan(spark, folder):
    """Claims written as CSV and read with the declared schema."""
    path = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    _claims(spark, folder).select([f.name for f in source.CLAIMS]).write.option("header", True).csv(path)
    return source.read_claims_csv(spark, path)


@query(f"{CLAIMED} SELECT CAST(claim_id AS VARCHAR) AS claim_id, nullif(CASE WHEN claim_id % 5 = 0 THEN '' ELSE repair_shop_name END, '') AS repair_shop_name, 'SUBMITTED' AS status, CAST(0 AS BIGINT) AS version FROM claims WHERE claim_id % 3 <> 0")
def staging_insert(spark, folder):
    """New claims only, blank shops null, each id once."""
    rows = _claims(spark, folder).withColumn("repair_shop_name", F.when(F.col("claim_id") % 5 == 0, "").otherwise(F.col("repair_shop_name")))
    found = source.staged(rows.unionByName(rows), rows.where("claim_id % 3 = 0"))
    return found.select(_text("claim_id"), "repair_shop_name", "status", "version")


@query(f"{CLAIMED} SELECT count(*) AS claims, count(repair_shop_name) AS with_shop FROM claims")
def staging_count(spark, folder):
    return _claims(spark, folder).agg(F.count("*").alias("claims"), F.count("repair_shop_name").alias("with_shop"))


@query(f"{CLAIMED} SELECT CAST(claim_id AS VARCHAR) AS claim_id, ring_id FROM claims WHERE ring_id IS NOT NULL")
def truth_csv_scan(spark, folder):
    """Members and rings, through the truth sink and scan."""
    path = f"{shared_dir(spark)}/generated-{uuid.uuid4().hex}"
    source.write_generated(_claims(spark, folder).withColumn("held_out", F.lit(False)), path)
    return source.read_truth_csv(spark, f"{path}/ground_truth_rings")


@query(f"{CLAIMED} SELECT DISTINCT ring_id FROM claims WHERE ring_id IS NOT NULL AND claim_id % 2 = 0")
def held_out_csv_scan(spark, folder):
    path = f"{shared_dir(spark)}/generated-{uuid.uuid4().hex}"
    source.write_generated(_claims(spark, folder).withColumn("held_out", F.expr("ring_id is not null and claim_id % 2 = 0")), path)
    return source.read_held_out_csv(spark, f"{path}/held_out_rings")


# --- entity resolution


@query(f"{GRAPH} SELECT claim_id, phone FROM norm")
def phone_norm(spark, folder):
    return _claims(spark, folder).select("claim_id", normalize.phone(F.col("claimant_phone")).alias("phone"))


@query(f"{GRAPH} SELECT claim_id, claimant_phone FROM norm WHERE phone IS NULL")
def bad_phones(spark, folder):
    """What is no number of a country that the numbering plan knows."""
    return entities.bad_phones(_claims(spark, folder))


@query(f"{GRAPH} SELECT claim_id, address FROM norm")
def address_norm(spark, folder):
    return _claims(spark, folder).select("claim_id", normalize.address(F.col("claimant_address")).alias("address"))


@query(f"{GRAPH} SELECT claim_id, shop FROM norm")
def shop_norm(spark, folder):
    return _claims(spark, folder).select("claim_id", normalize.shop(F.col("repair_shop_name")).alias("shop"))


@query(f"{GRAPH} SELECT * FROM links")
def links(spark, folder):
    return entities.links(_claims(spark, folder))


_SEEN = "SELECT sha256(entity_type || chr(31) || canonical_value) AS entity_id, entity_type, canonical_value, count(*) AS claim_count, {first} AS first_seen FROM (SELECT l.*, c.incident_date FROM links l JOIN claims c ON c.claim_id = l.claim_id) x GROUP BY entity_type, canonical_value"


@query(f"{GRAPH} {_SEEN.format(first='min(incident_date)')}")
def entity_table(spark, folder):
    return entities.entities(entities.links(_claims(spark, folder), "incident_date"), "incident_date")


@query(f"{GRAPH} {_SEEN.format(first='coalesce(min(incident_date) FILTER (claim_id % 2 = 0), min(incident_date))')}")
def entity_upsert(spark, folder):
    """Entities of even claims, then the odd ones' links upserted."""
    rows = _claims(spark, folder)
    old = entities.entities(entities.links(rows.where("claim_id % 2 = 0"), "incident_date"), "incident_date")
    return entities.upserted(old, entities.links(rows.where("claim_id % 2 = 1"), "incident_date"), "incident_date")


@query(f"{GRAPH} SELECT * FROM links WHERE claim_id % 4 = 1")
def resolve_backlog(spark, folder):
    rows = _claims(spark, folder)
    return entities.resolve_backlog(rows, entities.links(rows.where("claim_id % 4 <> 1")))


@query(f"{GRAPH} SELECT claim_id, claimant_name FROM norm WHERE phone = '+918000000050'")
def claims_for_entity(spark, folder):
    rows = _claims(spark, folder)
    return entities.claims_for_entity(rows, entities.links(rows), "PHONE", "+918000000050").select("claim_id", "claimant_name")


@query(f"{GRAPH} SELECT entity_type, canonical_value, degree AS claim_count FROM deg WHERE entity_type = 'SHOP' AND canonical_value = 'supplier 1 motors'")
def find_entity(spark, folder):
    found = entities.entities(entities.links(_claims(spark, folder)))
    return entities.find_entity(found, "SHOP", "supplier 1 motors").select("entity_type", "canonical_value", "claim_count")


@query(f"{GRAPH} SELECT entity_type, canonical_value, {oracle.masked('canonical_value')} AS shown FROM deg")
def masked_values(spark, folder):
    found = entities.entities(entities.links(_claims(spark, folder)))
    return found.select("entity_type", "canonical_value", normalize.masked(F.col("canonical_value")).alias("shown"))


# --- graph


@query(f"{GRAPH} SELECT claim_id, entity_type, canonical_value, degree, round(weight, 6) AS weight FROM edges")
def degree_idf(spark, folder):
    return _edges(spark, folder).select("claim_id", *graph.ENTITY, "degree", F.round("weight", 6).alias("weight"))


@query(f"WITH {oracle.graph(AS_OF)} SELECT claim_id, entity_type, canonical_value, degree, claim_amount, incident_date FROM edges")
def as_of_edges(spark, folder):
    return _edges(spark, folder, AS_OF).select("claim_id", *graph.ENTITY, "degree", "claim_amount", "incident_date")


@query(f"{GRAPH} SELECT entity_type, canonical_value, degree, round(1 / ln(1 + degree), 6) AS idf FROM deg WHERE degree > 1")
def shared_entities(spark, folder):
    found = entities.entities(entities.links(_claims(spark, folder))).where("claim_count > 1")
    return found.select(*graph.ENTITY, F.col("claim_count").alias("degree"), F.round(normalize.idf_weight(F.col("claim_count")), 6).alias("idf"))


@query(f"{GRAPH} SELECT 'claim' AS kind, CAST(claim_id AS VARCHAR) AS name, count(*) AS degree FROM edges GROUP BY claim_id UNION ALL SELECT 'entity', entity_type || ':' || canonical_value, degree FROM deg")
def vertices(spark, folder):
    return graph.vertices(_edges(spark, folder))


@query(f"{GRAPH} SELECT claim_id, entity_type, canonical_value, degree FROM pruned")
def pruned_edges(spark, folder):
    return graph.pruned(_edges(spark, folder)).select("claim_id", *graph.ENTITY, "degree")


@query(f"{GRAPH} SELECT a.claim_id, b.claim_id AS other_id, a.entity_type, a.canonical_value FROM pruned a JOIN pruned b ON a.entity_type = b.entity_type AND a.canonical_value = b.canonical_value AND a.claim_id <> b.claim_id")
def neighbours(spark, folder):
    return graph.neighbours(graph.pruned(_edges(spark, folder)))


# --- detector


@query(f"{RINGED} SELECT claim_id, ring_id, ring_size FROM rings")
def component_rings(spark, folder):
    return detect.rings(_edges(spark, folder))


@query(f"{RINGED} SELECT ring_id, count(*) AS members, min(claim_id) AS first_claim, max(claim_id) AS last_claim FROM rings GROUP BY 1")
def ring_members(spark, folder):
    return detect.ring_members(detect.rings(_edges(spark, folder)))


@query(f"{RINGED} SELECT claim_id, ring_id, ring_size FROM rings")
def rings_by_difference(spark, folder):
    """The rings of a network that took its claims in by three batches of days, from what each batch touched."""
    claims = cut(_claims(spark, folder))
    network = difference.Network(spark, f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}", buckets=difference.buckets_for(3 * claims.count()))
    day = F.col("incident_date")
    for part in (day <= AS_OF, (day > AS_OF) & (day <= VAL_END), day > VAL_END):
        network.add(claims.where(part))
    return network.rings()


_BURST = "SELECT {g}, CASE WHEN count(*) < 2 THEN 0.0 ELSE max(w) / CAST(count(*) AS DOUBLE) END AS burst FROM (SELECT {g}, count(*) OVER (PARTITION BY {g} ORDER BY incident_date RANGE BETWEEN CURRENT ROW AND INTERVAL 14 DAYS FOLLOWING) AS w FROM {t} WHERE incident_date IS NOT NULL) x GROUP BY {g}"


@query(f"{GRAPH} SELECT entity_type, canonical_value, round(burst, 6) AS burstiness FROM ({_BURST.format(g='entity_type, canonical_value', t='edges')}) y")
def burstiness_by_entity(spark, folder):
    found = detect.burstiness(_edges(spark, folder), graph.ENTITY)
    return found.select(*graph.ENTITY, F.round("burstiness", 6).alias("burstiness"))


@query(f"{GRAPH}, b AS ({_BURST.format(g='entity_type, canonical_value', t='edges')}) SELECT d.entity_type, d.canonical_value, CAST(d.degree AS DOUBLE) AS ratio, round(least(1.0, 0.85 * least(1.0, greatest(0.0, (d.degree - 1) / 4.0)) + 0.15 * b.burst), 4) AS score FROM deg d JOIN b ON b.entity_type = d.entity_type AND b.canonical_value = d.canonical_value")
def suspiciousness_by_entity(spark, folder):
    of = _edges(spark, folder)
    size = of.groupBy(*graph.ENTITY).agg(F.count("*").alias("n"))
    ratio = normalize.per_entity(F.col("n"), F.lit(1))
    return size.join(detect.burstiness(of, graph.ENTITY), graph.ENTITY).select(*graph.ENTITY, ratio.cast("double").alias("ratio"), normalize.suspiciousness(ratio, F.col("burstiness")).alias("score"))


@query(f"{RANKED} SELECT claim_id, round(score, 6) AS score FROM near")
def pagerank(spark, folder):
    of = cut(_edges(spark, folder))
    found = detect.pagerank(of, detect.rings(of))
    return found.select("claim_id", F.round("score", 6).alias("score"))


def _verdicts(spark, folder) -> DataFrame:
    of = cut(_edges(spark, folder))
    return detect.verdicts(of, detect.rings(of))


@query(f"{JUDGED} SELECT claim_id, CAST(fraud_score AS DOUBLE) AS fraud_score, rung, ring_id, ring_size FROM verdicts")
def verdicts(spark, folder):
    return _verdicts(spark, folder)


@query(f"{JUDGED} SELECT CASE WHEN fraud_score >= 0.75 THEN 'FLAG' WHEN fraud_score >= 0.4 THEN 'REVIEW' ELSE 'CLEAR' END AS decision_hint, rung, count(*) AS claims FROM verdicts GROUP BY ALL")
def decision_hints(spark, folder):
    found = _verdicts(spark, folder)
    return found.groupBy(normalize.decision_hint(F.col("fraud_score")).alias("decision_hint"), "rung").agg(F.count("*").alias("claims"))


@query()
def communities(spark, folder):
    """Claims of modularity communities with their scores; no SQL for the optimisation."""
    of = cut(_edges(spark, folder))
    return detect.community_verdicts(of, detect.communities(of))


@query(f"""WITH {oracle.graph()}
SELECT 'vertices without one community' AS rule, CAST(0 AS BIGINT) AS broken UNION ALL SELECT 'communities in several parts', 0 UNION ALL SELECT 'single moves that gain', 0 UNION ALL SELECT 'modularity below that of single vertices', 0
UNION ALL SELECT 'vertices', count(*) FROM (SELECT 'c' || claim_id AS v FROM edges UNION SELECT 'e:' || entity_type || ':' || canonical_value FROM edges) x
UNION ALL SELECT 'claims', count(DISTINCT claim_id) FROM edges""")
def community_checks(spark, folder):
    """What communities promise, checked on the graph itself: connected parts, no single move that gains, every vertex once."""
    of = cut(_edges(spark, folder))
    found = cut(detect.communities(of))
    counts = found.agg(F.count("*").alias("v"), F.count_if(F.col("id").startswith("c")).alias("c")).select(F.expr("stack(2, 'vertices', v, 'claims', c)").alias("rule", "broken"))
    return detect.community_faults(of, found).unionByName(counts)


@query()
def detect_ladder(spark, folder):
    """The whole ladder, communities included."""
    of = cut(_edges(spark, folder))
    return detect.verdicts(of, detect.rings(of), detect.community_verdicts(of, detect.communities(of)))


@query(f"""{RINGED}
SELECT 'claims' AS rule, count(DISTINCT claim_id) AS n FROM edges UNION ALL SELECT 'claims of component rings', count(*) FROM rings
UNION ALL SELECT 'ring claims below their ring', 0 UNION ALL SELECT 'claims without a ring that have one rung', 0 UNION ALL SELECT 'proximities out of bounds', 0""")
def ladder_checks(spark, folder):
    """What holds for the whole ladder, communities included, whatever the communities."""
    of = cut(_edges(spark, folder))
    known = cut(detect.rings(of))
    found = cut(detect.verdicts(of, known, cut(detect.community_verdicts(of, detect.communities(of)))))
    placed = found.join(known.select("claim_id", F.lit(True).alias("ringed")), "claim_id", "left")
    lone = (F.col("rung").isin("ppr", "none")) != F.col("ring_id").isNull()
    odd = (F.col("rung") == "ppr") & ~F.col("fraud_score").between(detect.PROXIMITY, 1.0)
    rows = {
        "claims": found.count(),
        "claims of component rings": placed.where("ringed").count(),
        "ring claims below their ring": placed.where(F.col("ringed") & (F.col("fraud_score") < detect.COMPONENT_SCORE)).count(),
        "claims without a ring that have one rung": found.where(lone).count(),
        "proximities out of bounds": found.where(odd).count(),
    }
    return spark.createDataFrame(list(rows.items()), "rule string, n long")


@query(f"""WITH RECURSIVE {oracle.graph()},
ids AS (SELECT 'c' || claim_id AS c, 'e:' || entity_type || ':' || canonical_value AS e, weight FROM edges),
both_ways AS (SELECT c AS v, e AS o, weight FROM ids UNION ALL SELECT e, c, weight FROM ids),
mass AS MATERIALIZED (SELECT v, sum(weight) AS k FROM both_ways GROUP BY 1),
steps AS MATERIALIZED (SELECT b.v, b.o, b.weight / m.k AS share, false AS own FROM both_ways b JOIN mass m ON m.v = b.v UNION ALL SELECT v, v, 0, true FROM mass),
push(turn, seed, v, p, r, pushed) AS (
  SELECT DISTINCT 0, 'c' || claim_id, 'c' || claim_id, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), false FROM edges WHERE incident_date = (SELECT max(incident_date) FROM edges)
  UNION ALL SELECT x.turn + 1, x.seed, s.o, sum(CASE WHEN s.own THEN x.p + CASE WHEN x.hot THEN {local_push.ALPHA} * x.r ELSE 0 END ELSE 0 END),
    sum(CASE WHEN s.own AND x.hot THEN 0 WHEN s.own THEN x.r ELSE x.r * s.share * {1 - local_push.ALPHA} END), bool_or(s.own AND (x.hot OR x.pushed))
  FROM (SELECT push.*, push.r / m.k > {local_push.EPSILON} AS hot FROM push JOIN mass m ON m.v = push.v WHERE turn < 150) x JOIN steps s ON s.v = x.v AND (s.own OR x.hot) GROUP BY 1, 2, 3)
SELECT seed, v, round(p, 9) AS p, round(r, 9) AS r, pushed FROM push WHERE turn = 150""")
def local_push_ranks(spark, folder):
    """Ranks around the newest claims, all those of the last day, by local push."""
    of = cut(_edges(spark, folder))
    last = of.agg(F.max("incident_date").alias("incident_date"))
    new = of.join(F.broadcast(last), "incident_date").select(F.concat(F.lit("c"), F.col("claim_id").cast("string")).alias("v")).distinct()
    found = local_push.local_push(detect.both_ways(of), new)
    return found.select("seed", "v", F.round("p", 9).alias("p"), F.round("r", 9).alias("r"), "pushed")


# --- features


@query(f"{CLAIMED} SELECT claim_id, CAST(claim_amount AS DOUBLE) AS claim_amount, CAST(isodow(incident_date) - 1 AS DOUBLE) AS day_of_week, CAST(CASE WHEN isodow(incident_date) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend FROM claims")
def features_tabular(spark, folder):
    return features.tabular(_claims(spark, folder))


@query(f"{GRAPH} SELECT claim_id, CAST(min(degree) AS DOUBLE) AS entity_degree_min, round(avg(degree), 6) AS entity_degree_mean, CAST(max(degree) AS DOUBLE) AS entity_degree_max, round(sum(weight), 6) AS idf_weighted_degree, CAST(count(*) AS DOUBLE) AS one_hop_entity_count, round(1.0 / count(*), 6) AS claimants_per_entity_1hop FROM edges GROUP BY claim_id")
def features_onehop(spark, folder):
    found = features.one_hop(_edges(spark, folder))
    rounded = [F.round(c, 6).alias(c) for c in ("entity_degree_mean", "idf_weighted_degree")]
    return found.select("claim_id", "entity_degree_min", rounded[0], "entity_degree_max", rounded[1], "one_hop_entity_count", F.round(1 / F.col("one_hop_entity_count"), 6).alias("claimants_per_entity_1hop"))


_NEAR = "near2 AS MATERIALIZED (SELECT DISTINCT a.claim_id, b.claim_id AS other_id FROM pruned a JOIN pruned b ON a.entity_type = b.entity_type AND a.canonical_value = b.canonical_value AND a.claim_id <> b.claim_id), dated AS (SELECT n.claim_id, c.incident_date FROM near2 n JOIN claims c ON c.claim_id = n.other_id UNION ALL SELECT claim_id, incident_date FROM claims)"


#: The same over all entities, whatever their degree.
_NEAR_WHOLE = _NEAR.replace("FROM pruned a JOIN pruned b", "FROM edges a JOIN edges b")


@query(f"{GRAPH}, {_NEAR_WHOLE}, b AS ({_BURST.format(g='claim_id', t='dated')}) SELECT b.claim_id, CAST(coalesce(n.n, 0) AS DOUBLE) AS two_hop_claim_count, round(b.burst, 6) AS burstiness_2hop FROM b LEFT JOIN (SELECT claim_id, count(*) AS n FROM near2 GROUP BY 1) n ON n.claim_id = b.claim_id")
def features_twohop(spark, folder):
    """Over all entities of a claim, whatever their degree."""
    found = features.two_hop(cut(_edges(spark, folder)), None)
    return found.select("claim_id", "two_hop_claim_count", F.round("burstiness_2hop", 6).alias("burstiness_2hop"))


@query(f"{RINGED} SELECT c.claim_id, CAST(coalesce(r.ring_size, 1) AS DOUBLE) AS component_size FROM (SELECT DISTINCT claim_id FROM edges) c LEFT JOIN rings r ON r.claim_id = c.claim_id")
def features_component(spark, folder):
    of = cut(_edges(spark, folder))
    return of.select("claim_id").distinct().join(detect.rings(of), "claim_id", "left").select("claim_id", F.coalesce("ring_size", F.lit(1)).cast("double").alias("component_size"))


@query()
def features_all(spark, folder):
    """All sixteen features, two-hop ones over all entities; three of them come from communities, which SQL can't find."""
    return features.features(cut(_edges(spark, folder)), limits=None)


_ROUNDED = ("entity_degree_mean", "idf_weighted_degree", "burstiness_2hop", "claimants_per_entity_1hop", "claimants_per_entity_2hop")


@query(
    f"{RINGED}, {_NEAR}, b AS ({_BURST.format(g='claim_id', t='dated')}), one AS (SELECT claim_id, CAST(min(degree) AS DOUBLE) AS entity_degree_min, avg(degree) AS entity_degree_mean, CAST(max(degree) AS DOUBLE) AS entity_degree_max, sum(weight) AS idf_weighted_degree, CAST(count(*) AS DOUBLE) AS one_hop_entity_count FROM edges GROUP BY 1), "
    "two AS (SELECT claim_id, CAST(count(*) AS DOUBLE) AS n FROM near2 GROUP BY 1) "
    "SELECT c.claim_id, CAST(c.claim_amount AS DOUBLE) AS claim_amount, CAST(isodow(c.incident_date) - 1 AS DOUBLE) AS day_of_week, CAST(CASE WHEN isodow(c.incident_date) >= 6 THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend, entity_degree_min, round(entity_degree_mean, 6) AS entity_degree_mean, entity_degree_max, round(idf_weighted_degree, 6) AS idf_weighted_degree, one_hop_entity_count, "
    "coalesce(two.n, 0) AS two_hop_claim_count, round(1 / one_hop_entity_count, 6) AS claimants_per_entity_1hop, round((coalesce(two.n, 0) + 1) / one_hop_entity_count, 6) AS claimants_per_entity_2hop, round(b.burst, 6) AS burstiness_2hop, CAST(coalesce(r.ring_size, 1) AS DOUBLE) AS component_size "
    "FROM claims c JOIN one ON one.claim_id = c.claim_id JOIN b ON b.claim_id = c.claim_id LEFT JOIN two ON two.claim_id = c.claim_id LEFT JOIN rings r ON r.claim_id = c.claim_id"
)
def features_without_communities(spark, folder):
    """The thirteen features that need no communities, through the same join as all sixteen."""
    of = cut(_edges(spark, folder))
    none = spark.createDataFrame([], "claim_id long, ring_id string, ring_size long, score double")
    found = features.features(of, found=none).drop("leiden_community_size", "leiden_suspiciousness", "ppr_score")
    return found.select(*[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in found.columns])


# --- evaluation


def _scored(spark, folder) -> DataFrame:
    rows = _claims(spark, folder)
    label = F.when(F.col("ring_id").isNull(), 0).otherwise(1).alias("label")
    score = F.round(F.least(F.col("score") / 4, F.lit(1.0)), 6).alias("score")
    return metrics.amount_zscore(rows).join(rows.select("claim_id", "incident_date", label), "claim_id").select("claim_id", "incident_date", score, "label")


@query(f"{SCORED} SELECT claim_id, round(abs(CAST(claim_amount AS DOUBLE) - m) / s, 6) AS score FROM claims, stats")
def amount_zscore(spark, folder):
    return metrics.amount_zscore(_claims(spark, folder)).select("claim_id", F.round("score", 6).alias("score"))


_SPLIT = f"CASE WHEN incident_date <= DATE '{TRAIN_END}' THEN 'train' WHEN incident_date <= DATE '{VAL_END}' THEN 'val' ELSE 'test' END"


@query(f"{SCORED} SELECT {_SPLIT} AS split, count(*) AS claims, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS positive_rate, coalesce(round((count(*) - sum(label)) / CAST(nullif(sum(label), 0) AS DOUBLE), 6), 1.0) AS class_weight FROM scored GROUP BY 1")
def temporal_split(spark, folder):
    rows = training.split(_scored(spark, folder), TRAIN_END, VAL_END)
    pos = F.sum("label")
    return rows.groupBy("split").agg(F.count("*").alias("claims"), pos.cast("long").alias("positives"), F.round(F.avg("label"), 6).alias("positive_rate"), F.coalesce(F.round((F.count("*") - pos) / F.nullif(pos, F.lit(0)), 6), F.lit(1.0)).alias("class_weight"))


@query(f"{CLAIMED} SELECT claim_id, CASE WHEN ring_id IS NULL THEN 0 ELSE 1 END AS label FROM claims")
def labels_of_claims(spark, folder):
    rows = _claims(spark, folder)
    return training.labelled(rows, rows.where("ring_id is not null")).select("claim_id", "label")


_K = "SELECT k, CAST(sum(CASE WHEN rn <= k THEN label ELSE 0 END) AS BIGINT) AS hits, least(k, max(n)) AS taken, max(pos) AS pos, max(n) AS n FROM (SELECT *, row_number() OVER (ORDER BY score DESC, claim_id) AS rn, count(*) OVER () AS n, sum(label) OVER () AS pos FROM scored) r, ({ks}) ks GROUP BY k"


@query(f"{SCORED} SELECT k, hits, round(hits / CAST(taken AS DOUBLE), 6) AS precision, round(hits / CAST(pos AS DOUBLE), 6) AS recall FROM ({_K.format(ks='SELECT unnest([50, 100, 500]) AS k')}) x")
def precision_at_k(spark, folder):
    return metrics.at_k(_scored(spark, folder)).select("k", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{SCORED} SELECT CAST(k AS INTEGER) AS k, round(hits / CAST(taken AS DOUBLE), 6) AS precision, round(hits / CAST(taken AS DOUBLE) / (pos / CAST(n AS DOUBLE)), 6) AS lift FROM ({_K.format(ks='SELECT DISTINCT unnest([50, 100, CAST(floor(count(*) * 0.01) AS BIGINT), CAST(floor(count(*) * 0.05) AS BIGINT)]) AS k FROM scored')}) x")
def lift(spark, folder):
    return metrics.lift(_scored(spark, folder)).select("k", F.round("precision", 6).alias("precision"), F.round("lift", 6).alias("lift"))


@query(f"{SCORED}, {oracle.GRID} SELECT t AS threshold, round(f1, 6) AS f1 FROM (SELECT t, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 12) AS f1 FROM counted) x ORDER BY x.f1 DESC, t LIMIT 1")
def best_threshold(spark, folder):
    return metrics.best_threshold(_scored(spark, folder)).select("threshold", F.round("f1", 6).alias("f1"))


@query(f"{SCORED}, {oracle.GRID} SELECT coalesce(max(CASE WHEN tp >= 0.95 * (tp + fn) AND tp + fn > 0 THEN t END), 0.01) AS threshold FROM counted")
def review_threshold(spark, folder):
    return metrics.review_threshold(_scored(spark, folder))


@query(f"{SCORED} SELECT round(sum(pos * tp / CAST(k AS DOUBLE)) / sum(pos), 6) AS average_precision FROM (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1) a) b")
def average_precision(spark, folder):
    return metrics.average_precision(_scored(spark, folder)).select(F.round("average_precision", 6).alias("average_precision"))


@query(f"{SCORED} SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn FROM scored")
def confusion(spark, folder):
    return metrics.confusion(_scored(spark, folder), 0.5)


@query(f"{SCORED} SELECT count(*) AS claims, round(avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(score), 6) AS mean_score FROM scored s JOIN claims c ON c.claim_id = s.claim_id WHERE c.ring_id IN (SELECT ring_id FROM claims WHERE ring_id IS NOT NULL GROUP BY 1 HAVING min(incident_date) > DATE '{VAL_END}')")
def ring_injection(spark, folder):
    """Recall on rings whose every member is after the validation period."""
    truth = _claims(spark, folder).where("ring_id is not null")
    late = truth.groupBy("ring_id").agg(F.min("incident_date").alias("d")).where(F.col("d") > F.lit(VAL_END).cast("date"))
    found = training.injection(_scored(spark, folder), truth.select("claim_id", "ring_id"), late.select("ring_id"), 0.3)
    return found.select("claims", F.round("recall", 6).alias("recall"), F.round("mean_score", 6).alias("mean_score"))


@query(f"{RINGED}, v AS (SELECT c.ring_id, r.ring_id AS detected, count(*) AS n FROM claims c LEFT JOIN rings r ON r.claim_id = c.claim_id WHERE c.ring_id IS NOT NULL GROUP BY ALL), m AS (SELECT ring_id, CAST(sum(n) AS BIGINT) AS members FROM v GROUP BY 1), b AS (SELECT ring_id, detected, n FROM (SELECT *, row_number() OVER (PARTITION BY ring_id ORDER BY n DESC, detected) AS rn FROM v WHERE detected IS NOT NULL) x WHERE rn = 1) SELECT m.ring_id, m.members, b.detected, coalesce(b.n, 0) AS votes, 2 * coalesce(b.n, 0) >= m.members AS recovered FROM m LEFT JOIN b ON b.ring_id = m.ring_id")
def ring_recall(spark, folder):
    rows = _claims(spark, folder)
    return metrics.ring_recall(rows.where("ring_id is not null").select("claim_id", "ring_id"), detect.rings(graph.edges(rows)))


@query(f"{JUDGED} SELECT count(*) AS flagged, round(coalesce(avg(CASE WHEN c.ring_id IS NULL THEN 0.0 ELSE 1.0 END), 0), 6) AS precision FROM verdicts v JOIN claims c ON c.claim_id = v.claim_id WHERE v.fraud_score >= 0.75")
def flagged_precision(spark, folder):
    truth = _claims(spark, folder).where("ring_id is not null")
    return metrics.flagged_precision(_verdicts(spark, folder), truth).select("flagged", F.round("precision", 6).alias("precision"))


@query(f"{CLAIMED} SELECT count(*) AS claims, count(ring_id) AS positives, round(count(ring_id) / CAST(count(*) AS DOUBLE), 6) AS base_rate FROM claims")
def base_rate(spark, folder):
    rows = _claims(spark, folder)
    return metrics.base_rate(rows, rows.where("ring_id is not null")).select("claims", "positives", F.round("base_rate", 6).alias("base_rate"))


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(n) AS n, round(avg(value), 6) AS mean, max(CASE WHEN rn = n // 2 THEN value END) AS median, max(CASE WHEN rn = least(CAST(floor(0.95 * n) AS BIGINT), n - 1) THEN value END) AS p95 FROM r")
def latency_percentiles(spark, folder):
    return metrics.order_statistics(table(spark, folder, "events"), "value").select("n", F.round("mean", 6).alias("mean"), "median", "p95")


# --- explanation


_TOP = "top5 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY weight DESC, entity_type, canonical_value) AS rnk FROM edges) x WHERE rnk <= 5), firsts AS MATERIALIZED (SELECT entity_type, canonical_value, list(claim_id ORDER BY claim_id)[1:11] AS ids FROM edges GROUP BY ALL)"


@query(f"{GRAPH}, {_TOP} SELECT t.claim_id, CAST(t.rnk AS INTEGER) AS rank, t.entity_type, {oracle.masked('t.canonical_value')} AS entity_value, t.degree AS entity_degree, array_to_string(list_filter(f.ids, lambda x: x <> t.claim_id)[1:10], ',') AS shared_with FROM top5 t JOIN firsts f ON f.entity_type = t.entity_type AND f.canonical_value = t.canonical_value")
def evidence_topk(spark, folder):
    found = explain.shared_entity_evidence(_edges(spark, folder))
    return found.select("claim_id", "rank", "entity_type", "entity_value", "entity_degree", F.array_join(F.transform("shared_with", lambda c: c.cast("string")), ",").alias("shared_with"))


@query(f"{JUDGED} SELECT claim_id, CASE WHEN rung = 'none' THEN 'No shared entities with any other claim.' WHEN ring_id IS NOT NULL THEN 'Part of a ' || ring_size || '-claim cluster (' || ring_id || ') detected via ' || rung || '.' ELSE 'Elevated risk via proximity to a flagged cluster (rung: ' || rung || ').' END AS summary FROM verdicts")
def rule_summary(spark, folder):
    found = _verdicts(spark, folder)
    return found.select("claim_id", explain.rule_summary(F.col("rung"), F.col("ring_id"), F.col("ring_size"), F.lit(True)).alias("summary"))


_HINT = "CASE WHEN fraud_score >= 0.75 THEN 'FLAG' WHEN fraud_score >= 0.4 THEN 'REVIEW' ELSE 'CLEAR' END"


@query(f"{JUDGED}, {_TOP}, shown AS (SELECT t.claim_id, count(*) AS n, string_agg('- Shares a ' || t.entity_type || ' (' || {oracle.masked('t.canonical_value')} || ') with ' || least(10, t.degree - 1) || ' other claim(s); that entity appears on ' || t.degree || ' claims total.', chr(10) ORDER BY rnk) AS lines FROM top5 t GROUP BY 1) SELECT v.claim_id, CAST(v.fraud_score AS DOUBLE) AS fraud_score, {_HINT} AS decision_hint, v.ring_id, v.rung, s.n + CASE WHEN v.ring_size IS NULL THEN 0 ELSE 1 END AS evidence, s.lines || CASE WHEN v.ring_size IS NULL THEN '' ELSE chr(10) || '- community size: ' || v.ring_size || ' (baseline 1).' END AS lines FROM verdicts v JOIN shown s ON s.claim_id = v.claim_id")
def claim_scores(spark, folder):
    """The score contract for every claim, its evidence as the lines that a prompt holds."""
    of = cut(_edges(spark, folder))
    found = explain.claim_scores(of, detect.verdicts(of, detect.rings(of)))
    evidence = F.col("explanation.evidence")
    return found.select("claim_id", "fraud_score", "decision_hint", "ring_id", "rung", F.size(evidence).cast("long").alias("evidence"), F.array_join(explain.evidence_lines(evidence), "\n").alias("lines"))


@query(f"{GRAPH}, {_TOP}, named AS (SELECT t.claim_id, unnest(list_filter(f.ids, lambda x: x <> t.claim_id)[1:10]) AS other FROM top5 t JOIN firsts f ON f.entity_type = t.entity_type AND f.canonical_value = t.canonical_value) SELECT claim_id, 1 + count(DISTINCT other) AS allowed FROM (SELECT DISTINCT claim_id, NULL AS other FROM edges UNION ALL SELECT claim_id, other FROM named) x GROUP BY 1")
def allowed_ids(spark, folder):
    of = cut(_edges(spark, folder))
    nothing = of.select("claim_id").distinct().selectExpr("claim_id", "0.0D as fraud_score", "'none' as rung", "cast(null as string) as ring_id", "cast(null as bigint) as ring_size")
    found = explain.claim_scores(of, nothing)
    return found.select("claim_id", F.size(explain.allowed_ids(F.col("claim_id"), F.col("explanation.evidence"))).cast("long").alias("allowed"))


def _uuids(n: str) -> str:
    return f"substr(md5(CAST({n} AS VARCHAR)), 1, 8) || '-aaaa-bbbb-cccc-' || substr(md5(CAST({n} AS VARCHAR)), 9, 12)"


@query(f"WITH e AS (SELECT event_id, {_uuids('event_id')} AS own, CASE event_id % 4 WHEN 0 THEN upper({_uuids('event_id')}) WHEN 1 THEN {_uuids('event_id + 1')} WHEN 2 THEN '' ELSE 'no ids' END AS said FROM events) SELECT event_id, event_id % 4 IN (0, 3) AS grounded FROM e")
def grounding_check(spark, folder):
    """Texts that name their own claim, another one, nothing, and no id."""
    rows = table(spark, folder, "events")
    md5 = lambda c: F.md5(c.cast("string"))
    name = lambda c: F.concat(F.substring(md5(c), 1, 8), F.lit("-aaaa-bbbb-cccc-"), F.substring(md5(c), 9, 12))
    e = F.col("event_id")
    said = F.when(e % 4 == 0, F.upper(name(e))).when(e % 4 == 1, name(e + 1)).when(e % 4 == 2, "").otherwise("no ids")
    return rows.select("event_id", explain.grounded(said, F.array(name(e))).alias("grounded"))


_SUMMARY = "CASE WHEN rung = 'none' THEN 'No shared entities with any other claim.' WHEN ring_id IS NOT NULL THEN 'Part of a ' || ring_size || '-claim cluster (' || ring_id || ') detected via ' || rung || '.' ELSE 'Elevated risk via proximity to a flagged cluster (rung: ' || rung || ').' END"


@query(f"{JUDGED} SELECT claim_id, {_SUMMARY} AS narrative, true AS grounded, 'template' AS model_version, CAST(0 AS DOUBLE) AS generation_ms FROM verdicts WHERE fraud_score >= 0.75")
def narratives(spark, folder):
    """Template texts of flagged claims."""
    of = cut(_edges(spark, folder))
    scores = explain.claim_scores(of, detect.verdicts(of, detect.rings(of)))
    return explain.narratives(scores.where("decision_hint = 'FLAG'"))


@query(f"{JUDGED} SELECT least(count(*), 20) AS sample_size, CAST(1 AS DOUBLE) AS grounded_rate, CAST(0 AS DOUBLE) AS fallback_rate FROM verdicts WHERE fraud_score >= 0.75")
def narrative_report(spark, folder):
    """How often a generator that repeats its prompt stays grounded; its times aren't compared."""
    of = cut(_edges(spark, folder))
    scores = explain.claim_scores(of, detect.verdicts(of, detect.rings(of)))
    found = explain.narrative_report(scores, lambda prompts: prompts, "echo")
    return found.select("sample_size", "grounded_rate", "fallback_rate")


_FEATURES = ("entity_degree_max", "two_hop_claim_count", "claim_amount", "day_of_week", "idf_weighted_degree", "burstiness_2hop")
_PUSH = "0.25 * (rnk % 2) - 0.125 + 0.5 / rnk"


@query(
    f"{RINGED}, {_TOP}, shown AS (SELECT t.claim_id, count(*) AS n, string_agg('- Shares a ' || t.entity_type || ' (' || {oracle.masked('t.canonical_value')} || ') with ' || least(10, t.degree - 1) || ' other claim(s); that entity appears on ' || t.degree || ' claims total.', chr(10) ORDER BY rnk) AS lines FROM top5 t GROUP BY 1), "
    f"f AS (SELECT c.claim_id, r.rnk, list_extract({list(_FEATURES)!r}, r.rnk) AS feature, CAST((c.claim_id + r.rnk) % 7 AS DOUBLE) AS v, CAST({_PUSH} AS DOUBLE) AS push FROM (SELECT DISTINCT claim_id FROM edges) c, (SELECT unnest([1, 2, 3, 4, 5]) AS rnk) r), "
    "pushed AS (SELECT claim_id, string_agg('- Model feature ' || chr(39) || feature || chr(39) || ' = ' || printf('%.2f', v) || ', pushed the score ' || CASE WHEN push >= 0 THEN 'toward fraud' ELSE 'toward clean' END || ' (weight ' || printf('%+.3f', push) || ').', chr(10) ORDER BY rnk) AS lines FROM f GROUP BY 1), "
    "p AS (SELECT claim_id, claim_id % 997 / 997.0 AS p FROM (SELECT DISTINCT claim_id FROM edges) x) "
    "SELECT p.claim_id, CAST(round(CAST(p.p AS DOUBLE), 4) AS DOUBLE) AS fraud_score, CASE WHEN p.p >= 0.31 THEN 'FLAG' WHEN p.p >= 0.01 THEN 'REVIEW' ELSE 'CLEAR' END AS decision_hint, 'model' AS rung, coalesce(r.ring_id, CASE WHEN p.claim_id % 3 = 0 THEN 'comm-' || p.claim_id % 10 END) AS ring_id, "
    "'Fraud probability ' || printf('%.2f', CAST(p.p AS DOUBLE)) || ' from the trained ring classifier (driven mainly by entity_degree_max).' AS summary, CAST(s.n + 5 AS INTEGER) AS evidence, s.lines || chr(10) || q.lines AS lines FROM p LEFT JOIN rings r ON r.claim_id = p.claim_id JOIN shown s ON s.claim_id = p.claim_id JOIN pushed q ON q.claim_id = p.claim_id"
)
def model_score_contract(spark, folder):
    """The model's score contract over given probabilities, contributions and communities."""
    of = cut(_edges(spark, folder))
    ids = of.select("claim_id").distinct()
    ranks = spark.range(1, 7).select(F.col("id").cast("int").alias("rnk"))
    given = F.element_at(F.array(*map(F.lit, _FEATURES)), F.col("rnk"))
    pushed = ids.join(F.broadcast(ranks)).select("claim_id", F.col("rnk").alias("rank"), given.alias("feature"), ((F.col("claim_id") + F.col("rnk")) % 7).cast("double").alias("feature_value"), F.expr(_PUSH.replace("0.25", "0.25D").replace("0.125", "0.125D").replace("0.5 ", "0.5D ")).alias("shap_value"))
    chances = ids.select("claim_id", (F.col("claim_id") % 997 / 997).alias("score"))
    groups = ids.where("claim_id % 3 = 0").select("claim_id", F.concat(F.lit("comm-"), F.col("claim_id") % 10).alias("ring_id"))
    found = scoring.model_scores(of, chances, pushed, detect.rings(of), groups, 0.31, 0.01, "m1")
    evidence = F.col("explanation.evidence")
    return found.select("claim_id", "fraud_score", "decision_hint", "rung", "ring_id", F.col("explanation.summary").alias("summary"), F.size(evidence).alias("evidence"), F.array_join(explain.evidence_lines(evidence), "\n").alias("lines"))


_ASKED = [1, 33, 2, 999_999_999, 7, 35, 70, 100, 3, 6]


@query(f"{JUDGED} SELECT v.claim_id, CAST(v.fraud_score AS DOUBLE) AS fraud_score, v.rung FROM (SELECT unnest({_ASKED}) AS claim_id) a JOIN verdicts v ON v.claim_id = a.claim_id")
def score_batch(spark, folder):
    """Scores of a few claims, one of them unknown, from a scorer that holds the rules' scores."""
    of = cut(_edges(spark, folder))
    held = explain.claim_scores(of, detect.verdicts(of, detect.rings(of)))
    return scoring.Scorer(lambda: _claims(spark, folder), scores=held).batch(_ASKED).select("claim_id", "fraud_score", "rung")


# --- audit log and workflow


def _events(spark, folder) -> DataFrame:
    """Audit events made of the events table."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("claim_id"), "event_id", F.col("ts").cast("timestamp").alias("occurred_at"), F.upper("event_type").alias("event_type"), F.lit(None).cast("string").alias("from_status"), F.lit("SUBMITTED").alias("to_status"),
        F.concat(F.lit("u"), F.col("user_id")).alias("actor_id"), F.lit("SYSTEM").alias("actor_role"), F.lit(None).cast("string").alias("reason"), (F.col("event_id") % 10000 / 10000).cast("decimal(5,4)").alias("fraud_score"), F.lit(None).cast("string").alias("ring_id"),
        F.lit(None).cast("string").alias("explanation_json"), F.lit("m1").alias("model_version"),
    )
    return rows


_FIRSTS = """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) x WHERE rn = 1),
j AS (SELECT user_id, '{"actorId":"u' || user_id || '","actorRole":"SYSTEM","claimId":"' || user_id || '","eventType":"' || upper(event_type) || '","explanationJson":null,"fraudScore":"' || CAST(CAST(event_id % 10000 / 10000.0 AS DECIMAL(5,4)) AS VARCHAR)
  || '","fromStatus":null,"modelVersion":"m1","occurredAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') END
  || 'Z","prevHash":"' || repeat('0', 64) || '","reason":null,"ringId":null,"seq":1,"toStatus":"SUBMITTED"}' AS body FROM f)"""


@query(f"{_FIRSTS} SELECT user_id AS claim_id, sha256(repeat('0', 64) || body) AS hash FROM j")
def audit_hash(spark, folder):
    """The first link of each chain."""
    return audit.append(_events(spark, folder), order=("occurred_at", "event_id")).where("seq = 1").select("claim_id", "hash")


@query("SELECT user_id AS claim_id, count(*) AS events, user_id % 3 <> 0 OR count(*) < 3 AS valid FROM events GROUP BY 1")
def audit_verify(spark, folder):
    """Chains of which every third claim's third event was changed afterwards."""
    chain = cut(audit.append(_events(spark, folder), order=("occurred_at", "event_id")))
    changed = chain.withColumn("actor_id", F.when((F.col("claim_id") % 3 == 0) & (F.col("seq") == 3), "someone").otherwise(F.col("actor_id")))
    return audit.verify(changed)


@query("SELECT user_id AS claim_id, date_trunc('millisecond', max(ts)) AS occurred_at, CAST(count(*) AS INTEGER) AS seq FROM events GROUP BY 1")
def latest_event(spark, folder):
    found = audit.latest(cut(audit.append(_events(spark, folder), order=("occurred_at", "event_id"))))
    return found.select("claim_id", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "seq")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS seq FROM events WHERE user_id = 1")
def audit_history(spark, folder):
    chain = cut(audit.append(_events(spark, folder).where("claim_id = 1"), order=("occurred_at", "event_id")))
    return audit.history(chain, 1).select("event_id", "seq")


@query("SELECT DISTINCT user_id AS claim_id, 'm1' AS model_version FROM events WHERE event_id % 2 = 0")
def scored_before(spark, folder):
    rows = _events(spark, folder).withColumn("event_type", F.when(F.col("event_id") % 2 == 0, "FRAUD_SCORED").otherwise("STATUS_CHANGED"))
    return audit.scored_before(rows)


def _canonical_rows(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.format_string('{ "z" : %d,\n"a": [1, {"y": null, "b": "x"}] }', F.col("event_id")).alias("raw"))


@query("SELECT event_id, '{\"a\":[1,{\"b\":\"x\",\"y\":null}],\"z\":' || event_id || '}' AS canonical FROM events")
def canonical_json(spark, folder):
    return _canonical_rows(spark, folder).select("event_id", audit.canonical_json(F.col("raw")).alias("canonical"))


def _requests(spark, folder) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    e = F.col("event_id")
    return table(spark, folder, "events").select("event_id", pick(workflow.STATUSES, e % 5).alias("from_status"), pick(workflow.STATUSES, F.floor(e / 5) % 5).alias("to_status"), pick(("ADJUSTER", "INVESTIGATOR", "SYSTEM", "AUDITOR"), F.floor(e / 25) % 4).alias("role"), F.when(e % 2 == 0, "checked").alias("reason"))


_REQUESTS = "req AS (SELECT event_id, list_extract(['SUBMITTED','UNDER_REVIEW','FLAGGED','APPROVED','DENIED'], CAST(event_id % 5 + 1 AS INTEGER)) AS f, list_extract(['SUBMITTED','UNDER_REVIEW','FLAGGED','APPROVED','DENIED'], CAST(event_id // 5 % 5 + 1 AS INTEGER)) AS t, list_extract(['ADJUSTER','INVESTIGATOR','SYSTEM','AUDITOR'], CAST(event_id // 25 % 4 + 1 AS INTEGER)) AS role, event_id % 2 = 0 AS reasoned FROM events)"
_ALLOWED = "allowed(f, t, role) AS (VALUES " + ", ".join(str(t) for t in workflow.TRANSITIONS) + ")"


@query(f"WITH {_REQUESTS}, {_ALLOWED} SELECT event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM allowed a WHERE a.f = r.f AND a.t = r.t) THEN 409 WHEN NOT EXISTS (SELECT 1 FROM allowed a WHERE a.f = r.f AND a.t = r.t AND a.role = r.role) THEN 403 WHEN r.f = 'FLAGGED' AND r.t = 'APPROVED' AND NOT reasoned THEN 400 ELSE 200 END AS outcome FROM req r")
def transitions_check(spark, folder):
    return workflow.checked(_requests(spark, folder)).select("event_id", "outcome")


@query(f"WITH {_REQUESTS}, {_ALLOWED} SELECT event_id AS claim_id, CASE WHEN r.f = 'FLAGGED' AND r.t = 'APPROVED' THEN 'HUMAN_OVERRIDE' ELSE 'STATUS_CHANGED' END AS event_type, r.t AS to_status FROM req r JOIN allowed a ON a.f = r.f AND a.t = r.t AND a.role = r.role WHERE NOT (r.f = 'FLAGGED' AND r.t = 'APPROVED' AND NOT reasoned)")
def transition_events(spark, folder):
    rows = _requests(spark, folder).withColumnRenamed("event_id", "claim_id").withColumn("actor_id", F.lit("a"))
    return workflow.transition_events(rows).select("claim_id", "event_type", "to_status")


def _asked(spark, folder) -> DataFrame:
    """Requests of the events table's users, in the order of events."""
    rows = _requests(spark, folder).drop("from_status")
    return table(spark, folder, "events").select(F.col("user_id").alias("claim_id"), "event_id", F.col("ts").alias("requested_at")).join(rows, "event_id")


@query(f"""WITH RECURSIVE {_REQUESTS}, {_ALLOWED},
q AS MATERIALIZED (SELECT e.user_id, r.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS rn FROM req r JOIN events e ON e.event_id = r.event_id),
fold(user_id, rn, event_id, outcome, status, version) AS (SELECT user_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, 'SUBMITTED', CAST(0 AS BIGINT) FROM (SELECT DISTINCT user_id FROM q) u
  UNION ALL SELECT user_id, rn, event_id, outcome, CASE WHEN outcome = 200 THEN t ELSE status END, version + CASE WHEN outcome = 200 THEN 1 ELSE 0 END FROM (
    SELECT q.user_id, q.rn, q.event_id, q.t, f.status, f.version, CASE WHEN NOT EXISTS (SELECT 1 FROM allowed a WHERE a.f = f.status AND a.t = q.t) THEN 409 WHEN NOT EXISTS (SELECT 1 FROM allowed a WHERE a.f = f.status AND a.t = q.t AND a.role = q.role) THEN 403 WHEN f.status = 'FLAGGED' AND q.t = 'APPROVED' AND NOT q.reasoned THEN 400 ELSE 200 END AS outcome
    FROM fold f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1) x)
SELECT user_id AS claim_id, event_id, outcome, status, version FROM fold WHERE rn > 0""")
def folded_requests(spark, folder):
    """Requests of one claim after another, each from the status that the ones before have left."""
    asked = cut(_asked(spark, folder))
    claims = asked.select("claim_id").distinct().select("claim_id", F.lit("SUBMITTED").alias("status"), F.lit(0).alias("version"))
    return workflow.folded(claims, asked, ("requested_at", "event_id")).select("claim_id", "event_id", "outcome", "status", "version")


@query(f"""WITH {oracle.CLAIMS},
first AS (SELECT claim_id, claim_id % 2 = 0 AS ok FROM claims WHERE claim_id % 3 <> 0),
second AS (SELECT c.claim_id, coalesce(f.ok, false) AS moved FROM claims c LEFT JOIN first f ON f.claim_id = c.claim_id)
SELECT claim_id, CAST(1 AS INTEGER) AS writer, CASE WHEN ok THEN 200 ELSE 403 END AS outcome, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS new_version FROM first
UNION ALL SELECT claim_id, 2, CASE WHEN moved THEN 409 ELSE 200 END, CAST(1 AS BIGINT) FROM second""")
def versioned_moves(spark, folder):
    """Two writers that have read the same claims: the second is refused where the first has moved the claim."""
    claims = _claims(spark, folder).select("claim_id")
    held = versions.Table(spark, f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}")
    held.create(claims.select("claim_id", F.lit("SUBMITTED").alias("status"), F.lit(0).cast("long").alias("version")))
    asked = claims.select("claim_id", F.lit(0).cast("long").alias("version"), F.lit(None).cast("string").alias("reason"))
    role = F.when(F.col("claim_id") % 2 == 0, "ADJUSTER").otherwise("AUDITOR")
    first = held.move(asked.where("claim_id % 3 <> 0").select("*", F.lit("UNDER_REVIEW").alias("to_status"), role.alias("role")))
    second = held.move(asked.select("*", F.lit("FLAGGED").alias("to_status"), F.lit("SYSTEM").alias("role")))
    both = first.withColumn("writer", F.lit(1)).unionByName(second.withColumn("writer", F.lit(2)))
    return both.select("claim_id", "writer", "outcome", "new_version")


@query("SELECT user_id AS claim_id, CAST(3 AS INTEGER) AS seq, CASE WHEN user_id % 3 = 0 THEN 'changed' ELSE 'deleted' END AS problem FROM events WHERE user_id % 3 <> 1 GROUP BY 1 HAVING count(*) >= 3")
def audit_altered(spark, folder):
    """Chains of which every third claim's third event was changed, and every other third's deleted."""
    chain = cut(audit.append(_events(spark, folder), order=("occurred_at", "event_id")))
    third = F.col("seq") == 3
    after = chain.where(~(third & (F.col("claim_id") % 3 == 2))).withColumn("reason", F.when(third & (F.col("claim_id") % 3 == 0), "other").otherwise(F.col("reason")))
    return audit.altered(chain, after)


@query("""SELECT user_id AS claim_id, CAST(3 AS INTEGER) AS seq, CASE WHEN user_id % 3 = 0 THEN 'changed' ELSE 'deleted' END AS problem
FROM events WHERE user_id % 3 <> 1 GROUP BY 1 HAVING count(*) >= 3""")
def audit_sealed(spark, folder):
    """Chains sealed in three batches, some changed or shortened afterwards: the events that the node tables alone name."""
    chain = cut(audit.append(_events(spark, folder), order=("occurred_at", "event_id")))
    tables = None
    for number, part in enumerate(("seq <= 2", "seq = 3", "seq > 3")):
        one = seals.seal(chain.where(part), tables, number)
        tables = one if tables is None else tables.unionByName(one)
    third = F.col("seq") == 3
    after = chain.where(~(third & (F.col("claim_id") % 3 == 2))).withColumn("reason", F.when(third & (F.col("claim_id") % 3 == 0), "other").otherwise(F.col("reason")))
    return seals.problems(tables, seals.recomputed(after))


@query(f"""{_FIRSTS},
h AS (SELECT user_id AS claim_id, sha256(repeat('0', 64) || body) AS d, sha256(CAST(user_id AS VARCHAR)) AS place FROM j),
b AS (SELECT substr(place, 1, 2) AS path, sha256(string_agg(claim_id || ':1:' || d, ',' ORDER BY claim_id || ':1')) AS digest FROM h GROUP BY 1),
m AS (SELECT substr(path, 1, 1) AS path, sha256(string_agg(path || ':' || digest, ',' ORDER BY path)) AS digest FROM b GROUP BY 1)
SELECT CAST(2 AS INTEGER) AS level, path, digest FROM b
UNION ALL SELECT 1, path, digest FROM m
UNION ALL SELECT 0, '', sha256(string_agg(path || ':' || digest, ',' ORDER BY path)) FROM m""")
def audit_seal_tree(spark, folder):
    """The tree over first links, sealed in two batches: the newest nodes are those of one tree over all."""
    first = cut(audit.append(_events(spark, folder), order=("occurred_at", "event_id")).where("seq = 1"))
    tables = seals.seal(first.where("claim_id % 2 = 0"), None, 0, depth=2)
    tables = tables.unionByName(seals.seal(first.where("claim_id % 2 = 1"), tables, 1, depth=2))
    found = seals.latest(tables, 0)
    for level in (1, 2):
        found = found.unionByName(seals.latest(tables, level))
    return found.select("level", "path", "digest")


@query("WITH s AS (SELECT user_id, list_extract(['SUBMITTED','UNDER_REVIEW','APPROVED'], CAST(user_id % 3 + 1 AS INTEGER)) AS f, CASE WHEN user_id % 4 = 0 THEN 'FLAGGED' ELSE 'UNDER_REVIEW' END AS t FROM (SELECT DISTINCT user_id FROM events) e WHERE user_id % 5 <> 0) SELECT user_id AS claim_id, f AS from_status, CASE WHEN f = 'SUBMITTED' THEN t ELSE f END AS to_status FROM s")
def apply_score(spark, folder):
    """Repeated scores, scores of claims scored before, and late ones."""
    rows = table(spark, folder, "events").select(F.col("user_id").alias("claim_id"))
    status = F.element_at(F.array(*map(F.lit, ("SUBMITTED", "UNDER_REVIEW", "APPROVED"))), (F.col("claim_id") % 3 + 1).cast("int"))
    scores = rows.select("claim_id", F.lit("m1").alias("model_version"), F.when(F.col("claim_id") % 4 == 0, "FLAG").otherwise("REVIEW").alias("decision_hint"))
    before = rows.where("claim_id % 5 = 0").select("claim_id", F.lit("m1").alias("model_version"), F.lit("FRAUD_SCORED").alias("event_type"))
    return workflow.apply_scores(rows.distinct().withColumn("status", status), scores, before).select("claim_id", "from_status", "to_status")


@query(f"{CLAIMED} SELECT problem, count(*) AS claims FROM (SELECT unnest(list_filter([CASE WHEN claim_id % 7 = 0 THEN 'claim_amount' END, CASE WHEN claim_id % 11 = 0 THEN 'claimant_name' END, CASE WHEN claim_id % 13 = 0 THEN 'incident_date' END], lambda x: x IS NOT NULL)) AS problem FROM claims) x GROUP BY 1")
def validation_report(spark, folder):
    c = F.col("claim_id")
    rows = _claims(spark, folder).withColumns({"claim_amount": F.when(c % 7 != 0, F.col("claim_amount")).otherwise(F.lit(0)), "claimant_name": F.when(c % 11 != 0, F.col("claimant_name")).otherwise(F.lit("  ")), "incident_date": F.when(c % 13 != 0, F.col("incident_date"))})
    return workflow.validated(rows).select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("claims"))


@query(f"{GRAPH} SELECT 'claims' AS part, count(phone) AS rows FROM norm UNION ALL SELECT 'links', count(*) FROM links WHERE claim_id IN (SELECT claim_id FROM norm WHERE phone IS NOT NULL) UNION ALL SELECT 'events', count(phone) FROM norm UNION ALL SELECT 'outbox', count(phone) FROM norm UNION ALL SELECT 'rejected', count(*) - count(phone) FROM norm")
def create_claims(spark, folder):
    made = workflow.create_claims(_claims(spark, folder))
    out = None
    for name in ("claims", "links", "events", "outbox", "rejected"):
        one = made[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _outbox(spark, folder) -> DataFrame:
    rows = _claims(spark, folder)
    return rows.select(F.col("claim_id").cast("string").alias("id"), F.col("claim_id").alias("aggregate_id"), F.lit("claim.submitted").alias("topic"), F.to_json(F.struct(_text("claim_id"))).alias("payload"), F.col("incident_date").cast("timestamp").alias("created_at"), F.when(F.col("claim_id") % 2 == 0, F.col("incident_date").cast("timestamp")).alias("sent_at"))


@query(f"{CLAIMED} SELECT CAST(claim_id AS VARCHAR) AS key, '{{\"claim_id\":\"' || claim_id || '\"}}' AS value, 'claim.submitted' AS topic FROM claims WHERE claim_id % 2 = 1")
def outbox_pending(spark, folder):
    return flows.outbox_messages(_outbox(spark, folder))


@query(f"{CLAIMED} SELECT count(*) AS rows, count(*) FILTER (claim_id % 2 = 0 OR claim_id % 3 = 0) AS sent FROM claims")
def outbox_mark_sent(spark, folder):
    rows = _outbox(spark, folder)
    done = flows.mark_sent(rows, rows.where("aggregate_id % 3 = 0").select("id"), "2026-01-01 00:00:00")
    return done.agg(F.count("*").alias("rows"), F.count("sent_at").alias("sent"))


# --- streaming


def _drained(spark, stream, mode="complete") -> DataFrame:
    return flows.drained(stream, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", mode)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, folder):
    found = _drained(spark, flows.windowed(flows.event_stream(spark, folder), "1 day"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("SELECT CAST(date_trunc('day', ts) - CAST(o AS INTEGER) * INTERVAL 1 DAY AS TIMESTAMP) AS window_start, event_type, count(*) AS events FROM events, (SELECT unnest(range(14)) AS o) r GROUP BY 1, 2")
def stream_sliding(spark, folder):
    found = _drained(spark, flows.windowed(flows.event_stream(spark, folder), "14 days", "1 day"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 DAY AS session_end, count(*) AS events FROM s GROUP BY user_id, n")
def stream_sessions(spark, folder):
    found = _drained(spark, flows.sessions(flows.event_stream(spark, folder)))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")


@query("SELECT DISTINCT user_id AS claim_id, event_type AS model_version FROM events")
def stream_dedup(spark, folder):
    rows = flows.event_stream(spark, folder).select(F.col("user_id").alias("claim_id"), F.col("event_type").alias("model_version"), "ts")
    found = _drained(spark, flows.deduplicated(rows, late="60 days").select("claim_id", "model_version"), "append")
    return found


@query("SELECT CAST(user_id AS VARCHAR) AS claim_id, event_type AS model_version, count(*) OVER (PARTITION BY user_id ORDER BY event_type) = 1 AS moved FROM (SELECT DISTINCT user_id, event_type FROM events) e")
def stream_apply_scores(spark, folder):
    """Scores folded into statuses with keyed state; a claim's first score moves it."""
    rows = flows.event_stream(spark, folder).select(F.col("user_id").cast("string").alias("claim_id"), F.col("event_type").alias("model_version"), F.lit("FLAG").alias("decision_hint"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    flows.apply_score_stream(rows, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("claim_id", "model_version", (F.col("from_status") != F.col("to_status")).alias("moved"))


@query(f"""WITH {oracle.CLAIMS},
e AS (SELECT CAST(claim_id AS VARCHAR) AS claim_id, claim_id % 3 = 0 AS asked, claim_id % 5 = 0 AS decided, claim_id % 7 = 0 AS known FROM claims)
SELECT claim_id,
  CASE WHEN known THEN 'DENIED' WHEN asked THEN 'UNDER_REVIEW' WHEN decided THEN 'APPROVED' ELSE 'FLAGGED' END AS status,
  CAST(CASE WHEN known THEN 1 WHEN asked THEN 2 WHEN decided THEN 2 ELSE 1 END AS BIGINT) AS events,
  CAST(CASE WHEN known THEN asked::INT + decided::INT WHEN asked THEN decided::INT ELSE 0 END AS BIGINT) AS refused, CAST(1 AS BIGINT) AS repeats
FROM e""")
def stream_claim_events(spark, folder):
    """Requests and scores of every claim in one stream over keyed state that starts from the claims table.

    An adjuster asks for review of some, then every claim is scored FLAG twice by one model, then an investigator approves some; some claims were denied before.
    """
    claims = cut(_claims(spark, folder).select(F.col("claim_id").alias("n"), F.col("claim_id").cast("string").alias("claim_id")))  # read four times
    at = lambda day: F.lit(f"2026-01-0{day} 10:00:00").cast("timestamp")
    asked = claims.where("n % 3 = 0").select("claim_id", at(1).alias("at"), F.lit("UNDER_REVIEW").alias("to_status"), F.lit("ADJUSTER").alias("role"), F.lit("a").alias("actor_id"))
    scored = claims.select("claim_id", F.explode(F.array(at(2), at(3))).alias("at"), F.lit("m1").alias("model_version"), F.lit("FLAG").alias("decision_hint"), F.lit(0.9).alias("fraud_score"))
    decided = claims.where("n % 5 = 0").select("claim_id", at(4).alias("at"), F.lit("APPROVED").alias("to_status"), F.lit("INVESTIGATOR").alias("role"), F.lit("i").alias("actor_id"), F.lit("seen").alias("reason"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    keyed.requests_as_events(asked).unionByName(keyed.scores_as_events(scored)).unionByName(keyed.requests_as_events(decided)).write.parquet(f"{path}/in")
    states = keyed.initial_states(claims.select("claim_id", F.when(F.col("n") % 7 == 0, "DENIED").otherwise("SUBMITTED").alias("status"), F.lit(0).alias("version")))
    stream = keyed.judged(spark.readStream.schema(keyed.EVENTS).parquet(f"{path}/in"), states)
    keyed.started(stream, f"{path}/out", f"{path}/state").awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    counted = lambda c: F.count_if(c).cast("long")
    last = F.max_by("to_status", F.when(F.col("outcome") == 200, F.col("seq")))
    return out.groupBy("claim_id").agg(last.alias("status"), counted(F.col("outcome") == 200).alias("events"), counted(F.col("outcome") >= 400).alias("refused"), counted(F.col("outcome") == 208).alias("repeats"))


@query(f"""WITH {oracle.CLAIMS}
SELECT CAST(claim_id AS VARCHAR) AS id, CAST(claim_id AS VARCHAR) AS key, '{{"claim_id":"' || claim_id || '"}}' AS value, 'claim.submitted' AS topic,
  CASE WHEN incident_date < DATE '{AS_OF}' THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS batch
FROM claims WHERE claim_id % 2 = 1""")
def outbox_published(spark, folder):
    """The outbox through a stream with offsets of its own, in two runs: each row is sent once, by the run that its time falls to."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = _outbox(spark, folder)
    for part in (rows.where(F.col("created_at") < AS_OF), rows.where(F.col("created_at") >= AS_OF)):
        outbox.store(part, f"{path}/store")
        outbox.published(spark, f"{path}/store", f"{path}/sink", f"{path}/state").awaitTermination()
    return outbox.sent(spark, f"{path}/sink").select("id", "key", "value", "topic", "batch")


# --- generator and model


@query()
def generated_claims(spark, folder):
    """Synthetic claims for the orders table, with rings planted for some of the customers."""
    return generate.of_tables(table(spark, folder, "orders"), table(spark, folder, "customer"))


@query("SELECT unnest(['repeated ids', 'rings of a wrong size', 'rings over more than 20 days', 'rings without a common phone', 'held-out rings too early', 'other rings too late', 'odd phones']) AS rule, CAST(0 AS BIGINT) AS broken")
def generated_invariants(spark, folder):
    """What holds of generated claims, whatever the seed, and how often it is broken."""
    p = generate.Plan()
    rows = cut(generate.of_tables(table(spark, folder, "orders"), table(spark, folder, "customer"), p))
    of_ring = rows.where("ring_id is not null")
    shared = of_ring.groupBy("ring_id", "claimant_phone").agg(F.count("*").alias("n")).groupBy("ring_id").agg(F.max("n").alias("common"), F.sum("n").alias("size"))
    days = of_ring.groupBy("ring_id").agg(F.date_diff(F.max("incident_date"), F.min("incident_date")).alias("days"), F.min("incident_date").alias("first"), F.max("incident_date").alias("last"), F.max("held_out").alias("late"))
    end = F.date_add(F.lit(p.start).cast("date"), p.val_end)
    broken = {
        "repeated ids": rows.agg((F.count("*") - F.count_distinct("claim_id")).alias("n")),
        "rings of a wrong size": shared.where((F.col("size") < p.least) | (F.col("size") > p.most)).agg(F.count("*").alias("n")),
        "rings over more than 20 days": days.where("days >= 20").agg(F.count("*").alias("n")),
        "rings without a common phone": shared.where("common < 2").agg(F.count("*").alias("n")),
        "held-out rings too early": days.where(F.col("late") & (F.col("first") <= end)).agg(F.count("*").alias("n")),
        "other rings too late": days.where(~F.col("late") & (F.col("last") > end)).agg(F.count("*").alias("n")),
        "odd phones": entities.bad_phones(rows).agg(F.count("*").alias("n")),
    }
    out = None
    for rule, found in broken.items():
        one = found.select(F.lit(rule).alias("rule"), F.col("n").cast("long").alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclasses.dataclass
class _Trained:
    """Point-in-time features, and the classifier made of them."""

    rows: DataFrame
    classifier: training.Classifier


#: Of this session's runs, by folder: training is the same for all queries that need it.
_TRAINED: dict[tuple[str, str], _Trained] = {}


def _dataset(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Point-in-time features with split and label, and the truth."""
    claims = _claims(spark, folder)
    truth = cut(claims.where("ring_id is not null").select("claim_id", "ring_id", "incident_date"))
    made = training.as_of_dataset(claims, TRAIN_END, VAL_END, None)
    return cut(training.split(training.labelled(made, truth), TRAIN_END, VAL_END)), truth


def _trained(spark, folder) -> _Trained:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TRAINED:
        rows, _ = _dataset(spark, folder)
        _TRAINED[key] = _Trained(rows, training.classifier(rows))
    return _TRAINED[key]


@query()
def as_of_features(spark, folder):
    """Features of every claim from the earliest of three graphs that has it."""
    return training.as_of_dataset(_claims(spark, folder), TRAIN_END, VAL_END, None)


def _earliest(day: str | None) -> str:
    return f"""(WITH {oracle.graph(day)}
      SELECT claim_id, CAST(min(degree) AS DOUBLE) AS entity_degree_min, round(avg(degree), 6) AS entity_degree_mean, CAST(max(degree) AS DOUBLE) AS entity_degree_max,
        round(sum(weight), 6) AS idf_weighted_degree, CAST(count(*) AS DOUBLE) AS one_hop_entity_count
      FROM edges GROUP BY claim_id)"""


@query(f"""WITH {oracle.CLAIMS},
parts AS (SELECT 1 AS n, * FROM {_earliest(TRAIN_END)} a UNION ALL SELECT 2, * FROM {_earliest(VAL_END)} b UNION ALL SELECT 3, * FROM {_earliest(None)} c),
first AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n) AS turn FROM parts)
SELECT c.claim_id, c.incident_date, CAST(c.claim_amount AS DOUBLE) AS claim_amount, entity_degree_min, entity_degree_mean, entity_degree_max, idf_weighted_degree, one_hop_entity_count
FROM first f JOIN claims c ON c.claim_id = f.claim_id WHERE turn = 1""")
def as_of_features_onehop(spark, folder):
    """What SQL can state of the point-in-time features: each claim's own entities in the earliest graph that has it."""
    found = training.as_of_dataset(_claims(spark, folder), TRAIN_END, VAL_END, made=features.own)
    plain = ("claim_id", "incident_date", "claim_amount", "entity_degree_min", "entity_degree_max", "one_hop_entity_count")
    return found.select(*plain, *[F.round(c, 6).alias(c) for c in ("entity_degree_mean", "idf_weighted_degree")])


@query(f"""WITH {oracle.CLAIMS}
SELECT 'test claims' AS rule, count(*) AS n FROM claims WHERE incident_date > DATE '{VAL_END}'
UNION ALL SELECT 'scores outside 0 to 1', 0 UNION ALL SELECT 'order that calibration reverses', 0
UNION ALL SELECT 'contributions', 5 * count(*) FROM claims WHERE incident_date > DATE '{VAL_END}'
UNION ALL SELECT 'contributions out of order', 0 UNION ALL SELECT 'average precision below that of the amount', 0""")
def model_checks(spark, folder):
    """What holds for scores and contributions whatever the model."""
    known = _trained(spark, folder)
    test = known.rows.where("split = 'test'")
    scored = cut(training.calibrated_scores(known.classifier.model, known.classifier.calibrator, test).select("claim_id", "raw", "score", "label", "claim_amount"))
    ladder = Window.orderBy("raw").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    steps = scored.groupBy("raw").agg(F.min("score").alias("least"), F.max("score").alias("most")).withColumn("before", F.max("most").over(ladder))
    pushed = cut(training.contributions(known.classifier.model, test))
    last = Window.partitionBy("claim_id").orderBy("rank")
    wrong = pushed.withColumn("before", F.lag(F.abs("shap_value")).over(last)).where(F.abs("shap_value") > F.col("before"))
    better = metrics.average_precision(scored).first()[0] >= metrics.average_precision(scored.select("claim_id", F.col("claim_amount").alias("score"), "label")).first()[0]
    found = {
        "test claims": scored.count(),
        "scores outside 0 to 1": scored.where("not (score between 0 and 1 and raw between 0 and 1)").count(),
        "order that calibration reverses": steps.where("least < before").count(),
        "contributions": pushed.count(),
        "contributions out of order": wrong.count(),
        "average precision below that of the amount": int(not better),
    }
    return spark.createDataFrame(list(found.items()), "rule string, n long")


@query()
def ablation_report(spark, folder):
    """Quality on the test period without the graph, with it, and calibrated."""
    dataset, truth = _dataset(spark, folder)
    late = truth.groupBy("ring_id").agg(F.min("incident_date").alias("d")).where(F.col("d") > F.lit(VAL_END).cast("date")).select("ring_id")
    found, _ = training.ablation(dataset, truth.select("claim_id", "ring_id"), late)
    rows = [(name, float(r["auprc"]), float(r["flag_threshold"]), float(r["review_threshold"]), *[int(r["confusion"][c]) for c in ("tp", "fp", "fn", "tn")], float(r["held_out"]["recall"])) for name, r in found.items()]
    return spark.createDataFrame(rows, "variant string, auprc double, flag_threshold double, review_threshold double, tp long, fp long, fn long, tn long, held_out_recall double")


@query()
def model_scores(spark, folder):
    """Calibrated scores of test claims from a model trained and calibrated on earlier ones."""
    known = _trained(spark, folder)
    found = training.calibrated_scores(known.classifier.model, known.classifier.calibrator, known.rows.where("split = 'test'"))
    return found.select("claim_id", "raw", "score", "label")


@query()
def model_contributions(spark, folder):
    """The five strongest feature contributions of every test claim."""
    known = _trained(spark, folder)
    return training.contributions(known.classifier.model, known.rows.where("split = 'test'"))


@query()
def model_claim_scores(spark, folder):
    """The score contract of every claim by the trained model."""
    found = scoring.scores_by_model(cut(_edges(spark, folder)), _trained(spark, folder).classifier, None)
    evidence = F.col("explanation.evidence")
    return found.select("claim_id", "fraud_score", "decision_hint", "ring_id", "rung", F.col("explanation.summary").alias("summary"), F.size(evidence).alias("evidence"))
