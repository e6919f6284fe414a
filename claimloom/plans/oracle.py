"""Shared parts of the SQL that checks the registered queries; DuckDB's dialect."""

from __future__ import annotations

from claimloom.functions.normalize import ABBREVIATIONS, ABROAD, COMPANY_SUFFIXES, HOME_PREFIX, PHONE
from claimloom.sources.claims import DERIVATION

CLAIMS = f"claims AS MATERIALIZED ({DERIVATION.format(lineitem='lineitem', orders='orders', customer='customer')})"


def phone(c: str) -> str:
    sign = f"CASE WHEN trim({c}) LIKE '+%' THEN '+' ELSE '' END"
    dialled = f"{sign} || regexp_replace({c}, '[^0-9]', '', 'g')"
    rest = rf"regexp_extract({dialled}, '^(?:\+|00)([0-9]+)$', 1)"
    abroad = rf"CASE WHEN regexp_matches({rest}, '{ABROAD}') THEN '+' || regexp_replace({rest}, '{HOME_PREFIX}', '\1') END"
    return f"coalesce(nullif('+91' || regexp_extract({dialled}, '{PHONE}', 1), '+91'), {abroad})"


def address(c: str) -> str:
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ABBREVIATIONS.items())
    words = rf"list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
    return f"array_to_string(list_sort(list_transform({words}, lambda w: CASE w {known} ELSE w END)), ' ')"


def shop(c: str) -> str:
    text = rf"regexp_replace(lower({c}), '[^a-z0-9\s&]', ' ', 'g')"
    for suffix in COMPANY_SUFFIXES:
        text = f"replace({text}, '{suffix}', ' ')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def masked(c: str) -> str:
    return f"CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) ELSE left({c}, 2) || repeat('*', length({c}) - 4) || right({c}, 2) END"


def graph(as_of: str | None = None) -> str:
    """CTEs norm, links, deg, edges, pruned."""
    where = f"WHERE incident_date <= DATE '{as_of}'" if as_of else ""
    return f"""{CLAIMS},
norm AS (SELECT *, {phone("claimant_phone")} AS phone, {address("claimant_address")} AS address, {shop("repair_shop_name")} AS shop FROM claims {where}),
links AS MATERIALIZED (
  SELECT claim_id, 'PHONE' AS entity_type, phone AS canonical_value, 'CLAIMANT_PHONE' AS role, claimant_phone AS raw_value FROM norm WHERE phone IS NOT NULL
  UNION ALL SELECT claim_id, 'ADDRESS', address, 'CLAIMANT_ADDRESS', claimant_address FROM norm
  UNION ALL SELECT claim_id, 'SHOP', shop, 'REPAIR_SHOP', repair_shop_name FROM norm WHERE shop IS NOT NULL AND trim(repair_shop_name) <> ''),
deg AS (SELECT entity_type, canonical_value, count(*) AS degree FROM links GROUP BY ALL),
edges AS MATERIALIZED (SELECT l.claim_id, l.entity_type, l.canonical_value, CAST(c.claim_amount AS DOUBLE) AS claim_amount, c.incident_date, d.degree, 1 / ln(1 + d.degree) AS weight
  FROM links l JOIN claims c ON c.claim_id = l.claim_id JOIN deg d ON d.entity_type = l.entity_type AND d.canonical_value = l.canonical_value),
pruned AS MATERIALIZED (SELECT * FROM edges WHERE degree <= CASE entity_type WHEN 'ADDRESS' THEN 1 ELSE 50 END)"""


RINGS = """multi AS MATERIALIZED (SELECT claim_id, entity_type, canonical_value FROM pruned WHERE degree > 1),
reach(claim_id, root) AS (SELECT DISTINCT claim_id, claim_id FROM multi
  UNION SELECT b.claim_id, r.root FROM reach r JOIN multi a ON a.claim_id = r.claim_id JOIN multi b ON b.entity_type = a.entity_type AND b.canonical_value = a.canonical_value),
comp AS (SELECT claim_id, min(root) AS component FROM reach GROUP BY 1),
rings AS MATERIALIZED (SELECT claim_id, 'kcore-' || component AS ring_id, ring_size FROM (SELECT *, count(*) OVER (PARTITION BY component) AS ring_size FROM comp) x WHERE ring_size >= 3)"""


def pagerank(rounds: int = 170, damping: float = 0.85) -> str:
    """CTEs from rings (the seeds) to near(claim_id, score): plain power iteration until what is left is under 1e-11.

    The vertex * restarts: it keeps its rank and gives the seeds their share.
    """
    return f"""both_ways AS (SELECT 'c' || claim_id AS v, 'e:' || entity_type || ':' || canonical_value AS o, weight FROM edges
  UNION ALL SELECT 'e:' || entity_type || ':' || canonical_value, 'c' || claim_id, weight FROM edges),
mass AS (SELECT v, sum(weight) AS k FROM both_ways GROUP BY 1),
vertex AS MATERIALIZED (SELECT v, row_number() OVER () AS i FROM mass),
start AS MATERIALIZED (SELECT x.i, 1.0 / (SELECT count(*) FROM rings) AS r FROM rings JOIN vertex x ON x.v = 'c' || claim_id),
steps AS MATERIALIZED (SELECT x.i AS v, y.i AS o, b.weight / m.k * {damping} AS p FROM both_ways b JOIN mass m ON m.v = b.v JOIN vertex x ON x.v = b.v JOIN vertex y ON y.v = b.o
  UNION ALL SELECT 0, i, r * {1 - damping!r} FROM start UNION ALL SELECT 0, 0, 1.0),
ranks(turn, v, r) AS (SELECT 0, i, CAST(r AS DOUBLE) FROM start UNION ALL SELECT 0, 0, CAST(1 AS DOUBLE)
  UNION ALL SELECT k.turn + 1, s.o, sum(s.p * k.r) FROM ranks k JOIN steps s ON s.v = k.v WHERE k.turn < {rounds} GROUP BY 1, 2),
last AS MATERIALIZED (SELECT x.v, k.r FROM ranks k JOIN vertex x ON x.i = k.v WHERE k.turn = {rounds}),
near AS MATERIALIZED (SELECT c.claim_id, coalesce(k.r, 0) / (SELECT max(r) FROM last) AS score FROM (SELECT DISTINCT claim_id FROM edges) c LEFT JOIN last k ON k.v = 'c' || c.claim_id
  WHERE c.claim_id NOT IN (SELECT claim_id FROM rings))"""


VERDICTS = """verdicts AS MATERIALIZED (SELECT c.claim_id,
    CASE WHEN g.claim_id IS NOT NULL THEN 0.9 WHEN n.score > 0.05 THEN round(n.score, 4) ELSE 0.0 END AS fraud_score,
    CASE WHEN g.claim_id IS NOT NULL THEN 'k_core' WHEN n.score > 0.05 THEN 'ppr' ELSE 'none' END AS rung, g.ring_id, g.ring_size
  FROM (SELECT DISTINCT claim_id FROM edges) c LEFT JOIN rings g ON g.claim_id = c.claim_id LEFT JOIN near n ON n.claim_id = c.claim_id)"""

#: Distance from the mean amount as a score, the truth as the label.
SCORED = f"""{CLAIMS},
stats AS (SELECT avg(CAST(claim_amount AS DOUBLE)) AS m, stddev_pop(CAST(claim_amount AS DOUBLE)) AS s FROM claims),
scored AS MATERIALIZED (SELECT claim_id, incident_date, round(least(abs(CAST(claim_amount AS DOUBLE) - m) / s / 4, 1.0), 6) AS score, CASE WHEN ring_id IS NULL THEN 0 ELSE 1 END AS label FROM claims, stats)"""

GRID = """grid AS (SELECT CAST(range AS DOUBLE) / 100 AS t FROM range(1, 100)),
counted AS (SELECT t, sum(CASE WHEN score >= t AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= t AND label = 0 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN score < t AND label = 1 THEN 1 ELSE 0 END) AS fn FROM grid, scored GROUP BY t)"""
