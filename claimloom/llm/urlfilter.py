"""URL filters by pattern rules indexed by their rarest literal token.

A rule is a regular expression with literal tokens (runs of a-z and 0-9) that
every URL it matches contains whole. Token frequencies in the URLs choose each
rule's rarest token, and a hash table from tokens to rules is folded into the
plan as a literal. For a URL only the rules that its own tokens fetch run
their regular expressions. Everything is DataFrame expressions in one
projection: no shuffle, no exploded rows, no Python, and a host with a third
of all rows is spread like any other.

The table has a checked size: up to `RULES_AT_ONCE` rules are one literal, and
more rules take more such projections, of which the best match is kept.
"""

from __future__ import annotations

import dataclasses
import json
import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.tables import table

RULES_AT_ONCE = 20_000
#: Characters of rules' tokens up to which these travel to the tasks.
BROADCAST_CHARS = 8_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTRY = "struct<token:string,tier:int,length:int,name:string,verdict:string,regex:string>"


@dataclasses.dataclass(frozen=True)
class Rule:
    """name: as reported; verdict: allow or block; regex: looked for in host + path + rest; tokens: literal, lower case; tier: higher ones win."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    tier: int = 0

    @property
    def length(self) -> int:
        return len(self.name)


def host_rule(verdict: str, host: str, path: str, tier: int = 1) -> Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""
    ends = re.match(r".*[^A-Za-z0-9]", path, re.DOTALL)  # what follows it may go on in the URL
    tokens = re.findall("[a-z0-9]+", (host + (ends[0] if ends else "")).lower())
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{_plain(host)}{_plain(path) or '(?=[/?#]|$)'}", tuple(tokens), tier)


def wildcard_rule(verdict: str, pattern: str, tier: int = 0) -> Rule:
    """`*` stands for any characters, `^` for a separator or an end; all else for itself, a-z in either case."""
    regex = "".join({"*": ".*", "^": r"(?:^|$|[^A-Za-z0-9])"}.get(c, _plain(c)) for c in pattern)
    found = re.finditer("[a-z0-9]+", pattern.lower())
    whole = [m[0] for m in found if m.start() and m.end() < len(pattern) and "*" not in (pattern[m.start() - 1], pattern[m.end()])]
    return Rule(pattern, verdict, f"(?is){regex}", tuple(whole), tier)


def _plain(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


#: The rules of the production query: hosts with paths, then patterns for what those leave open.
RULES = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
    *(wildcard_rule("block", p) for p in ("^cheap-pills^", "^spam-farm^", "^casino^", "^adult^", "^torrent^", "^adserver^", "^ads^", "^login^", "^logout^", "^phpsessid=", "^doubleclick.net/", "^wp-login.php^", "^cart/*checkout^")),
)


def lowered(c: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(c, _UPPER, _LOWER)


def with_parts(df: DataFrame, url_col: str, host: str, path: str, rest: str) -> DataFrame:
    """Adds host, path and what follows the path; all empty where the URL is null or has no `://`."""
    at = F.locate("://", F.col(url_col))
    after = F.when(at > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    df = df.withColumn(rest, F.coalesce(after, F.lit("")))
    df = df.withColumn(host, F.regexp_extract(rest, "^[^/?#]*", 0))
    df = df.withColumn(rest, F.expr(f"substring(`{rest}`, length(`{host}`) + 1)"))
    df = df.withColumn(path, F.regexp_extract(rest, "^[^?#]*", 0))
    return df.withColumn(rest, F.expr(f"substring(`{rest}`, length(`{path}`) + 1)")).withColumn(host, lowered(F.col(host)))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(lowered(text), "[^a-z0-9]+"))


def token_counts(texts: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many rows of `texts` (one string column) hold each literal token of `rules`; as many entries as the rules have tokens.

    A token finds its rules' tokens by a hash join, so what a URL costs doesn't
    depend on how many rules there are.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    listed = texts.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(wanted)), "array<string>")).alias("t"))
    if sum(map(len, wanted)) <= BROADCAST_CHARS:
        listed = F.broadcast(listed)
    hits = texts.select(F.explode(_tokens(F.col(texts.columns[0]))).alias("t")).join(listed, "t")
    return {r.t: r.n for r in hits.groupBy("t").agg(F.count("*").alias("n")).collect()}


def _table(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int, list[dict]]:
    """Buckets of entries under their rarest tokens; the rules that have no token apart."""
    buckets = 1 << max(4, (2 * len(rules)).bit_length())
    held: list[list[dict]] = [[] for _ in range(buckets)]
    apart = []
    for r in rules:
        entry = {"tier": r.tier, "length": r.length, "name": r.name, "verdict": r.verdict, "regex": r.regex}
        if r.tokens:
            token = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            h = xxhash.xxh64_intdigest(token.encode(), 42)
            held[h % buckets].append(entry | {"token": token})
        else:
            apart.append(entry | {"token": ""})
    return F.from_json(F.lit(json.dumps(held)), f"array<array<{_ENTRY}>>"), buckets, apart


def _fetched(tokens: Column, held: Column, buckets: int) -> Column:
    """The entries of all `tokens`."""

    def of(token):
        bucket = F.element_at(held, (F.pmod(F.xxhash64(token), F.lit(buckets)) + 1).cast("int"))
        return F.filter(bucket, lambda entry: entry["token"] == token)

    return F.flatten(F.transform(tokens, of))


def judge(df: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (all by default), then host, path, rule, pattern, verdict.

    rule: the name of the longest fitting rule of a tier above 0, else null;
    pattern: that of the longest fitting tier-0 rule if there is no such rule;
    verdict: the found rule's, else allow. Ties of length go to the name that
    sorts last. Null, empty and other URLs without `://`: host and path are
    empty and nothing fits. Rows repeat as they do in `df`; an empty table
    stays empty; URLs of any length are read whole. Columns of `df` that are
    named like a new one are replaced.
    """
    new = ("host", "path", "rule", "pattern", "verdict")
    keep = [c for c in (keep or df.columns) if c.lower() not in new]
    rows = df.select(F.col(url_col).alias("__url"), *keep)
    rows = with_parts(rows, "__url", "__host", "__path", "__rest")
    rows = rows.withColumn("__text", F.concat("__host", "__path", "__rest")).drop("__url", "__rest")
    counts = token_counts(rows.select("__text"), rules)
    rows = rows.withColumn("__tokens", _tokens(F.col("__text")))
    best = None
    for at in range(0, max(1, len(rules)), RULES_AT_ONCE):
        table_, buckets, apart = _table(list(rules[at : at + RULES_AT_ONCE]), counts)
        candidates = _fetched(F.col("__tokens"), table_, buckets)
        if apart:
            candidates = F.concat(candidates, F.from_json(F.lit(json.dumps(apart)), f"array<{_ENTRY}>"))
        fitting = F.filter(candidates, lambda r: F.regexp_like(F.col("__text"), r["regex"]))
        found = F.array_max(F.transform(fitting, lambda r: F.struct(r["tier"].alias("tier"), r["length"].alias("length"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
        best = found if best is None else F.array_max(F.array(best, found))
    rows = rows.withColumn("__best", best)
    return rows.select(
        *keep,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.when(F.col("__best.tier") > 0, F.col("__best.name")).alias("rule"),
        F.when(F.col("__best.tier") == 0, F.col("__best.name")).alias("pattern"),
        F.coalesce("__best.verdict", F.lit("allow")).alias("verdict"),
    )


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"), keep=["page_id"])


def _oracle() -> str:
    named = [r for r in sorted(RULES, key=lambda r: (-r.length, r.name)) if r.tier]
    patterns = [r for r in sorted(RULES, key=lambda r: (r.length, r.name), reverse=True) if not r.tier]

    def fits(r: Rule) -> str:
        host, slash, path = r.name.partition("/")
        return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{path}')"

    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in named)
    verdict = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in named)
    pattern = " ".join(f"WHEN regexp_matches(host || path || rest, '{r.regex}') THEN '{r.name}'" for r in patterns)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
b AS (SELECT page_id, regexp_extract(after, '^[^/?#]*') AS h, substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1) AS tail FROM a),
c AS (SELECT page_id, translate(h, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(tail, '^[^?#]*') AS path,
             substr(tail, length(regexp_extract(tail, '^[^?#]*')) + 1) AS rest FROM b),
d AS (SELECT *, CASE {rule} END AS rule FROM c),
e AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {pattern} END END AS pattern FROM d)
SELECT page_id, host, path, rule, pattern, CASE {verdict} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM e
"""


ORACLE = _oracle()
