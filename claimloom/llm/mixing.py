"""Mixing sources to target weights along a time-varying curriculum.

Sources share the corpus's words by weight; no source is repeated more than
`MAX_REPEATS` times, and what it cannot use goes to the others by weight. Each
source's documents form a stream in the order of a content hash, repeated
until the source's demand is met. A source's schedule says how its weight
varies over training time; its integral is the cumulative demand, and
inverting it turns an offset in the stream into a training position. A
document has one for each of its copies, and copies are range-sorted by them.

Stream offsets are prefix sums. The hash's first digits deal each source into
`4096` buckets, so that a source with a third of all rows is still summed in
parallel: bucket totals are pre-aggregated, a window over at most 4096 rows a
source gives bucket offsets, and a window inside the bucket does the rest.
Only ids, sizes and hashes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.operators.ranges import ranked, running_sums
from claimloom.plans.durable import cut
from claimloom.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
#: Weights that sources take in turn, in the order of their names.
WEIGHTS = (1, 2, 3)
#: For each of `WEIGHTS`: knots (time, weight) of a piecewise linear schedule over training time 0 to 1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def _stream(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("skey"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)).alias("key"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Adds turn (place among `weights`), weight and target to (skey, source, source_size), a row a source.

    The targets are least(most x size, level x weight) for the level at which
    they sum to all sizes: what resharing excess by weight converges to.
    Sources are ordered by code point, null last. Ranks and running sums go
    range by range, so there may be as many sources as web hosts.
    """
    by_name = F.struct(F.col("source").isNull().alias("last"), "source")
    named = ranked(sizes.withColumn("name", by_name), "name", "rank")
    turn = ((F.col("rank") - 1) % len(weights)).cast("int")
    named = named.select("skey", "source", "source_size", turn.alias("turn"), F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight"))
    named = named.withColumn("full", F.struct((most * F.col("source_size") / F.col("weight")).alias("at"), "skey"))
    summed = cut(running_sums(named, "full", {"upto": "source_size", "weighed": "weight"}))
    whole = summed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all"))
    filled, open_ = F.col("upto") - F.col("source_size"), F.col("all") - F.col("weighed") + F.col("weight")
    levels = summed.join(F.broadcast(whole)).withColumn("level", (F.col("total") - most * filled) / open_)
    first = levels.where(F.col("full.at") >= F.col("level")).agg(F.min(F.struct("full", "level"))["level"].alias("level"))
    target = F.least(F.coalesce("level", F.lit(0.0)) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return summed.join(F.broadcast(first)).withColumn("target", target).select("skey", "source", "source_size", "turn", "weight", "target")


def invert_demand(share: Column, knots) -> Column:
    """The time by which a schedule's integral reaches `share` of its whole."""
    pieces = list(zip(knots, knots[1:], strict=False))
    areas = [(t1 - t0) * (g0 + g1) / 2 for (t0, g0), (t1, g1) in pieces]
    whole, out = share * sum(areas), None
    for i in reversed(range(len(pieces))):
        (t0, g0), (t1, g1) = pieces[i]
        need, slope = whole - F.lit(sum(areas[:i])), (g1 - g0) / (t1 - t0)
        # the root of slope / 2 x^2 + g0 x = need, in the form that stays stable as the slope vanishes
        x = 2 * need / (g0 + F.sqrt(F.greatest(F.lit(g0 * g0) + 2 * slope * need, F.lit(0.0))))
        here = F.lit(t0) + F.greatest(x, F.lit(0.0))
        out = here if out is None else F.when(whole < sum(areas[: i + 1]), here).otherwise(out)
    return F.least(out, F.lit(1.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, most: int = MAX_REPEATS) -> DataFrame:
    """One row for each row of `docs`: doc_id, key, size, source_size, target, taken, copies, position, positions.

    taken: words the mix takes of it, repeats counted; a source's sum is its
    target rounded to a whole word (only the document at the end of the demand
    is cut short). positions: training times of its copies, ascending; copy c
    lies c times the source's size behind the first in the stream. position:
    that of the first copy. Both are null if it is not taken. key: hash of id
    and text, the stream's order.

    Null text: size 0, nothing taken. Null source: a source of its own, last.
    Null id: hashed as an empty id. Repeated rows have neighbouring places in
    the stream. A source without words has target 0. Empty table: empty
    result. Very long texts count whole. Other columns are not read.
    """
    rows = cut(_stream(docs, id_col, text_col, source_col))
    sources = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources, weights, most))
    bucket = F.substring("key", 1, 3).alias("bucket")
    totals = rows.groupBy("skey", bucket).agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("skey", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("bucket", bucket).withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, ["skey", "bucket"]).join(targets.drop("source"), "skey")
    placed = placed.withColumn("at", F.col("offset") + F.col("inner")).withColumn("demand", F.least(F.round("target").cast("long"), most * F.col("source_size")))
    demand = placed.withColumn("full", F.expr("if(source_size = 0, 0, demand div source_size)")).withColumn("rest", F.expr("if(source_size = 0, 0, demand % source_size)"))
    more = F.least(F.greatest(F.col("rest") - F.col("at"), F.lit(0)), F.col("size"))
    taken = F.col("full") * F.col("size") + more

    def placed_at(copy: int) -> Column:
        share = (F.col("at") + copy * F.col("source_size")) / F.greatest(F.col("demand"), F.lit(1))
        position = None
        for i, knots in enumerate(schedules):
            here = invert_demand(share, knots)
            position = here if position is None else F.when(F.col("turn") == i, here).otherwise(position)
        return position

    out = demand.withColumn("taken", taken).withColumn("copies", (F.col("full") + (more > 0).cast("long")))
    times = F.array_compact(F.array(*[F.when(F.col("copies") > c, placed_at(c)) for c in range(most)]))
    out = out.withColumn("positions", F.when(F.col("taken") > 0, times)).withColumn("position", F.get("positions", 0))
    return out.select("doc_id", "key", "size", "source_size", "target", "taken", "copies", "position", "positions")


def _planned(docs: DataFrame, new: tuple[str, ...]) -> tuple[list[str], DataFrame]:
    """The columns of `docs` that have no name of `new`, and the rows that the mix takes: these columns, then a struct __mix of the mix's own."""
    own = ("size", "source_size", "target", "taken", "copies", "position", "positions")
    plain = [c for c in docs.columns if c.lower() not in new]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*plain, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)).alias("__mix_key"))
    found = cut(mix(docs).where("taken > 0"))
    plan = found.groupBy(F.col("key").alias("__mix_of")).agg(F.max(F.struct(*own)).alias("__mix"))
    return plain, keyed.join(plan, F.col("__mix_key") == F.col("__mix_of")).select(*plain, "__mix")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, taken, copies, position and positions, sorted by position.

    Columns of `docs` with these names are replaced. Rows with equal id and
    text share a place and all stay. Null and wordless texts have no word to
    take and go; an empty table stays empty.
    """
    new = ("size", "source_size", "target", "taken", "copies", "position", "positions")
    plain, joined = _planned(docs, new)
    return joined.select(*plain, *[F.col("__mix")[c].alias(c) for c in new]).sort("position", "doc_id")


def mixed_copies(docs: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, in training order, with size, source_size, target, taken, copies, copy and position.

    copy: 0 for the first. taken and position are those of the copy. Columns
    of `docs` with these names are replaced. Rows with equal id and text share
    their places and all stay. Null and wordless texts have no word to take
    and go; an empty table stays empty.
    """
    new = ("size", "source_size", "target", "taken", "copies", "copy", "position")
    plain, joined = _planned(docs, new)
    dealt = joined.select(*plain, "__mix", F.posexplode("__mix.positions").alias("__mix_copy", "__mix_position"))
    size = F.col("__mix.size")
    values = {"taken": F.least(size, F.col("__mix.taken") - F.col("__mix_copy") * size), "copy": F.col("__mix_copy"), "position": F.col("__mix_position")}
    return dealt.select(*plain, *[values.get(c, F.col("__mix")[c]).alias(c) for c in new]).sort("position", "doc_id", "copy")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes, in training order; documents it leaves out come last."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position").sort(F.col("position").asc_nulls_last(), "doc_id")


def op7_mixing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in training order."""
    found = mix(table(spark, sf_dir, "documents")).where("taken > 0")
    dealt = found.select("doc_id", "size", "source_size", "target", "taken", F.posexplode("positions").alias("copy", "position"))
    return dealt.withColumn("taken", F.least("size", F.expr("taken - copy * size"))).sort("position", "doc_id", "copy")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
sources AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY skey),
named AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sources),
weighed AS (SELECT *, CAST(turn + 1 AS DOUBLE) AS weight, 3 * source_size / CAST(turn + 1 AS DOUBLE) AS full_at FROM named),
ranked AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY full_at, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY full_at, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total
  FROM weighed),
leveled AS (SELECT *, CAST(total - 3 * filled AS DOUBLE) / open AS level FROM ranked),
one AS (SELECT level FROM leveled WHERE full_at >= level ORDER BY full_at, skey LIMIT 1),
targets AS (SELECT skey, source_size, turn, least(coalesce((SELECT level FROM one), 0.0) * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM leveled),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, t.turn, least(CAST(round(t.target) AS BIGINT), 3 * t.source_size) AS demand,
         CAST(coalesce(sum(r.size) OVER (PARTITION BY r.skey ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM rows r JOIN targets t ON t.skey = r.skey),
taken AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE (demand // source_size) * size + least(greatest(demand % source_size - ahead, 0), size) END AS taken,
         ahead / CAST(greatest(demand, 1) AS DOUBLE) AS x
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN least(1.0, greatest(0.0, CASE
    WHEN turn = 0 THEN x
    WHEN turn = 1 THEN 2 * x / (0.5 + sqrt(0.25 + 2 * x))
    WHEN x < 0.625 THEN 2 * x / (1.5 + sqrt(greatest(2.25 - 2 * x, 0.0)))
    ELSE 0.5 + 2 * (x - 0.625) / (1.0 + sqrt(greatest(1.0 - 2 * (x - 0.625), 0.0))) END)) END AS position
FROM taken
"""
