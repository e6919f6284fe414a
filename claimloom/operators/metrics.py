"""Evaluation of scores and of detected rings, without collecting scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.ranges import running_sums
from claimloom.plans.durable import cut

KS = (50, 100, 500)


def grid(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(t, tp, fp, fn, tn) for thresholds 0.01 to 0.99.

    Each score counts once, under the last threshold it reaches; running sums
    over the 100 counts do the rest, so scores meet no threshold twice.
    """
    step = F.least(F.greatest(F.floor(F.round(F.col(score) * 100, 9)), F.lit(0)), F.lit(99))
    counts = scored.groupBy(step.cast("int").alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    every = scored.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("s")).join(counts, "s", "left").na.fill(0)
    up = Window.partitionBy(F.lit(0)).orderBy(F.desc("s"))
    whole = Window.partitionBy(F.lit(0))
    sums = every.select("s", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    return sums.where("s >= 1").select((F.col("s") / 100).alias("t"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The first grid threshold of highest F1."""
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return grid(scored).agg(F.max(F.struct(F.round(f1, 12).alias("f1"), (-F.col("t")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def review_threshold(scored: DataFrame, recall: float = 0.95) -> DataFrame:
    """The highest grid threshold with that recall, or 0.01."""
    enough = (F.col("tp") >= recall * (F.col("tp") + F.col("fn"))) & (F.col("tp") + F.col("fn") > 0)
    return grid(scored).agg(F.coalesce(F.max(F.when(enough, F.col("t"))), F.lit(0.01)).alias("threshold"))


def confusion(scored: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    return scored.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Step-wise area under precision and recall; equal scores enter together.

    Labels are counted by distinct score first; the running sum works on ranges
    of scores, whose totals are summed ahead, so no task sorts all of them.
    """
    ties = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    steps = running_sums(ties, "s", {"tp": "pos", "k": "n"}, descending=True)
    area = F.sum(F.col("pos") * F.col("tp") / F.col("k"))
    return steps.agg(F.coalesce(area / F.nullif(F.sum("pos"), F.lit(0)), F.lit(0.0)).alias("average_precision"))


def at_k(scored: DataFrame, ks=KS, score: str = "score", label: str = "label", key: str = "claim_id") -> DataFrame:
    """(k, hits, precision, recall) among the k highest scores, ties by key; k no larger than the table.

    Labels are summed by distinct score first; a k that ends among claims of
    one score takes the first of that score by key, and only claims of these
    scores, one for each k, are ranked.
    """
    ties = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    steps = cut(running_sums(ties, "s", {"tp": "pos", "upto": "n"}, descending=True))
    whole = steps.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all"))
    wanted = scored.sparkSession.createDataFrame([(k,) for k in sorted(set(ks))], "k long")
    # of the score at which k ends: what comes before it, and how many of its claims still count
    ends = steps.join(F.broadcast(wanted), (F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto")))
    ends = ends.select("k", "s", (F.col("tp") - F.col("pos")).alias("hits0"), (F.col("k") - F.col("upto") + F.col("n")).alias("take"))
    tied = scored.select(F.col(score).alias("s"), F.col(key).alias("key"), F.col(label).cast("long").alias("y")).join(F.broadcast(ends.select("s").distinct()), "s")
    placed = tied.groupBy("s", "key").agg(F.sum("y").alias("y"), F.count("*").alias("m"))
    order = F.struct("s", "key").alias("o")
    placed = running_sums(placed.select(order, "y", "m"), "o", {"y_upto": "y", "m_upto": "m"})
    first = placed.groupBy("o.s").agg(F.min(F.struct("o", (F.col("y_upto") - F.col("y")).alias("y0"), (F.col("m_upto") - F.col("m")).alias("m0"))).alias("f"))
    placed = placed.select("o.s", "y_upto", "m_upto", "y", "m").join(F.broadcast(first.select("s", "f.y0", "f.m0")), "s")
    # rows of one key and score beyond `take` count in part, hits first
    more = placed.join(F.broadcast(ends), "s").where(F.col("m_upto") - F.col("m") - F.col("m0") < F.col("take"))
    part = F.least(F.col("y"), F.col("take") - (F.col("m_upto") - F.col("m") - F.col("m0")))
    counted = more.groupBy("k", "hits0").agg(F.sum(F.when(F.col("m_upto") - F.col("m0") <= F.col("take"), F.col("y")).otherwise(part)).alias("y"))
    inside = counted.select("k", (F.col("hits0") + F.col("y")).alias("hits"))
    found = wanted.join(inside, "k", "left").join(F.broadcast(whole)).where("all > 0")
    hits, taken = F.coalesce("hits", "all_pos"), F.least("k", "all")
    return found.select("k", hits.alias("hits"), (hits / taken).alias("precision"), F.coalesce(hits / F.nullif("all_pos", F.lit(0)), F.lit(0.0)).alias("recall"))


def lift(scored: DataFrame, score: str = "score", label: str = "label", key: str = "claim_id") -> DataFrame:
    """(k, precision, lift over the base rate) at 50, 100, 1 % and 5 %."""
    n = scored.count()
    base = scored.agg((F.sum(F.col(label).cast("long")) / F.count("*")).alias("base"))
    found = at_k(scored, sorted({50, 100, int(n * 0.01), int(n * 0.05)} - {0}), score, label, key)
    return found.join(F.broadcast(base)).select("k", "precision", (F.col("precision") / F.col("base")).alias("lift"))


def ring_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(ring_id, members, detected, votes, recovered): the detected ring most members share, smallest id at a tie.

    recovered: it holds at least half of all members, undetected ones included.
    """
    voted = truth.select("claim_id", F.col("ring_id").alias("true_ring")).join(found.select("claim_id", F.col("ring_id").alias("detected")), "claim_id", "left")
    size = voted.groupBy("true_ring").agg(F.count("*").alias("members"))
    votes = voted.where("detected is not null").groupBy("true_ring", "detected").agg(F.count("*").alias("votes"))
    most = votes.groupBy("true_ring").agg(F.min(F.struct((-F.col("votes")).alias("v"), "detected")).alias("b"))
    joined = size.join(most, "true_ring", "left").select(F.col("true_ring").alias("ring_id"), "members", F.col("b.detected").alias("detected"), F.coalesce(-F.col("b.v"), F.lit(0)).alias("votes"))
    return joined.withColumn("recovered", 2 * F.col("votes") >= F.col("members"))


def amount_zscore(claims: DataFrame) -> DataFrame:
    """(claim_id, score): distance of the amount from the mean, in population standard deviations (1 if there are none)."""
    stats = claims.agg(F.avg(F.col("claim_amount").cast("double")).alias("mean"), F.stddev_pop(F.col("claim_amount").cast("double")).alias("sd"))
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return claims.join(F.broadcast(stats)).select("claim_id", (F.abs(F.col("claim_amount").cast("double") - F.col("mean")) / sd).alias("score"))


def flagged_precision(found: DataFrame, truth: DataFrame, at: float = 0.75) -> DataFrame:
    """(flagged, precision) of claims scored at the flag threshold or above."""
    hit = found.where(F.col("fraud_score") >= at).join(truth.select("claim_id", F.lit(1).alias("y")), "claim_id", "left")
    return hit.agg(F.count("*").alias("flagged"), F.coalesce(F.avg(F.coalesce("y", F.lit(0))), F.lit(0.0)).alias("precision"))


def base_rate(claims: DataFrame, truth: DataFrame) -> DataFrame:
    total = claims.agg(F.count("*").alias("claims"))
    return total.join(F.broadcast(truth.agg(F.count("*").alias("positives")))).select("claims", "positives", (F.col("positives") / F.col("claims")).alias("base_rate"))


def order_statistics(values: DataFrame, column: str) -> DataFrame:
    """(n, mean, median, p95): the values at ranks n // 2 and min(int(0.95 n), n - 1), from 0, as stored values.

    Values are counted first, so ranks run over distinct values, range by range.
    """
    counts = cut(values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c")))
    total = counts.agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    last = running_sums(counts, "v", {"upto": "c"}).join(F.broadcast(total))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    late = F.least(F.floor(0.95 * F.col("n")), F.col("n") - 1)
    return last.agg(F.first("n").alias("n"), F.first("mean").alias("mean"), at(F.floor(F.col("n") / 2)).alias("median"), at(late).alias("p95"))
