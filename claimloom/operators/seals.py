"""Seals over the audit log: a Merkle tree over the ends of all chains, one node table a batch of events.

A claim's place in the tree is the digest of its id, so places are even
whatever the ids; inner nodes have sixteen children. A batch's node table has
its own events, the new ends of their chains and the nodes above these, and
nothing else: it is made from the batch, and from the brothers of what
changed. The newest version of every node, over all tables, is the tree. Its
root stands for every event so far, as a chain's end stands for its chain.

Whether a log that is at hand is the one that was sealed shows from the node
tables alone, no older copy of the log is needed: the trees are compared from
the root down, only where they differ, and in the claims so found the events'
digests say which were changed or lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import audit
from claimloom.plans.durable import cut, drop

#: Levels below the root: 16^4 buckets hold 100 claims each at 6.5 million claims. A tree keeps its depth.
DEPTH = 4
CLAIM, EVENT = -1, -2
_COLUMNS = ["level", "path", "claim_id", "seq", "digest"]


def depth_for(claims: int, bucket: int = 100) -> int:
    """Levels at which a bucket has about `bucket` claims or fewer."""
    depth = 1
    while claims > bucket * 16**depth:
        depth += 1
    return depth


def _path(claim: Column, depth: int) -> Column:
    return F.substring(F.sha2(claim.cast("string"), 256), 1, depth)


def _rows(of: DataFrame, level: int, path: Column, digest: str) -> DataFrame:
    """Rows of a node table for claims or events."""
    return of.select(F.lit(level).alias("level"), path.alias("path"), "claim_id", F.col("seq").cast("int").alias("seq"), F.col(digest).alias("digest"))


def _digest(of: DataFrame, by: Column, name: Column) -> DataFrame:
    """(path, digest): a node's digest is that of its children's `name:digest`, by name, comma-joined.

    A group is a bucket or the sixteen children of a node.
    """
    parts = F.array_sort(F.collect_list(F.struct(name.alias("n"), "digest")))
    text = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["n"], p["digest"])), ",")
    return of.groupBy(by.alias("path")).agg(F.sha2(text, 256).alias("digest"))


def _node_rows(of: DataFrame, level: int, like: DataFrame) -> DataFrame:
    kind = like.schema["claim_id"].dataType
    return of.select(F.lit(level).alias("level"), "path", F.lit(None).cast(kind).alias("claim_id"), F.lit(None).cast("int").alias("seq"), "digest")


def latest(nodes: DataFrame, level: int) -> DataFrame:
    """The newest version of each node of a level."""
    of = nodes.where(F.col("level") == level)
    key = ["path", "claim_id"] if level == CLAIM else ["path"]
    rest = [c for c in _COLUMNS if c not in key]
    return of.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("n")).select(*key, "n.*").select(*_COLUMNS)


def _raised(ends: DataFrame, former: DataFrame | None, depth: int) -> list[DataFrame]:
    """The ends' rows and those of all nodes above, from the lowest level up."""
    made, changed = [ends], ends
    for level in range(depth, -1, -1):
        lower = CLAIM if level == depth else level + 1
        up = F.col("path") if lower == CLAIM else F.substring("path", 1, level)
        whole = changed
        if former is not None:
            old = latest(former, lower).withColumn("__up", up)
            touched = changed.select(up.alias("__up")).distinct()
            own = ["path", "claim_id"] if lower == CLAIM else ["path"]
            brothers = old.join(touched, "__up", "left_semi").join(changed.select(*own), own, "left_anti").select(*_COLUMNS)
            whole = changed.unionByName(brothers)
        name = F.concat_ws(":", F.col("claim_id").cast("string"), F.col("seq").cast("string")) if lower == CLAIM else F.col("path")
        changed = cut(_node_rows(_digest(whole, up, name), level, ends))
        made.append(changed)
    return made


def seal(events: DataFrame, former: DataFrame | None = None, batch: int = 0, depth: int = DEPTH) -> DataFrame:
    """The node table (batch, level, path, claim_id, seq, digest) of a batch of chained events, after the tables `former`.

    Reads the batch, and of `former` the brothers of what changed. An empty
    batch gives an empty table: the root stays. Check `misplaced` first.
    """
    own = cut(_rows(events, EVENT, _path(F.col("claim_id"), depth), "hash"))
    ends = own.groupBy("path", "claim_id").agg(F.max_by(F.struct("seq", "digest"), "seq").alias("e")).select("path", "claim_id", "e.*")
    made = _raised(cut(_rows(ends, CLAIM, F.col("path"), "digest")), former, depth)
    out = own
    for one in made:
        out = out.unionByName(one)
    out = cut(out.select(F.lit(batch).alias("batch"), *_COLUMNS).repartitionByRange("level", "path").sortWithinPartitions("level", "path"))
    drop(own, *made)
    return out


def misplaced(events: DataFrame, former: DataFrame | None = None) -> DataFrame:
    """(claim_id, seq) of events that don't continue the sealed end of their chain or one another: the guard before a batch is appended.

    Reads the batch, and of `former` the ends of its claims.
    """
    before = events.select("claim_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("__before"))
    if former is not None:
        ends = former.where(F.col("level") == CLAIM).join(events.select("claim_id").distinct(), "claim_id", "left_semi")
        ends = ends.groupBy("claim_id").agg(F.max_by(F.struct("seq", "digest"), "batch").alias("e"))
        before = before.unionByName(ends.select("claim_id", (F.col("e.seq") + 1).alias("seq"), F.col("e.digest").alias("__before")))
    before = before.groupBy("claim_id", "seq").agg(F.min("__before").alias("__before"))
    joined = events.join(before, ["claim_id", "seq"], "left")
    first = F.when(F.col("seq") == 1, F.lit(audit.GENESIS))
    fits = (F.col("prev_hash") == F.coalesce("__before", first)) & (F.col("hash") == audit.event_hash(F.col("prev_hash"), F.col("seq")))
    judged = joined.groupBy("claim_id", "seq").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits"), F.count("*").alias("n"))
    if former is not None:  # a number that is sealed already is none of a new event, though it may fit the event before it
        judged = judged.join(ends.select("claim_id", F.col("e.seq").alias("__end")), "claim_id", "left")
    else:
        judged = judged.withColumn("__end", F.lit(0))
    return judged.where(~F.col("fits") | (F.col("n") > 1) | (F.col("seq") <= F.coalesce("__end", F.lit(0)))).select("claim_id", "seq")


def recomputed(chain: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The node table of a log by its contents: nothing is taken from the hashes that it states but the links to check them.

    A chain with an event that doesn't fit has an end that no seal can have.
    """
    previous = chain.groupBy("claim_id", (F.col("seq") + 1).alias("seq")).agg(F.min("hash").alias("__prev"))  # one row, also of repeated events
    digest = audit.event_hash(F.coalesce("prev_hash", F.lit("")), F.col("seq"))
    joined = chain.join(previous, ["claim_id", "seq"], "left").withColumn("digest", digest)
    linked = F.col("prev_hash") == F.when(F.col("seq") == 1, F.lit(audit.GENESIS)).otherwise(F.col("__prev"))
    fits = F.coalesce(linked & (F.col("hash") == F.col("digest")), F.lit(False))
    path, seq = _path(F.col("claim_id"), depth).alias("path"), F.col("seq").cast("int").alias("seq")
    own = cut(joined.select(F.lit(EVENT).alias("level"), path, "claim_id", seq, "digest", fits.alias("fits")))
    ends = own.groupBy("path", "claim_id").agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("last"), (F.bool_and("fits") & (F.count("*") == F.max("seq"))).alias("whole"))
    ends = ends.withColumn("digest", F.when(F.col("whole"), F.col("last")).otherwise("broken"))
    out = own.drop("fits")
    for one in _raised(cut(_rows(ends, CLAIM, F.col("path"), "digest")), None, depth):
        out = out.unionByName(one)
    return out.select(F.lit(0).alias("batch"), *_COLUMNS)


def root(nodes: DataFrame) -> str | None:
    """The digest of all that is sealed; None before the first event."""
    found = latest(nodes, 0).select("digest").first()
    return found and found.digest


def problems(sealed: DataFrame, present: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(claim_id, seq, problem) of sealed events that `present` has changed, repeated or lost; empty if it has only been appended to.

    Both are node tables. Goes down from the root where the trees differ.
    Claims and events that are only in `present` are new ones.
    """
    suspect = None
    for level in [*range(depth + 1), CLAIM]:
        old, now = latest(sealed, level), latest(present, level)
        if suspect is not None:
            up = F.col("path") if level == CLAIM else F.substring("path", 1, level - 1)
            old = old.withColumn("__up", up).join(suspect.select(F.col("path").alias("__up")), "__up", "left_semi")
        key = ["path", "claim_id"] if level == CLAIM else ["path"]
        joined = old.select(*key, "digest").join(now.select(*key, F.col("digest").alias("__now")), key, "left")
        found = cut(joined.where("__now is null or __now <> digest").select(*key))
        if suspect is not None:
            drop(suspect)
        suspect = found
    claims = suspect.select("path", "claim_id")
    old = sealed.where(F.col("level") == EVENT).join(claims, ["path", "claim_id"], "left_semi").select("claim_id", "seq", "digest")
    now = present.where(F.col("level") == EVENT).join(claims, ["path", "claim_id"], "left_semi")
    now = cut(now.groupBy("claim_id", "seq").agg(F.count("*").alias("__n"), F.min("digest").alias("__least"), F.max("digest").alias("__most")))
    same = (F.col("__least") == F.col("digest")) & (F.col("__most") == F.col("digest"))
    problem = F.when(F.col("__n").isNull(), "deleted").when(~same, "changed").when(F.col("__n") > 1, "repeated")
    return old.join(now, ["claim_id", "seq"], "left").select("claim_id", "seq", problem.alias("problem")).where("problem is not null")
