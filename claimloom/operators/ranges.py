"""Running sums and ranks over a whole table, range by range.

Rows are dealt out by ranges of the order column; only one row a range meets
in one task, so no task sorts or holds the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.plans.durable import cut


def running_sums(rows: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """`rows` with each new column of `sums`: the sum of a column (nulls count nothing) up to and with the row.

    `order` has no repeated values. Empty table: empty result.
    """
    by = F.desc(order) if descending else F.asc(order)
    ranged = cut(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__{new}") for new, c in sums.items()])
    ahead = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{new}").over(ahead), F.lit(0)).alias(f"__{new}") for new in sums])
    within = Window.partitionBy("__part").orderBy(by)
    own = {new: F.coalesce(F.sum(c).over(within), F.lit(0)) for new, c in sums.items()}
    joined = ranged.withColumns(own).join(F.broadcast(offsets), "__part")
    return joined.select(*rows.columns, *[(F.col(new) + F.col(f"__{new}")).alias(new) for new in sums])


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """`rows` with `name`: their place by `order` (no repeated values), from 1."""
    return running_sums(rows.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}).drop("__one")
