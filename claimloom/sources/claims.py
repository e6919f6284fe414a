"""Claims from files and from the order tables, and the sinks of generated data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.sources.tables import table

CLAIMS = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("claimant_name", T.StringType()),
        T.StructField("policy_number", T.StringType()),
        T.StructField("claim_amount", T.DecimalType(14, 2)),
        T.StructField("incident_date", T.DateType()),
        T.StructField("claimant_phone", T.StringType()),
        T.StructField("claimant_address", T.StringType()),
        T.StructField("repair_shop_name", T.StringType()),
    ]
)
TRUTH = T.StructType([T.StructField("claim_id", T.StringType()), T.StructField("ring_id", T.StringType())])
HELD_OUT = T.StructType([T.StructField("ring_id", T.StringType())])

#: Claims made of orders: every fiftieth customer is a ring that shares a phone number; some phones are foreign or no numbers.
DERIVATION = """
WITH first_item AS (
  SELECT l_orderkey, min_by(l_suppkey, (l_linenumber, l_suppkey, l_partkey)) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, CAST(o.o_orderdate AS DATE) AS od, c.c_name, c.c_nationkey, f.l_suppkey,
         o.o_custkey % 50 = 0 AS is_ring,
         CAST(CASE WHEN o.o_custkey % 50 = 0 THEN 8000000000 + o.o_custkey ELSE 9000000000 + o.o_orderkey END AS VARCHAR(10)) AS num
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey LEFT JOIN first_item f ON f.l_orderkey = o.o_orderkey)
SELECT o_orderkey AS claim_id, c_name AS claimant_name, 'POL-' || CAST(10000 + o_orderkey % 90000 AS VARCHAR(20)) AS policy_number,
       CAST(o_totalprice AS DECIMAL(14,2)) AS claim_amount,
       CASE WHEN is_ring THEN CAST('1995-01-01' AS DATE) + CAST((o_custkey * 37) % 2000 + o_orderkey % 20 AS INT) ELSE od END AS incident_date,
       CASE WHEN o_orderkey % 97 = 0 THEN '+65 ' || substr(num, 1, 4) || ' ' || substr(num, 5, 4) WHEN o_orderkey % 89 = 0 THEN '0065' || substr(num, 1, 8)
            WHEN o_orderkey % 83 = 0 THEN '0000000000' WHEN o_orderkey % 79 = 0 THEN '+91 (0) ' || num WHEN o_orderkey % 4 = 0 THEN '+91-' || num WHEN o_orderkey % 4 = 1 THEN num
            WHEN o_orderkey % 4 = 2 THEN '0' || substr(num, 1, 5) || ' ' || substr(num, 6, 5)
            ELSE '+91 ' || substr(num, 1, 5) || ' ' || substr(num, 6, 5) END AS claimant_phone,
       CAST(1 + o_orderkey % 200 AS VARCHAR(20)) || CASE o_orderkey % 3 WHEN 0 THEN ', ' ELSE ' ' END
         || split_part('Orchard,Willow Bank,Quarry,Juniper,Foundry,Beacon,Granite,Meadow,Harbour,Canal,Weaver,Mill', ',', CAST(1 + o_custkey % 12 AS INT))
         || CASE o_orderkey % 3 WHEN 0 THEN ' rd. ' WHEN 1 THEN ' Road, ' ELSE ' Rd, ' END || 'City' || CAST(c_nationkey AS VARCHAR(20)) AS claimant_address,
       CASE WHEN l_suppkey IS NULL THEN NULL ELSE 'Supplier ' || CAST(l_suppkey AS VARCHAR(20)) || CASE o_orderkey % 2 WHEN 0 THEN ' Motors' ELSE ' MOTORS PVT LTD' END END AS repair_shop_name,
       CASE WHEN is_ring THEN 'ring-' || CAST(o_custkey AS VARCHAR(20)) END AS ring_id
FROM base
"""


def claims_of_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The claims relation that the registered queries run on; ring_id is the truth, never a feature.

    Claims are dealt out by id, as one small file would otherwise keep all
    later work in one task.
    """
    rows = spark.sql(DERIVATION, **{t: table(spark, folder, t) for t in ("lineitem", "orders", "customer")})
    return rows.repartition(spark.sparkContext.defaultParallelism, "claim_id")


def read_claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed scan of a claims file with a header; malformed lines become nulls, which `validated` reports."""
    return spark.read.schema(CLAIMS).option("header", True).csv(path)


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).option("header", True).csv(path)


def read_held_out_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HELD_OUT).option("header", True).csv(path)


def staged(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows to append to the claims table: first row an id, ids that exist left out, empty shops null, status SUBMITTED."""
    fresh = rows.dropDuplicates(["claim_id"])
    if existing is not None:
        fresh = fresh.join(existing.select("claim_id"), "claim_id", "left_anti")
    now = F.current_timestamp()
    return fresh.withColumns({"repair_shop_name": F.nullif("repair_shop_name", F.lit("")), "status": F.lit("SUBMITTED"), "created_at": now, "updated_at": now, "version": F.lit(0).cast("long")})


def bulk_load(spark: SparkSession, csv_path: str, table_path: str) -> int:
    """Append the new claims of a file to a Parquet table; returns how many were staged."""
    rows = read_claims_csv(spark, csv_path)
    try:
        existing = spark.read.parquet(table_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = None
    staged(rows, existing).write.mode("append").parquet(table_path)
    return rows.count()


def replay(claims: DataFrame, count: int, folder: str) -> int:
    """Write the first `count` claims as submission messages to a stream's source folder; returns how many."""
    head = claims.orderBy("claim_id").limit(count)
    head.select(F.to_json(F.struct("claim_id")).alias("value")).write.mode("append").text(folder)
    return head.count()


def write_generated(claims: DataFrame, folder: str) -> None:
    """Claims without the truth, the truth of ring members, and the held-out rings in order."""
    option = {"header": True, "mode": "overwrite"}
    claims.select([f.name for f in CLAIMS]).write.csv(f"{folder}/claims", **option)
    claims.where("ring_id is not null").select("claim_id", "ring_id").write.csv(f"{folder}/ground_truth_rings", **option)
    claims.where("held_out").select("ring_id").distinct().orderBy("ring_id").write.csv(f"{folder}/held_out_rings", **option)
