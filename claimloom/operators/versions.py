"""Claims under optimistic locks: writes that name the version they were made for, and a table that two writers can't both put in place.

A table is a folder of parts and of manifests. A part has rows written at one
time, by bucket of their key; a manifest, one for each version of the table,
lists the parts that make it up. A row's newest part counts. To write, a
caller reads a version, makes a part, and puts the next manifest in place,
which succeeds for one writer only. Who comes second reads the fresh state and
judges its requests anew: those whose claim has moved meanwhile are refused
with 409, the others go through. Nothing is changed in place, so a reader
keeps the version that it began with, and a writer that dies leaves a part
that no manifest lists.

A write reads and writes only the buckets of the claims that it is about.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import workflow
from claimloom.plans.durable import cut, drop

#: Parts of a table before they are merged into one, and buckets of a table.
MOST_PARTS, BUCKETS = 24, 64


class Conflict(Exception):
    """Another writer was first, again and again."""


@dataclasses.dataclass
class Manifests:
    """Numbered manifests in the folder `path`, which all executors share; each number is put in place by one writer.

    Needs a store with a rename that doesn't replace, as HDFS has, or local files.
    """

    spark: SparkSession
    path: str

    def _jvm(self, *names: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The table's version: that of its last manifest, 0 before the first."""
        place, files = self._jvm("versions")
        names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        place, files = self._jvm("versions", f"{version:020d}")
        stream = files.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, version: int, manifest: dict) -> bool:
        """Whether the manifest is now that of `version`; False if another one is."""
        hidden, files = self._jvm("versions", f".{uuid.uuid4().hex}")
        place, _ = self._jvm("versions", f"{version:020d}")
        stream = files.create(hidden, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        jvm = self.spark.sparkContext._jvm
        try:
            if files.getScheme() == "file":  # a rename replaces here, a link never does
                nio = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(nio(place), nio(hidden))
            else:
                return bool(files.rename(hidden, place))
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            files.delete(hidden, False)
        return True

    def _drop_part(self, name: str) -> None:
        place, files = self._jvm(name)
        files.delete(place, True)


@dataclasses.dataclass
class Table(Manifests):
    """The table in the folder `path`; rows are keyed by claim_id and count a version of their own."""

    most_parts: int = MOST_PARTS
    buckets: int = BUCKETS

    def _bucket(self, claim, buckets: int):
        return F.pmod(F.xxhash64(claim), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> str:
        name = f"part-{uuid.uuid4().hex}"
        spread = rows.withColumn("__bucket", self._bucket(F.col("claim_id"), buckets))
        spread.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        return name

    def create(self, claims: DataFrame) -> int:
        """Version 1, of (claim_id, status, version, ...); Conflict if there is a table."""
        if self.version():
            raise Conflict(f"there is a table in {self.path}")
        part = self._write(claims, self.buckets)
        if not self._put(1, {"parts": [part], "schema": claims.schema.json(), "buckets": self.buckets}):
            raise Conflict(f"there is a table in {self.path}")
        return 1

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The claims of a version, the last if none is named; only those of some buckets if these are named."""
        from pyspark.sql.types import IntegerType, StructType

        manifest = self._manifest(version or self.version())
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        stored = StructType([*schema.fields]).add("__bucket", IntegerType())
        found = None
        for i, part in enumerate(manifest["parts"]):
            one = self.spark.read.schema(stored).parquet(f"{self.path}/{part}")
            one = one if buckets is None else one.where(F.col("__bucket").isin(buckets))
            one = one.drop("__bucket").withColumn("__part", F.lit(i))
            found = one if found is None else found.unionByName(one)
        rest = [c for c in schema.fieldNames() if c != "claim_id"]
        if len(manifest["parts"]) == 1:
            return found.select(*schema.fieldNames())
        return found.groupBy("claim_id").agg(F.max_by(F.struct(*rest), "__part").alias("__row")).select("claim_id", "__row.*").select(*schema.fieldNames())

    def move(self, requests: DataFrame, most_tries: int = 10) -> DataFrame:
        """Requests (claim_id, version, to_status, role, reason, ...) with from_status, outcome and new_version.

        `version` is the claim's when the caller read it. Outcomes: 404 unknown
        claim, 409 the claim has moved since, or has no such transition, or a
        request of the same claim and table comes first (by all columns in
        order), 403, 400, else 200 and the claim is moved. All that pass are
        written as one version of the table.
        """
        asked = cut(requests)
        for _ in range(most_tries):
            at = self.version()
            manifest = self._manifest(at)
            touched = [r[0] for r in asked.select(self._bucket(F.col("claim_id"), manifest["buckets"])).distinct().collect()]  # no more than there are buckets
            held = self.read(at, touched)
            judged = cut(self._judged(asked, held))
            passed = judged.where("outcome = 200").select("claim_id", "to_status")
            if passed.isEmpty():
                return judged
            rows = held.join(passed, "claim_id").withColumns({"status": F.col("to_status"), "version": F.col("version") + 1}).select(*held.columns)
            parts = [*manifest["parts"], self._write(rows, manifest["buckets"])]
            if self._put(at + 1, manifest | {"parts": parts}):
                if len(parts) > self.most_parts:
                    self.merge()
                drop(asked)
                return judged
            self._drop_part(parts[-1])  # the other writer was first
            drop(judged)
        raise Conflict(f"{most_tries} tries, each time another writer was first")

    def _judged(self, asked: DataFrame, held: DataFrame) -> DataFrame:
        names = asked.columns
        known = held.select("claim_id", F.col("status").alias("from_status"), F.col("version").alias("__held"))
        joined = asked.join(known, "claim_id", "left")
        checked = workflow.checked(joined)
        moved = F.col("__held") != F.col("version")
        outcome = F.when(F.col("__held").isNull(), 404).when(F.coalesce(moved, F.lit(True)), 409).otherwise(F.col("outcome"))
        found = cut(checked.withColumn("outcome", outcome))
        # of several that pass for one claim the least one is first; a partial aggregate, then a join with it
        content = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
        first = cut(found.where("outcome = 200").groupBy("claim_id").agg(F.min(content).alias("__first")))
        out = found.withColumn("__content", content).join(first, "claim_id", "left")
        won = F.when((F.col("outcome") == 200) & (F.col("__content") != F.col("__first")), 409).otherwise(F.col("outcome"))
        return out.withColumn("outcome", won).select(*names, "from_status", "outcome", F.when(F.col("outcome") == 200, F.col("__held") + 1).otherwise(F.col("__held")).alias("new_version"))

    def merge(self) -> bool:
        """Make one part of all; False if another writer was first, which changes nothing. Former parts stay for former versions."""
        at = self.version()
        manifest = self._manifest(at)
        part = self._write(self.read(at), manifest["buckets"])
        if self._put(at + 1, manifest | {"parts": [part]}):
            return True
        self._drop_part(part)
        return False
