"""The outbox as a stream source with offsets, and a sink whose commits say what was sent.

`store` appends outbox rows to a folder. The source "outbox" reads them by
offsets of (created_at, id): a batch is all that lies after one offset and not
after the next, whatever files it is in, so a batch that is repeated holds the
same rows. The sink "sent" lets each task write a file of its own under a new
name; a batch is sent when its commit, the list of its files, is in place.
Files that no commit lists were never sent: `sent` reads the others. So a
restart between write and commit loses nothing, and one between the commit
and the stream's own log repeats nothing.

Rows go from file to message by Arrow batches; no task holds more than one.
The folders may be in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

MESSAGES = "id string, key string, value string, topic string, created_at timestamp"
_COMMITS = "file string, batch long, rows long, sent_at double"
#: Rows younger than this many seconds are left for a later batch, as older ones may still be on their way to the store.
SETTLED_AFTER = 10.0


def store(outbox: DataFrame, path: str) -> None:
    """Append rows (id, aggregate_id, topic, payload, created_at, sent_at) that aren't sent to the store.

    A row without created_at or id has no place in the order; it is refused.
    """
    rows = outbox.where("sent_at is null").select(
        F.coalesce(F.col("id").cast("string"), F.raise_error(F.lit("an outbox row has no id"))).alias("id"), F.col("aggregate_id").cast("string").alias("key"), F.col("payload").alias("value"), "topic",
        F.coalesce(F.unix_micros("created_at"), F.raise_error(F.lit("an outbox row has no created_at"))).alias("at"),
    )
    rows.write.mode("append").parquet(path)


def _opened(path: str) -> tuple[pfs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pfs.FileSystem.from_uri(path)


@dataclasses.dataclass
class _Piece(InputPartition):
    """A row group of a file, and the offsets between which its rows are wanted."""

    file: str
    group: int
    after: dict
    upto: dict


def _beyond(table, offset: dict):
    """Which rows lie after `offset`; all of them after the first one."""
    if offset["at"] is None:
        return pc.is_valid(table["at"])
    later, same = pc.greater(table["at"], offset["at"]), pc.equal(table["at"], offset["at"])
    return pc.or_(later, pc.and_(same, pc.greater(table["id"], offset["id"])))


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, settled_after: float):
        self.path, self.settled_after = path, settled_after
        self.known: dict[str, list[tuple[int, int]]] = {}  # a stored file never changes

    def initialOffset(self) -> dict:
        return {"at": None, "id": None}

    def _groups(self, files: pfs.FileSystem, root: str):
        """(file, row group, first, last) of all that is stored; footers are read once."""
        for info in files.get_file_info(pfs.FileSelector(root, allow_not_found=True)):
            if info.type != pfs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            if info.path not in self.known:
                with pq.ParquetFile(info.path, filesystem=files) as f:
                    at = f.schema_arrow.get_field_index("at")
                    columns = [f.metadata.row_group(i).column(at).statistics for i in range(f.metadata.num_row_groups)]
                    self.known[info.path] = [(s.min, s.max) for s in columns]
            for i, (first, last) in enumerate(self.known[info.path]):
                yield info.path, i, first, last

    def latestOffset(self) -> dict:
        """The last row that is old enough; of files, only row groups that may hold it are read."""
        files, root = _opened(self.path)
        due = int((time.time() - self.settled_after) * 1e6)
        best = (None, None)
        for file, group, first, last in sorted(self._groups(files, root), key=lambda g: -g[3]):
            if first > due or (best[0] is not None and last < best[0]):
                continue
            with pq.ParquetFile(file, filesystem=files) as f:
                for batch in f.iter_batches(row_groups=[group], columns=["id", "at"]):
                    batch = batch.filter(pc.less_equal(batch["at"], due))
                    if batch.num_rows:
                        at = pc.max(batch["at"]).as_py()
                        found = (at, pc.max(batch.filter(pc.equal(batch["at"], at))["id"]).as_py())
                        best = found if best[0] is None else max(best, found)
        return {"at": best[0], "id": best[1]}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        files, root = _opened(self.path)
        if end["at"] is None:
            return []
        return [_Piece(file, group, start, end) for file, group, first, last in self._groups(files, root) if first <= end["at"] and (start["at"] is None or last >= start["at"])]

    def read(self, partition: _Piece):
        files, _ = _opened(self.path)
        with pq.ParquetFile(partition.file, filesystem=files) as f:
            for batch in f.iter_batches(row_groups=[partition.group], columns=["id", "key", "value", "topic", "at"]):
                batch = batch.filter(pc.and_(_beyond(batch, partition.after), pc.invert(_beyond(batch, partition.upto))))
                if batch.num_rows:
                    made = batch["at"].cast(pa.timestamp("us")).cast(pa.timestamp("us", tz="UTC"))
                    yield pa.RecordBatch.from_arrays([*[batch[n] for n in ("id", "key", "value", "topic")], made], ["id", "key", "value", "topic", "created_at"])

    def commit(self, end: dict) -> None:
        """Nothing to do: what was sent is told by the sink."""


class OutboxSource(DataSource):
    """Option path: the store; settled_after: seconds until a row is due."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], float(self.options.get("settled_after", SETTLED_AFTER)))


@dataclasses.dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        """A file under a name of its own; no row, no file."""
        files, root = _opened(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        files.create_dir(f"{root}/data", recursive=True)
                        out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=files)
                    out.write_batch(batch)
                    rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return _Written(name if rows else None, rows)

    def commit(self, messages, batchId: int) -> None:
        """Put the list of the batch's files in place; a batch that has one is sent already, and the new files go."""
        files, root = _opened(self.path)
        made = [m for m in messages if m is not None and m.file]
        place = f"{root}/commits/{batchId:020d}.json"
        if files.get_file_info(place).type != pfs.FileType.NotFound:
            return self._remove(files, root, made)
        files.create_dir(f"{root}/commits", recursive=True)
        now, hidden = time.time(), f"{root}/commits/.{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write("".join(json.dumps({"file": m.file, "batch": batchId, "rows": m.rows, "sent_at": now}) + "\n" for m in made).encode())
        files.move(hidden, place)
        return None

    def abort(self, messages, batchId: int) -> None:
        files, root = _opened(self.path)
        self._remove(files, root, [m for m in messages if m is not None and m.file])

    @staticmethod
    def _remove(files: pfs.FileSystem, root: str, made: list[_Written]) -> None:
        for m in made:
            files.delete_file(f"{root}/data/{m.file}")


class SentSink(DataSource):
    """Option path: the folder for messages and commits."""

    @classmethod
    def name(cls) -> str:
        return "sent"

    def streamWriter(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the formats "outbox" and "sent" known to the session."""
    spark.dataSource.register(OutboxSource)
    spark.dataSource.register(SentSink)


def published(spark: SparkSession, store_path: str, sink_path: str, checkpoint: str, seconds: float | None = None, **options):
    """Send what the store has and the sink hasn't: all that is due now, or every `seconds`."""
    register(spark)
    rows = spark.readStream.format("outbox").options(path=store_path, **options).load()
    writer = rows.writeStream.format("sent").option("path", sink_path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def sent(spark: SparkSession, sink_path: str) -> DataFrame:
    """(id, key, value, topic, created_at, batch, sent_at) of the messages of committed batches; none before the first."""
    files, root = _opened(sink_path)
    types = f"{MESSAGES}, batch long, sent_at timestamp"
    if any(files.get_file_info(f"{root}/{part}").type == pfs.FileType.NotFound for part in ("commits", "data")):
        return spark.createDataFrame([], types)
    commits = spark.read.schema(_COMMITS).json(f"{sink_path}/commits")
    rows = spark.read.schema(MESSAGES).parquet(f"{sink_path}/data").withColumn("file", F.col("_metadata.file_name"))
    at = F.timestamp_micros((F.col("sent_at") * 1e6).cast("long")).alias("sent_at")
    return rows.join(commits, "file").select(*[c.split()[0] for c in MESSAGES.split(", ")], "batch", at)
