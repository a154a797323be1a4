"""An audit log of files that are added as events happen: it outlives the process, an event that is written again counts
once, and a stream reads it for running totals."""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.commits import create_once
from millrace.schemas import AUDIT

LINES = f"id string, {AUDIT}"


class AuditLog:
    """Events of ``schemas.AUDIT`` with an id, below a folder: a file an event, or files of many."""

    def __init__(self, spark: SparkSession, path: str):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark, self.path = spark, self.fs.makeQualified(where).toString().rstrip("/")

    def record(self, component: str, operation: str, target: str, local: bool = True, status: str = "ok", details: str | None = None, event: str | None = None) -> str:
        """Writes one event before it returns, and returns its id; with an ``event`` id that is there already, nothing."""
        event, now = event or uuid.uuid4().hex, time.time()
        if not event.replace("-", "").isalnum():
            raise ValueError(f"an event's id is made of letters, digits and hyphens, not {event!r}")
        row = {
            "id": event, "timestamp": datetime.fromtimestamp(now, UTC).isoformat(timespec="microseconds"), "component": component, "operation": operation, "target": target[:200],
            "status": status, "is_local": local, "details": details,
        }
        create_once(self.spark, f"{self.path}/{event}.json", (json.dumps(row) + "\n").encode())
        return event

    def append(self, events: DataFrame) -> None:
        """Writes a table of events; of a stream, each batch of it.  Ids that are there already count once when read."""
        events.select("id", *self._columns()).write.mode("append").json(self.path)

    @staticmethod
    def _columns() -> list[str]:
        return [c.split()[0] for c in AUDIT.split(", ")]

    def table(self) -> DataFrame:
        """All events, each id once: of those that were written again, the earliest."""
        if not self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            return self.spark.createDataFrame([], LINES)
        return first_of_each(self.spark.read.schema(LINES).json(self.path))

    def stream(self, per_batch: int | None = None) -> DataFrame:
        """The log as a stream: events as they are written, each file once."""
        reader = self.spark.readStream.schema(LINES)
        return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).json(self.path)

    def count(self, path: str, checkpoint: str, per_batch: int | None = None):
        """Follows the log up to its end and keeps running totals by day and place below ``path``: a folder a batch, written
        again if the batch is.  Read them by ``totals``; started again it goes on where it stopped."""

        def add(batch: DataFrame, number: int) -> None:
            rows = batch.dropDuplicates(["id"]).select("id", F.to_date("timestamp").alias("day"), "is_local")
            seen = self._batches(path, number)
            if seen is not None:  # an event that an earlier batch had, written again
                rows = rows.join(seen.select("id"), "id", "left_anti")
            rows.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

        return self.stream(per_batch).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()

    def _batches(self, path: str, before: int | None = None) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not self.fs.exists(where):
            return None
        names = [f.getPath().getName() for f in self.fs.listStatus(where)]
        found = [f"{path}/{n}" for n in names if n.startswith("batch=") and (before is None or int(n[6:]) < before)]
        return self.spark.read.parquet(*found) if found else None

    def totals(self, path: str) -> DataFrame:
        """Running totals by day: events, local and external ones."""
        rows = self._batches(path)
        rows = rows if rows is not None else self.spark.createDataFrame([], "id string, day date, is_local boolean")
        return rows.groupBy("day").agg(F.count("*").alias("events"), F.count_if("is_local").alias("local_events"), F.count_if(~F.col("is_local")).alias("external_events"))


def first_of_each(events: DataFrame) -> DataFrame:
    columns = [c for c in events.columns if c != "id"]
    return events.groupBy("id").agg(F.min_by(F.struct(*columns), "timestamp").alias("e")).select("id", "e.*")
