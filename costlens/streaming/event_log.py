"""A replayable event log as a streaming source (A6): a Python data source with offsets, partitions and restart.

The log is a folder that the driver and all executors see.  Producers append *segments*: ``segment=<number>`` folders of
files with one JSON text a line, written by Spark's committer, which leaves ``_SUCCESS`` when a segment is whole.  The
offset of the log is the number of whole segments in a row from 0, so a half-written segment is never read and a reader
never skips one.  A read starts at the earliest segment (or ``startingSegment``), every file is a partition, and Spark
keeps the offsets in its checkpoint: a stopped query goes on where it stood."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from costlens.session import ship_package

FORMAT = "costlens_event_log"
SCHEMA = "segment long, file string, line long, payload string"


def segment_path(log: str, number: int) -> str:
    return f"{log}/segment={number:09d}"


def whole_segments(log: str, begin: int = 0) -> int:
    """First number from ``begin`` on that is not a whole segment."""
    while os.path.exists(f"{segment_path(log, begin)}/_SUCCESS"):
        begin += 1
    return begin


class SegmentFile(InputPartition):
    def __init__(self, segment: int, path: str):
        self.segment, self.path = segment, path


class EventLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log, self.start = options["path"].removeprefix("file:").rstrip("/"), int(options.get("startingSegment", "0"))

    def initialOffset(self) -> dict:
        return {"segment": self.start}

    def latestOffset(self) -> dict:
        return {"segment": whole_segments(self.log, self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for n in range(start["segment"], end["segment"]):
            names = sorted(p for p in glob.glob(f"{segment_path(self.log, n)}/*") if not os.path.basename(p).startswith(("_", ".")))
            out += [SegmentFile(n, p) for p in names]
        return out

    def read(self, partition: SegmentFile) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        with open(partition.path, encoding="utf-8", newline="\n") as f:
            for number, line in enumerate(f):
                yield partition.segment, name, number, line.rstrip("\n")


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return EventLogReader(self.options)


def append_segment(events: DataFrame, log: str, number: int | None = None) -> int:
    """Append the rows of ``events`` as JSON texts; returns the segment's number (overwritten if it was cut off midway)."""
    number = whole_segments(log.removeprefix("file:")) if number is None else number
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns])).alias("value")
    events.select(body).write.mode("overwrite").text(segment_path(log, number))
    return number


def read_log(spark: SparkSession, log: str, starting_segment: int = 0) -> DataFrame:
    """The log as a streaming frame (segment, file, line, payload)."""
    ship_package(spark)
    spark.dataSource.register(EventLog)
    return spark.readStream.format(FORMAT).option("startingSegment", str(starting_segment)).load(log)
