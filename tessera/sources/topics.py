"""A message log as a streaming source: ``topic_log``.

    append(df, path)                                                      # one more segment, written by Spark
    spark.dataSource.register(TopicLog)
    spark.readStream.format("topic_log").option("path", path).option("channels", "orders,alerts").option("pattern", "results:.*").load()

The log is a folder of segments, each a folder of Parquet files named after the offset of its first message; a segment counts
once its write is complete. The position of the stream is the number of messages read. Every file of a segment is a
partition of a batch, cut to the offsets of that batch, so a batch that is run again reads the same messages. Channels named in
``channels`` or matched as a whole by ``pattern`` are picked in the reader (all, if neither is given). ``from`` is ``start`` (default) or ``end``.
Files are opened through pyarrow, which takes local paths and the URIs of stores that it knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "position long, channel string, ts timestamp, payload string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Segment(InputPartition):
    """Messages [first, last) of one file, whose first message has the position ``start``."""

    file: str
    start: int
    first: int
    last: int


def _files(path: str) -> list[tuple[str, int, int]]:
    """(file, position of its first message, messages) of all complete segments, in order."""
    store, root = _store(path)
    found: dict[int, list[str]] = {}
    complete = set()
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if m := re.search(r"/segment=(\d+)/([^/]+)$", info.path):
            if m[2] == "_SUCCESS":
                complete.add(int(m[1]))
            elif m[2].endswith(".parquet") and not m[2].startswith(("_", ".")):
                found.setdefault(int(m[1]), []).append(info.path)
    out = []
    for start in sorted(complete):
        for file in sorted(found.get(start, [])):
            n = pq.read_metadata(file, filesystem=store).num_rows
            out.append((file, start, n))
            start += n
    return out


def append(messages: DataFrame, path: str) -> int:
    """Adds messages (channel, ts, payload) as one segment; returns the position behind it. A log has one writer at a time."""
    files = _files(path)
    start = files[-1][1] + files[-1][2] if files else 0
    messages.select("channel", F.col("ts").cast("timestamp").alias("ts"), "payload").write.mode("overwrite").parquet(f"{path}/segment={start:020d}")
    return sum(n for _, _, n in _files(path))


class TopicReader(DataSourceStreamReader):
    """Positions, partitions and messages of a log."""

    def __init__(self, options: dict[str, str]):
        self.path, self.begin = options["path"], options.get("from", "start")
        self.channels = [c.strip() for c in options.get("channels", "").split(",") if c.strip()]
        self.pattern = options.get("pattern", "")

    def _end(self) -> int:
        files = _files(self.path)
        return files[-1][1] + files[-1][2] if files else 0

    def initialOffset(self) -> dict:
        return {"position": self._end() if self.begin == "end" else 0}

    def latestOffset(self) -> dict:
        return {"position": self._end()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        low, high = start["position"], end["position"]
        return [Segment(f, at, max(low, at), min(high, at + n)) for f, at, n in _files(self.path) if at < high and at + n > low]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        at = partition.start
        for batch in pq.ParquetFile(partition.file, filesystem=store).iter_batches(columns=["channel", "ts", "payload"]):
            low, high = max(partition.first, at), min(partition.last, at + batch.num_rows)
            if low < high:
                rows = batch.slice(low - at, high - low)
                rows = pa.RecordBatch.from_arrays([pa.array(range(low, high), pa.int64()), rows["channel"], rows["ts"].cast(pa.timestamp("us", "UTC")), rows["payload"]], ["position", "channel", "ts", "payload"])
                yield rows.filter(self._asked(rows["channel"]))
            at += batch.num_rows

    def _asked(self, channel: pa.Array) -> pa.Array:
        if not self.channels and not self.pattern:
            return pc.is_valid(channel)
        named = pc.is_in(channel, value_set=pa.array(self.channels, pa.string()))
        matched = pc.match_substring_regex(channel, f"^(?:{self.pattern})$") if self.pattern else pa.array([False] * len(channel))
        return pc.or_kleene(named, pc.fill_null(matched, False))

    def commit(self, end: dict) -> None:
        """Nothing to give back: segments stay until the log's owner removes them."""


class TopicLog(DataSource):
    """The source ``topic_log``."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TopicReader:
        return TopicReader(self.options)
