"""Quote documents as a registered Spark data source: ``spark.read.format("quote_docs")``.

A folder of JSON-lines files, one quote document per line with its envelope: ``{"tick_id": .., "ticker": ..,
"ts": "..", "value": ".."}``.  The source yields the envelope's columns; ``quotes.extract_quotes`` then takes
the quote out of ``value`` in the JVM.

* Batch: files are cut into byte ranges of ``splitBytes`` (option, 16 MB), one partition each; a range owns the
  lines that start in it.  Filters on ``ticker`` and ``ts`` (=, IN, <, <=, >, >=) are pushed into the reader, which applies
  them to Arrow batches before anything reaches the JVM (Spark asks for them where
  ``spark.sql.python.filterPushdown.enabled`` is set; it re-applies nothing that was accepted).
* Stream: an offset is the (modification time, path) of the last file taken; files are to appear with growing
  times, as a producer that writes and renames them makes them.  A micro-batch takes all new files, or the oldest
  ``maxFilesPerTrigger`` (option) where a query on a processing-time trigger should work off a backlog in
  steps; an ``availableNow`` run asks a Python source for its end once, so with that option it takes one step.

Files are opened through Arrow's file systems (local paths, file://, hdfs://, s3://, gs://), on the executors.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual)

NAME = "quote_docs"
SCHEMA = "tick_id long, ticker string, ts timestamp, value string"
ARROW = pa.schema([("tick_id", pa.int64()), ("ticker", pa.string()), ("ts", pa.timestamp("us", tz="UTC")), ("value", pa.string())])
LINES = pa.schema([("tick_id", pa.int64()), ("ticker", pa.string()), ("ts", pa.string()), ("value", pa.string())])
CHUNK = 4 << 20
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str, int]]:
    """(modification time, path, size) of the data files below ``path``, oldest first."""
    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found
                  if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))


def _ranges(files: Iterable[tuple[int, str, int]], split: int) -> list[Range]:
    return [Range(p, at, min(at + split, size)) for _, p, size in files for at in range(0, size, split)]


def _lines(handle, start: int, stop: int) -> Iterator[bytes]:
    """Chunks of whole lines: those that start in [start, stop)."""
    at = start
    if start:
        handle.seek(start - 1)                       # a line that starts right at ``start`` follows a line feed
        while True:
            piece = handle.read(1 << 16)
            if not piece:
                return
            cut = piece.find(b"\n")
            if cut >= 0:
                at = handle.tell() - len(piece) + cut + 1
                break
    handle.seek(at)
    while at < stop:
        piece = handle.read(min(CHUNK, stop - at))
        while piece and not piece.endswith(b"\n"):   # to the end of the last line
            more = handle.read(1 << 16)
            cut = more.find(b"\n")
            piece += more if cut < 0 else more[: cut + 1]
            if not more or cut >= 0:
                break
        if not piece:
            return
        at += len(piece)
        handle.seek(at)
        yield piece


def _table(piece: bytes) -> pa.Table:
    options = pj.ParseOptions(explicit_schema=LINES, unexpected_field_behavior="ignore")
    t = pj.read_json(io.BytesIO(piece), read_options=pj.ReadOptions(block_size=max(len(piece) + 1, 1 << 20)), parse_options=options)
    stamp = pc.assume_timezone(pc.strptime(pc.utf8_slice_codeunits(t["ts"], 0, 19), "%Y-%m-%dT%H:%M:%S", "us"), "UTC")
    micros = pc.cast(pc.utf8_slice_codeunits(t["ts"], 20, 26), pa.int64())
    at = pc.add(pc.cast(stamp, pa.int64()), micros).cast(pa.timestamp("us", tz="UTC"))
    return pa.table([t["tick_id"], t["ticker"], at, t["value"]], schema=ARROW)


def _kept(table: pa.Table, filters: list[Filter]) -> pa.Table:
    for f in filters:
        column = table[f.attribute[0]]
        if isinstance(f, In):
            mask = pc.is_in(column, value_set=pa.array([v for v in f.value if v is not None], column.type))
        else:
            mask = COMPARE[type(f)](column, pa.scalar(f.value, column.type))
        table = table.filter(mask)
    return table


def _read(part: Range, base: str, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    store, _ = _open(base)
    with store.open_input_file(part.path) as handle:
        for piece in _lines(handle, part.start, part.stop):
            yield from _kept(_table(piece), filters).to_batches(max_chunksize=65_536)


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.filters = options["path"], int(options.get("splitBytes", 16 << 20)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = getattr(f, "attribute", None) in (("ticker",), ("ts",)) and (type(f) in COMPARE or isinstance(f, In))
            if known and getattr(f, "value", None) is not None:
                self.filters.append(f)
            else:
                yield f                              # left to Spark

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.path), self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.path, self.filters)


class QuoteStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", 16 << 20))
        self.most, self.taken = int(options["maxFilesPerTrigger"]) if "maxFilesPerTrigger" in options else None, None

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        after = self.taken or (-1, "")
        new = [f for f in _files(self.path) if f[:2] > after][: self.most]
        if new:
            self.taken = new[-1][:2]
        time, path = self.taken or (-1, "")
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        lo, hi = (start["time"], start["path"]), (end["time"], end["path"])
        self.taken = max(self.taken or hi, hi)       # a restarted query goes on from its committed offset
        return _ranges([f for f in _files(self.path) if lo < f[:2] <= hi], self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.path, [])


class QuoteDocs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(self.options)

    def streamReader(self, schema) -> QuoteStreamReader:
        return QuoteStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``quote_docs`` known to the session, with filter pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(QuoteDocs)


def write_quote_docs(docs: DataFrame, path: str) -> None:
    """Append documents (tick_id, ticker, ts, value) as JSON lines."""
    line = F.to_json(F.struct("tick_id", "ticker", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "value"))
    docs.select(line.alias("value")).write.mode("append").text(path)
