"""A log store of Parquet files in folders by hour, as a data source with bounds and a stream.

Batch: a time range and categories are options of the source. Folders outside the range are not listed,
their files not opened; inside a file row groups are skipped by their statistics. The hour is only an
index: rows are compared by their own time. The bounds are options and not pushed filters, because Spark
keeps the filters pushed last for all uses of a source table: with ``pushFilters`` the union of 10 and 50
rows of one table, each by its own filter, gave 100.

Stream: an offset is the start of the newest hour that has files and the time at which the last file
landed. A batch takes the files that landed between two offsets and lie no further back than the
look-back before the newest hour. So each file is read in one batch, a restart repeats nothing, and a row
may come at least the look-back late; later ones are left to a batch read. A file counts once it is
``settle`` seconds old, because stores round the time at which a file landed.

Defined results: bounds are inclusive; a null category is in no list of categories; rows with a null
time are returned by reads without a time bound and never by the stream; a store without files is empty;
columns that a file lacks are null; other columns of the files are ignored.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HOUR_US = 3_600_000_000
LOG_ROW = "time_generated timestamp, category string, log_s string"
TIME, CATEGORY = "time_generated", "category"
LOOKBACK_MINUTES = 10
SETTLE_SECONDS = 5
# Files are packed into tasks of about this size; opening one costs as much as reading OPEN_BYTES.
TASK_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def write_log_store(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Adds rows to the store; hours with many rows get several files."""
    hour = F.floor(F.unix_micros(TIME) / HOUR_US)
    (rows.withColumn("hour", hour).hint("rebalance", F.col("hour"))
     .write.partitionBy("hour").mode(mode).parquet(path))


def micros(value: dt.datetime) -> int:
    value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    return (value - EPOCH) // dt.timedelta(microseconds=1)


class _Store:
    """Listing and reading; opened where it is used, on the driver or in a task."""

    def __init__(self, path: str):
        from pyarrow import fs
        self.fs, self.root = fs.FileSystem.from_uri(path)

    def _list(self, folder: str) -> list:
        from pyarrow import fs
        return self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True))

    def hours(self) -> list[int | None]:
        """The hours that have a folder; None is the folder of rows without a time."""
        names = [f.base_name[5:] for f in self._list(self.root) if f.base_name.startswith("hour=")]
        return [int(n) if n.lstrip("-").isdigit() else None for n in names]

    def files(self, hour: int | None) -> list:
        name = "__HIVE_DEFAULT_PARTITION__" if hour is None else hour
        return [f for f in self._list(f"{self.root}/hour={name}")
                if f.is_file and not f.base_name.startswith(("_", "."))]

    def rows(self, path: str, schema: pa.Schema, bounds: dict) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        layout = ds.ParquetFileFormat(read_options=ds.ParquetReadOptions(coerce_int96_timestamp_unit="us"))
        data = ds.FileSystemDataset.from_paths(
            [path], schema=schema, format=layout, filesystem=self.fs)
        yield from data.to_batches(columns=schema.names, filter=expression(bounds))


def expression(bounds: dict):
    """What the bounds ask of a row."""
    import pyarrow.dataset as ds
    low, high = bounds.get("low"), bounds.get("high")
    parts = [compare for bound, compare in (
        (low, ds.field(TIME) >= _stamp(low)), (high, ds.field(TIME) <= _stamp(high))) if bound is not None]
    if bounds.get("categories") is not None:
        parts.append(ds.field(CATEGORY).isin(pa.array(bounds["categories"], pa.string())))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def _stamp(us: int | None) -> pa.Scalar:
    return pa.scalar(us, pa.timestamp("us", tz="UTC"))


def packed(files: Iterable, bounds: dict) -> list[InputPartition]:
    """Files in the order of their hours, packed into tasks."""
    out, size = [], TASK_BYTES
    for f in files:
        cost = f.size + OPEN_BYTES
        if size + cost > TASK_BYTES:
            out.append([])
            size = 0
        out[-1].append(f.path)
        size += cost
    return [InputPartition(json.dumps({"paths": p, "bounds": bounds})) for p in out]


class _Reading:
    """What batch and stream have in common."""

    def __init__(self, schema: T.StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema
        self.path = options["path"]
        self.columns = to_arrow_schema(schema)
        self.bounds: dict = {}
        if options.get("categories"):
            self.bounds["categories"] = sorted(options["categories"].split(","))

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands over where there are no partitions
            return
        store, task = _Store(self.path), json.loads(partition.value)
        for path in task["paths"]:
            yield from store.rows(path, self.columns, task["bounds"])


class LogReader(_Reading, DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.bounds.update({name: int(options[name]) for name in ("low", "high") if options.get(name)})

    def partitions(self) -> list[InputPartition]:
        low, high = self.bounds.get("low"), self.bounds.get("high")
        store = _Store(self.path)
        timed = low is not None or high is not None
        hours = [h for h in store.hours() if (not timed if h is None else (
            (low is None or h >= low // HOUR_US) and (high is None or h <= high // HOUR_US)))]
        hours.sort(key=lambda h: (h is None, h or 0))
        return packed((f for h in hours for f in store.files(h)), self.bounds)


class LogStreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.lookback_us = int(float(options.get("lookbackminutes", LOOKBACK_MINUTES)) * 60_000_000)
        self.settle_ns = int(float(options.get("settleseconds", SETTLE_SECONDS)) * 1e9)
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"time": None, "landed": 0}

    def _files(self, start: dict) -> list:
        """Hours and files that the look-back reaches and that landed after the offset."""
        store = _Store(self.path)
        since = None if start["time"] is None else (start["time"] - self.lookback_us) // HOUR_US
        hours = sorted(h for h in store.hours() if h is not None and (since is None or h >= since))
        return [(h, f) for h in hours for f in store.files(h) if f.mtime_ns > start["landed"]]

    def latestOffset(self) -> dict:
        settled = time.time_ns() - self.settle_ns
        found = [(h, f.mtime_ns) for h, f in self._files(self.last) if f.mtime_ns <= settled]
        if found:
            newest = max(h for h, _ in found) * HOUR_US
            before = self.last["time"]
            self.last = {"time": newest if before is None else max(newest, before),
                         "landed": max(m for _, m in found)}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.last["landed"] < end["landed"]:
            self.last = end
        bounds = dict(self.bounds)
        if start["time"] is not None:
            bounds["low"] = start["time"] - self.lookback_us
        return packed((f for _, f in self._files(start) if f.mtime_ns <= end["landed"]), bounds)


class LogStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_store"

    def schema(self) -> str:
        return LOG_ROW

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> LogStreamReader:
        return LogStreamReader(schema, self.options)


def read_log_store(spark: SparkSession, path: str, schema: str | T.StructType = LOG_ROW,
                   start: dt.datetime | None = None, end: dt.datetime | None = None,
                   categories: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a time range (both ends inclusive) and of some categories (none given: of all)."""
    spark.dataSource.register(LogStore)
    return (spark.read.format("log_store").schema(schema).option("categories", ",".join(categories))
            .option("low", "" if start is None else micros(start))
            .option("high", "" if end is None else micros(end)).load(path))


def read_padded_range(spark: SparkSession, path: str, start: dt.datetime, end: dt.datetime,
                      schema: str | T.StructType = LOG_ROW, before: int = 2, after: int = 6,
                      **kw) -> DataFrame:
    """A time range widened, in minutes, to absorb ingestion lag."""
    return read_log_store(spark, path, schema, start - dt.timedelta(minutes=before),
                          end + dt.timedelta(minutes=after), **kw)


def stream_log_store(spark: SparkSession, path: str, schema: str | T.StructType = LOG_ROW,
                     categories: tuple[str, ...] = (), lookback_minutes: float = LOOKBACK_MINUTES,
                     settle_seconds: float = SETTLE_SECONDS) -> DataFrame:
    """Follow the store: rows of new files, up to the look-back late."""
    spark.dataSource.register(LogStore)
    return (spark.readStream.format("log_store").schema(schema)
            .option("categories", ",".join(categories)).option("lookbackMinutes", str(lookback_minutes))
            .option("settleSeconds", str(settle_seconds)).load(path))
