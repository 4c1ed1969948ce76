"""Saved response pages as a data source: read backwards in slices of time, or as a stream that resumes by symbol.

A page is a text file with a JSON array of klines, in the folder symbol=<symbol>/page=<number>; the number is that of
its slice of time, so a listing tells which pages a scan needs, and no other page is opened.

    spark.dataSource.register(KlinePages)
    spark.read.format("kline_pages").load(path).where("ts >= 1704067200000")
    spark.readStream.format("kline_pages").load(path)
"""

from __future__ import annotations

import json
import posixpath
from collections import defaultdict
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .klines import FIELDS

MS = 60_000
#: One-minute bars in a page, as the exchange's responses have them.
PAGE = 1000
SCHEMA = "symbol string, ts long, " + ", ".join(f"{f} double" for f in FIELDS)


def save_pages(bars: DataFrame, path: str, minutes: int = PAGE) -> None:
    """Bars (symbol, ts and FIELDS) as pages of `minutes` minutes, beside those that are there; a page's bars are few."""
    kline = F.struct("ts", F.array(*(F.col(c).cast("string") for c in ("ts", *FIELDS))).alias("kline"))
    pages = bars.groupBy("symbol", F.floor(F.col("ts") / (minutes * MS)).alias("page")).agg(F.sort_array(F.collect_list(kline)).alias("klines"))
    pages.select("symbol", "page", F.to_json(F.transform("klines", lambda k: k.kline)).alias("value")).write.mode("append").partitionBy("symbol", "page").text(path)


def _files(path: str):
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, folder.rstrip("/")


def listed(path: str) -> dict[str, dict[int, list[str]]]:
    """Files by symbol and page number; only names are read. A missing folder has none."""
    from pyarrow import fs

    system, folder = _files(path)
    found: dict[str, dict[int, list[str]]] = defaultdict(lambda: defaultdict(list))
    for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
        name, page, symbol = posixpath.basename(info.path), *(posixpath.basename(p) for p in (posixpath.dirname(info.path), posixpath.dirname(posixpath.dirname(info.path))))
        if info.type == fs.FileType.File and name[0] not in "._" and page.startswith("page=") and symbol.startswith("symbol="):
            found[unquote(symbol.removeprefix("symbol="))][int(page.removeprefix("page="))].append(info.path)
    return found


def klines(path: str, files: list[str]) -> dict[int, list[str]]:
    """The klines of a page's files by open time: of repeated ones the first."""
    system, _ = _files(path)
    out: dict[int, list[str]] = {}
    for file in sorted(files):
        with system.open_input_stream(file) as stream:
            body = stream.readall()
        try:
            for line in body.decode().splitlines():
                for kline in json.loads(line):
                    out.setdefault(int(kline[0]), kline)
        except (ValueError, TypeError, IndexError) as e:
            raise ValueError(f"{file} is not a page of klines: {e}") from e
    return out


@dataclass
class Slice(InputPartition):
    """Some pages of a symbol that follow one another, and the times that are wanted, both ends included."""

    symbol: str
    number: int
    pages: list[list[str]]
    first: int
    last: int


def _rows(path: str, part: Slice):
    import pyarrow as pa

    for files in part.pages:
        found = [(ts, k) for ts, k in sorted(klines(path, files).items()) if part.first <= ts <= part.last]
        if found:
            columns = [pa.array([part.symbol] * len(found)), pa.array([ts for ts, _ in found], pa.int64()), *(pa.array([float(k[i + 1]) for _, k in found], pa.float64()) for i in range(len(FIELDS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["symbol", "ts", *FIELDS])


class _Options:
    def __init__(self, options):
        self.path = options["path"]
        self.width = int(options.get("minutes", PAGE)) * MS
        self.together = int(options.get("pagesPerPartition", 16))
        self.mark = options.get("mark")
        self.resume = {s: int(t) for s, t in json.loads(options.get("resume", "{}")).items()}

    def slices(self, pages: dict[int, list[str]], symbol: str, first: int, last: int) -> list[Slice]:
        """Slices of the pages that can hold a time from first to last, the oldest first."""
        wanted = sorted(n for n in pages if (n + 1) * self.width > first and n * self.width <= last)
        groups = defaultdict(list)
        for n in wanted:
            groups[n // self.together].append(sorted(pages[n]))
        return [Slice(symbol, n, g, first, last) for n, g in sorted(groups.items())]


_ALWAYS = -(1 << 62), 1 << 62


class _Backward(DataSourceReader):
    """A scan, newest slice first; bounds on ts and symbol leave whole slices out before a task starts."""

    def __init__(self, options):
        self.options, (self.first, self.last), self.symbols = _Options(options), _ALWAYS, None

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0].lower() if len(getattr(f, "attribute", ())) == 1 else None
            if column == "ts" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if column == "ts" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = wanted if self.symbols is None else self.symbols & wanted
            yield f  # Spark tests the rows again

    def partitions(self):
        found = [part for symbol, pages in listed(self.options.path).items() if self.symbols is None or symbol in self.symbols for part in self.options.slices(pages, symbol, self.first, self.last)]
        return sorted(found, key=lambda part: -part.number) or [Slice("", 0, [], *_ALWAYS)]  # Spark wants one at least

    def read(self, partition):
        return _rows(self.options.path, partition)


class _Forward(DataSourceStreamReader):
    """A stream whose offset is the last open time read of each symbol.

    The checkpoint keeps the offset, so a stream that is started again goes on after it; option `resume`, JSON of times
    by symbol, is where a new one starts. With option `mark`, what Spark has committed is written to that file.
    """

    def __init__(self, options):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return dict(self.options.resume)

    def latestOffset(self) -> dict:
        path = self.options.path
        last = {s: max(klines(path, pages[max(pages)]), default=_ALWAYS[0]) for s, pages in listed(path).items()}  # one page a symbol is opened
        return self.options.resume | last

    def partitions(self, start: dict, end: dict):
        out = []
        for symbol, pages in listed(self.options.path).items():
            first, last = int(start.get(symbol, _ALWAYS[0])) + 1, int(end.get(symbol, _ALWAYS[0]))
            if first <= last:
                out += self.options.slices(pages, symbol, first, last)
        return out

    def read(self, partition):
        return _rows(self.options.path, partition)

    def commit(self, end: dict) -> None:
        if self.options.mark:
            system, file = _files(self.options.mark)
            with system.open_output_stream(file) as out:
                out.write(json.dumps(end, sort_keys=True).encode())


class KlinePages(DataSource):
    """Options: path; minutes (of a page, 1000), pagesPerPartition (16), and for streams resume and mark."""

    @classmethod
    def name(cls):
        return "kline_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Backward(self.options)

    def streamReader(self, schema):
        return _Forward(self.options)


def scan(spark: SparkSession, path: str, minutes: int = PAGE) -> DataFrame:
    """All bars in saved pages; where() bounds on ts and symbol keep other pages closed.

    The session hands filters to Python sources from then on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(KlinePages)
    return spark.read.format("kline_pages").option("minutes", minutes).load(path)


def stream(spark: SparkSession, path: str, minutes: int = PAGE, resume: dict[str, int] | None = None) -> DataFrame:
    """Bars in saved pages as a stream; resume: the last open time that is there already, by symbol."""
    spark.dataSource.register(KlinePages)
    return spark.readStream.format("kline_pages").option("minutes", minutes).option("resume", json.dumps(resume or {})).load(path)
