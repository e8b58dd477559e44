"""Remote JSON feeds as Spark data sources: paged observations (batch) and polled bars (stream).

Requests are made by the tasks, a range of pages or a symbol each, and are repeated with growing
pauses.  What is read goes by the request alone, so a task that is run again reads the same.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..functions.clean import MISSING, keep_last

#: Answers that are asked for again, how often, and the first pause in seconds.
AGAIN, TRIES, PAUSE = {429, 500, 502, 503, 504}, 4, 0.6
#: Pages that one task reads, and pages of a feed beyond which something is wrong.
PAGES_A_TASK, MOST_PAGES = 10, 10_000

OBSERVATIONS = "source string, d date, field string, value double, page int, place int, status string, attempts int, error string"


@dataclass
class Feed:
    """A paged feed: ``url`` may hold {page}, {offset}, {limit}, {since} and {until}.

    ``records`` names the list in a document, ``date`` a record's date, and ``fields`` the keys
    that give each field, the first usable one, times ``scale``.  ``pages`` (or ``count``, of
    records) names where a document tells how many there are; without either, pages are read
    until one has fewer than ``limit`` records, and without a limit there is one page.  Names
    reach into nested documents by dots.
    """

    name: str
    url: str
    records: str
    fields: dict[str, list[str]]
    date: str = "date"
    scale: float = 1.0
    pages: str | None = None
    count: str | None = None
    limit: int = 0


def at(document: Any, name: str) -> Any:
    for key in name.split("."):
        document = document.get(key) if isinstance(document, dict) else None
    return document


def number(value: Any) -> float | None:
    """A usable number, with or without thousands separators."""
    if value is None or str(value).strip().lower() in MISSING:
        return None
    try:
        out = float(str(value).replace(",", ""))
    except ValueError:
        return None
    return out if abs(out) != float("inf") and out == out else None


def day(value: Any) -> dt.date | None:
    try:
        return dt.date.fromisoformat(str(value)[:10])
    except ValueError:
        return None


def _get(url: str, timeout: float) -> Any:
    """The document at a URL; of a folder in a file system, the documents of its files as one list of lines."""
    if url.startswith(("http://", "https://")):
        request = urllib.request.Request(url, headers={"Accept": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    if system.get_file_info(path).type != fs.FileType.Directory:
        with system.open_input_stream(path) as file:
            return json.loads(file.read())
    text = b""
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.is_file and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path) as file:
                text += file.read()
    return json.loads(text)


def fetch(url: str, timeout: float = 12.0, tries: int = TRIES, pause: float = PAUSE, wait: Callable[[float], None] = time.sleep) -> tuple[Any, int]:
    """(document, attempts); raises the last error after so many tries, and at once an answer that no repetition would change."""
    for attempt in range(1, tries + 1):
        try:
            return _get(url, timeout), attempt
        except (OSError, ValueError) as error:  # of urllib and pyarrow too; ValueError: not JSON
            error.attempts = attempt
            final = isinstance(error, FileNotFoundError) or isinstance(error, urllib.error.HTTPError) and error.code not in AGAIN
            if final or attempt == tries:
                raise
            told = error.headers.get("Retry-After") if isinstance(error, urllib.error.HTTPError) else None
            wait(float(told) if told and told.isdigit() else pause * 2 ** (attempt - 1))
    raise ValueError("tries must be positive")


@dataclass
class Pages(InputPartition):
    feed: dict
    first: int
    last: int | None  # None: until a page is short
    since: str = ""
    until: str = ""


@dataclass
class PagedReader(DataSourceReader):
    feeds: list[Feed]
    since: dt.date
    until: dt.date
    status: bool
    asked: dict = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of the date narrow the requests; anything else is left to Spark."""
        one = dt.timedelta(days=1)
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("d",) or not isinstance(value, dt.date):
                yield f
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since = max(self.since, value + one if isinstance(f, GreaterThan) and value < dt.date.max else value)
            if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.until = min(self.until, value - one if isinstance(f, LessThan) and value > dt.date.min else value)
            yield f  # Spark looks at what came once more: rows of status have no date

    def _url(self, feed: Feed, page: int, part: Pages) -> str:
        return feed.url.format(page=page, offset=(page - 1) * feed.limit, limit=feed.limit, since=part.since, until=part.until)

    def partitions(self) -> list[Pages]:
        """Ranges of pages of each feed that tells how many there are; the first page is asked for that."""
        out = []
        for feed in self.feeds:
            part = Pages(asdict(feed), 1, None if feed.limit and not (feed.pages or feed.count) else 1, self.since.isoformat(), self.until.isoformat())
            total = 1
            if feed.pages or feed.count:
                try:
                    told = number(at(fetch(self._url(feed, 1, part))[0], feed.pages or feed.count))
                    total = max(1, int(told) if feed.pages else -(-int(told) // max(1, feed.limit))) if told is not None else 1
                except (OSError, ValueError):
                    total = 1  # the task that asks again tells what is wrong
            if total > MOST_PAGES:
                raise ValueError(f"{feed.name} has {total} pages")
            if total == 1:
                out.append(part)
            else:
                out += [Pages(part.feed, a, min(total, a + PAGES_A_TASK - 1), part.since, part.until) for a in range(1, total + 1, PAGES_A_TASK)]
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        feed, since, until = Feed(**partition.feed), day(partition.since), day(partition.until)
        page, rows, attempts = partition.first, 0, 0
        try:
            while True:
                document, tried = fetch(self._url(feed, page, partition))
                attempts += tried
                records = at(document, feed.records) or []
                for place, record in enumerate(records):
                    own = day(at(record, feed.date))
                    if own is None or not since <= own <= until:
                        continue
                    for name, keys in feed.fields.items():
                        values = [v for v in (number(at(record, k)) for k in keys) if v is not None]
                        rows += 1
                        yield feed.name, own, name, values[0] * feed.scale if values else None, page, place, None, None, None
                if page == partition.last or partition.last is None and len(records) < feed.limit:
                    break
                page += 1
                if page > MOST_PAGES:
                    raise ValueError(f"{feed.name} has more than {MOST_PAGES} pages")
        except (OSError, ValueError) as error:
            if not self.status:
                raise
            yield feed.name, None, None, float(rows), page, None, "failed", attempts + getattr(error, "attempts", 0), f"{type(error).__name__}: {error}"[:300]
            return
        if self.status:
            yield feed.name, None, None, float(rows), page, None, "ok", attempts, None


class PagedJson(DataSource):
    """``spark.read.format("paged_json")``: options feeds (JSON of ``Feed``s), since, until, status."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return OBSERVATIONS

    def reader(self, schema: StructType) -> DataSourceReader:
        feeds = [Feed(**f) for f in json.loads(self.options["feeds"])]
        bound = lambda name, default: dt.date.fromisoformat(self.options.get(name, default))
        return PagedReader(feeds, bound("since", "0001-01-01"), bound("until", "9999-12-31"), self.options.get("status", "false") == "true")


def observations(spark: SparkSession, feeds: list[Feed], since: str | None = None, until: str | None = None, status: bool = False) -> DataFrame:
    """What the feeds hold, (source, d, field, value, page, place, ...).

    Bounds on ``d`` in a filter narrow the requests as ``since`` and ``until`` do.  A feed that
    fails raises, or with ``status`` has a row with status ``failed``, its error and attempts;
    every range of pages then has such a row, ``ok`` if all went well.  Each action asks anew:
    write what came before it is used twice.
    """
    spark.dataSource.register(PagedJson)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("paged_json").option("feeds", json.dumps([asdict(f) for f in feeds])).option("status", str(status).lower())
    reader = reader.option("since", since) if since else reader
    return (reader.option("until", until) if until else reader).load()


def latest(rows: DataFrame) -> DataFrame:
    """(source, field, d, value): of a date's values the last by page and place; a last one without a number leaves none."""
    kept = keep_last(rows.where("d is not null"), ["source", "field", "d"], ["page", "place"])
    return kept.where("value is not null").select("source", "field", "d", "value")


def health(rows: DataFrame) -> DataFrame:
    """(source, status, rows, attempts, error): one row a feed; one failed range of pages makes it ``failed``."""
    told = rows.where("status is not null").groupBy("source")
    failed = F.col("status") == "failed"
    return told.agg(F.when(F.bool_or(failed), "failed").otherwise("ok").alias("status"), F.sum("value").cast("long").alias("rows"), F.sum("attempts").alias("attempts"), F.min_by("error", F.when(failed, F.col("page"))).alias("error"))


BARS = "symbol string, ts timestamp, open double, high double, low double, close double, volume long"


@dataclass
class Minutes(InputPartition):
    symbol: str
    after: int
    upto: int


@dataclass
class BarReader(DataSourceStreamReader):
    """Offsets are the minute, since 1970, up to which bars have been read; a range of minutes can be asked for again at any time."""

    url: str
    clock: str
    symbols: list[str]
    start: int
    step: int
    last: int = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"minute": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        """The clock's last whole minute; a clock that is put back gives nothing new."""
        self.last = max(self.last, self.start, int(fetch(self.clock)[0]["minute"]))
        return {"minute": self.last}

    def partitions(self, start: dict, end: dict) -> list[Minutes]:
        """A symbol and ``step`` minutes each, however long the stream has stood still."""
        self.last = max(self.last, end["minute"])
        return [Minutes(s, a, min(a + self.step, end["minute"])) for s in self.symbols for a in range(start["minute"], end["minute"], self.step)]

    def read(self, partition: Minutes) -> Iterator[tuple]:
        document, _ = fetch(self.url.format(symbol=partition.symbol, after=partition.after, upto=partition.upto))
        for bar in document["bars"]:
            if partition.after < bar["minute"] <= partition.upto:
                ts = dt.datetime.fromtimestamp(bar["minute"] * 60, dt.timezone.utc)
                yield partition.symbol, ts, *(number(bar.get(k)) for k in ("open", "high", "low", "close")), int(bar["volume"])

    def commit(self, end: dict) -> None:
        """Nothing is held here for batches that are done."""


class PolledBars(DataSource):
    """``spark.readStream.format("polled_bars")``: options url ({symbol}, {after}, {upto}), clock, symbols (JSON), start and step in minutes."""

    @classmethod
    def name(cls) -> str:
        return "polled_bars"

    def schema(self) -> str:
        return BARS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        return BarReader(o["url"], o["clock"], json.loads(o["symbols"]), int(o["start"]), int(o.get("step", "60")))


def bar_stream(spark: SparkSession, url: str, clock: str, symbols: list[str], start: int, step: int = 60) -> DataFrame:
    """One-minute bars of the symbols from minute ``start`` (exclusive) on; a task asks for one symbol and at most ``step`` minutes."""
    spark.dataSource.register(PolledBars)
    reader = spark.readStream.format("polled_bars").option("url", url).option("clock", clock).option("symbols", json.dumps(symbols))
    return reader.option("start", start).option("step", step).load()
