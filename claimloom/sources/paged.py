"""A paged REST source as a Python data source, with pacing and retries.

``spark.read.format("paged").option("url", ..).option("since", ..)``: pages are
followed by their ``next`` link; records come as (id, modified, body JSON).
The offset of an incremental read is the time of its start, and it only moves
when a scan was complete.

``spark.readStream.format("paged")`` reads the same records as a stream. Its
offsets are the newest modification time of each court, so a checkpoint is the
state of the sync: a batch holds the records after its start and up to its end,
a batch that failed is read again with the same bounds, and a record that was
modified since then comes with its new time in a later batch.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Pacing and retries of the source.
PACE_S, TRIES, LONGEST_S, PAGE = 0.72, 5, 60.0, 20


def fetch(url: str, token: str | None = None) -> dict:
    request = urllib.request.Request(url, headers={"Authorization": f"Token {token}"} if token else {})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.load(answer)


def patient(get: Callable[[str], dict], url: str, *, sleep=time.sleep) -> dict:
    """One page; limits and server errors are waited out, other errors raise."""
    for attempt in range(TRIES):
        try:
            return get(url)
        except urllib.error.HTTPError as error:
            if error.code != 429 and error.code < 500 or attempt == TRIES - 1:
                raise
            told = error.headers.get("Retry-After") if error.headers else None
            sleep(float(told or 60) if error.code == 429 else min(2.0**attempt, LONGEST_S))
        except urllib.error.URLError:
            if attempt == TRIES - 1:
                raise
            sleep(min(2.0**attempt, LONGEST_S))
    raise RuntimeError("unreachable")


def pages(get: Callable[[str], dict], url: str, *, sleep=time.sleep, clock=time.monotonic) -> Iterator[dict]:
    """Records of all pages; the next link carries all parameters itself."""
    last = None
    while url:
        if last is not None and (wait := PACE_S - (clock() - last)) > 0:
            sleep(wait)
        last = clock()
        page = patient(get, url, sleep=sleep)
        yield from page.get("results") or ()
        url = page.get("next")


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, modified string, body string"

    def reader(self, schema):
        return PagedReader(self.options)

    def streamReader(self, schema):
        return PagedStream(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        """One partition for each value of ``courts`` (comma-separated)."""
        return [InputPartition(c.strip()) for c in self.options.get("courts", "").split(",")]

    def read(self, partition):
        asked = {"page_size": self.options.get("page_size", str(PAGE))}
        if partition.value:
            asked["docket__court"] = partition.value
        if self.options.get("since"):
            asked["date_modified__gte"] = self.options["since"]
        url = f"{self.options['url']}?{urllib.parse.urlencode(asked)}"
        token = self.options.get("token")
        for record in pages(lambda u: fetch(u, token), url):
            yield str(record.get("id")), record.get("date_modified"), json.dumps(record)


class Span(InputPartition):
    """Records of a court that were modified after ``after`` and not after ``until``."""

    def __init__(self, court: str, after: str, until: str):
        super().__init__(court)
        self.court, self.after, self.until = court, after, until


class PagedStream(DataSourceStreamReader):
    """Times are ISO texts of one form, so they compare as texts; a record without one is never new."""

    def __init__(self, options):
        self.options = dict(options)

    def _url(self, court: str, **more: str) -> str:
        asked = {"page_size": self.options.get("page_size", str(PAGE)), **more}
        if court:
            asked["docket__court"] = court
        return f"{self.options['url']}?{urllib.parse.urlencode(asked)}"

    def _get(self, url: str) -> dict:
        return fetch(url, self.options.get("token"))

    def _courts(self) -> list[str]:
        return [c.strip() for c in self.options.get("courts", "").split(",")]

    def initialOffset(self) -> dict:
        return {c: self.options.get("since", "") for c in self._courts()}

    def latestOffset(self) -> dict:
        """One small page for each court, newest first."""
        newest = {}
        for court in self._courts():
            found = patient(self._get, self._url(court, order_by="-date_modified", page_size="1")).get("results") or ()
            newest[court] = max([self.options.get("since", ""), *(r.get("date_modified") or "" for r in found)])
        return newest

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(c, start.get(c, ""), until) for c, until in end.items() if until > start.get(c, "")]

    def read(self, partition: Span):
        since = {"date_modified__gte": partition.after} if partition.after else {}
        for record in pages(self._get, self._url(partition.court, **since)):
            modified = record.get("date_modified") or ""
            if partition.after < modified <= partition.until:
                yield str(record.get("id")), modified, json.dumps(record)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offsets; nothing is kept here."""
