"""A paged, append-only web source as a streaming data source, read by the executors: one task a symbol.

A batch is a span of time: its end is the clock less a margin in which rows may still be published.  A symbol's task fetches page
after page from the symbol's cursor to that end.  If a fetch fails, or a turn's pages are used up, the task keeps the pages that it
got and notes in a log how far it came; the symbol's next turn starts there, and no other symbol waits for it.

The log is a folder that driver and executors share, a small file for each symbol and batch.  A batch that is run again
reads what its log says and nothing else; a failure then fails the batch, as rows would be missing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from hashlib import sha256
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

Row = tuple  # (symbol, ts_ms, ...)
Fetch = Callable[[str, int, int], list[Row]]  # symbol, first ts_ms, limit -> rows in ascending order


class Log:
    """How far each symbol came in each batch; the first note of a batch holds."""

    def __init__(self, folder: str):
        self.folder = folder

    def _store(self):
        from pyarrow import fs

        if urlsplit(self.folder).scheme:
            return fs.FileSystem.from_uri(self.folder)
        return fs.LocalFileSystem(), self.folder

    def _file(self, base: str, symbol: str, until: int) -> str:
        return f"{base}/{sha256(symbol.encode()).hexdigest()[:16]}/{until}.json"

    def reached(self, symbol: str, until: int) -> int | None:
        from pyarrow import fs

        store, base = self._store()
        path = self._file(base, symbol, until)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            text = f.read()
        return json.loads(text)["reached"] if text else None

    def note(self, symbol: str, until: int, reached: int) -> int:
        """Write it down unless there is a note; what holds then.  On a local or mounted folder the file is made by one writer only."""
        from pyarrow import fs

        store, base = self._store()
        path = self._file(base, symbol, until)
        store.create_dir(path.rsplit("/", 1)[0])
        text = json.dumps({"symbol": symbol, "reached": reached})
        if isinstance(store, fs.LocalFileSystem):
            try:
                with open(path, "x", encoding="utf-8") as f:
                    f.write(text)
            except FileExistsError:
                return self.reached(symbol, until)
            return reached
        known = self.reached(symbol, until)
        if known is None:
            with store.open_output_stream(path) as f:
                f.write(text.encode())
        return reached if known is None else known


class Turn(InputPartition):
    """A symbol's part of a batch."""

    def __init__(self, symbol: str, since: int, until: int):
        self.symbol, self.since, self.until = symbol, since, until


class PagedReader(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, symbols: list[str], folder: str, anchor_ms: int, limit: int, pages: int, clock: Callable[[], int]):
        self.fetch, self.symbols, self.log, self.anchor_ms, self.limit, self.pages, self.clock = fetch, symbols, Log(folder), anchor_ms, limit, pages, clock

    def initialOffset(self) -> dict:
        return {"until": self.anchor_ms}

    def latestOffset(self) -> dict:
        return {"until": max(self.anchor_ms, self.clock())}

    def partitions(self, start: dict, end: dict) -> list[Turn]:
        """A turn for each symbol, from where its last one ended."""
        since = lambda s: self.log.reached(s, start["until"])
        return [Turn(s, start["until"] if (known := since(s)) is None else known, end["until"]) for s in self.symbols]

    def read(self, partition: Turn) -> Iterator[Row]:
        known = self.log.reached(partition.symbol, partition.until)
        until = partition.until if known is None else known
        since = came = partition.since
        for _ in range(self.pages):
            if since >= until:
                break
            try:
                page = self.fetch(partition.symbol, since, self.limit)
            except OSError:
                if known is not None:
                    raise
                break
            yield from (r for r in page if r[1] < until)
            if len(page) < self.limit or page[-1][1] >= until:
                came = until
                break
            since = came = page[-1][1] + 1
        if known is None and self.log.note(partition.symbol, partition.until, came) != came:
            raise RuntimeError(f"another attempt at {partition.symbol}'s turn came elsewhere; run again, this one reads what that noted")


def wall_clock(margin_ms: int = 60_000) -> Callable[[], int]:
    """Now, less a margin in which rows may still be published."""
    return lambda: int(time.time() * 1000) - margin_ms


def paged_source(
    name: str, schema: str, fetch: Fetch, symbols: list[str], folder: str, anchor_ms: int = 1_483_228_800_000, limit: int = 1000,
    pages: int = 2500, clock: Callable[[], int] | None = None,
) -> type[DataSource]:
    """A class for spark.dataSource.register; then spark.readStream.format(name).  folder: of the log, for this stream alone."""
    now = clock or wall_clock()

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> PagedReader:
            return PagedReader(fetch, symbols, folder, anchor_ms, limit, pages, now)

    return Paged
