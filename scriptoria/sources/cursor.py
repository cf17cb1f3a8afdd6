"""A service read page by page through its own cursors, as a stream.

The offset of the stream is the service's cursor, so a query that starts again reads on where
it stopped, and a batch that was planned but not finished is read again between the same
cursors: no row is lost or doubled. How many pages there are need not be known; after the
last page the stream waits. A page at a time passes through the reader, never the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: The cursor of the first page.
START = "*"


class CursorSource(DataSource):
    """Subclass with `fetch`: cursor -> (rows, next cursor or None after the last page), and
    `columns`, the rows' DDL. Option `pages` bounds the pages of a batch (default 1)."""

    fetch: Callable[[str], tuple[list[tuple], str | None]]
    columns = "value string"

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return self.columns

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _CursorReader(type(self).fetch, int(self.options.get("pages", "1")))


class _CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, fetch, pages: int):
        self.fetch, self.pages = fetch, pages

    def initialOffset(self) -> dict:
        return {"cursor": START, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The pages of one batch, and the cursor behind them."""
        rows: list[tuple] = []
        at = dict(start)
        for _ in range(self.pages):
            if at["done"]:
                break
            page, after = self.fetch(at["cursor"])
            rows += page
            at = {"cursor": at["cursor"], "done": True} if after is None else {"cursor": after, "done": False}
        return iter(rows), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The pages of a batch that was planned before: the same cursors again."""
        at = dict(start)
        while at != end:
            page, after = self.fetch(at["cursor"])
            yield from page
            at = {"cursor": at["cursor"], "done": True} if after is None else {"cursor": after, "done": False}
