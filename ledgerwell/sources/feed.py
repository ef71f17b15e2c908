"""A paged label feed as a data source: tasks fetch ranges of pages side by side.

Pages are planned in waves, each twice as wide as the last, until the labels hold enough records, the feed ends or a page fails. What
comes after the first empty or failed page is left out, as if pages had been read one by one; a label's place in the feed is its
arrival, so that the first record of a name is kept whichever task read it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerwell.session import stored
from ledgerwell.sources.labels import CLASSES, LABEL_FIELDS, LAST_SKIP, NAMES, SCHEMA, records_from_labels

Fetch = Callable[[int, int], list[dict]]
_COLUMNS = (*NAMES, *CLASSES, *LABEL_FIELDS.values())


class Pages(InputPartition):
    """The labels from one place of the feed to another."""

    def __init__(self, first: int, after: int):
        self.first, self.after = first, after


def _row(item: dict, arrival: int) -> tuple:
    flat = item | next((v for v in item.values() if isinstance(v, dict)), {})
    as_list = lambda v: None if v is None else [str(x) for x in v] if isinstance(v, list) else [str(v)]
    return (*(as_list(flat.get(c)) for c in _COLUMNS), arrival, False)


class FeedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, first: int, after: int, per_page: int, pages: int):
        self.fetch, self.first, self.after, self.per_page, self.step = fetch, first, after, per_page, per_page * pages

    def partitions(self) -> list[Pages]:
        return [Pages(k, min(k + self.step, self.after)) for k in range(self.first, self.after, self.step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for skip in range(partition.first, partition.after, self.per_page):
            try:
                found = self.fetch(self.per_page, skip)
            except Exception:  # a page that fails ends the feed, as an empty one does
                found = []
            if not found:
                yield (*(None for _ in _COLUMNS), skip, True)
                return
            for k, item in enumerate(found):
                yield _row(item, skip + k)


def source(fetch: Fetch) -> type[DataSource]:
    """A data source named label_feed over fetch(limit, skip); options first, after (places), per_page and pages (of a task)."""

    class LabelFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "label_feed"

        def schema(self) -> str:
            return SCHEMA + ", ended boolean"

        def reader(self, schema) -> FeedReader:
            return FeedReader(fetch, *(int(self.options[k]) for k in ("first", "after", "per_page", "pages")))

    return LabelFeed


def read_labels(spark: SparkSession, fetch: Fetch, per_page: int = 100, target: int = 500, pages: int = 4, width: int = 16, last: int = LAST_SKIP) -> DataFrame:
    """Labels of a feed with their arrival, in waves of `width` pages and more, dealt to tasks by `pages`, until they make
    `target` records, the feed ends or `last` is reached."""
    spark.dataSource.register(source(fetch))
    rows, first = None, 0
    while first < last:
        after = min(last, first + width * per_page)
        after += -(after - first) % per_page
        wave = spark.read.format("label_feed").options(first=first, after=after, per_page=per_page, pages=pages).load()
        wave = stored(wave, "labels")
        rows = wave if rows is None else rows.unionByName(wave)
        end = rows.agg(F.min(F.when(F.col("ended"), F.col("arrival")))).first()[0]
        if end is not None or records_from_labels(rows.where("not ended").drop("ended")).count() >= target:
            return (rows if end is None else rows.where(F.col("arrival") < end)).where("not ended").drop("ended")
        first, width = after, 2 * width
    return rows.where("not ended").drop("ended")


def read_records(spark: SparkSession, fetch: Fetch, per_page: int = 100, target: int = 500, **plan) -> DataFrame:
    """The first `target` records of a feed, each the first to arrive of its name."""
    return records_from_labels(read_labels(spark, fetch, per_page, target, **plan)).limit(target)
