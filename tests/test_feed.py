"""A paged feed read by several tasks gives what reading it page by page gives."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerwell.sources import feed, labels

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import the tests


def item(k):
    full = {c: [f"{c} of {k}"] for c in labels.LABEL_FIELDS.values()}
    if k % 7 == 0:
        full.pop("mechanism_of_action")
    return full | {"nested": {"generic_name": [f"NAME-{k % 900}"] if k % 11 else None, "brand_name": "Brand" if k % 13 else None, "route": ["ORAL", 3]}}


def fetch_of(n, fails=None):
    def fetch(limit, skip):
        if fails is not None and skip >= fails:
            raise OSError("no answer")
        return [item(k) for k in range(skip, min(skip + limit, n))]

    return fetch


@pytest.mark.parametrize(("n", "fails", "target"), [(10_000, None, 500), (10_000, None, 10**6), (950, None, 10**6), (3000, 700, 10**6), (0, None, 5), (3000, 0, 5)])
def test_same_as_page_by_page(spark, n, fails, target):
    fetch = fetch_of(n, fails)
    want = labels.records_from_labels(labels.label_rows(spark, labels.pages(fetch, 100, target))).collect() if n and fails != 0 else []
    got = feed.read_records(spark, fetch, 100, target).collect()
    assert got == want and len(got) <= target


def test_read_by_several_tasks_without_gaps(spark):
    rows = feed.read_labels(spark, fetch_of(10_000), 100, 10**6)
    assert rows.select(F.count("*"), F.count_distinct("arrival"), F.max("arrival")).first() == (10_000, 10_000, 9999)
    reader = feed.FeedReader(fetch_of(10_000), 0, 10_000, 100, 4)
    parts = reader.partitions()
    assert len(parts) == 25 and [p.first for p in parts[1:]] == [p.after for p in parts[:-1]]


def test_few_pages_beyond_enough(spark, tmp_path):
    asked = tmp_path / "asked"

    def fetch(limit, skip):
        with open(asked, "a") as f:
            f.write(f"{skip}\n")
        return [item(k) for k in range(skip, skip + limit)]

    assert feed.read_records(spark, fetch, 50, 100, pages=2, width=4, last=5000).count() == 100
    assert max(map(int, asked.read_text().split())) < 1500
