import random

import pytest

VOCABULARY = [f"w{i}" for i in range(400)]


@pytest.fixture
def save(spark, tmp_path):
    """Writes rows of documents or pages with columns of clashing names; returns the folder."""

    def run(rows, name="documents", schema="doc_id bigint, text string, lang string, source string"):
        width = len(schema.split(","))
        rows = [(*r, *[None] * (width - len(r)), "clash", 1, [2]) for r in rows]
        more = ", row string, key int, n array<int>"
        spark.createDataFrame(rows, schema + more).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return run


@pytest.fixture
def prose():
    rng = random.Random(8)
    return lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
