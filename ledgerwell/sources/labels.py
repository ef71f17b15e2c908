"""Records from a paged label feed, name normalisation, and the registry of pair sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwell.sources.records import clean_label

#: Field of a record and of a label; a record needs the first two and four in all.
LABEL_FIELDS = {
    "indications": "indications_and_usage", "mechanism": "mechanism_of_action", "dosage": "dosage_and_administration", "side_effects": "adverse_reactions",
    "contraindications": "contraindications", "interactions": "drug_interactions", "description": "description",
}
NAMES, CLASSES = ("generic_name", "brand_name"), ("pharm_class_epc", "pharm_class_moa", "route")
LEAST_FIELDS, LAST_SKIP = 4, 25_000
SCHEMA = ", ".join(f"{c} array<string>" for c in (*NAMES, *CLASSES, *LABEL_FIELDS.values())) + ", arrival bigint"


def pages(fetch: Callable[[int, int], list[dict]], per_page: int = 100, target: int = 500) -> Iterator[dict]:
    """Label objects of a paged feed, fetch(limit, skip), until it ends, fails, or enough of them make a record of a new name."""
    skip = n = 0
    names: set[str] = set()
    while n < target and skip < LAST_SKIP:
        try:
            batch = fetch(per_page, skip)
        except Exception:
            return
        if not batch:
            return
        for item in batch:
            yield item
            if (name := usable_name(item)) and name not in names:
                names.add(name)
                n += 1
                if n == target:
                    return
        skip += per_page


def usable_name(item: dict) -> str | None:
    """The lower-case name of a label that makes a record, by the rules of records_from_labels; else None."""
    flat = item | next((v for v in item.values() if isinstance(v, dict)), {})
    shown = lambda v: " ".join(" ".join(map(str, v if isinstance(v, list) else [v])).split()) if v is not None else ""
    name = next((x for c in NAMES if (x := shown((flat.get(c) or [None])[0] if isinstance(flat.get(c), list) else flat.get(c)))), None)
    cells = {ours: shown(flat.get(theirs)) for ours, theirs in LABEL_FIELDS.items()}
    cells["description"] = cells["description"] or cells["indications"]
    enough = flat.get(LABEL_FIELDS["indications"]) and flat.get(LABEL_FIELDS["mechanism"]) and sum(map(bool, cells.values())) >= LEAST_FIELDS
    return name.lower() if name and enough else None


def label_rows(spark: SparkSession, labels: Iterator[dict]) -> DataFrame:
    """Label objects as rows, their list fields as arrays; the nested name block is flattened."""
    as_list = lambda v: None if v is None else v if isinstance(v, list) else [str(v)]
    rows = []
    for k, item in enumerate(labels):
        flat = item | next((v for v in item.values() if isinstance(v, dict)), {})
        rows.append((*(as_list(flat.get(c)) for c in (*NAMES, *CLASSES, *LABEL_FIELDS.values())), k))
    return spark.createDataFrame(rows, SCHEMA)


def _first(columns: tuple[str, ...]) -> F.Column:
    return F.coalesce(*(F.nullif(F.trim(F.get(c, 0)), F.lit("")) for c in columns))


def title(column: F.Column) -> F.Column:
    """Upper case after every non-letter, as for names with hyphens and digits."""
    parts = F.regexp_extract_all(column, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def records_from_labels(labels: DataFrame, source: str = "label feed") -> DataFrame:
    """Records of labels that hold enough, the first to arrive of each name."""
    cells = {ours: clean_label(F.coalesce(theirs, F.array().cast("array<string>"))) for ours, theirs in LABEL_FIELDS.items()}
    rows = labels.select(title(_first(NAMES)).alias("name"), title(F.coalesce(_first(CLASSES), F.lit("Unclassified"))).alias("category"), *(v.alias(k) for k, v in cells.items()), F.size("indications_and_usage").alias("_i"), F.size("mechanism_of_action").alias("_m"), "arrival")
    rows = rows.where("name is not null and _i > 0 and _m > 0").withColumn("description", F.when(F.col("description") == "", F.substring("indications", 1, 600)).otherwise(F.col("description")))
    filled = sum((F.when(F.col(f) != "", 1).otherwise(0) for f in LABEL_FIELDS), F.lit(0))
    first = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("arrival"))
    return rows.where(filled >= LEAST_FIELDS).withColumn("k", first).where("k = 1").orderBy("arrival").select("name", "category", *LABEL_FIELDS, F.lit(source).alias("source"))


def normalised(names: DataFrame, column: str, lookup: Callable[[str], str | None]) -> DataFrame:
    """(column, standard) of the distinct names, by a driver-side lookup asked once a name; its failures are nulls.

    Names go through one by one as they are read; what stays on the driver is the table of those that were found.
    """
    found = []
    for (name,) in names.select(column).where(F.col(column).isNotNull()).distinct().toLocalIterator():
        try:
            standard = lookup(name)
        except Exception:
            standard = None
        if standard:
            found.append((name, standard))
    return names.select(column).distinct().join(names.sparkSession.createDataFrame(found, f"{column} string, standard string"), column, "left")


@dataclass(frozen=True)
class PairSource:
    """A source of pair rows with its terms of use."""

    id: str
    load: Callable[[SparkSession], DataFrame]
    name: str = ""
    licence: str = "unknown"
    commercial_use: bool = False


_sources: dict[str, PairSource] = {}


def register(source: PairSource) -> None:
    _sources[source.id] = source


def pair_source(id_: str) -> PairSource:
    if id_ not in _sources:
        raise KeyError(f"unknown pair source {id_!r}; registered: {sorted(_sources) or 'none'}")
    return _sources[id_]


def read_dump(path: str) -> Callable[[int, int], list[dict]]:
    """fetch() over a saved feed, for runs without a network."""
    with open(path, encoding="utf-8") as f:
        everything = json.load(f)
    return lambda limit, skip: everything[skip : skip + limit]
