"""Health checks with exit codes, and the scan of source text for keys."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwell.config import load
from ledgerwell.functions import lists


def exit_code(results: dict[str, str]) -> int:
    """0: all ok; 1: some degraded; 2: any failed."""
    return 2 if "fail" in results.values() else 1 if "degraded" in results.values() else 0


def quick(config_path: str | None = None) -> dict[str, str]:
    """Checks that need no index: settings, and the packages that optional readers use."""
    out = {"config": "degraded" if load(config_path).warnings else "ok"}
    for name, module in (("pdf", "pypdf"), ("yaml", "yaml")):
        try:
            __import__(module)
            out[name] = "ok"
        except ImportError:
            out[name] = "degraded"
    return out


def key_literals(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text that looks like a stored key."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike("|".join(lists.KEY_SHAPES)))


def deep(spark: SparkSession, records_path: str, known: str, absent: str) -> dict[str, str]:
    """Builds an engine from records: a known name must be answered, an absent one refused."""
    from ledgerwell.operators import chunking, dense
    from ledgerwell.plans.engine import Engine, health
    from ledgerwell.sources.records import read_records

    try:
        engine = Engine(chunking.documents_from_records(read_records(spark, records_path)), encoder=dense.hashing_encoder())
        return {"records": "ok"} | health(engine, known, absent)
    except Exception as e:
        return {"records": "fail", "reason": f"degraded: {type(e).__name__}"}


def main(arguments: list[str]) -> int:
    """[config] [--deep records known absent]: prints the state of each part; the exit code tells the worst."""
    if "--deep" in arguments:
        from ledgerwell.session import session

        at = arguments.index("--deep")
        found = quick(arguments[0] if at else None) | deep(session("checks", "local[*]"), *arguments[at + 1 : at + 4])
    else:
        found = quick(arguments[0] if arguments else None)
    for name, state in found.items():
        print(f"{state:9} {name}")
    return exit_code(found)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
