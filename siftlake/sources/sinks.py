"""Writers. Spark's commit protocol takes the place of temporary files and renames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

PROVIDER = re.compile(r"[a-z0-9][a-z0-9.-]*")


def run_path(root: str, provider: str, stage: str, known: list[str] | None = None) -> str:
    """The folder of a stage under its provider; an unknown provider is refused."""
    if not PROVIDER.fullmatch(provider) or (known is not None and provider not in known):
        raise ValueError(f"unknown provider {provider!r}")
    return f"{root}/provider={provider}/stage={stage}"


def write_run(rows: DataFrame, root: str, provider: str, stage: str, known: list[str] | None = None) -> str:
    """One stage's rows as JSON under provider and stage. Overwrites that stage alone."""
    path = run_path(root, provider, stage, known)
    rows.write.mode("overwrite").json(path)
    return path


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_provenance(spark, path: str, **facts: str) -> None:
    """One row about a run beside its results."""
    spark.createDataFrame([Row(**facts)]).withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def write_by_lane(rows: DataFrame, path: str) -> None:
    """A folder per lane; lanes that are not in rows stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lane_id").json(path)


def seed_provider(spark, root: str, stage: str, source: str, target: str) -> DataFrame:
    """Copy one provider's stage to another, marked with where it came from."""
    rows = spark.read.json(f"{root}/provider={source}/stage={stage}").withColumn("seeded_from", F.lit(source))
    write_run(rows, root, target, stage)
    return rows


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table, for a report; refuses more than `most` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["-"] * len(rows.columns)), *(line(r) for r in found)])
