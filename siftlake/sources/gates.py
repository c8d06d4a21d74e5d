"""Gates between stages: a share of rows that must hold as they are written, and provenance that must fit as they are read.

Both refuse with an error. The share is counted by an observation while the rows pass to their sink, so nothing is read twice; what
was written by a run that failed its gate is marked as failed, and readers refuse it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftlake.sources import sinks
from siftlake.sources.folders import file_system

#: A run of which fewer findings yield a code has a fault in its schema.
FLOOR = 0.95
META = "provider string, stage string, model string, exit_code int, rows long, held long, reason string, written_at timestamp"


class GateError(RuntimeError):
    """A stage's rows or their origin are not what the next stage may build on."""


def passed(rows: DataFrame, holds: Column, action: Callable[[DataFrame], object], floor: float = FLOOR, what: str = "rows") -> tuple[int, int]:
    """Run an action over the rows and count those that hold on the way; too few, or no rows at all, are an error after it.

    holds: null counts as not holding. The action must read the rows once, as a write does.
    """
    seen = Observation()
    action(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(holds, F.lit(False))).alias("held")))
    found = seen.get
    n, held = int(found.get("rows") or 0), int(found.get("held") or 0)
    if not n:
        raise GateError(f"no {what}")
    if held < floor * n:
        raise GateError(f"only {held} of {n} {what} pass, {held / n:.1%}; the floor is {floor:.0%}")
    return n, held


def has_code(codes: Column) -> Column:
    """Whether a finding yields a category code."""
    return F.size(F.coalesce(codes, F.array().cast("array<string>"))) > 0


def write_stage(rows: DataFrame, root: str, provider: str, stage: str, model: str = "", holds: Column | None = None, floor: float = FLOOR, known: list[str] | None = None) -> str:
    """One stage's rows and a row about the run beside them: failed, with the reason, if the write or the gate fails."""
    spark, path = rows.sparkSession, sinks.run_path(root, provider, stage, known)
    code, counted, reason = 1, (None, None), "the write failed"

    def written(passing: DataFrame) -> None:
        sinks.write_run(passing, root, provider, stage)

    try:
        if holds is None:
            written(rows)
        else:
            counted = passed(rows, holds, written, floor, f"rows of {stage}")
        code, reason = 0, ""
    except GateError as error:
        reason = str(error)
        raise
    finally:
        facts = spark.createDataFrame([(provider, stage, model, code, *counted, reason)], META.rpartition(",")[0])
        facts.withColumn("written_at", F.current_timestamp()).write.mode("append").json(meta_path(root, provider, stage))
    return path


def meta_path(root: str, provider: str, stage: str) -> str:
    return f"{root}/_meta/provider={provider}/stage={stage}"


def assert_upstream(spark: SparkSession, root: str, provider: str, stage: str) -> None:
    """An error if the stage's rows come from another provider or from a run that failed. A stage without provenance is let through with a warning."""
    path = meta_path(root, provider, stage)
    system, found = file_system(spark, path)
    if not system.exists(found):
        warnings.warn(f"no provenance of {stage} under {provider!r}", stacklevel=2)
        return
    meta = spark.read.schema(META).json(path).agg(F.max_by(F.struct("provider", "exit_code", "reason"), "written_at").alias("m")).first()["m"]
    if meta is None:
        warnings.warn(f"no provenance of {stage} under {provider!r}", stacklevel=2)
    elif meta["provider"] != provider:
        raise GateError(f"{stage} was made by {meta['provider']!r}, not by {provider!r}")
    elif meta["exit_code"] != 0:
        raise GateError(f"{stage} of {provider!r} failed: {meta['reason']}")


def read_stage(spark: SparkSession, root: str, provider: str, stage: str, schema: str | None = None) -> DataFrame:
    """A stage's rows, once their provenance is found to fit."""
    assert_upstream(spark, root, provider, stage)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(sinks.run_path(root, provider, stage))
