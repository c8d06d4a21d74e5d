"""Resuming a run as a stream: lanes that are done stay done over restarts, failed ones open again.

Attempts (run, ord, lane_id, failed, result) come in any number of micro-batches. The state of a run is a table
of its lanes, dealt to parts; an attempt at a lane that is done is a repetition and goes, one that failed leaves the lane open for the next, and the
first one that succeeds is let through and closes it. The table can start from an earlier run's checkpoint, in either of its shapes.
Of attempts at one place the one that succeeds comes first, so that only failures before it count; one of which it is not known whether it failed is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftlake.sources.adapters import consumption
from siftlake.streaming.sinks import first_success

OUT = "run string, ord long, lane_id string, result string, tries int"
#: States that a run's lanes are dealt to; a query keeps the number that it was started with.
PARTS = 64
#: Attempts at lanes of one part, over all of its runs, that a large table is dealt by.
PART_ROWS = 1 << 15
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_KNOWN = pa.schema([("lane_id", pa.string()), ("done", pa.bool_()), ("earlier", pa.int64())])


class ResumeRun(StatefulProcessor):
    """Some lanes of one run: a table of their states and of how often each was tried, read and written once for all rows of a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lanes = handle.getValueState("lanes", "lanes binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        own = pd.DataFrame({"lane_id": initialState["lane_id"], "done": initialState["failed"].eq(False), "earlier": 1})
        self._put(pd.concat([self._known(), own]).groupby("lane_id", dropna=False, as_index=False).agg({"done": "any", "earlier": "sum"}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        tried = pd.concat(list(rows)).dropna(subset=["failed"]).astype({"failed": bool}).sort_values(["ord", "failed"]).merge(known, "left", "lane_id")
        tried = tried[~tried["done"].eq(True)]
        tried["earlier"] = tried["earlier"].fillna(0).astype(int) + tried.groupby("lane_id", dropna=False).cumcount() + 1
        kept = tried[~tried["failed"]].drop_duplicates("lane_id")
        ends = pd.concat([kept, tried.drop_duplicates("lane_id", keep="last")]).drop_duplicates("lane_id")  # where a lane's tries stop: at the first that succeeds
        if len(ends):
            self._put(pd.concat([ends.assign(done=~ends["failed"])[list(_KNOWN.names)], known]).drop_duplicates("lane_id"))
        yield pd.DataFrame({"run": key[0], **{c: kept[c] for c in ("ord", "lane_id", "result")}, "tries": kept["earlier"]})

    def _known(self) -> pd.DataFrame:
        """Lanes by lane_id with done and earlier, the number of tries so far."""
        held = self.lanes.get()
        return (pa.ipc.open_stream(held[0]).read_all() if held else _KNOWN.empty_table()).to_pandas()

    def _put(self, known: pd.DataFrame) -> None:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _KNOWN) as stream:
            stream.write_table(pa.Table.from_pandas(known, _KNOWN, preserve_index=False))
        self.lanes.update((out.getvalue().to_pybytes(),))

    def close(self) -> None:
        pass


def checkpointed_lanes(spark: SparkSession, path: str, run: str) -> DataFrame:
    """run, lane_id and failed of an earlier checkpoint, a bare array or the object of lanes and older entries."""
    return consumption(spark, path).select(F.lit(run).alias("run"), "lane_id", "failed")


def resume_stream(attempts: DataFrame, before: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """The attempts that a run keeps, its lanes dealt to `parts` states. before: lanes (run, lane_id, failed) of earlier checkpoints; they count once, at the query's first start.

    Needs the RocksDB state store (`with_rocks`). A lane is tried once more for each row of it, failed or not, until it is done.
    """
    dealt = lambda rows: rows.withColumn("_part", F.pmod(F.xxhash64("lane_id"), F.lit(parts)))
    start = dealt(before).groupBy("run", "_part") if before is not None else None
    return dealt(attempts).groupBy("run", "_part").transformWithStateInPandas(ResumeRun(), OUT, "Append", "None", initialState=start)


def resume_batch(attempts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The same of all attempts at once."""
    tries = attempts
    if before is not None:
        done = before.where("NOT failed").select("run", "lane_id").distinct()
        tries = attempts.join(done, ["run", "lane_id"], "left_anti")
        earlier = before.groupBy("run", "lane_id").agg(F.count("*").alias("_earlier"))
    kept = first_success(tries)
    failed = tries.where("failed").select("run", "lane_id", F.col("ord").alias("_ord"))
    own = kept.join(failed, ["run", "lane_id"], "left").groupBy("run", "ord", "lane_id", "result").agg(F.count_if(F.col("_ord") < F.col("ord")).alias("_failed"))
    if before is not None:
        own = own.join(earlier, ["run", "lane_id"], "left")
    count = F.col("_failed") + 1 + (F.coalesce("_earlier", F.lit(0)) if before is not None else 0)
    return own.select("run", "ord", "lane_id", "result", count.cast("int").alias("tries"))


class with_rocks:
    """The RocksDB state store for the queries that start inside; the session's own setting afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(ROCKS[0], None)
        self.spark.conf.set(*ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.spark.conf.unset(ROCKS[0])
        else:
            self.spark.conf.set(ROCKS[0], self.before)
