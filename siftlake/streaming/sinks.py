"""Sinks of streams that commit each micro-batch once.

A batch is written below `batch=<its id>`, and Spark's commit protocol leaves `_SUCCESS` there once all of it is there. A query
that stops between the write and its own checkpoint's commit runs the batch again under the same id, over what it wrote; one that stops
within the write leaves no `_SUCCESS`, and readers pass it by. So every lane, and every line of a ledger, is there once.

One folder is one query's: two queries that write there would take each other's ids.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siftlake.sources.folders import file_system, removed

BATCH = re.compile(r"batch=(\d+)")
#: A compacted folder holds the batches up to the one in its name.
UPTO = re.compile(r"upto=(\d+)")


def write_batch(rows: DataFrame, batch_id: int, root: str, by: str | None = None) -> None:
    """One micro-batch as JSON lines, in place of what an earlier try of it left; `by` makes a folder for each value, a lane for instance."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(f"{root}/batch={batch_id}")


def committing(rows: DataFrame, root: str, checkpoint: str, by: str | None = None) -> DataStreamWriter:
    """A writer of a stream that commits each of its batches below a folder; start it with a trigger of choice."""
    return rows.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, root, by)).option("checkpointLocation", checkpoint)


def _folders(spark: SparkSession, root: str) -> tuple[dict[int, str], dict[int, str]]:
    """Committed batches and compacted folders, by number."""
    system, found = file_system(spark, root)
    batches, compacted = {}, {}
    for status in system.listStatus(found) if system.exists(found) else []:
        name, path = status.getPath().getName(), status.getPath().toString()
        for pattern, into in ((BATCH, batches), (UPTO, compacted)):
            if (match := pattern.fullmatch(name)) and system.exists(file_system(spark, f"{path}/_SUCCESS")[1]):
                into[int(match[1])] = path
    return batches, compacted


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all committed batches with `batch`, the id of theirs. The driver lists one name a batch."""
    batches, compacted = _folders(spark, root)
    last = max(compacted, default=-1)
    empty = spark.createDataFrame([], f"{schema}, batch long")
    read = lambda paths: spark.read.schema(schema).option("recursiveFileLookup", "true").json(paths)
    own = [path for n, path in batches.items() if n > last]
    number = F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long")
    found = read(own).withColumn("batch", number) if own else empty
    if last < 0:
        return found
    return spark.read.schema(f"{schema}, batch long").json(compacted[last]).unionByName(found)


def compact(spark: SparkSession, root: str, schema: str) -> int:
    """Fold all batches committed so far into one folder and return the last one's id; run it beside the query at any time.

    The new folder counts from its `_SUCCESS` on, in one step; only then the folders that it stands for go.
    """
    batches, compacted = _folders(spark, root)
    last = max([*batches, *compacted], default=-1)
    if last >= 0 and last not in compacted:
        committed(spark, root, schema).write.mode("overwrite").json(f"{root}/upto={last}")
    for path in [*(p for n, p in batches.items() if n <= last), *(p for n, p in compacted.items() if n < last)]:
        removed(spark, path)
    return last


def latest(rows: DataFrame, key: str = "lane_id", order: tuple[str, ...] = ("batch", "ord")) -> DataFrame:
    """The last row of each lane: a lane that failed and was done again counts as done."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("_row")).select("_row.*")


def first_success(attempts: DataFrame) -> DataFrame:
    """Of attempts (run, ord, lane_id, failed, ...) the first of each lane that did not fail: what a run without stops keeps."""
    order = Window.partitionBy("run", "lane_id").orderBy("ord")
    return attempts.where("NOT failed").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
