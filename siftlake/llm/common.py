"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where none is set and driver and executors are one process a temporary folder."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no table is read from any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def gathered(df: DataFrame, rows: int = 50_000) -> tuple[DataFrame, int]:
    """The table cut off by a checkpoint, in as many partitions as its rows fill, and their number.

    Rounds over a table that shrinks (edges, links) would else go on with all partitions of the first shuffle.
    """
    kept = checkpointed(df)
    n = kept.count()
    return kept.coalesce(1 + n // rows), n


def written(df: DataFrame, path: str, rows: int = 50_000) -> tuple[DataFrame, int]:
    """The same by a Parquet table at `path`, which the caller deletes: for loops.

    A checkpoint keeps the size that Spark guessed for its plan, and the guess for a join is the product of its sides. Where each round
    joins what the last one made, the guess gets several times the digits a round, and in the end fills the driver's memory; of a file the size is known.
    """
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    n = kept.count()
    return kept.coalesce(1 + n // rows), n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def boxed(docs: DataFrame) -> DataFrame:
    """Each row of a table as one struct `row`, so that no name of its columns can clash with an operator's, beside
    `id` (doc_id) and `body` (a hash of the text), which together tell rows apart."""
    columns = [docs[f"`{name}`"] for name in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(text_or_empty(docs)).alias("body"))


def unboxed(rows: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of the boxed table again, some of them replaced."""
    return rows.select(*[replaced.get(name, F.col("row")[name]).alias(name) for name in columns])


def parts(sizes: np.ndarray, limit: int, rows: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows that hold at most `limit` bytes, or one row where that is longer, and at most `rows` rows."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + limit, side="right"))), at + rows)
        yield at, stop
        at = stop


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most `limit` bytes of a string column, or of one row where that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for begin, stop in parts(sizes, limit, rows):
            yield batch.slice(begin, stop - begin)
