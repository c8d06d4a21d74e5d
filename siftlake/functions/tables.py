"""Table functions for SQL.

    SELECT * FROM chunk_plan(TABLE(files), 'lines', 2000, 20)
    SELECT * FROM merge_findings(TABLE(findings))
    SELECT * FROM merged_sizes(TABLE(SELECT lane, turn, title, lines, classes FROM findings DISTRIBUTE BY lane SORT BY lane, turn, ord))

merge_findings asks for its rows by itself: partitioned by lane and ordered by turn and ord, whatever their order in the table. chunk_plan
takes rows as they come and keeps their columns. merged_sizes makes the same merge where only its sizes are asked for: it takes Arrow batches
of rows that are together by lane and in order, with the lines of a trace and the names of classes as lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, arrow_udtf, udtf

from siftlake.functions.records import parts, values
from siftlake.operators import findings as G
from siftlake.operators.lanes import LINE_BUDGET, OVERLAP


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_STRING, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
#: G.SCHEMA as a type: what analyzes a call has no session that could read DDL.
FINDING = _struct(
    lane=_STRING, turn=_INT, ord=_LONG, finding_id=_STRING, title=_STRING, description=_STRING, confidence=T.DoubleType(),
    trace=T.ArrayType(_struct(kind=_STRING, file=_STRING, line=_INT)), classes=T.ArrayType(T.StructType([T.StructField("class", _STRING), T.StructField("step", _INT)])),
)


def _input(table: AnalyzeArgument, *needed: str) -> T.StructType:
    """The columns of a table argument, which must have some."""
    if not table.isTable:
        raise ValueError("the first argument must be a table, as in TABLE(files)")
    missing = set(needed) - set(table.dataType.names)
    if missing:
        raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
    return table.dataType


class ChunkPlan:
    """Overlapping line ranges that cover each file: its columns, index, start_line and end_line. A file without lines has one empty chunk."""

    @staticmethod
    def analyze(table: AnalyzeArgument, lines: AnalyzeArgument, budget: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        columns = _input(table, lines.value)
        most, shared = (budget.value if budget else LINE_BUDGET), (overlap.value if overlap else OVERLAP)
        if not 0 <= shared < most:
            raise ValueError("the overlap must be less than the budget")
        extra = [T.StructField(name, T.IntegerType()) for name in ("index", "start_line", "end_line")]
        return AnalyzeResult(T.StructType([*columns.fields, *extra]))

    def eval(self, row: Row, lines: str, budget: int = LINE_BUDGET, overlap: int = OVERLAP) -> Iterator[tuple]:
        n, index, start = row[lines] or 0, 1, 1
        if n <= 0:
            yield (*row, 1, 0, 0)
            return
        while True:
            yield (*row, index, start, min(n, start + budget - 1))
            if start + budget - 1 >= n:
                return
            index, start = index + 1, start + budget - overlap


class MergeFindings:
    """Each lane's turns folded in order, up to the first turn that adds and revises nothing."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _input(table, *FINDING.names)
        return AnalyzeResult(FINDING, partitionBy=[PartitioningColumn("lane")], orderBy=[OrderingColumn("turn"), OrderingColumn("ord")])

    def __init__(self):
        self.fold = G.Replay()

    def eval(self, row: Row) -> None:
        self.fold.take(row.asDict(recursive=True))

    def terminate(self) -> Iterator[tuple]:
        yield from self.fold.close()


class MergedSizes:
    """What each lane's findings come to once merged: how many, and the steps and classes of all."""

    def __init__(self):
        self.at, self.fold = None, None

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for part in parts(rows, G.WALKED_ROWS):
            for lane, turn, title, lines, classes in zip(*(values(part.column(name)) for name in ("lane", "turn", "title", "lines", "classes"))):
                if self.fold is None or lane != self.at:
                    done += self._sizes()
                    self.at, self.fold = lane, G.SizesReplay()
                self.fold.take(turn, title, lines, classes)
        if done:
            yield _sizes_batch(done)

    def terminate(self) -> Iterator[pa.RecordBatch]:
        if self.fold:
            yield _sizes_batch(self._sizes())

    def _sizes(self) -> list[tuple]:
        return [(self.at, *self.fold.lane.sizes())] if self.fold else []


def _sizes_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("lane", pa.string()), *((name, pa.int64()) for name in ("findings", "steps", "classes"))]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))


chunk_plan, merge_findings = udtf(ChunkPlan), udtf(MergeFindings)
merged_sizes = arrow_udtf(MergedSizes, returnType="lane string, findings long, steps long, classes long")


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_plan", chunk_plan)
    spark.udtf.register("merge_findings", merge_findings)
    spark.udtf.register("merged_sizes", merged_sizes)
