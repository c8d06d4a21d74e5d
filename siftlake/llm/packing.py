"""Packing by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and a closing id 1. Full windows are cut off its start; what
remains is cut into parts of at most `part_tokens`, and the parts of `group_docs` documents at a
time are dealt to windows by multiway differencing: partial partitions with opposing imbalances
are merged, largest spread first, which gives near-equal windows. The window count starts at the
least possible and rises until no window exceeds the capacity.

No row leaves its task: a group is a run of documents of one input partition, so there is no
shuffle, memory is bounded by one group, and a lost task is simply run again with the same
result. Sequence ids are unique: the partition's number in the high bits, a counter in the low.

Defined results: very long texts are encoded as a whole and cut into many pieces; null and empty texts are the closing id alone; rows with equal or null doc_id are
packed as rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftlake.llm import bpe, common

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(name, T.LongType()) for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
    ]
)
CLOSING = (1).to_bytes(4, "little")


def difference_partition(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Deal items to at most `windows` sets with near-equal sums: (sum, item numbers) per set."""
    tie = itertools.count()
    # A partition is its sets in ascending order of sum; sets that are empty are left out.
    heap = [(-size, next(tie), [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, first = heapq.heappop(heap)
        _, _, second = heapq.heappop(heap)
        shared = len(first) + len(second) - windows
        if shared <= 0:
            merged = first + second
        else:
            # The largest sets of one meet the smallest of the other; the rest meet empty sets.
            low, high = (first, second) if len(first) <= len(second) else (second, first)
            meet = high[:shared]
            other = low[::-1][len(low) - shared :]
            merged = low[shared:] + high[shared:]
            merged += [(a + b, x + y) for (a, x), (b, y) in zip(meet, other, strict=True)]
        merged.sort(key=lambda part: part[0])
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, next(tie), merged))
    return heap[0][2] if heap else []


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each window; no window exceeds the capacity."""
    windows = -(-sum(sizes) // capacity)
    while True:
        dealt = difference_partition(sizes, windows)
        if not dealt or dealt[-1][0] <= capacity:
            return [items for _, items in dealt]
        windows += max(1, windows // 256)


def pack(
    docs: DataFrame, capacity: int = 2048, part_tokens: int = 512, group_docs: int = 1024, json_path: str | None = None, rank_path: str | None = None
) -> DataFrame:
    """One row per piece of a document: where it stands there and in its sequence."""
    if not 0 < part_tokens <= capacity:
        raise ValueError("part_tokens must be between 1 and capacity")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.load(json_path, rank_path)
        sequence = itertools.count(TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        parts: list[tuple] = []
        held = 0

        def deal() -> None:
            for items in pack_group([part[2] for part in parts], capacity):
                number, offset = next(sequence), 0
                for i in sorted(items):
                    rows.append((*parts[i], number, offset))
                    offset += parts[i][2]
            parts.clear()

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ids = encoder.encode(text).tobytes() + CLOSING
                total = len(ids) // 4
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, next(sequence), 0))
                for start in range(full, total, part_tokens):
                    length = min(part_tokens, total - start)
                    parts.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
                held += 1
                if held == group_docs:
                    deal()
                    held = 0
            yield _frame(rows)
            rows.clear()
        deal()
        yield _frame(rows)

    return docs.select("doc_id", common.text_or_empty(docs).alias("text")).mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=SCHEMA.names)
    return frame.astype({name: "Int64" if name == "doc_id" else "int64" for name in SCHEMA.names})


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
