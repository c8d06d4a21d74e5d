"""Token counts per section by offset-mapped attribution.

Each document is encoded once, as a whole. The ids' byte lengths give every token's span in the
UTF-8 text, and an interval join (binary search of the sorted token starts among the sorted
section bounds) hands each token to a section. A token that crosses a boundary is allocated by
`rule`:
  "start"     to the section that holds its first byte;
  "majority"  to the section that holds most of its bytes, the earlier one on a tie.
So the sections' counts add up to the document's.

Sections are given as an array of byte offsets at which each begins; the default is the lines of
the text, each with its newline. One pass over the input, no shuffle.

Defined results: null and empty texts have one section of zero tokens; very long texts are encoded as a whole, by
themselves; rows with equal or null doc_id are counted as rows of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftlake.llm import bpe, common

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(name, T.LongType()) for name in ("section", "start_byte", "end_byte", "n_tokens", "n_crossing", "doc_tokens")]
)

#: Characters of text whose sections are listed at a time; a longer text by itself.
PART_CHARS = 4 << 20


def line_starts(data: bytes) -> np.ndarray:
    """Byte offsets at which the lines of a text begin."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return np.concatenate([[0], ends[ends < len(data)]])


def attribute(starts: np.ndarray, token_lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross into another section."""
    ends = np.cumsum(token_lengths)
    begins = ends - token_lengths
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, ends - 1, side="right") - 1
    owner = first.copy()
    crossing = first != last
    if rule == "majority":
        for i in np.flatnonzero(crossing):
            bounds = np.clip(np.append(starts[first[i] : last[i] + 1], ends[i]), begins[i], ends[i])
            owner[i] = first[i] + int(np.argmax(np.diff(bounds)))
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def count_tokens(
    docs: DataFrame, rule: str = "start", sections: Callable[[bytes], np.ndarray] = line_starts, json_path: str | None = None, rank_path: str | None = None
) -> DataFrame:
    """One row per document and section."""
    if rule not in ("start", "majority"):
        raise ValueError(f"unknown rule {rule!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.load(json_path, rank_path)
        lengths = encoder.byte_lengths()
        for batch, begin, stop in ((b, *part) for b in batches for part in common.parts(b["text"].str.len().to_numpy(), PART_CHARS, 4096)):
            columns: list[list] = [[] for _ in SCHEMA.names]
            for doc_id, text in zip(batch["doc_id"][begin:stop], batch["text"][begin:stop], strict=True):
                data = text.encode()
                starts = sections(data)
                tokens = lengths[encoder.encode(text)]
                counts, crossing = attribute(starts, tokens, rule)
                n = len(starts)
                for column, values in zip(
                    columns, ([None if pd.isna(doc_id) else int(doc_id)] * n, range(n), starts, np.append(starts[1:], len(data)), counts, crossing, [len(tokens)] * n), strict=True
                ):
                    column.extend(values)
            frame = pd.DataFrame(dict(zip(SCHEMA.names, columns, strict=True)))
            yield frame.astype({name: "Int64" if name == "doc_id" else "int64" for name in SCHEMA.names})

    return docs.select("doc_id", common.text_or_empty(docs).alias("text")).mapInPandas(run, SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir))
