"""Runs of words that repeat with a period, found by a suffix automaton.

A run is a stretch of words of smallest period q, of at least `least` words and `times` periods, that no
neighbouring word extends. Of each text only the stretches that can hold one are looked at: in a
run, every `width` words in a row come again one period before or after, so words outside of such
rows are left out, again and again until nothing goes (`stretches`). That loses no run.

In a stretch, the states of the suffix automaton are gone through from the longest to the shortest, and
the ordered set of end positions of each is merged into that of its suffix link, the smaller set into the
larger one. Each end that came from a smaller set has new neighbours once the set is whole. If their distance is at most the
length of the state, the state's longest string and its copy touch or overlap: a square, whose period is
primitive, as a shorter one would have put another end between. Each square not yet covered by a run
of its period is extended to both sides as far as words one period apart are the same.

find_runs gives the runs of each text by start and period, and the text with every word dropped that lies in a run after
its first period. A text is worked on in one task, by itself; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; very long texts are worked on as a whole, in memory of
some 600 bytes for each word of the longest stretch that can hold a run; a null doc_id is
a document like any other, rows with equal doc_id or text are documents of their own; other columns are ignored, whatever
their names; an empty table gives no rows; runs of the same start are told apart by their period.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import common

LEAST, TIMES = 6, 4
#: How often a stretch is cut; cutting less costs time, not results.
ROUNDS = 24
_TIMES = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start: long, length: long, period: long>"
SCHEMA = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())])


def row_width(least: int, times: int) -> int:
    """The most words in a row of which every run holds each row twice, one period apart."""
    return min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))


def stretches(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Begin and end of the stretches that can hold a run, each run lying in one of them."""
    width = row_width(least, times)
    todo, out = [(0, len(ids), 0)], []
    while todo:
        begin, end, turn = todo.pop()
        if end - begin < least:
            continue
        rows = np.zeros(end - begin - width + 1, dtype=np.uint64)
        for i in range(width):
            rows = rows * _TIMES + ids[begin + i : end - width + 1 + i]
        _, which, counts = np.unique(rows, return_inverse=True, return_counts=True)
        edges = np.flatnonzero(np.diff((counts[which] > 1).astype(np.int8), prepend=0, append=0))
        parts = [(begin + a, begin + b + width - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        if parts == [(begin, end)] or turn == ROUNDS:
            out += [(a, b) for a, b in parts if b - a >= least]
        else:
            todo += [(a, b, turn + 1) for a, b in parts]
    return out


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length, suffix link, and end of the prefix (-1 for clones) of each state of the suffix automaton."""
    follow: list[dict[int, int]] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for at, word in enumerate(ids):
        state = len(length)
        length.append(at + 1)
        link.append(0)
        end.append(at)
        follow.append({})
        p = last
        while p >= 0 and word not in follow[p]:
            follow[p][word] = state
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                follow.append(follow[q].copy())
                while p >= 0 and follow[p].get(word) == q:
                    follow[p][word] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[state] = q
        last = state
    return length, link, end


def squares(ids: list[int]) -> Iterator[tuple[int, int]]:
    """Period and last position of squares of primitive period, at least one in each run of two periods or more."""
    length, link, end = automaton(ids)
    # Ends are kept negative, as the prefix's own end, the lowest, then goes to the end of the list.
    ends: list[list[int] | None] = [[-e] if e >= 0 else [] for e in end]
    fresh: list[list[int] | None] = [None] * len(ends)
    for state in np.argsort(-np.array(length), kind="stable").tolist():
        own, reach = ends[state], length[state]
        for e in fresh[state] or ():  # all that its set will hold is there now
            at = bisect.bisect_left(own, e)
            if at and e - own[at - 1] <= reach:
                yield e - own[at - 1], -own[at - 1]
            if at + 1 < len(own) and own[at + 1] - e <= reach:
                yield own[at + 1] - e, -e
        parent = link[state]
        if parent > 0:
            large, small = ends[parent], own
            if len(large) < len(small):
                large, small = small, large
            for e in small:
                bisect.insort(large, e)
            ends[parent] = large
            fresh[parent] = small if fresh[parent] is None else fresh[parent] + small
        ends[state] = fresh[state] = None


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Start, length and period of the runs, by start and period."""
    known: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    found = []
    for period, last in squares(ids):
        starts, stops = known[period]
        at = bisect.bisect_right(starts, last) - 1
        if at >= 0 and last < stops[at]:
            continue
        begin, stop = last - 2 * period + 1, last + 1
        while begin and ids[begin - 1] == ids[begin - 1 + period]:
            begin -= 1
        while stop < len(ids) and ids[stop] == ids[stop - period]:
            stop += 1
        starts.insert(at + 1, begin + period)
        stops.insert(at + 1, stop)
        if stop - begin >= max(least, times * period):
            found.append((begin, stop - begin, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def runs_of_words(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), dtype=np.uint64, count=len(words))
    return sorted(
        ((begin + start, length, period) for begin, end in stretches(ids, least, times) for start, length, period in runs_of(ids[begin:end].tolist(), least, times)),
        key=lambda run: (run[0], run[2]),
    )


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words).decode()


def find_runs(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs and collapsed of each text; `prepare` may change a document's words before."""
    if least < 2 or times < 2:
        raise ValueError("runs of less than two words or two periods are not found by squares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            ids, rows = part.column("doc_id"), []
            for doc_id, text in zip(ids.to_pylist(), part.column("text").to_pylist(), strict=True):
                words = text.encode().split()
                if prepare is not None:
                    words = prepare(doc_id, words)
                found = runs_of_words(words, least, times)
                rows.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], collapsed(words, found)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, type=t) for c, t in zip(columns, _ARROW.types[1:], strict=True)]], schema=_ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).mapInArrow(run, SCHEMA)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's edit: the tail of about every tenth document repeats its first words."""
    number = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(common.documents(spark, sf_dir), planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
