"""Removal of repeated byte strings by prefix-free parsing.

Every whole text, as UTF-8 bytes, is parsed into phrases at rolling-hash triggers: of each string
of `length` bytes the gram of `GRAM` bytes with the least rolling hash is its trigger, and all
strings with the same trigger form a phrase, which overlaps the next one. Equal strings have equal
triggers, so equal strings stand at the same place of phrases with the same trigger, and the parse
of a repeated passage repeats phrase for phrase.

1. Parse. An occurrence of a phrase that came before is repeated as a whole; one row per phrase
   settles all strings in it. Repeats within `FLUSH` phrases of a task are settled before the
   shuffle and neighbours among them joined to runs, so a passage that every document holds
   arrives once per so many phrases, and a periodic text arrives as a few rows.
2. Dictionary. The rows are dealt by trigger and sorted by phrase, document and start: the first of
   a phrase is its dictionary entry, the others are repeats. Entries that share a trigger with
   another entry may still share single strings with it; all others have none. A trigger with many
   different phrases (such as the edge of a line that a third of all documents hold) is dealt by
   phrase instead, so that no task gets all of its rows; a marker tells the trigger's own task.
3. Suffixes. The suffixes of the entries of a trigger are sorted by their first `length` bytes, which
   is the dictionary's suffix array as far as repeats of that length need it; equal ones stand in
   the order of the parse, which gives corpus order: all but the first of equal ones are repeats.
   The strings of triggers with more than `sorted_entries` entries are settled as phrases are, by 128-bit
   hashes of trigger, place and content, so no task gathers more than a bounded number.

Only strings of one length count here, so suffixes of different triggers are never compared and no
suffix array of the whole corpus is written. Triggers and whole phrases are told apart by 64-bit
hashes, the sorted suffixes by their bytes.

The bytes of all repeats are then removed in one join with the texts. Every Python step works on
slices of bounded size, however many rows a batch holds and however long a text is; beside a slice
it holds one text.

Defined results: null and empty texts, and texts shorter than `length`, lose nothing; null doc_ids
come first; rows with equal doc_id are documents of their own, in order of a 64-bit hash of their
text; rows equal in both are at the same place of the corpus, so neither repeats the other, and
they lose the same bytes; very long texts are parsed in segments, with the same result; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siftlake.llm import common
from siftlake.llm.fingerprint import mixed, prefix_hashes

GRAM = 32
#: Bytes of a text that are parsed at a time, phrases that are settled at a time, bytes of output at a time.
SEGMENT, FLUSH, SLICE = 1 << 18, 1 << 18, 1 << 21
#: A trigger with more phrases than that among those settled at a time is dealt by phrase.
CROWD = 8
#: A place is one number: start (34 bits), strings (14 bits), trigger's offset (14 bits). The text's hash is the column `tag`.
START, COUNT = 28, 14
UNITS = "k long, u long, doc_id long, tag long, place long, kind int"
#: Of a CROWDED row k is a hash of trigger and phrase, and u the trigger; of a REPEAT u is the number of bytes.
UNIT, REPEAT, SHARED, CROWDED = 0, 1, 2, 3
MARKER = -1


def parse(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a text: hash of the trigger, hash of the phrase, start, number of strings, offset of the trigger."""
    parts = list(parsed(data, length))
    if not parts:
        return tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def parsed(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """parse() of one segment after another."""
    span = length - GRAM + 1  # grams of a string
    if span < 1 or span >= 1 << COUNT:
        raise ValueError(f"length must be at least {GRAM} and below {(1 << COUNT) + GRAM - 1}")
    low = np.uint64((1 << 24) - 1)
    for begin in range(0, max(0, len(data) - length + 1), SEGMENT):
        own = data[begin : begin + SEGMENT + length - 1]
        sums, down = prefix_hashes(own)
        n_grams, n_strings = len(own) - GRAM + 1, len(own) - length + 1
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[:n_grams])
        least, width = (grams & ~low) | np.arange(n_grams, dtype=np.uint64), 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        trigger = (least[:n_strings] & low).astype(np.int64)
        starts = np.flatnonzero(np.diff(trigger, prepend=-1))
        ends = np.append(starts[1:], n_strings) + length - 1
        at = trigger[starts]
        phrase = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        yield grams[at], phrase, starts + begin, ends - starts - length + 1, at - starts


def tag_of(data: bytes) -> int:
    """Spark's xxhash64 of the text."""
    value = xxh64_intdigest(data, 42)
    return value - (1 << 64) if value >> 63 else value


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, tag, and the text as bytes."""
    text = common.text_or_empty(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 for null, and where they are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _settled_here(parts: list[tuple], docs: np.ndarray, none: np.ndarray, tags: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of some phrases: the first of each as UNIT or CROWDED, runs of the others as REPEAT."""
    g, u, start, count, offset, row = (np.concatenate(column) for column in zip(*parts, strict=True))
    by_row = np.lexsort((tags, docs, ~none))  # null doc_ids first
    rank = np.empty(len(docs), dtype=np.int64)
    rank[by_row] = np.cumsum(np.concatenate([[0], (docs[by_row[1:]] != docs[by_row[:-1]]) | (none[by_row[1:]] != none[by_row[:-1]]) | (tags[by_row[1:]] != tags[by_row[:-1]])]))
    order = np.lexsort((start, rank[row], u, g))
    g, u, start, count, offset, row = (column[order] for column in (g, u, start, count, offset, row))
    new_g = np.append(True, g[1:] != g[:-1])
    new = new_g | np.append(True, u[1:] != u[:-1])
    again = ~new & np.append(False, (rank[row[1:]] == rank[row[:-1]]) & (start[1:] == start[:-1]))  # a row of equal doc_id and text
    heads = np.flatnonzero(new_g)
    crowded = (np.add.reduceat(new.astype(np.int64), heads) > CROWD)[np.cumsum(new_g) - 1]

    def made(k, u, of, place, kind) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(k), 1 << 16):
            some = slice(at, at + (1 << 16))
            ids = pa.array(docs[of[some]], mask=none[of[some]])
            yield pa.RecordBatch.from_arrays([pa.array(k[some].view(np.int64)), pa.array(u[some].view(np.int64)), ids, pa.array(tags[of[some]]), pa.array(place[some]), pa.array(np.full(len(ids), kind, dtype=np.int32))], ["k", "u", "doc_id", "tag", "place", "kind"])

    place = (start << START) | (count << COUNT) | offset
    some = new & ~crowded
    yield from made(g[some], u[some], row[some], place[some], UNIT)
    some = new & crowded
    yield from made(mixed(g[some] ^ mixed(u[some])), g[some], row[some], place[some], CROWDED)
    marks = g[heads[crowded[heads]]]
    yield from made(marks, np.full(len(marks), -(1 << 63), dtype=np.int64), np.zeros(len(marks), dtype=np.int64), np.full(len(marks), MARKER), UNIT)
    some = np.flatnonzero(~new & ~again)
    some = some[np.lexsort((start[some], rank[row[some]]))]
    row, start, stop = row[some], start[some], start[some] + count[some] + length - 1
    first, last = _runs(rank[row], start, stop)
    yield from made(mixed(start[first].view(np.uint64) ^ mixed(tags[row[first]].view(np.uint64))), stop[last] - start[first], row[first], start[first] << START, REPEAT)


def _runs(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs that overlap or touch; given in order of group, start and stop."""
    if not len(start):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    breaks = np.flatnonzero((group[1:] != group[:-1]) | (start[1:] > stop[:-1])) + 1
    return np.append(0, breaks), np.append(breaks - 1, len(start) - 1)


def units(docs: DataFrame, length: int) -> DataFrame:
    """Phrases: the first of each among those settled at a time, and runs of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, none), (tags, _) = _longs(batch["doc_id"]), _longs(batch["tag"])
            held, n = [], 0
            for i, text in enumerate(batch["text"]):
                for part in parsed(np.frombuffer(text.as_buffer(), dtype=np.uint8), length):
                    held.append((*part, np.full(len(part[0]), i)))
                    n += len(part[0])
                    if n >= FLUSH:
                        yield from _settled_here(held, ids, none, tags, length)
                        held, n = [], 0
            if held:
                yield from _settled_here(held, ids, none, tags, length)

    return _rows(docs).mapInArrow(run, UNITS)


def settled(found: DataFrame, length: int) -> DataFrame:
    """Repeated phrases as REPEAT, with their bytes, and dictionary entries that share a trigger with another as SHARED."""
    n = common.shuffle_partitions(found.sparkSession)
    dealt = found.repartition(n, "k").sortWithinPartitions("kind", "k", "u", F.asc_nulls_first("doc_id"), "tag", "place")
    names = ["k", "doc_id", "tag", "place", "bytes", "kind"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # kind, k, phrase and place of the row before
        first = None  # the first entry of the trigger at hand, while it is the only one
        for batch in batches:
            given = batch[batch["kind"] == REPEAT]
            if len(given):
                yield given.assign(bytes=given["u"])[names]
            batch = batch[batch["kind"] != REPEAT].reset_index(drop=True)
            if not len(batch):
                continue
            of, k, u = batch["kind"].to_numpy(), batch["k"].to_numpy(), batch["u"].to_numpy()
            own = batch["doc_id"].astype("Int64")
            place = batch["place"].to_numpy()
            at = np.stack([own.fillna(0).to_numpy(dtype=np.int64), own.isna().to_numpy().astype(np.int64), batch["tag"].to_numpy(), place])
            new_k = np.append(last is None or of[0] != last[0] or k[0] != last[1], (of[1:] != of[:-1]) | (k[1:] != k[:-1]))
            new_u = new_k | np.append(last is None or u[0] != last[2], u[1:] != u[:-1])
            before = np.concatenate([at[:, :1] if last is None else last[3], at[:, :-1]], axis=1)
            again = ~new_u & (at == before).all(axis=0)  # a row of equal doc_id and text is at the same place
            group = np.cumsum(new_k)
            shared = np.zeros(group[-1] + 1, dtype=bool)
            shared[group[new_u & ~new_k]] = True
            kind = np.where(~new_u, REPEAT, np.where(shared[group] | (group == 0) | (of == CROWDED), SHARED, UNIT)).astype(np.int32)
            if first is not None and shared[0] and not new_k[0]:
                yield first.assign(kind=np.int32(SHARED))
                first = None
            kind[again | (place == MARKER)] = UNIT
            out = batch[["doc_id", "tag", "place"]].assign(k=np.where(of == CROWDED, u, k), bytes=((place >> COUNT) & ((1 << (START - COUNT)) - 1)) + length - 1, kind=kind)[names]
            heads = np.flatnonzero(new_k)
            if len(heads):
                only = not shared[group[heads[-1]]] and of[heads[-1]] == UNIT and place[heads[-1]] != MARKER
                first = out.iloc[[heads[-1]]] if only else None
            yield out[kind != UNIT]
            last = (of[-1], k[-1], u[-1], at[:, -1:])

    return dealt.mapInPandas(run, "k long, doc_id long, tag long, place long, bytes long, kind int")


def _by_document(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Texts with the marks of their doc_id and text as lists."""
    rows = _rows(docs)
    lists = marks.withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"})
    return rows.join(lists, rows["doc_id"].eqNullSafe(lists["_doc"]) & (rows["tag"] == lists["_tag"]), how).drop("_doc", "_tag")


def _places(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, and offset of the trigger."""
    return places >> START, (places >> COUNT) & ((1 << (START - COUNT)) - 1), places & ((1 << COUNT) - 1)


def _each(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at starts."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _entries(docs: DataFrame, marked: DataFrame, length: int) -> DataFrame:
    """The bytes of dictionary entries (k, doc_id, tag, place)."""
    lists = marked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("k", "place")).alias("marks")).select("doc_id", "tag", "marks.k", "marks.place")
    names = ["k", "doc_id", "tag", "place", "body"]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # rows of equal doc_id and text follow each other, and one is enough
        for batch in batches:
            rows, held = [], 0
            for doc_id, tag, text, keys, places in zip(*(batch[name] for name in ("doc_id", "tag", "text", "k", "place")), strict=True):
                doc_id, tag, data = doc_id.as_py(), tag.as_py(), memoryview(text.as_buffer())
                if (doc_id, tag) == last:
                    continue
                last = (doc_id, tag)
                for k, place in zip(keys.values.to_numpy().tolist(), places.values.to_numpy().tolist(), strict=True):
                    start, count = place >> START, (place >> COUNT) & ((1 << (START - COUNT)) - 1)
                    rows.append((k, doc_id, tag, place, bytes(data[start : start + count + length - 1])))
                    held += count + length + 200
                    if held >= SLICE:
                        yield frame(rows)
                        rows, held = [], 0
            if rows:
                yield frame(rows)

    return _by_document(docs, lists, "inner").mapInArrow(run, "k long, doc_id long, tag long, place long, body binary")


def _later_strings(group: np.ndarray, corpus: np.ndarray, place: np.ndarray, bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that an entry of the same group (trigger) holds earlier in the corpus: number of the entry, start and bytes.

    corpus: the entry's rank in the order of the parse. All suffixes are sorted by group, offset from
    the trigger and their first `length` bytes, equal ones in the order of the parse; all but the
    first of equal ones are repeats.
    """
    order = np.argsort(corpus, kind="stable")
    group, place, bodies = group[order], place[order], [bodies[i] for i in order]
    start, count, offset = _places(place)
    sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    at = _each(np.cumsum(sizes) - sizes, count)
    entry = np.repeat(np.arange(len(bodies)), count)
    within = at - np.repeat(np.cumsum(sizes) - sizes, count)
    table = np.empty((len(at), 6 + length), dtype=np.uint8)
    table[:, :4] = np.unique(group, return_inverse=True)[1].astype(">u4").view(np.uint8).reshape(-1, 4)[entry]
    table[:, 4:6] = (offset[entry] - within).astype(">u2").view(np.uint8).reshape(-1, 2)
    table[:, 6:] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(bodies), dtype=np.uint8), length)[at]
    suffixes = table.view(f"S{6 + length}")[:, 0].argsort(kind="stable")
    later = np.zeros(len(at), dtype=bool)
    for i in range(1, len(at), 1 << 14):
        some = suffixes[i - 1 : i + (1 << 14)]
        later[some[1:]] = (table[some[1:]] == table[some[:-1]]).all(axis=1)
    held = np.flatnonzero(later)  # strings of an entry stand together, in order
    begin = start[entry[held]] + within[held]
    first, last = _runs(entry[held], held, held + 1)
    return order[entry[held[first]]], begin[first], begin[last] - begin[first] + length


def _sorted_suffixes(entries: DataFrame, length: int, at_a_time: int = 1024) -> DataFrame:
    """Repeats among entries whose triggers have few entries: dealt and sorted by trigger, a few triggers at a time."""
    dealt = entries.repartition(common.shuffle_partitions(entries.sparkSession), "k").sortWithinPartitions("k", F.asc_nulls_first("doc_id"), "tag", "place")

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        entry, start, size = _later_strings(rows["k"].to_numpy(), np.arange(len(rows)), rows["place"].to_numpy(), list(rows["body"]), length)
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").iloc[entry].reset_index(drop=True), "tag": rows["tag"].to_numpy()[entry], "start": start, "bytes": size})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = held.drop_duplicates(["k", "doc_id", "tag", "place"], ignore_index=True)  # rows of equal doc_id and text
            k = held["k"].to_numpy()
            ends, begin = np.flatnonzero(k[1:] != k[:-1]) + 1, 0  # the last trigger may go on
            for end in ends[np.append(np.diff(ends // at_a_time) > 0, True)] if len(ends) else ends:
                yield solved(held.iloc[begin:end])
                begin = end
            held = held.iloc[begin:].reset_index(drop=True)
        if held is not None and len(held):
            yield solved(held)

    return dealt.mapInPandas(run, "doc_id long, tag long, start long, bytes long")


def _hashed_suffixes(entries: DataFrame, length: int) -> DataFrame:
    """The same among entries of any number: each string is settled as a phrase of its own, first within its task and then by hash, so
    one that all entries hold arrives once for so many of them, and nothing is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 4096):
                batch = whole.slice(part, 4096)
                (k, _), (ids, none), (tags, _), (place, _) = (_longs(batch[name]) for name in ("k", "doc_id", "tag", "place"))
                start, count, offset = _places(place)
                bodies = batch["body"].to_pylist()
                sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
                sums, down = prefix_hashes(np.frombuffer(b"".join(bodies), dtype=np.uint8))
                at = _each(np.cumsum(sizes) - sizes, count)
                entry = np.repeat(np.arange(len(bodies)), count)
                within = at - np.repeat(np.cumsum(sizes) - sizes, count)
                content = mixed((sums[at + length] - sums[at]) * down[at])
                other = mixed(k.view(np.uint64)[entry] ^ mixed((offset[entry] - within).astype(np.uint64)))
                yield from _settled_here([(content, other, start[entry] + within, np.ones_like(at), np.zeros_like(at), entry)], ids, none, tags, length)

    later = settled(entries.mapInArrow(run, UNITS), length).where(F.col("kind") == REPEAT)
    return later.select("doc_id", "tag", F.shiftright("place", START).alias("start"), "bytes")


def repeated_spans(docs: DataFrame, length: int = 100, sorted_entries: int = 4096) -> DataFrame:
    """doc_id, tag, and the start and bytes of the repeats of each text that has any, as two arrays.

    sorted_entries: triggers with more dictionary entries than that are not sorted in one task but
    settled string by string, by hash; the result is the same. All that needs the texts is one plan, which
    deals them out once.
    """
    marks = common.checkpointed(settled(units(docs, length), length).where(F.col("kind") != UNIT))
    found = marks.where(F.col("kind") == REPEAT).select("doc_id", "tag", F.shiftright("place", START).alias("start"), "bytes")

    shared = marks.where(F.col("kind") == SHARED).select("k", "doc_id", "tag", "place")
    many = common.checkpointed(shared.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > sorted_entries).select("k"))
    few = shared
    if not many.isEmpty():
        few = shared.join(many, "k", "left_anti")
        found = found.unionByName(_hashed_suffixes(_entries(docs, shared.join(many, "k", "left_semi"), length), length))
    found = found.unionByName(_sorted_suffixes(_entries(docs, few, length), length))
    lists = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "bytes")).alias("spans"))
    return lists.select("doc_id", "tag", "spans.start", "spans.bytes")


REMOVED = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def cut_repeats(docs: DataFrame, length: int = 100, sorted_entries: int = 4096) -> DataFrame:
    """Per document: n_bytes, the removed spans (start, stop), and the kept bytes."""

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), REMOVED, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "removed", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text, starts, sizes in zip(*(batch[name] for name in ("doc_id", "text", "start", "bytes")), strict=True):
                data = memoryview(text.as_buffer())
                removed = []
                if starts.is_valid:
                    start = starts.values.to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate((start + sizes.values.to_numpy())[order])
                    first, last = _runs(np.zeros(len(start)), start, stop)
                    removed = list(zip(start[first].tolist(), stop[last].tolist(), strict=True))
                edges = [0, *(edge for span in removed for edge in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id.as_py(), len(data), [{"start": a, "stop": b} for a, b in removed], kept))
                held += len(kept) + 200 * (1 + len(removed))
                if held >= SLICE:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    found = _by_document(docs, repeated_spans(docs, length, sorted_entries), "left")
    return found.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start: long, stop: long>>, kept binary")


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(common.documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, span: total + span["stop"] - span["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
