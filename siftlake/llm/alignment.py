"""Alignment of two tokenizers: where tokens of both end together, and how often their ids are linked.

Side A is a byte-level BPE over a space and the text, side B a sentencepiece model over the text, which adds that
space itself. Byte offsets at which a token of each side ends cut both into groups, and link the two tokens.

Both tokenizers cut at every space after a character that is no white space: no token of A and no
piece of B reaches over one (`Aligner` checks B's pieces, and encodes texts as a whole if one does). So
texts are cut there, and what the chunk of a word holds is kept for when the word comes again.

Rows are dealt to blocks, slices of a task's texts. A block's links are a posting list for each pair of ids: its
documents and how often each holds the pair. One pass writes the lists and the documents as a table, so nothing is encoded
twice. A pair's count is summed from sums per list. Lists and counts are then shuffled by B id to cells
of about `CELL` postings and met in a cogroup, which sorts and spills: a cell holds all pairs of its B
ids, so it finds counts and their maxima by itself, and emits what each document of its lists gets, which is
summed by document. B ids are dealt to `GROUPS` groups of about equal postings; a group of more than `CELL`
postings is split by block over several cells, each of which gets the group's counts. The
driver sees one number for each id of B's vocabulary.

Defined results: null and empty texts, and those whose tokens do not give back a space and the text, have
no tokens: all numbers 0, no groups; very long texts are a block each, encoded as a whole in one task; a null doc_id is a document like any other, and rows of
equal doc_id or text are documents of their own; ties for the highest count all count as best; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import bpe, common

GROUPS = 32
CELL = 2_000_000
#: Documents of a block, as bits of their number in it.
DOC_BITS = 12
ID_BITS = 20
#: Chunks that an aligner remembers before it starts anew.
KEPT = 200_000
SPACE = "▁"

ABOUT = "struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, groups: string>"
SCHEMA = f"block long, b int, a int, n long, held int, docs binary, counts binary, about array<{ABOUT}>"
_ABOUT = pa.struct([*((name, pa.int64()) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("groups", pa.string())])
_ARROW = pa.schema([("block", pa.int64()), ("b", pa.int32()), ("a", pa.int32()), ("n", pa.int64()), ("held", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("about", pa.list_(_ABOUT))])
SHARE = "block long, doc int, n_best long, count_sum long"
_SHARE = pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


#: The space between two chunks: one that follows a character other than white space.
BETWEEN = re.compile(r"(?<=\S) ")


class Aligner:
    """Encodes chunks, each once while it is remembered, and holds what was found under the chunk's number.

    n_a, n_b      tokens of each side; -1 where a side does not give the chunk back
    begin, links  where its links stand in `pairs`, pairs of ids with B above A, and how many they are
    groups        its groups as text
    """

    def __init__(self, json_path: str | None = None, rank_path: str | None = None, piece_path: str | None = None):
        import sentencepiece

        self._a = bpe.load(json_path, rank_path)
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path or bpe.vocabulary_path("piece_bpe_32k.model"))
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self._lengths = self._a.byte_lengths(), np.array(list(map(len, self._bytes)), dtype=np.int64)
        self._cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._lead = len(self._b.encode("a"))
        #: An id's text before another one of its group, and at the end of side A, then of side B.
        self._ids = max(map(len, self._lengths))
        self._texts = np.array([b"%d%c" % (i, end) for end in b",|;" for i in range(self._ids)], dtype=object)
        self._sizes = np.array(list(map(len, self._texts)), dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n_a = self.n_b = self.begin = self.links = self.pairs = np.empty(0, dtype=np.int64)
        self.groups: list[bytes] = []

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's chunks, in order. What is new among them is encoded in one go."""
        if len(self.known) > KEPT:
            self.forget()
        parts = [BETWEEN.split(text) if self._cuts else [text] for text in texts]
        new = list(dict.fromkeys(p for own in parts for p in own if p not in self.known))
        joined = [p for p in new if self._cuts and p and SPACE not in p and not p[-1].isspace()]
        if not self._learned(joined):
            joined = []
        for part in set(new).difference(joined):
            self._learned([part]) or self._put([part], [-1], [-1], [0], np.empty(0, dtype=np.int64), [b""])
        return [[self.known[p] for p in own] for own in parts]

    def _put(self, parts: list[str], n_a, n_b, links, pairs: np.ndarray, groups: list[bytes]) -> None:
        self.known.update(zip(parts, range(len(self.groups), len(self.groups) + len(parts)), strict=True))
        links = np.asarray(links)
        self.begin = np.concatenate([self.begin, len(self.pairs) + np.cumsum(links) - links])
        for name, values in (("n_a", n_a), ("n_b", n_b), ("links", links), ("pairs", pairs)):
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        self.groups += groups

    def _learned(self, parts: list[str]) -> bool:
        """Encode a space and each part, all after another; False, and nothing learned, where a side does not give that back."""
        if not parts:
            return True
        text = " ".join(parts)
        data = f" {text}".encode()
        ids_a = self._a.encode_plain(f" {text}").astype(np.int64)
        ids_b = np.array(self._b.encode(text) if text else self._b.encode("a ")[self._lead :], dtype=np.int64)
        if b"".join([self._bytes[i] for i in ids_b.tolist()]) != data:
            return False
        ends_a, ends_b = np.cumsum(self._lengths[0][ids_a]), np.cumsum(self._lengths[1][ids_b])
        if ends_a[-1] != len(data):
            return False
        in_a, in_b = (np.zeros(len(data) + 1, dtype=bool) for _ in range(2))
        in_a[ends_a], in_b[ends_b] = True, True
        last_a, last_b = np.flatnonzero(in_b[ends_a]), np.flatnonzero(in_a[ends_b])
        common, sizes = ends_a[last_a], np.array([len(p.encode()) + 1 for p in parts])
        cuts = np.cumsum(sizes)
        if not (in_a & in_b)[cuts].all():
            return False
        upto = lambda ends: np.diff(np.searchsorted(ends, cuts, side="right"), prepend=0)
        # Groups as text: of each group A's ids, then B's, each with what stands behind it.
        kind_a, kind_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        kind_a[last_a], kind_b[last_b] = 1, 2
        group = np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1])
        which = np.concatenate([kind_a * self._ids + ids_a, kind_b * self._ids + ids_b])[np.argsort(group, kind="stable")]
        blob = b"".join(self._texts[which].tolist())
        stops = np.cumsum(self._sizes[which])[np.cumsum(upto(ends_a) + upto(ends_b)) - 1].tolist()
        groups = [blob[i : j - 1] for i, j in zip([0, *stops], stops, strict=False)]
        self._put(parts, upto(ends_a), upto(ends_b), upto(common), ids_b[last_b] << ID_BITS | ids_a[last_a], groups)
        return True


def posted(batches: Iterator[pa.RecordBatch], aligner: Aligner, part_id: int, with_groups: bool = False) -> Iterator[pa.RecordBatch]:
    """For each slice of texts its posting lists, and one row of its documents."""
    for ordinal, part in enumerate(common.slices(batches, "text", rows=1 << DOC_BITS)):
        block, ids, texts = part_id << 32 | ordinal, part.column("doc_id").to_pylist(), part.column("text").to_pylist()
        numbers = aligner.numbers([text for text in texts if text])
        found, about, chunks = iter(numbers), [], []
        for doc, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            own = np.array(next(found) if text else [], dtype=np.int64)
            if not len(own) or aligner.n_a[own].min() < 0:
                about.append((doc_id, 0, 0, 0, 0, "", ""))
                continue
            n = int(aligner.links[own].sum())
            groups = b";".join([aligner.groups[i] for i in own.tolist()])
            about.append((doc_id, int(aligner.n_a[own].sum()), int(aligner.n_b[own].sum()), n, n, hashlib.sha256(groups).hexdigest(), groups.decode() if with_groups else ""))
            chunks.append(own << DOC_BITS | doc)
        if chunks:
            yield _lists(aligner, np.concatenate(chunks), block)
        rows = [dict(zip([f.name for f in _ABOUT], row, strict=True)) for row in about]
        yield pa.RecordBatch.from_pylist([{"block": block, "about": rows}], schema=_ARROW)


def _lists(aligner: Aligner, chunks: np.ndarray, block: int) -> pa.RecordBatch:
    """The posting lists of a block's chunks, each a chunk's number above that of its document."""
    chunks, times = np.unique(chunks, return_counts=True)
    number, doc = chunks >> DOC_BITS, chunks & ((1 << DOC_BITS) - 1)
    links = aligner.links[number]
    place = np.arange(links.sum()) + np.repeat(aligner.begin[number] - np.cumsum(links) + links, links)
    code, times = aligner.pairs[place] << DOC_BITS | np.repeat(doc, links), np.repeat(times, links)
    order = np.argsort(code, kind="stable")
    code, first = np.unique(code[order], return_index=True)
    times = np.add.reduceat(times[order], first)
    pair, begin = np.unique(code >> DOC_BITS, return_index=True)
    ends = np.append(begin, len(code))
    binary = lambda values: pa.Array.from_buffers(pa.binary(), len(pair), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])
    columns = [
        pa.array(np.full(len(pair), block)),
        pa.array((pair >> ID_BITS).astype(np.int32)),
        pa.array((pair & ((1 << ID_BITS) - 1)).astype(np.int32)),
        pa.array(np.add.reduceat(times, begin)),
        pa.array(np.diff(ends).astype(np.int32)),
        binary((code & ((1 << DOC_BITS) - 1)).astype("<u2")),
        binary(times.astype("<u4")),
        pa.nulls(len(pair), pa.list_(_ABOUT)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def dealt(held: dict[int, int], groups: int = GROUPS, cell: int = CELL) -> list[tuple[int, int, int]]:
    """B id, first cell and number of cells: ids in groups of about equal postings, as many cells a group as it fills."""
    heap, members = [(0, g) for g in range(groups)], [[] for _ in range(groups)]
    for b, n in sorted(held.items(), key=lambda item: (-item[1], item[0])):
        total, g = heapq.heappop(heap)
        members[g].append(b)
        heapq.heappush(heap, (total + n, g))
    out, first = [], 0
    for total, g in sorted(heap, key=lambda item: item[1]):
        cells = max(1, -(-total // cell))
        out += [(b, first, cells) for b in members[g]]
        first += cells
    return out


def shares(lists: pa.Table, counts: pa.Table) -> pa.Table:
    """What the documents of a cell's lists get: links of the highest count of their B id, and the counts of all links."""
    code = lambda t: t["b"].to_numpy().astype(np.int64) << ID_BITS | t["a"].to_numpy()
    pairs, n = code(counts), counts["n"].to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    if not lists.num_rows:
        return _SHARE.empty_table()
    _, first, side = np.unique(pairs >> ID_BITS, return_index=True, return_inverse=True)
    best = n == np.maximum.reduceat(n, first)[side]
    at = np.searchsorted(pairs, code(lists))
    blocks, block = np.unique(lists["block"].to_numpy(), return_inverse=True)
    held = lists["held"].to_numpy()
    joined = lambda name, kind: np.frombuffer(b"".join(lists[name].to_pylist()), dtype=kind).astype(np.int64)
    place, times = np.repeat(block << DOC_BITS, held) | joined("docs", "<u2"), joined("counts", "<u4")
    n_best, count_sum, there = (np.zeros(len(blocks) << DOC_BITS, dtype=np.int64) for _ in range(3))
    np.add.at(n_best, place, times * np.repeat(best[at], held))
    np.add.at(count_sum, place, times * np.repeat(n[at], held))
    there[place] = 1
    some = np.flatnonzero(there)
    return pa.table([blocks[some >> DOC_BITS], (some & ((1 << DOC_BITS) - 1)).astype(np.int32), n_best[some], count_sum[some]], schema=_SHARE)


def align(docs: DataFrame, with_groups: bool = False, groups: int = GROUPS, cell: int = CELL, paths: tuple[str | None, str | None, str | None] = (None, None, None)) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (the hash of the groups' text), and the text itself if asked for."""
    spark = docs.sparkSession
    folder = f"{common.checkpoint_dir(spark)}/alignment-{uuid.uuid4()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from posted(batches, Aligner(*paths), TaskContext.get().partitionId(), with_groups)

    docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text")).mapInArrow(run, SCHEMA).write.parquet(folder)
    table = spark.read.schema(SCHEMA).parquet(folder)
    lists = table.where("about IS NULL").drop("about")
    totals = common.checkpointed(lists.groupBy("b", "a").agg(F.sum("n").alias("n"), F.sum("held").alias("held")))
    by_side = {r["b"]: r["held"] for r in totals.groupBy("b").agg(F.sum("held").alias("held")).collect()}  # as many as B has ids
    cells = F.broadcast(spark.createDataFrame(dealt(by_side, groups, cell), "b int, first long, cells long"))
    own = lists.join(cells, "b").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("block"), F.col("cells")))
    counts = totals.join(cells, "b").select("b", "a", "n", F.explode(F.sequence("first", F.col("first") + F.col("cells") - 1)).alias("cell"))
    parts = own.select("cell", "block", "b", "a", "held", "docs", "counts").groupBy("cell").cogroup(counts.groupBy("cell")).applyInArrow(shares, SHARE)
    summed = parts.groupBy("block", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = table.where("about IS NOT NULL").select("block", F.posexplode("about").alias("doc", "row"))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    found = rows.join(summed, ["block", "doc"], "left").select(*[f"row.{name}" for name in kept], zero("n_best"), zero("count_sum"), "row.groups_sha256", *["row.groups"] * with_groups)
    found = common.checkpointed(found)
    common.removed(spark, folder)
    return found


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.documents(spark, sf_dir))
