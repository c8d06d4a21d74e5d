"""Near copies by an inverted join of signature coordinates, and their connected components.

The set of a text is its distinct shingles of `width` words. Each distinct text is a node with a signature of
`COORDINATES` minima, and is posted under each pair of a coordinate and its value. Two sets of a
similarity of `percent` or more agree on at least `least_matches` coordinates, but for a probability of `LOSS`.

Prefix: of its coordinates, rarest pairs first, a node needs to be met under so many only as leave one in common with every node
that it may match. Pairs that no other node has are the rarest and meet nobody, so a node with fewer
shared pairs than matches wanted drops out, and of the others the rarest shared pairs are kept.

Nodes under one pair form a crowd around its head, the node with most shared pairs, hence the least edited of
a family; crowds of the same head are one, so near copies are sent to one or a few crowds, not to one for each pair that
they share. Crowds are dealt to cells of about `CELL_BYTES` of text. In a cell the head is held against all members first.
From then on only nodes that no links connect yet are compared (skip): collisions are counted on one half of the coordinates, then on the
other where the threshold can still be met, and what is above it is confirmed on the full sets. A cell
returns the confirmed links that connect its nodes, fewer than it has nodes, so no group is ever
expanded into its pairs. A crowd larger than a cell is first held against its head in blocks; then the members
that no link connects with the head go to cells with each block. What a text is connected with does not depend on any of
this, as two linked texts are met in at least one cell and either linked or connected there already.

Defined results: words are split by ASCII white space and compared without regard to ASCII case; a text of fewer than `width`
words has one shingle of all its words; null and empty texts and those without words have an empty set, are
linked with nothing, equal ones included, and are kept; very long texts are compared as a whole; a null doc_id is the smallest of a
component only if no other is there; rows with equal doc_id or text are documents of their own, equal texts being
linked; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import common
from siftlake.llm.components import roots
from siftlake.llm.fingerprint import mixed, shingle_hashes

WIDTH, PERCENT = 3, 85
COORDINATES, HALF = 64, 32
LOSS = 2e-7
CELL_BYTES = 8 << 20
_draw = np.random.default_rng(12)
_FLIP, _TIMES = (_draw.integers(0, 2**64, COORDINATES, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def least_matches(percent: int, loss: float = LOSS) -> int:
    """The most matching coordinates that sets of this similarity miss with a probability of at most `loss`."""
    p, missed = percent / 100, 0.0
    for wanted in range(COORDINATES):
        missed += comb(COORDINATES, wanted) * p**wanted * (1 - p) ** (COORDINATES - wanted)
        if missed > loss:
            return max(1, wanted)
    return COORDINATES


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text.encode().lower().decode(), width))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper half of the least of each hash of the shingles."""
    least = np.full(COORDINATES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[at : at + 512, None] ^ _FLIP) * _TIMES).min(axis=0))
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """id, two hashes of the text, its length in bytes, the size of its set and its signature, null for an empty set."""
    kinds = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bytes", pa.int64()), ("n_shingles", pa.int64()), ("signature", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text"):
            sets = [shingle_set(text, width) for text in part.column("text").to_pylist()]
            made = pa.array([signature(s) if len(s) else None for s in sets], type=kinds.field("signature").type)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("id", "h1", "h2", "bytes")), pa.array([len(s) for s in sets], type=pa.int64()), made], schema=kinds)

    return hashed(docs, "text").mapInArrow(run, "id long, h1 long, h2 long, bytes long, n_shingles long, signature array<int>")


def hashed(docs: DataFrame, *more: str) -> DataFrame:
    text = common.text_or_empty(docs)
    columns = {"bytes": F.octet_length(text).cast("long"), "text": text}
    return docs.select(
        docs["doc_id"].cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(12), text).alias("h2"), *[columns[c].alias(c) for c in (["bytes", *more] if more else [])]
    )


def prefixes(nodes: DataFrame, wanted: int) -> DataFrame:
    """node, shared (how many of its pairs others have too) and keys, the rarest of them, for each node that may match another."""
    posted = nodes.where("signature IS NOT NULL").select("node", F.posexplode("signature").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("pairs"))
    size = F.size("pairs")
    kept = F.transform(F.slice("pairs", F.lit(1), size - wanted + 1), lambda pair: pair["key"])
    return shared.where(size >= wanted).select("node", size.alias("shared"), kept.alias("keys"))


def crowds(prefix: DataFrame) -> DataFrame:
    """head and node: who is to be compared around which head, the head itself included."""
    posted = common.checkpointed(prefix.select(F.explode("keys").alias("key"), "node", "shared"))
    heads = posted.groupBy("key").agg(F.max(F.struct("shared", F.xxhash64("node"), "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return posted.join(heads, "key").select(F.col("first.node").alias("head"), "node").distinct()


def confirmed(rows: pa.Table, width: int, percent: int, wanted: int) -> pa.Table:
    """Links that connect the nodes of a cell's crowds, as far as left ones are linked with right ones."""
    rows = rows.sort_by([("head", "ascending"), ("node", "ascending")])
    heads, nodes = rows["head"].to_numpy(), rows["node"].to_numpy()
    signatures = rows["signature"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    left, right = rows["left"].to_numpy(), rows["right"].to_numpy()
    texts, sets, links = rows["text"], {}, []
    for begin, end in zip(*(edges := np.flatnonzero(np.diff(heads, prepend=heads[0] - 1, append=heads[-1] + 1)), edges[1:]), strict=False):
        for at in range(begin, end):
            if nodes[at] not in sets:
                sets[nodes[at]] = shingle_set(texts[at].as_py(), width)
        crowd = Crowd(signatures[begin:end], [sets[n] for n in nodes[begin:end]], percent, wanted)
        first = np.flatnonzero(nodes[begin:end] == heads[begin])
        for x in [*first, *np.setdiff1d(np.flatnonzero(left[begin:end]), first)]:
            links += [(nodes[begin + x], nodes[begin + y]) for y in crowd.joined(x, np.flatnonzero(right[begin:end]))]
    return pa.table([pa.array([pair[i] for pair in links], type=pa.int64()) for i in (0, 1)], schema=_LINKS)


class Crowd:
    """Nodes with signatures and sets, and which of them are connected so far."""

    def __init__(self, signatures: np.ndarray, sets: list[np.ndarray], percent: int, wanted: int):
        self.signatures, self.percent, self.wanted = signatures, percent, wanted
        self.sizes = np.array(list(map(len, sets)))
        self.group = np.arange(len(sets))
        self._begins = np.cumsum(self.sizes) - self.sizes
        unique, self._flat = np.unique(np.concatenate(sets), return_inverse=True)
        self._mark = np.zeros(len(unique), dtype=bool)

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of a set with others."""
        own = self._flat[self._begins[x] : self._begins[x] + self.sizes[x]]
        self._mark[own] = True
        if 4 * len(others) > len(self.sizes):
            out = np.add.reduceat(self._mark[self._flat], self._begins, dtype=np.int64)[others]
        else:
            out = np.array([np.count_nonzero(self._mark[self._flat[self._begins[y] : self._begins[y] + self.sizes[y]]]) for y in others], dtype=np.int64)
        self._mark[own] = False
        return out

    def joined(self, x: int, others: np.ndarray) -> list[int]:
        """Those of the others that a link of x connects with it for the first time."""
        others = others[self.group[others] != self.group[x]]
        small, large = np.minimum(self.sizes[x], self.sizes[others]), np.maximum(self.sizes[x], self.sizes[others])
        others = others[100 * small >= self.percent * large]
        own = self.signatures[x]
        matches = (self.signatures[others, :HALF] == own[:HALF]).sum(axis=1)
        others, matches = others[ok := matches + COORDINATES - HALF >= self.wanted], matches[ok]
        others = others[matches + (self.signatures[others, HALF:] == own[HALF:]).sum(axis=1) >= self.wanted]
        if not len(others):
            return []
        shared = self.shared(x, others)
        near = others[100 * shared >= self.percent * (self.sizes[x] + self.sizes[others] - shared)]
        new = []
        for y in near.tolist():
            if self.group[y] != self.group[x]:
                self.group[self.group == self.group[y]] = self.group[x]
                new.append(y)
        return new


def linked(members: DataFrame, texts: DataFrame, width: int, percent: int, cell_bytes: int) -> DataFrame:
    """Links (a, b) that connect the nodes of crowds (head, node) as all of their links do."""
    wanted = least_matches(percent)
    sized = common.checkpointed(members.join(texts.select("node", "bytes"), "node"))
    totals = common.checkpointed(sized.groupBy("head").agg(F.sum("bytes").alias("total"), F.count("*").alias("n")))
    full = F.lit(cell_bytes)
    #: A member counts with its signature and objects too.
    weight = F.col("total") + 1024 * F.col("n")
    small, large = totals.where(weight <= full), common.checkpointed(totals.where(weight > full).withColumn("blocks", F.ceil(weight / full)))
    bins = 1 + (small.agg(F.sum(weight).alias("n")).first()["n"] or 0) // cell_bytes
    block = lambda node, n: F.pmod(F.xxhash64(node, F.lit(3)), n)

    def cells(rows: DataFrame) -> DataFrame:
        """Of rows (place, i, j, head, node, left, right)."""
        held = rows.join(texts.drop("bytes"), "node")
        return held.groupBy("place", "i", "j").applyInArrow(lambda table: confirmed(table, width, percent, wanted), "a long, b long")

    none, yes = F.lit(-1).cast("long"), F.lit(True)
    binned = sized.join(small, "head").select(F.pmod(F.xxhash64("head"), F.lit(bins)).alias("place"), none.alias("i"), none.alias("j"), "head", "node", yes.alias("left"), yes.alias("right"))
    found, _ = common.gathered(cells(binned))
    if large.isEmpty():
        return found
    held = common.checkpointed(sized.join(large, "head"))
    is_head = F.col("node") == F.col("head")
    own = F.when(is_head, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block("node", F.col("blocks"))))
    stars = held.select(F.col("head").alias("place"), F.explode(own).alias("i"), none.alias("j"), "head", "node", is_head.alias("left"), (~is_head).alias("right"))
    found, _ = common.gathered(found.unionByName(cells(stars)))
    labels = roots(found)
    label = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    known = held.join(label("node"), "node", "left").join(label("head"), "head", "left")
    known = common.checkpointed(known.withColumn("apart", F.coalesce("node_root", "node") != F.coalesce("head_root", "head")))
    rest = known.where("apart").groupBy("head").agg(F.ceil(F.sum(F.col("bytes") + 1024) / full).alias("lefts"))
    known = known.join(rest, "head")
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    columns = lambda i, j, left: [F.col("head").alias("place"), i.alias("i"), j.alias("j"), "head", "node", F.lit(left).alias("left"), F.lit(not left).alias("right")]
    lefts = known.where("apart").withColumn("j", F.explode(each("blocks"))).select(*columns(block("node", F.col("lefts")), F.col("j"), True))
    rights = known.withColumn("i", F.explode(each("lefts"))).select(*columns(F.col("i"), block("node", F.col("blocks")), False))
    return found.unionByName(common.gathered(cells(lefts.unionByName(rights)))[0])


def text_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Each distinct text by its hashes h1 and h2, with n_shingles, the first document of it and of its component (struct of none, id, h1, h2)."""
    first = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")
    merged = signed(docs, width).groupBy("h1", "h2").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c in ("bytes", "n_shingles", "signature")])
    nodes = common.checkpointed(merged.withColumn("node", F.monotonically_increasing_id()))
    members = common.checkpointed(crowds(prefixes(nodes, least_matches(percent))))
    needed = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "signature", "bytes", "first.id", "h1", "h2")
    texts = common.checkpointed(_texts_of(docs, needed))
    labels = roots(linked(members, texts, width, percent, cell_bytes))
    lowest = labels.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component"))
    return nodes.join(labels.join(lowest, "root").select("node", "component"), "node", "left").select("h1", "h2", "n_shingles", "first", F.coalesce("component", "first").alias("component"))


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """id, h1 and h2 of the documents that stay: the first of each component, a null id after all others. Here texts without words
    are copies of each other, as all of them but one are to go."""
    known = text_components(docs, width, percent, cell_bytes)
    none = known.where("n_shingles = 0").agg(F.min("first").alias("component")).where("component IS NOT NULL")
    return known.where("n_shingles > 0").select("component").distinct().unionByName(none).select("component.id", "component.h1", "component.h2")


def _texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """needed with the text of one document each."""
    own = needed.withColumnsRenamed({"id": "its_id", "h1": "its_h1", "h2": "its_h2"})
    rows = hashed(docs, "text").drop("bytes")
    same = (rows["h1"] == own["its_h1"]) & (rows["h2"] == own["its_h2"]) & rows["id"].eqNullSafe(own["its_id"])
    return rows.join(own, same).select("node", "signature", "bytes", "text").dropDuplicates(["node"])


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    known = text_components(docs, width, percent, cell_bytes)
    rows = hashed(docs).join(known, ["h1", "h2"])
    own: Column = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component.id"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def op12_near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(common.documents(spark, sf_dir))
