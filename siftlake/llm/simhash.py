"""SimHash near-dedup with vantage-point trees.

Texts are reduced to 64-bit fingerprints of their word shingles. Distinct fingerprints are dealt
to the shards of a vantage-point tree: at a node, a fingerprint within the node's radius of its
vantage point goes to the inner side, and one beyond radius - max_bits to the outer side, so those
near the boundary go to both and, by the triangle inequality, any two fingerprints within max_bits
of each other meet in a shard. The tree is built from a sample of the fingerprints, in proportion to
the shards wanted and at most `sample`; it only steers the dealing, so every fingerprint is compared
whatever the sample.

Each split sends a share of its rows to both sides, about a fifth where fingerprints are random, so
the rows dealt grow with the number of splits. Shards are therefore as large as a task holds with
ease, `MOST_SHARD` fingerprints of eight bytes, and smaller only as far as all tasks are to have work;
vantage points are chosen by what both sides will cost together.

A shard that holds more than `shard_rows` is split into blocks, and each pair of blocks becomes a
cell, so no task holds more than two blocks. Within a cell the tree goes on, down to leaves that
are compared pair by pair; only a spanning forest of the links leaves the task, never all pairs of
a group. Components are then found over the forest's edges (components.roots), and each document
gets the smallest doc_id of its component.

Defined results: very long texts are fingerprinted as a whole; null and empty texts have fingerprint zero and link like any other; rows with
equal doc_id are rows of their own; a null doc_id never names a component unless all its members
are null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import common
from siftlake.llm.components import roots

LEAF_PAIRS = 384
LEAST_SHARD, MOST_SHARD = 1 << 15, 1 << 22
COST = 1.3


def fingerprint(text: str, width: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 hashes."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z are changed, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    width = min(width, len(words))
    begin, end = starts[: len(words) - width + 1].tolist(), (starts[width:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, dtype=np.int64), len(begin)
    for at in range(0, n, 4096):
        hashes = np.array([digest(joined[b:e], 42) for b, e in zip(begin[at : at + 4096], end[at : at + 4096], strict=True)], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprint_column(width: int = 3):
    """A column function from text to fingerprint, as a signed long."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(text, width) for text in texts], dtype=np.uint64).view(np.int64))

    return made


class Tree:
    """Vantage points and radii of a binary tree in heap order; leaves have none."""

    def __init__(self, points: np.ndarray, max_bits: int, leaf_points: int, seed: int = 1):
        self.max_bits = max_bits
        self.nodes: dict[int, tuple[np.uint64, int]] = {}
        self.leaves: dict[int, int] = {}  # numbers of the leaves
        draw = np.random.default_rng(seed)
        waiting = [(1, points)]
        while waiting:
            at, own = waiting.pop()
            if len(own) > leaf_points and (node := best_node(own, max_bits, draw)):
                self.nodes[at] = node
                inner, outer = sides(own, node, max_bits)
                waiting += [(2 * at, own[inner]), (2 * at + 1, own[outer])]
            else:
                self.leaves[at] = len(self.leaves)

    def deal(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of the leaves and the places of the points that go there."""
        waiting = [(1, np.arange(len(points)))]
        while waiting:
            at, places = waiting.pop()
            if at in self.leaves:
                yield self.leaves[at], places
            elif len(places):
                inner, outer = sides(points[places], self.nodes[at], self.max_bits)
                waiting += [(2 * at, places[inner]), (2 * at + 1, places[outer])]


def sides(points: np.ndarray, node: tuple[np.uint64, int], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    distance = np.bitwise_count(points ^ node[0])
    return np.flatnonzero(distance <= node[1]), np.flatnonzero(distance.astype(np.int64) > node[1] - max_bits)


def best_node(points: np.ndarray, max_bits: int, draw: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and radius, of a few tried, whose sides cost least together; None if none leaves both sides smaller by a tenth.

    A side costs its size to the power of `COST`, so an overlap counts as well as the larger side.
    """
    some = points if len(points) <= 4096 else points[:: len(points) // 2048]
    best, least = None, np.inf
    for point in points[draw.integers(0, len(points), tries)]:
        inner = np.cumsum(np.bincount(np.bitwise_count(some ^ point), minlength=65)).astype(np.float64)
        outer = len(some) - np.concatenate([np.zeros(max_bits), inner[: 65 - max_bits]])
        cost = np.where(np.maximum(inner, outer) < 0.9 * len(some), inner**COST + outer**COST, np.inf)
        if cost.min() < least:
            best, least = (point, int(cost.argmin())), cost.min()
    return best


def united(tops: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each group once a and b are linked; tops: those before."""
    while True:
        one, other = tops[a], tops[b]
        apart = one != other
        if not apart.any():
            return tops
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        tops = tops.copy()
        np.minimum.at(tops, np.maximum(one, other), np.minimum(one, other))
        while not np.array_equal(tops, further := tops[tops]):
            tops = further


def forest(points: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct points: each point and a linked one that stands for its group."""
    tops = np.arange(len(points))
    for _, places in Tree(points, max_bits, LEAF_PAIRS).deal(points):
        own = points[places]
        for at in range(0, len(own), LEAF_PAIRS):
            some = own[at : at + LEAF_PAIRS]
            for other in range(at, len(own), LEAF_PAIRS):
                near = np.bitwise_count(some[:, None] ^ own[None, other : other + LEAF_PAIRS]) <= max_bits
                i, j = np.nonzero(near)
                tops = united(tops, places[at + i], places[other + j])
    moved = np.flatnonzero(tops != np.arange(len(points)))
    return points[moved], points[tops[moved]]


def links(prints: DataFrame, max_bits: int = 2, sample: int = 1 << 17, shard_rows: int | None = None) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links among distinct fingerprints `fp`.

    sample: most fingerprints, about, from which the tree is built. shard_rows: most rows of a block.
    """
    total = prints.count()
    if shard_rows is None:
        shard_rows = max(LEAST_SHARD, min(MOST_SHARD, total // 16))
    wanted = min(sample, max(1 << 14, 128 * total // shard_rows))
    drawn = prints.where(F.pmod(F.xxhash64("fp", F.lit(17)), F.lit(1 << 32)) < min(1.0, wanted / max(1, total)) * (1 << 32))
    points = np.sort(drawn.select("fp").toArrow()["fp"].to_numpy().astype(np.int64)).view(np.uint64)  # about `wanted` numbers
    leaf_points = max(16, math.floor(0.75 * len(points) * shard_rows / max(1, total)))
    tree = Tree(points, max_bits, leaf_points)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(dtype=np.int64)
            for leaf, places in tree.deal(fp.view(np.uint64)):
                if len(places):
                    yield pd.DataFrame({"leaf": leaf, "fp": fp[places]})

    shards = common.checkpointed(prints.select("fp").mapInPandas(dealt, "leaf long, fp long"))
    blocks = shards.groupBy("leaf").agg(F.ceil(F.count("*") / shard_rows).alias("blocks"))
    cells = shards.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("fp", F.lit(3)), "blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    cells = cells.select("leaf", F.explode(pair).alias("cell"), "fp").select("leaf", "cell.i", "cell.j", "fp")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(np.unique(group["fp"].to_numpy(dtype=np.int64).view(np.uint64)), max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return cells.groupBy("leaf", "i", "j").applyInPandas(linked, "a long, b long")


def near_components(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, body (a hash of the text), fp (the fingerprint as a signed long) and component_id."""
    made = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(common.text_or_empty(docs)).alias("body"), fingerprint_column(width)(common.text_or_empty(docs)).alias("fp"))
    prints = common.checkpointed(made)
    classes = common.checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = roots(links(classes, max_bits))
    named = classes.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "body", "fp", "component_id")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
