"""Document fingerprints by consistent weighted sampling.

Terms are the shingles of five words (all words, where there are fewer), weighted by how often
they occur. For sample k each term of weight w draws r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from
its own hash and takes t = floor(ln w / r + b), a = c * exp(-r * (t - b + 1)); the term of least a
and its t are the sample (Ioffe's scheme). Two texts agree on a sample with a probability equal to
the generalised Jaccard similarity of their weighted terms. The draws come from two tables of
`TABLE_ROWS` rows, chosen by separate bits of the term's hash.

A fingerprint is `samples` four-digit hexadecimal numbers; likeness is the share of equal ones.

neighbour_fingerprints compares each text with the next document's in descending doc_id. The rows
are dealt to ranges of (doc_id, hash of the text), cut from a sample in proportion to the ranges, and
walked in order with one row of look-ahead; only the first row of each range is sent twice, to be the
look-ahead of the range before. The driver sees `SAMPLED` sampled pairs of numbers and one first row a
range. Many rows of one doc_id, null above all, are cut by their hash.

Defined results: null and empty texts have no terms: their fingerprint is of the empty set, all
equal; null doc_ids come last; equal doc_ids are ordered by a 64-bit hash of the text; very long texts
are fingerprinted as a whole, a block of terms at a time; other columns are ignored; one row is its
own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.llm import common

SHINGLE = 5
SAMPLES = 128
TABLE_ROWS = 8192
BLOCK = 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit hashes."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = {"up": powers(_BASE, 1 << 16), "down": powers(pow(_BASE, -1, 1 << 64), 1 << 16)}


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash modulo 2**64, and the powers that shift it back."""
    if len(data) + 1 > len(_powers["up"]):
        n = 2 * len(data)
        _powers.update(up=powers(_BASE, n), down=powers(pow(_BASE, -1, 1 << 64), n))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _powers["up"][: len(data)], out=sums[1:])
    return sums, _powers["down"]


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle of words, in order."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data].astype(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    sums, down = prefix_hashes(data)
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    width = min(width, len(words))
    up = _powers["up"]
    return mixed(sum(words[i : len(words) - width + 1 + i] * up[i + 1] for i in range(width)))


class WeightedSampler:
    def __init__(self, samples: int = SAMPLES, rows: int = TABLE_ROWS, seed: int = 42):
        draw = np.random.default_rng(seed)
        self.rows = np.uint64(rows - 1)
        self.log_c = np.log(draw.gamma(2.0, 1.0, (rows, samples))).astype(np.float32)
        self.r = draw.gamma(2.0, 1.0, (rows, samples)).astype(np.float32)
        self.b = draw.random((rows, samples)).astype(np.float32)
        self.one = self.r * (1 - self.b)  # r * (t - b + 1) for weight 1, where t is 0
        self.samples = samples

    def fingerprint(self, terms: np.ndarray) -> np.ndarray:
        """terms: hashes, repeats being weight."""
        best = np.full(self.samples, np.inf, dtype=np.float32)
        code = np.zeros(self.samples, dtype=np.uint64)
        unique, weight = np.unique(terms, return_counts=True)
        column = np.arange(self.samples)
        for begin in range(0, len(unique), BLOCK):
            hashes, w = unique[begin : begin + BLOCK], weight[begin : begin + BLOCK]
            i, j = (hashes & self.rows).astype(np.intp), ((hashes >> np.uint64(20)) & self.rows).astype(np.intp)
            a = self.log_c[i] - self.one[j]
            heavy = np.flatnonzero(w > 1)
            if len(heavy):
                r, b = self.r[j[heavy]], self.b[j[heavy]]
                t = np.floor(np.log(w[heavy]).astype(np.float32)[:, None] / r + b)
                a[heavy] = self.log_c[i[heavy]] - r * (t - b + 1)
            first = a.argmin(axis=0)
            least = a[first, column]
            better = least < best
            chosen = first[better]
            steps = np.zeros(len(chosen))
            many = w[chosen] > 1
            if many.any():
                rows, columns = j[chosen[many]], column[better][many]
                steps[many] = np.floor(np.log(w[chosen[many]]).astype(np.float32) / self.r[rows, columns] + self.b[rows, columns])
            best[better] = least[better]
            code[better] = mixed(hashes[chosen] + steps.astype(np.int64).astype(np.uint64) * np.uint64(_BASE))
        return (code >> np.uint64(48)).astype(">u2")


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float(np.count_nonzero(one == other)) / len(one)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of each whole text; one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = WeightedSampler(samples)
        for batch in batches:
            made = [sampler.fingerprint(shingle_hashes(text)).tobytes().hex() for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": made})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fingerprint string")


NEIGHBOUR_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


#: Sampled pairs a range, from which the ranges are cut.
SAMPLED = 64


def range_of(cuts: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of cuts (rows of key and hash, in descending key and ascending hash) that come before or at each pair."""
    down = -cuts[:, 0] - 1  # descending keys as ascending numbers, without overflow
    own = -keys - 1
    first, last = np.searchsorted(down, own, side="left"), np.searchsorted(down, own, side="right")
    for key in np.unique(keys[last > first]):  # keys at which a cut falls
        at = np.flatnonzero(keys == key)
        some = slice(first[at[0]], last[at[0]])
        first[at] += np.searchsorted(cuts[some, 1], hashes[at], side="right")
    return first


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, key, hash, range and spare: rows in ranges of descending doc_id; each range ends with spare rows, the
    first of the next range (the first range's, at the very end)."""
    text = common.text_or_empty(docs)
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), key.alias("key"), F.xxhash64(text).alias("hash"))
    share = min(1.0, SAMPLED * ranges / max(1, docs.count()))
    drawn = rows.where(F.pmod(F.xxhash64("key", "hash", F.lit(11)), F.lit(1 << 32)) < share * (1 << 32)).select("key", "hash").toArrow()
    some = np.stack([drawn["key"].to_numpy(), drawn["hash"].to_numpy()], axis=1).astype(np.int64)
    some = some[np.lexsort((some[:, 1], -some[:, 0] - 1))]
    places = np.unique(np.arange(1, ranges) * len(some) // ranges)
    cuts = np.unique(np.column_stack([-some[places, 0] - 1, some[places, 1]]), axis=0) if len(some) else np.empty((0, 2), dtype=np.int64)
    cuts[:, 0] = -cuts[:, 0] - 1

    @F.pandas_udf("int")
    def ranged(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(range_of(cuts, keys.to_numpy(), hashes.to_numpy()))

    first = rows.groupBy(ranged("key", "hash").alias("range")).agg(F.max(F.struct("key", F.bitwise_not("hash"))).alias("head")).select("range", "head.*").toArrow()
    found = sorted(zip(*(first.column(i).to_pylist() for i in range(3)), strict=True))  # one row a range
    head = np.full((len(cuts) + 1, 3), -1, dtype=np.int64)  # key, hash and the range before
    for i, (at, head_key, turned) in enumerate(found):
        head[at] = head_key, ~turned, found[i - 1][0]

    @F.pandas_udf("struct<range: int, spare: int>")
    def placed(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        k, h = keys.to_numpy(), hashes.to_numpy()
        at = range_of(cuts, k, h)
        is_head = (head[at, 0] == k) & (head[at, 1] == h)
        return pd.DataFrame({"range": at, "spare": pd.Series(head[at, 2]).where(pd.Series(is_head)).astype("Int64")})

    at = rows.withColumn("at", placed("key", "hash"))
    own = F.struct(F.col("at.range").alias("range"), F.lit(0).alias("spare"))
    twice = F.array(own, F.struct(F.col("at.spare").alias("range"), F.lit(1).alias("spare")))
    both = at.select("doc_id", "text", "key", "hash", F.explode(F.when(F.col("at.spare").isNull(), F.array(own)).otherwise(twice)).alias("to"))
    return both.select("doc_id", "text", "key", "hash", "to.range", "to.spare")


def neighbour_fingerprints(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    ranges = ranges or common.shuffle_partitions(docs.sparkSession)
    dealt = in_ranges(docs, ranges).repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "spare", F.desc("key"), "hash")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = WeightedSampler(samples)
        made = lambda text: sampler.fingerprint(shingle_hashes(text))
        waiting = None  # the last row, until its next is seen
        for batch in batches:
            rows = []
            for doc_id, text, at, spare in zip(batch["doc_id"], batch["text"], batch["range"], batch["spare"], strict=True):
                own = None
                if waiting is not None and waiting[0] == at:
                    own = made(text)
                    rows.append(compared(*waiting[1:], text, own, made))
                    waiting = None
                if not spare:
                    waiting = (at, doc_id, text, made(text) if own is None else own)
            frame = pd.DataFrame(rows, columns=NEIGHBOUR_SCHEMA.names)
            yield frame.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    return dealt.mapInPandas(run, NEIGHBOUR_SCHEMA)


def compared(doc_id, text: str, own: np.ndarray, following: str, following_print: np.ndarray, made) -> tuple:
    third = len(text) // 3
    edited = text[: len(text) - third] + following[:third]
    edited_print = made(edited)
    return (
        None if pd.isna(doc_id) else int(doc_id),
        len(text),
        hashlib.sha256(edited.encode()).hexdigest(),
        own.tobytes().hex(),
        edited_print.tobytes().hex(),
        likeness(own, edited_print),
        likeness(own, following_print),
    )


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(common.documents(spark, sf_dir))
