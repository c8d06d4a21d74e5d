"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each whole text is reduced to a few transformed statistics. The class means and covariances are
sums over all labelled training rows, added up by Spark; the driver sees one row per class and
moment. Covariances are shrunk towards the pooled one and towards its diagonal, and their Cholesky
factors are kept; a score is the logistic function of the difference of the two log densities,
each from a Mahalanobis distance.

Labels, language, source and doc_id are never inputs of a score.

Defined results: very long texts are measured as a whole; null and empty texts have the statistics of an empty text and get a score like
any other; rows with equal or null doc_id are scored as rows of their own; labels other than 0 and
1, and null ones, are not learnt from, repeated ones count once, and a document with both labels counts
for both; where a class has no training row, every score is the share
of label 1 (0.5 without labels); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import common

N_FEATURES = 18
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 white space, 2 lower, 3 upper, 4 digit, 5 stop, 6 symbol, 7 beyond ASCII
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[44, 46]] = 5
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",."]] = 6
_CLASS[128:] = 7


#: Weights, in bytes, words and lines, with which every statistic is drawn to a usual value: those of a few words say little.
BYTES, WORDS, LINES = 100, 20, 5


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=8)
    n = len(data)
    words = text.split()
    n_words = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    share = counts[counts > 0] / max(1, n)
    lines = text.split("\n")
    drawn = lambda count, whole, usual, weight: float(np.sqrt((count + usual * weight) / (whole + weight)))
    mean = (lengths.sum() + 5.5 * WORDS) / (n_words + WORDS)
    spread = (((lengths - mean) ** 2).sum() + 9 * WORDS) / (n_words + WORDS)
    return np.array(
        [
            np.log(n + BYTES),
            np.log(mean),
            0.5 * np.log(spread),
            drawn(kinds[1], n, 0.16, BYTES),
            drawn(kinds[3], kinds[2] + kinds[3], 0.03, BYTES),
            drawn(kinds[4], n, 0.002, BYTES),
            drawn(kinds[5], n, 0.03, BYTES),
            drawn(kinds[6], n, 0.002, BYTES),
            drawn(kinds[7], n, 0.02, BYTES),
            drawn(counts[33], n, 0.0, BYTES),
            drawn(counts[124], n, 0.0, BYTES),
            drawn(counts[10], n, 0.004, BYTES),
            drawn(len(set(words)), n_words, 0.75, WORDS),
            drawn(len(set(lines)), len(lines), 0.95, LINES),
            drawn(np.count_nonzero(lengths <= 3), n_words, 0.35, WORDS),
            drawn(np.count_nonzero(lengths >= 16), n_words, 0.01, WORDS),
            float(4.2 * BYTES - n * (share * np.log2(share)).sum()) / (n + BYTES),
            drawn(counts.max(), n, 0.16, BYTES),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log normalisers of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    share: float | None = None

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(rows), self.share)
        density = [c - 0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def discriminant(moments: dict[int, np.ndarray], to_pooled: float = 0.1, to_diagonal: float = 0.05, ridge: float = 1e-4) -> Discriminant:
    """moments: for class 0 and 1 the count, the sums and the sums of products, one after another."""
    d = N_FEATURES
    counts = np.array([moments[k][0] if k in moments else 0.0 for k in (0, 1)])
    if counts.min() < 1:
        return Discriminant(np.empty(0), np.empty(0), np.empty(0), float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = np.stack([moments[k][1 : 1 + d] / moments[k][0] for k in (0, 1)])
    scatter = np.stack([moments[k][1 + d :].reshape(d, d) / moments[k][0] - np.outer(means[k], means[k]) for k in (0, 1)])
    pooled = np.tensordot(counts / counts.sum(), scatter, 1)
    factors, constants = [], []
    for k in (0, 1):
        cov = (1 - to_pooled) * scatter[k] + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + ridge * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.stack(factors), np.array(constants))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "x": [statistics(text) for text in batch["text"]]})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_or_empty(docs).alias("text"))
    return rows.mapInPandas(run, "doc_id long, x array<double>")


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from all labelled rows outside the held-out fold."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for label, rows in batch.groupby("quality"):
                x = np.stack(rows["x"].to_numpy())
                part = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                sums[label] = sums.get(label, 0) + part
        if sums:
            yield pd.DataFrame({"label": list(sums), "part": [list(v) for v in sums.values()]}).astype({"label": "int64"})

    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1)).distinct()
    training = stats.where(~is_held_out()).join(marked, "doc_id").select("quality", "x")
    parts = training.mapInPandas(moments, "label long, part array<double>").select("label", F.posexplode("part").alias("at", "value"))
    found: dict[int, np.ndarray] = {}
    for row in parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():  # 2 x 343 rows
        found.setdefault(row["label"], np.zeros(1 + N_FEATURES + N_FEATURES**2))[row["at"]] = row["value"]
    return discriminant(found)


def scorer(model: Discriminant):
    """A column function from text to score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.stack([statistics(text) for text in texts])))

    return score


def op2_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.checkpointed(with_statistics(common.documents(spark, sf_dir)))
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = model.score(np.stack(batch["x"].to_numpy()))
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores})

    scored = stats.select("doc_id", is_held_out().alias("held_out"), "x").mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
