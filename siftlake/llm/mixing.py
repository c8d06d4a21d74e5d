"""Mixing sources to target weights by a low-discrepancy schedule.

A document's size is its number of words. Sources, in order of code point with null last, weigh
1, 2, 3, repeating, and share the words of the whole input; a target is capped at `cap` times its
source's size and the excess shared again by weight until none is above its cap.

Each source's documents are shuffled by hash and laid end to end, and the stream is cut into
blocks of equal words. The schedule is a sequence of slots: slot i stands at the golden-ratio
point i * phi mod 1, which falls to a source by the cumulative weights; the r-th slot of a source
takes its block r mod n, where n is the number of its blocks. Points of such a sequence fill every
interval evenly, so each source's count stays within a few slots of its share at every length.

Positions in a stream and ranks of slots are prefix sums in two levels (within chunks of bounded
size, then over the chunks), so that no task orders a whole source. Up to `max_sources` sources the
driver computes the targets and the sources' table is broadcast; more are numbered by ranges, get
their targets by sums over the table and their slots by a join on cells of the schedule's points, and
nothing of them but counts reaches the driver.

Defined results: null and empty texts have size 0 and none is taken of them; null is a source of
its own; rows with equal or null doc_id are rows of their own, and those of equal text too have one place in the order; a very
long text counts with all its words, of which some blocks may be taken more often than others; other columns are ignored; an empty
table gives no rows. Reruns agree: order and schedule depend on doc_id, size, source and a hash of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm import common

#: 2**64 divided by the golden ratio, odd.
GOLDEN = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"
SLOTS_A_CHUNK = 1 << 16
DOCS_A_CHUNK = 1024


def targets(sizes: list[int], weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> list[float]:
    """Words to take of each source."""
    out = [0.0] * len(sizes)
    left, free = float(sum(sizes)), list(range(len(sizes)))
    while free:
        total = sum(weights[i % len(weights)] for i in free)
        share = {i: left * weights[i % len(weights)] / total for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free = [i for i in free if share[i] <= cap * sizes[i]]
    return out


def golden_points(slots: np.ndarray) -> np.ndarray:
    """The points of slots as 64-bit fractions."""
    return slots.astype(np.uint64) * np.uint64(GOLDEN)


def ranked(slots: DataFrame, counts: DataFrame) -> DataFrame:
    """slot, ix and rank, from slots (chunk, ix, slot, within) and the number of slots of each chunk and source."""
    before = Window.partitionBy("ix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("chunk", "ix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Catalyst takes a map's output to be as small as its input, here a range of chunks, and would broadcast it.
    return slots.join(offsets.hint("merge"), ["chunk", "ix"]).select("slot", "ix", (F.col("offset") + F.col("within")).alias("rank"))


def schedule(spark: SparkSession, shares: list[float], n_slots: int) -> DataFrame:
    """slot, ix (the source's number) and rank of the slot among its source's."""
    ends = np.cumsum(np.asarray(shares, dtype=np.float64) / sum(shares))
    bounds = np.array([min((1 << 64) - 1, int(end * 2**64)) for end in ends[:-1]], dtype=np.uint64)
    chunks = spark.range(0, -(-n_slots // SLOTS_A_CHUNK)).withColumnRenamed("id", "chunk")

    def sources(chunk: int) -> np.ndarray:
        begin = chunk * SLOTS_A_CHUNK
        return np.searchsorted(bounds, golden_points(np.arange(begin, min(begin + SLOTS_A_CHUNK, n_slots))), side="right")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in batch["chunk"]:
                counts = np.bincount(sources(chunk), minlength=len(shares))
                ix = np.flatnonzero(counts)
                yield pd.DataFrame({"chunk": chunk, "ix": ix, "n": counts[ix]})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk in batch["chunk"]:
                ix = sources(chunk)
                slots = pd.DataFrame({"slot": chunk * SLOTS_A_CHUNK + np.arange(len(ix)), "chunk": chunk, "ix": ix})
                slots["within"] = slots.groupby("ix").cumcount()
                yield slots

    return ranked(chunks.mapInPandas(numbered, "slot long, chunk long, ix long, within long"), chunks.mapInPandas(counted, "chunk long, ix long, n long"))


def joined_schedule(known: DataFrame, n_slots: int, cell_rows: int = 4096) -> DataFrame:
    """The same for any number of sources (ix, share): points and the sources' intervals meet in cells, where each point takes the
    last interval that begins before it."""
    spark = known.sparkSession
    chunk = F.expr("ix div 65536")
    whole = known.agg(F.sum("share").alias("share"), F.count("*").alias("n")).first()
    cells = 1 + (n_slots + whole["n"]) // cell_rows
    running = lambda *by: Window.partitionBy(*by).orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy(chunk.alias("chunk")).agg(F.sum("share").alias("share"))  # a row for 65,536 sources
    sums = sums.select("chunk", F.coalesce(F.sum("share").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    laid = known.withColumn("chunk", chunk).join(sums, "chunk").withColumn("start", F.col("before") + F.coalesce(F.sum("share").over(running("chunk")), F.lit(0.0)))
    cell = lambda point: F.least(F.floor(point * cells), F.lit(cells - 1)).cast("long")
    laid = laid.where("share > 0").select("ix", (F.col("start") / whole["share"]).alias("start"), ((F.col("start") + F.col("share")) / whole["share"]).alias("stop"))
    begins = laid.select("ix", "start", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop")))).alias("cell"))
    begins = begins.select("cell", F.greatest("start", F.col("cell") / cells).alias("point"), F.lit(-1).cast("long").alias("slot"), "ix")

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots = batch["slot"].to_numpy()
            yield pd.DataFrame({"slot": slots, "point": (golden_points(slots) >> np.uint64(11)) / 2.0**53})

    drawn = spark.range(0, n_slots).toDF("slot").mapInPandas(points, "slot long, point double")
    rows = drawn.select(cell(F.col("point")).alias("cell"), "point", "slot", F.lit(None).cast("long").alias("ix")).unionByName(begins)
    last = F.last("ix", ignorenulls=True).over(Window.partitionBy("cell").orderBy("point", "slot", "ix").rowsBetween(Window.unboundedPreceding, 0))
    slots = common.checkpointed(rows.withColumn("ix", last).where("slot >= 0").select("slot", "ix", F.expr(f"slot div {SLOTS_A_CHUNK}").alias("chunk")))
    within = F.row_number().over(Window.partitionBy("ix", "chunk").orderBy("slot")) - 1
    return ranked(slots.withColumn("within", within.cast("long")), slots.groupBy("chunk", "ix").agg(F.count("*").alias("n")))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    size = size_of(docs["text"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), F.xxhash64(common.text_or_empty(docs)).alias("body"))


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Sources with their place `ix` in order of code point, null last, for any number of them."""
    n = common.shuffle_partitions(sources.sparkSession)
    ordered = F.asc_nulls_last("source")
    placed = common.checkpointed(sources.repartitionByRange(n, ordered).sortWithinPartitions(ordered).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(max(counts, default=0) + 1)])]).tolist()
    return placed.withColumn("ix", F.get(F.array(*map(F.lit, before)), part.cast("int")) + within).drop("at")


def joined_targets(sources: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """targets() for any number of numbered sources: the level, words a weight, rises until no source is newly above its cap."""
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("ix") % len(weights)).cast("int"))
    rows = sources.withColumn("weight", weight)
    total = float(rows.agg(F.sum("size").alias("n")).first()["n"] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap * F.col("size")
        now = rows.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, cap * F.col("size"))), F.lit(0.0)).alias("words"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("free")).first()
        if now["n"] == capped or not now["free"]:
            break
        level, capped = (total - now["words"]) / now["free"], now["n"]
    return rows.withColumn("target", F.when(over, cap * F.col("size")).otherwise(F.lit(level) * F.col("weight")).cast("double")).drop("weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 1024, least_slots: int = 256, max_sources: int = 100_000) -> DataFrame:
    """Per document: source, size, source_size, target and taken.

    block_words: most words of a block; sources with a small target get smaller blocks, so that
    `least_slots` slots make it up and the target is still met closely. max_sources: above that many
    sources the same is done by joins instead of on the driver.
    """
    spark = docs.sparkSession
    sized = common.checkpointed(sized_documents(docs))
    sources = common.checkpointed(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")))
    few = sources.count() <= max_sources
    if few:
        rows = sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))  # at most max_sources rows
        goal = targets([r["size"] for r in rows], weights, cap)
        aimed = spark.createDataFrame([(*r, i, t) for i, (r, t) in enumerate(zip(rows, goal, strict=True))], "source string, size long, docs long, ix long, target double")
    else:
        aimed = joined_targets(numbered_sources(sources), weights, cap)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.expr(f"cast(floor(target) as long) div {least_slots}"))).cast("int")
    known = aimed.withColumn("block_words", block).select(
        "source",
        "ix",
        F.col("size").alias("source_size"),
        "target",
        "block_words",
        F.expr("(size + block_words - 1) div block_words").alias("n_blocks"),
        F.expr(f"(docs + {DOCS_A_CHUNK - 1}) div {DOCS_A_CHUNK}").alias("n_chunks"),
        (F.col("target") / F.col("block_words")).alias("share"),
    )
    known = F.broadcast(known) if few else common.checkpointed(known)  # few: at most max_sources rows
    named = sized.join(known.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    empty = named.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    n_slots = round(known.agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("n")).first()["n"])
    if not n_slots:
        return empty

    shuffled = named.where("size > 0").withColumn("place", F.xxhash64("doc_id", "size", "body", F.lit("mix"))).withColumn("chunk", F.pmod("place", "n_chunks"))
    before = Window.partitionBy("ix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = shuffled.groupBy("ix", "chunk").agg(F.sum("size").alias("words"))
    chunks = chunks.select("ix", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_start"))
    within = Window.partitionBy("ix", "chunk").orderBy("place", "doc_id", "size", "body").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("chunk_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    laid = shuffled.join(chunks, ["ix", "chunk"]).withColumn("start", start)
    pieces = laid.withColumn("block", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest("start", F.col("block") * F.col("block_words"))

    if few:
        slots = schedule(spark, [r["share"] for r in known.orderBy("ix").collect()], n_slots)
    else:
        slots = joined_schedule(known.select("ix", "share"), n_slots)
    slots = slots.join(known.select("ix", "n_blocks"), "ix").where("n_blocks > 0")
    times = slots.where(F.col("rank") < cap * F.col("n_blocks")).groupBy("ix", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count("*").alias("times"))
    taken = pieces.join(times.hint("merge"), ["ix", "block"], "left").withColumn("taken", words * F.coalesce("times", F.lit(0)))
    full = taken.groupBy("doc_id", "source", "size", "source_size", "target", "ix", "start").agg(F.sum("taken").cast("long").alias("taken"))
    return full.select("doc_id", "source", "size", "source_size", "target", "taken").unionByName(empty)


def op3_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
