"""Token budgets, costs and measured usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.rounding import half_up, total_or_null

PASS_MULTIPLIER = 4
TOKENS_PER_SECOND = 150
LEAST_SECONDS = 30
FOLLOW_UP_INPUT = 1.19
OUTPUT_PER_CALL = 718


def at_ranks(rows: DataFrame, value: str, shares: dict[str, float], ranges: int = 256) -> DataFrame:
    """One row: for each name the value at place floor(n * share) of the sorted ones, counted from 0."""
    return at_ranks_of(rows, {name: (value, share) for name, share in shares.items()}, ranges)


def at_ranks_of(rows: DataFrame, wanted: dict[str, tuple[str, float]], ranges: int = 256) -> DataFrame:
    """The same for names of (column, share), each by its column.

    Works on counts per distinct value, which are pre-aggregated and summed by ranges between quantiles; only the ranges
    that hold a place are ordered. All columns, of one numeric type, go through the same two passes. The driver sees the quantiles.
    """
    columns = list(dict.fromkeys(column for column, _ in wanted.values()))
    points = [i / ranges for i in range(1, ranges)]
    found = rows.select(*[F.percentile_approx(column, points, 100 * ranges).alias(f"c{i}") for i, column in enumerate(columns)]).first()
    at = F.lit(0)
    for i in range(len(columns)):
        if cuts := sorted(set(found[i] or [])):
            at = F.when(F.col("c") == i, F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("v")))).otherwise(at)
    values = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(column).alias("v")) for i, column in enumerate(columns)])))
    counts = values.groupBy("c", "v").agg(F.count("*").alias("n")).withColumn("_range", at)
    sums = counts.groupBy("c", "_range").agg(F.sum("n").alias("n"))  # at most `ranges` rows a column
    every = Window.partitionBy("c")
    sums = sums.select("c", "_range", F.sum("n").over(every.orderBy("_range")).alias("upto"), F.sum("n").over(every).alias("total"), "n")
    places = F.inline(F.array(*[F.struct(F.lit(columns.index(column)).alias("of"), F.lit(name).alias("name"), F.floor(F.col("total") * share).alias("place")) for name, (column, share) in wanted.items()]))
    met = sums.select("c", "_range", "upto", "n", places).where("of = c AND place >= upto - n AND place < upto")
    met = met.select("c", "_range", "name", (F.col("place") - F.col("upto") + F.col("n")).alias("left"))
    running = F.sum("n").over(Window.partitionBy("name").orderBy("v"))
    reached = counts.join(F.broadcast(met), ["c", "_range"]).withColumn("upto", running).where(F.col("upto") > F.col("left"))  # a row a name
    return reached.agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted])


def plan_by_size(lanes: DataFrame) -> DataFrame:
    """Ceilings per lane from seed_bytes, and a flag on the top quartile by bytes or by files."""
    ceiling = half_up(F.col("seed_bytes") / 4 * PASS_MULTIPLIER)
    bounds = at_ranks_of(lanes.select(F.col("seed_bytes").cast("long"), F.col("seed_files").cast("long")), {"_bytes": ("seed_bytes", 0.75), "_files": ("seed_files", 0.75)})
    return lanes.crossJoin(F.broadcast(bounds)).withColumns(  # one row
        {
            "token_ceiling": ceiling,
            "seconds_ceiling": F.greatest(F.lit(LEAST_SECONDS).cast("long"), half_up(ceiling / TOKENS_PER_SECOND)),
            "escalate": (F.col("seed_bytes") >= F.col("_bytes")) | (F.col("seed_files") >= F.col("_files")),
        }
    ).drop("_bytes", "_files")


def calls_per_chunk(mode: str, classes: Column, passes: int = 1, group: int = 3) -> Column:
    if mode == "none":
        return F.lit(1)
    return 1 + F.ceil(classes / group) if mode == "sweep" else F.lit(1 + passes)


def plan_by_lane(lanes: DataFrame, mode: str = "trace", boilerplate: int = 600, playbook: int = 1500, context: int = 200) -> DataFrame:
    """Projected calls and tokens per lane. The whole file's bytes are charged to every chunk."""
    per_chunk = half_up((F.lit(boilerplate + context) + F.col("n_classes") * playbook + F.col("bytes")) / 4)
    calls = calls_per_chunk(mode, F.col("n_classes"))
    per_call = per_chunk * calls if mode == "sweep" else per_chunk * (1 + (calls - 1) * F.lit(FOLLOW_UP_INPUT))
    return lanes.withColumns(
        {
            "projected_input": half_up(per_call * F.col("chunks")),
            "projected_calls": (calls * F.col("chunks")).cast("long"),
            "projected_output": half_up(calls * F.col("chunks") * OUTPUT_PER_CALL),
        }
    )


def cost(price: Column, prompt: Column, output: Column, cached: Column, written: Column) -> Column:
    """USD; cached and written tokens are parts of the prompt; null where there is no price."""
    cached = F.least(F.coalesce(cached, F.lit(0)), prompt)
    written = F.least(F.coalesce(written, F.lit(0)), prompt - cached)
    fresh = prompt - cached - written
    rate = lambda name: F.coalesce(price[name], price["input"])
    million = F.lit(1e6)
    return fresh / million * price["input"] + cached / million * rate("cached_input") + written / million * rate("cache_write") + output / million * price["output"]


def lane_totals(chunks: DataFrame) -> DataFrame:
    """Sums per lane; null as soon as one chunk was not measured."""
    return chunks.groupBy("lane_id").agg(*(total_or_null(F.col(name)).alias(name) for name in ("prompt_tokens", "completion_tokens")), F.count("*").alias("chunks"))


def attributed(segments: DataFrame, chunk: list[str], order: str = "pos") -> DataFrame:
    """Measured prompt tokens shared out over a chunk's segments by characters, rounded; the last segment takes what is left."""
    whole = Window.partitionBy(*chunk)
    walk = whole.orderBy(order)
    share = half_up(F.col("prompt_tokens") * (F.col("chars") / F.sum("chars").over(whole)))
    rows = segments.withColumn("_share", share).withColumn("_before", F.coalesce(F.sum("_share").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.lead(F.lit(1)).over(walk).isNull()
    measured = (F.coalesce("prompt_tokens", F.lit(0)) != 0) & (F.sum("chars").over(whole) != 0)
    value = F.when(measured, F.when(last, F.col("prompt_tokens") - F.col("_before")).otherwise(F.col("_share")))
    return rows.withColumn("derived_tokens", value).drop("_share", "_before")


def predicted_against_actual(lanes: DataFrame, by: list[str]) -> DataFrame:
    """Totals and accuracy over lanes that completed with a measurement."""
    done = lanes.where("completed AND actual IS NOT NULL")
    ratio = F.when(F.sum("predicted") > 0, F.sum("actual") / F.sum("predicted"))
    return done.groupBy(*by).agg(
        F.count("*").alias("lanes"),
        F.sum("predicted").alias("predicted"),
        F.sum("actual").alias("actual"),
        F.count_if(F.col("actual") > F.col("predicted")).alias("over"),
        F.count_if(F.col("actual") <= F.col("predicted")).alias("under"),
        ratio.alias("accuracy"),
    )


def size_buckets(files: DataFrame) -> DataFrame:
    """Files in five buckets bounded at the quartiles and the 90th percentile of hunted files, rounded up to KB."""
    shares = {"b25": 0.25, "b50": 0.5, "b75": 0.75, "b90": 0.9}
    places = at_ranks(files.where("NOT skipped"), "bytes", shares)
    bounds = places.select(*[(F.ceil(F.col(name) / 1024) * 1024).alias(name) for name in shares])
    with_bounds = files.crossJoin(F.broadcast(bounds))  # one row
    bucket = F.lit(0)
    for name in shares:
        bucket = bucket + F.when(F.col("bytes") >= F.col(name), 1).otherwise(0)
    return with_bounds.withColumn("bucket", bucket).drop(*shares)


#: Estimates of prompts: bytes of a line, of a line's number, of a section's heading, of a playbook.
PER_LINE, NUMBER, HEADING, PLAYBOOK = 40, 6, 10, 2263


def estimated_lines(size: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(size / PER_LINE))


def estimated_chunks(lines: Column, budget: int = 500, overlap: int = 20) -> Column:
    return F.when(lines <= budget, F.lit(1).cast("long")).otherwise(F.ceil((lines - budget) / (budget - overlap)) + 1)


def estimated_seed_bytes(size: Column, lines: Column, budget: int = 500, overlap: int = 20) -> Column:
    """Bytes of a file's numbered text in all of its chunks; 0 without lines. Chunks but the last are taken to be full."""
    chunks = estimated_chunks(lines, budget, overlap)
    last = F.greatest(F.lit(1).cast("long"), lines - (chunks - 2) * (budget - overlap) - overlap)
    many = (chunks - 1) * (budget * (PER_LINE + NUMBER) + HEADING) + last * (PER_LINE + NUMBER) + HEADING
    return F.when(lines <= 0, F.lit(0).cast("long")).when(chunks <= 1, size + lines * NUMBER + HEADING).otherwise(many)


def estimated_category_bytes(categories: Column) -> Column:
    return F.greatest(categories, F.lit(0)) * PLAYBOOK


def price_problems(prices: DataFrame) -> DataFrame:
    """Prices (model, input, cached_input, output, max_output_tokens) that a run must not start with, with the first problem of each."""
    problem = (
        F.when(F.col("input").isNull() | F.col("output").isNull(), "incomplete")
        .when((F.col("input") < 0) | (F.col("output") < 0) | (F.col("cached_input") < 0), "negative")
        .when(F.col("cached_input") > F.col("input"), "cached above fresh")
        .when(F.col("max_output_tokens") <= 0, "no output tokens")
    )
    return prices.withColumn("problem", problem).where("problem IS NOT NULL")


def bucket_costs(files: DataFrame, categories: int = 25, narrow: float = 1.5) -> DataFrame:
    """Input tokens of each size bucket, computed from its average file, with few and with all categories."""
    per_byte, fixed = 0.342, 3060
    groups = size_buckets(files).groupBy("bucket").agg(
        F.count_if(~F.col("skipped")).alias("hunted"), F.count_if("skipped").alias("skips"), F.sum(F.when(~F.col("skipped"), F.col("bytes"))).alias("hunt_bytes")
    )
    rows = groups.where("hunted > 0").withColumn("avg_bytes", F.floor(F.col("hunt_bytes") / F.col("hunted")))
    rows = rows.withColumn("avg_lines", estimated_lines(F.col("avg_bytes")))
    rows = rows.withColumn("avg_chunks", estimated_chunks(F.col("avg_lines")))
    seed = estimated_seed_bytes(F.col("avg_bytes"), F.col("avg_lines"))
    tokens = lambda k: (F.lit(float(fixed)) + seed + k * PLAYBOOK) * per_byte * F.col("hunted")
    return rows.withColumns({"narrow_input": tokens(narrow), "broad_input": tokens(float(categories))}).drop("hunt_bytes")
