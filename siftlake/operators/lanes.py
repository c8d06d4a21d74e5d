"""Work lanes: which files are hunted, for which classes, in which chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.operators.ranking import first_of_group

LINE_BUDGET, OVERLAP = 2000, 20


def disposition(files: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """hunt or skip, with the reason: denied files, then non-executable languages; unknown ones are hunted."""
    rows = files
    flag = F.lit(False)
    if denied is not None:
        rows = rows.join(denied.select("path").distinct().withColumn("_denied", F.lit(True)), "path", "left")
        flag = F.coalesce("_denied", F.lit(False))
    skipped = F.coalesce(F.col("language").isin(dims.NON_EXECUTABLE), F.lit(False))
    out = rows.withColumns(
        {
            "disposition": F.when(flag | skipped, "skip").otherwise("hunt"),
            "skip_reason": F.when(flag, "deny-listed").when(skipped, F.concat(F.lit("no executable logic: "), F.col("language"))),
        }
    )
    return out.drop("_denied")


def ledger(lanes: DataFrame) -> DataFrame:
    """One row: every file of the inventory is hunted or skipped."""
    counts = lanes.agg(F.count("*").alias("total"), F.count_if(F.col("disposition") == "hunt").alias("hunt"), F.count_if(F.col("disposition") == "skip").alias("skip"))
    return counts.withColumn("unaccounted", F.col("total") - F.col("hunt") - F.col("skip"))


def with_classes(signals: DataFrame) -> DataFrame:
    """Classes of each file: the floor and those of its signals, sorted. The table of signals is fixed, so it is a literal map."""
    pairs = [x for signal, names in dims.SIGNAL_CLASSES.items() for x in (F.lit(signal), F.array(*map(F.lit, names)))]
    implied = F.flatten(F.transform("signals", lambda s: F.coalesce(F.try_element_at(F.create_map(*pairs), s), F.array().cast("array<string>"))))
    return signals.withColumn("classes", F.array_sort(F.array_union(F.array(*map(F.lit, dims.FLOOR_CLASSES)), implied)))


def chunks(files: DataFrame, budget: int = LINE_BUDGET, overlap: int = OVERLAP, lines: str = "lines") -> DataFrame:
    """Overlapping line ranges that cover each file: index, start_line, end_line. A file without lines has one empty chunk."""
    n, step = F.col(lines), budget - overlap
    count = F.when(n <= budget, 1).otherwise(F.ceil((n - budget) / step).cast("int") + 1)
    rows = files.withColumn("index", F.explode(F.sequence(F.lit(1), count)))
    start = F.when(n <= 0, 0).otherwise((F.col("index") - 1) * step + 1)
    return rows.withColumns({"start_line": start, "end_line": F.when(n <= 0, 0).otherwise(F.least(n, (F.col("index") - 1) * step + budget))})


def lane_ids(lanes: DataFrame, order: list[str], after: DataFrame | int = 0, prefix: str = "file-", buckets: int = 256) -> DataFrame:
    """lane_id numbered in order, from `after` + 1 (or from the highest id of a table of lanes), at least four digits wide.

    Numbering is in two levels, within ranges of the order and over the ranges, so no task holds
    all lanes. The ranges are quantiles of the first column of the order, which must be a number.
    """
    first = F.col(order[0])
    cuts = lanes.select(F.percentile_approx(first, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0]  # at most `buckets` numbers
    cuts = sorted(set(cuts or []))
    ranged = lanes.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < first)) if cuts else F.lit(0))
    start = F.lit(after) if isinstance(after, int) else None
    if start is None:
        highest = after.agg(F.coalesce(F.max(F.regexp_extract("lane_id", "([0-9]+)$", 1).cast("long")), F.lit(0)).alias("_after"))
        ranged, start = ranged.crossJoin(F.broadcast(highest)), F.col("_after")  # one row
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_range", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))  # at most `buckets` rows
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    number = (within + F.col("_before") + start).cast("string")
    named = ranged.join(before, "_range").withColumn("lane_id", F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.length(number), F.lit(4)), "0")))
    return named.drop("_range", "_before", "_after")


def pending(lanes: DataFrame, consumption: DataFrame, most: int | None = None, order: str = "ord") -> DataFrame:
    """Lanes that no successful report covers; failed ones are retried. `most` bounds one pass."""
    done = consumption.where(~F.col("failed")).select("lane_id").distinct()
    left = lanes.where("disposition = 'hunt'").join(done, "lane_id", "left_anti")
    return left.orderBy(order).limit(most) if most else left


def class_groups(lanes: DataFrame, size: int) -> DataFrame:
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("classes") - 1) / size).cast("int")), lambda i: F.slice("classes", i * size + 1, size))
    return lanes.withColumn("groups", groups)


def planned(lanes: DataFrame, plan: DataFrame) -> DataFrame:
    """Lanes with the columns of their budget plan (lane_id, ...); `unplanned` ones are skipped by a run."""
    known = plan.withColumn("_planned", F.lit(True))
    return lanes.join(known, "lane_id", "left").withColumn("unplanned", F.col("_planned").isNull()).drop("_planned")


def escalations(lanes: DataFrame, found: DataFrame) -> DataFrame:
    """Lanes with `found`, the findings (lane_id, found) of the first phase, 0 where there are none."""
    return lanes.join(found.select("lane_id", "found"), "lane_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))


def approved(requests: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Requests with `approved`: whether a decision of the same key, a lane and a file for instance, is there."""
    known = decisions.select(*key).distinct().withColumn("_yes", F.lit(True))
    return requests.join(known, key, "left").withColumn("approved", F.coalesce("_yes", F.lit(False))).drop("_yes")


def seed_files(of_handlers: DataFrame, extras: DataFrame, most: int) -> DataFrame:
    """Files (lane_id, path) of each lane's handlers and of its extras, once each, the first `most` in order of path."""
    every = of_handlers.select("lane_id", "path").unionByName(extras.select("lane_id", "path")).distinct()
    first = first_of_group(every, ["lane_id"], ["path"], most)
    return first.groupBy("lane_id").agg(F.array_sort(F.collect_list("path")).alias("seed_files"))
