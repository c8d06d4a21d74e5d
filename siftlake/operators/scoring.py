"""Findings against ground truth: which entries were found, where, and under which class.

Findings come as steps (finding_id, file, line, code), entries as (key, file, line, codes). Files
match if one path ends with the other; that forces equal basenames, so the join hashes on the
basename and keeps the path test as a residual. A basename of very many paths, such as index.ts, would meet all of its
paths with each other; those are met by equal ends of paths instead. Lines match within a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.paths import basename, normalized, same_file
from siftlake.functions.rounding import percent
from siftlake.operators.ranking import before_ranges, in_ranges, null_safe

LOCALIZED_WITHIN = 15
#: Different paths of one basename beyond which they are met by their ends.
HOT_PATHS = 1000
UNMAPPED = "<unmapped>"


def file_join(left: DataFrame, right: DataFrame, left_file: str, right_file: str, how: str = "inner") -> DataFrame:
    """Rows whose files match. Columns of the two sides must not clash."""
    a = left.withColumn("_a", normalized(F.col(left_file))).withColumn("_a_name", basename(F.col("_a")))
    b = right.withColumn("_b", normalized(F.col(right_file))).withColumn("_b_name", basename(F.col("_b")))
    if how == "inner":
        return met_files(a.drop("_a_name"), b.drop("_b_name"), "_a", "_b").drop("_a", "_b")
    joined = a.join(b, (F.col("_a_name") == F.col("_b_name")) & same_file(F.col("_a"), F.col("_b")), how)
    return joined.drop("_a", "_a_name", "_b", "_b_name")


def met_files(left: DataFrame, right: DataFrame, a: str, b: str, hot: int = HOT_PATHS) -> DataFrame:
    """Rows whose normalized paths a and b match. Columns of the two sides must not clash.

    Basenames of more than `hot` different paths on the right are met by ends: every end of a path after a slash is a key, and paths
    match if one is an end of the other, so that only rows that match come out of the join, however many share the name.
    """
    left, right = left.withColumn("_left_name", basename(F.col(a))), right.withColumn("_right_name", basename(F.col(b)))
    paths = right.select("_right_name", b).distinct()
    crowded = paths.groupBy("_right_name").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(F.col("_right_name").alias("_crowded"))
    plain = (F.col("_left_name") == F.col("_right_name")) & same_file(F.col(a), F.col(b))
    if crowded.isEmpty():
        return left.join(right, plain).drop("_left_name", "_right_name")
    split = lambda side, name, how: side.join(crowded, F.col(name) == F.col("_crowded"), how)
    few = split(left, "_left_name", "left_anti").join(split(right, "_right_name", "left_anti"), plain)
    own, other = split(left, "_left_name", "left_semi").where(F.col(a) != ""), split(right, "_right_name", "left_semi")
    longer = own.withColumn("_end", F.explode(ends_of(F.col(a)))).join(other, F.col("_end") == F.col(b))
    shorter = own.join(other.withColumn("_end", F.explode(ends_of(F.col(b), own=False))), F.col("_end") == F.col(a))
    return few.unionByName(longer.drop("_end")).unionByName(shorter.drop("_end")).drop("_left_name", "_right_name")


def ends_of(path: Column, own: bool = True) -> Column:
    """The ends of a path after each slash, and the path itself unless left out."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1 if own else 2), F.greatest(F.size(parts), F.lit(1 if own else 2))), lambda n: F.when(n <= F.size(parts), F.array_join(F.slice(parts, n, F.size(parts) - n + 1), "/")))


def with_aliases(rows: DataFrame, class_code: DataFrame, codes: str = "codes") -> DataFrame:
    """codes widened to all codes of every class that they touch; codes without a class stay.

    The registry of classes is a handful of rows, so it is turned into one map per code.
    """
    pairs = class_code.alias("own").join(class_code.alias("kin"), F.col("own.class") == F.col("kin.class"))
    kin = pairs.groupBy(F.col("own.code").alias("code")).agg(F.collect_set("kin.code").alias("kin"))
    one = kin.agg(F.map_from_entries(F.collect_list(F.struct("code", "kin"))).alias("_kin"))
    widened = F.array_sort(F.array_distinct(F.flatten(F.transform(codes, lambda code: F.coalesce(F.try_element_at("_kin", code), F.array(code))))))
    return rows.crossJoin(F.broadcast(one)).withColumn(codes, widened).drop("_kin")  # one row


def judged_pairs(steps: DataFrame, truth: DataFrame, class_code: DataFrame | None = None, hot: int = HOT_PATHS) -> DataFrame:
    """One row per entry and finding that meet in a file: the least distance, and whether they share a code.

    The steps are read once: a finding's places and codes are gathered in one aggregation, and its places meet the
    entries of their file with both sides' codes beside them. A step without a line meets its file but has no distance.
    class_code widens both sides' codes by their classes. Codes are kin both ways, so the wide sets meet if the findings' own
    codes meet the entries' widened twice: the many findings go through the shuffles with the codes that they came with, as
    their places in the list of all that entries want. That list is one row, of a handful of codes as the registry.
    """
    place = F.struct(normalized(F.col("file")).alias("_a"), F.col("line").alias("line"))
    code, wanted = F.col("code"), F.col("codes")
    if class_code is not None:
        truth = with_aliases(with_aliases(truth, class_code), class_code)
        listed = F.broadcast(truth.select(F.explode("codes").alias("code")).agg(F.array_sort(F.collect_set("code")).alias("_all")))
        steps, truth = steps.crossJoin(listed), truth.crossJoin(listed)
        at = lambda code: F.array_position("_all", code).cast("int")
        code, wanted = F.nullif(at(code), F.lit(0)), F.transform(wanted, at)
    found = steps.groupBy("finding_id").agg(F.collect_set(place).alias("_places"), F.collect_set(code).alias("codes"))
    placed = found.select("finding_id", "codes", F.inline("_places"))
    entries = truth.select("key", normalized(F.col("file")).alias("_b"), F.col("line").alias("_line"), wanted.alias("_wanted"))
    met = met_files(placed, entries, "_a", "_b", hot)
    return met.groupBy("key", "finding_id").agg(F.min(F.abs(F.col("line") - F.col("_line"))).alias("delta"), F.max(F.arrays_overlap("codes", "_wanted")).alias("same_code"))


def verdicts(truth: DataFrame, pairs: DataFrame, within: int = LOCALIZED_WITHIN) -> DataFrame:
    """Per entry: found at all, localized, and recalled, blind to codes and not."""
    some = lambda test: F.coalesce(F.max(F.coalesce(test, F.lit(False))), F.lit(False))
    near, exact = F.col("delta") <= within, F.col("delta") == 0
    flags = pairs.groupBy("key").agg(
        some(exact & F.col("same_code")).alias("recall"),
        some(exact).alias("recall_blind"),
        some(near & F.col("same_code")).alias("localized"),
        some(near).alias("localized_blind"),
        F.min("delta").alias("least_delta"),
        F.lit(True).alias("file_hit"),
    )
    names = ("recall", "recall_blind", "localized", "localized_blind", "file_hit")
    joined = truth.join(flags, "key", "left")
    return joined.select(*truth.columns, "least_delta", *(F.coalesce(name, F.lit(False)).alias(name) for name in names))


def scorecard(judged: DataFrame) -> DataFrame:
    """One row of hits and percentages over all entries."""
    names = ("recall", "recall_blind", "localized", "localized_blind", "file_hit")
    counts = judged.agg(F.count("*").alias("entries"), *(F.count_if(name).alias(f"{name}_hits") for name in names))
    return counts.select("*", *(percent(F.col(f"{name}_hits"), F.col("entries")).alias(f"{name}_pct") for name in names))


def per_class(judged: DataFrame, class_code: DataFrame) -> DataFrame:
    """Recall of each class; an entry of two classes counts for both, one of none as unmapped."""
    named = judged.withColumn("code", F.explode_outer("codes")).join(class_code, "code", "left")
    named = named.select("key", F.coalesce("class", F.lit(UNMAPPED)).alias("class"), "recall", "localized").distinct()
    groups = named.groupBy("class").agg(F.count("*").alias("entries"), F.count_if("recall").alias("recall"), F.count_if("localized").alias("localized"))
    return groups.withColumn("recall_pct", percent(F.col("recall"), F.col("entries")))


def precision_proxy(findings: DataFrame, pairs: DataFrame, within: int = LOCALIZED_WITHIN) -> DataFrame:
    """Findings that localize an entry, of all findings. A null id counts as one member of its set."""
    near = F.col("delta") <= within
    key = F.coalesce(F.col("finding_id").cast("string"), F.lit("∅"))
    hits = pairs.agg(F.count_distinct(F.when(near, key)).alias("localized_findings"), F.count_distinct(F.when(near & F.col("same_code"), key)).alias("matched_findings"))
    total = findings.agg(F.count("*").alias("findings"))
    whole = F.col("findings")
    return total.crossJoin(hits).select(  # one row each
        "*", percent(F.col("localized_findings"), whole).alias("blind_pct"), percent(F.col("matched_findings"), whole).alias("aware_pct")
    )


def residual_bucket(row_delta: str = "least_delta", within: int = LOCALIZED_WITHIN) -> Column:
    """Why an entry was missed, the first that holds."""
    return (
        F.when(F.col("recall"), "HIT")
        .when(F.col("recall_blind") | (F.col("localized_blind") & ~F.col("localized")), "CATEGORY_MISS")
        .when(F.col("localized"), "LINE_MISS_NEAR")
        .when(F.col("file_hit") & F.col(row_delta).isNotNull(), "LINE_MISS_FAR")
        .when(F.col("file_hit"), "FILE_ONLY")
        .otherwise("NOT_FOUND")
    )


def span_islands(spans: DataFrame, group: str = "file", ranges: int | None = None) -> DataFrame:
    """Line spans (start, stop, tag) with `_island`, the number in their group of the merged span that they are part of.

    Ranges of a group are walked apart: the greatest end of all ranges before is known from one row a range, so each range
    finds by itself where a merged span begins, and counts of those give the numbers. No task holds a hot group.
    """
    ranged = in_ranges(spans, [group], ["start", "stop", "tag"], ranges)
    reach = before_ranges(ranged, [group], F.max("stop"), F.max, "_reach")
    order = Window.partitionBy(group, "_range").orderBy("start", "stop", "tag")
    inside = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    known = null_safe(ranged, reach, [group, "_range"]).withColumn("_before", F.greatest("_reach", inside))  # nulls are skipped
    fresh = known.withColumn("_new", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + 1), 1).otherwise(0)).drop("_before", "_reach")
    ahead = before_ranges(fresh, [group], F.sum("_new"), F.sum, "_ahead")
    joined = null_safe(fresh.withColumn("_within", F.sum("_new").over(order)), ahead, [group, "_range"])
    return joined.withColumn("_island", F.col("_within") + F.coalesce("_ahead", F.lit(0))).drop("_new", "_within", "_ahead", "_range")


def merged_spans(spans: DataFrame, group: str = "file", tags: bool = True, ranges: int | None = None) -> DataFrame:
    """Line spans (start, stop, tag) of a group merged where they touch; tags are joined in order of start, unless left out."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "stop", "tag"))), lambda s: s["tag"].cast("string")), ",")
    merged = span_islands(spans, group, ranges).groupBy(group, "_island")
    return merged.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *[listed.alias("tags")] * tags).drop("_island")
