"""Sizes of merged findings against the merge itself, rows dealt to as many tasks as they need, and what goes through their shuffles."""

import random

from pyspark.sql import functions as F

from siftlake.functions import tables
from siftlake.operators import findings as G
from siftlake.operators import scoring as S
from siftlake.operators.ranking import dealt, dealt_if_many, members_by_cube
from siftlake.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_sizes_equal_the_merge(spark):
    draw, rows = random.Random(5), []
    for i in range(3000):
        lines = [draw.randrange(12) for _ in range(draw.randint(1, 4))]  # repeated ones
        classes = [draw.choice("ABC") for _ in range(draw.randint(0, 3))]  # repeated ones
        trace = [("sink", "a.ts", n) for n in lines]
        rows.append((f"lane{i % 40}" if i % 40 else None, draw.randint(0, 4), i, f"f{i}", draw.choice([None, "", " t ", "t", "u"]), "", 0.5, trace, [(c, 0) for c in classes]))
    found = spark.createDataFrame(rows, G.SCHEMA)
    tables.register(spark)
    flat = found.selectExpr("lane", "turn", "ord", "title", "transform(trace, s -> s.line) AS lines", "transform(classes, c -> c.class) AS classes")
    got = spark.sql("SELECT * FROM merged_sizes(TABLE({t}))", t=flat.repartition(3, "lane").sortWithinPartitions("lane", "turn", "ord"))
    whole = G.merged(found).groupBy("lane").agg(F.count("*").alias("findings"), F.sum(F.size("trace")).alias("steps"), F.sum(F.size("classes")).alias("classes"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    assert spark.sql("SELECT * FROM merged_sizes(TABLE({t}))", t=flat.limit(0)).count() == 0


def test_dealt_grows_with_the_rows(spark):
    rows = spark.range(10_000).withColumn("k", F.col("id") % 500)
    spread = dealt(rows, 10_000, "k", most=500)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert spread.rdd.getNumPartitions() == 20 and sum(sizes) == 10_000 and max(sizes) < 1500
    assert dealt(rows, 10, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_members_by_cube_equal_the_cube(spark):
    draw = random.Random(3)
    data = [(draw.choice([None, "a", "b"]), draw.choice([None, "x", "y", "z"]), draw.choice([None, *range(40)])) for _ in range(500)] + [("only", "null", None)]
    rows = spark.createDataFrame(data, "class string, provider string, id long")
    got, want = members_by_cube(rows, "id", ["class", "provider"]), rows.cube("class", "provider").agg(F.count_distinct("id").alias("members"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_cube_query_deals_findings_once(spark):
    plan = plan_of(QUERIES["class_provider_cube"](spark, SF))
    assert "Expand" not in plan and "hashpartitioning(finding_id" in plan and "REPARTITION_BY_NUM" in plan


def test_segment_queries_deal_chunks_once(spark):
    for name in ("segment_attribution", "token_rollup", "top_lanes_pivot"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert plan.count("hashpartitioning(l_orderkey") == 1 and "hashpartitioning(chunk" not in plan and "REPARTITION_BY_NUM" in plan


def test_kin_codes_meet_both_ways(spark):
    classes = spark.createDataFrame([("one", "X"), ("one", "Z"), ("two", "Y"), ("two", "Z"), ("three", "Q")], "class string, code string")
    kin = {"X": {"X", "Z"}, "Y": {"Y", "Z"}, "Z": {"X", "Y", "Z"}, "Q": {"Q"}, "free": {"free"}, "other": {"other"}}
    codes = [*kin, None]
    steps = spark.createDataFrame([(i, "src/a.ts", i % 5, c) for i, c in enumerate(codes)] + [(0, "src/a.ts", 1, "Q")], "finding_id long, file string, line int, code string")
    truth = spark.createDataFrame([(f"k{c}", "a.ts", 2, [c]) for c in codes] + [("none", "a.ts", 2, [])], "key string, file string, line int, codes array<string>")
    pairs = S.judged_pairs(steps, truth, classes)
    wide = lambda own: set().union(*(kin.get(c, {None}) for c in own))
    finds = {i: wide([c]) - {None} for i, c in enumerate(codes)} | {0: wide(["X", "Q"])}
    wants = {f"k{c}": wide([c]) for c in codes} | {"none": set()}
    got = {(r["key"], r["finding_id"]): bool(r["same_code"]) for r in pairs.collect()}
    assert got == {(k, i): bool(f & w) for k, w in wants.items() for i, f in finds.items()}


def test_many_rows_are_dealt_for_a_join_and_few_are_not(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, other = spark.range(1000).withColumn("k", F.col("id") % 50), spark.range(50).withColumnRenamed("id", "p").hint("merge")
    many = dealt_if_many(rows, 1000, "k", most=10).join(other, F.col("k") == F.col("p"))
    assert many.rdd.getNumPartitions() == 100 and many.count() == 1000
    assert dealt_if_many(rows, least * 10, "k", most=10) is rows
