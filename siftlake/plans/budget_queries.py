"""Queries of budgets, costs and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions.rounding import total_or_null
from siftlake.operators import budget as B
from siftlake.operators import coverage as C
from siftlake.operators.ranking import dealt
from siftlake.plans import views as V
from siftlake.plans.recon_queries import _LANES, _WITH, _lanes
from siftlake.plans.registry import query

_HALF = lambda x: f"CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT)"
_AT = lambda name, column, share: f"{name} AS (SELECT list_sort(list({column}))[CAST(floor(count(*) * {share}) AS BIGINT) + 1] AS t FROM d)"


@query(
    V.with_views(
        "v_file",
        f"""d AS (SELECT dir AS lane_id, count(*) AS seed_files, sum(bytes)::BIGINT AS seed_bytes FROM v_file GROUP BY 1), {_AT("qb", "seed_bytes", 0.75)}, {_AT("qf", "seed_files", 0.75)}
SELECT lane_id, seed_files, seed_bytes, {_HALF("seed_bytes / 4.0 * 4")} AS token_ceiling, greatest(30, {_HALF(_HALF("seed_bytes / 4.0 * 4") + " / 150.0")}) AS seconds_ceiling,
    seed_bytes >= qb.t OR seed_files >= qf.t AS escalate FROM d, qb, qf""",
    )
)
def budget_plan_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = V.files(spark, sf_dir).groupBy(F.col("dir").alias("lane_id")).agg(F.count("*").alias("seed_files"), F.sum("bytes").alias("seed_bytes"))
    return B.plan_by_size(lanes)


_PLAN = f"""l AS (SELECT path, bytes, CASE WHEN lines <= 20 THEN 1 ELSE CAST(ceil((lines - 20) / 15.0) AS BIGINT) + 1 END AS chunks, ord % 5 + 3 AS n_classes FROM lane WHERE disposition = 'hunt'),
p AS (SELECT *, {_HALF("(800 + n_classes * 1500 + bytes) / 4.0")} AS c FROM l),
plan AS (SELECT path, chunks, {_HALF("c * (1 + 1.19::DOUBLE) * chunks")} AS projected_input, (2 * chunks)::BIGINT AS projected_calls, (2 * chunks * 718)::BIGINT AS projected_output FROM p)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.expr("CASE WHEN lines <= 20 THEN 1L ELSE ceil((lines - 20) / 15) + 1 END")
    lanes = _lanes(spark, sf_dir).where("disposition = 'hunt'").select("path", "bytes", chunks.alias("chunks"), (F.col("ord") % 5 + 3).alias("n_classes"))
    return B.plan_by_lane(lanes).select("path", "chunks", "projected_input", "projected_calls", "projected_output")


@query(_WITH(f", {_LANES}, {_PLAN} SELECT * FROM plan"))
def budget_plan_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(_WITH(f", {_LANES}, {_PLAN} SELECT path, projected_input FROM plan ORDER BY projected_input DESC, path LIMIT 20"))
def top_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("path", "projected_input").orderBy(F.desc("projected_input"), "path").limit(20)


@query(_WITH(f", {_LANES}, {_PLAN} SELECT count(*) AS lanes, sum(chunks)::BIGINT AS chunks, sum(projected_input)::BIGINT AS input, sum(projected_calls)::BIGINT AS calls, sum(projected_output)::BIGINT AS output FROM plan"))
def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda name, to: F.sum(name).alias(to)
    return _plan(spark, sf_dir).agg(F.count("*").alias("lanes"), total("chunks", "chunks"), total("projected_input", "input"), total("projected_calls", "calls"), total("projected_output", "output"))


_CHUNKS_SQL = """u AS (SELECT o_custkey AS lane_id, o_orderkey AS chunk, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS prompt_tokens,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END AS completion_tokens, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 2) AS BIGINT) END AS cached_tokens,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice / 4) AS BIGINT) END AS written_tokens, o_orderpriority AS model, o_orderstatus AS status FROM orders)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda by: F.floor(F.col("o_totalprice") / by).cast("long")
    measured = F.col("o_orderkey") % 97 != 0
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("lane_id"),
        F.col("o_orderkey").alias("chunk"),
        F.when(measured, whole(1)).alias("prompt_tokens"),
        F.when(measured, whole(10)).alias("completion_tokens"),
        F.when(F.col("o_orderkey") % 3 == 0, whole(2)).alias("cached_tokens"),
        F.when(F.col("o_orderkey") % 5 == 0, whole(4)).alias("written_tokens"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("status"),
    )


@query(f"WITH {_CHUNKS_SQL} SELECT lane_id, CASE WHEN count(*) = count(prompt_tokens) THEN sum(prompt_tokens)::BIGINT END AS prompt_tokens, CASE WHEN count(*) = count(completion_tokens) THEN sum(completion_tokens)::BIGINT END AS completion_tokens, count(*) AS chunks FROM u GROUP BY 1")
def lane_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.lane_totals(_chunks(spark, sf_dir))


@query(
    f"""WITH {_CHUNKS_SQL} SELECT count(*) AS calls, count(DISTINCT lane_id) AS lanes, sum(prompt_tokens)::BIGINT AS measured_prompt, CASE WHEN count(*) = count(prompt_tokens) THEN sum(prompt_tokens)::BIGINT END AS prompt_tokens,
    coalesce(sum(cached_tokens), 0)::BIGINT AS cached_tokens, count_if(prompt_tokens IS NULL)::BIGINT AS unmeasured FROM u"""
)
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).agg(
        F.count("*").alias("calls"),
        F.count_distinct("lane_id").alias("lanes"),
        F.sum("prompt_tokens").alias("measured_prompt"),
        total_or_null(F.col("prompt_tokens")).alias("prompt_tokens"),
        F.coalesce(F.sum("cached_tokens"), F.lit(0)).alias("cached_tokens"),
        F.count_if(F.col("prompt_tokens").isNull()).alias("unmeasured"),
    )


_PRICES = [("1-URGENT", 1.25, 0.125, None, 10.0), ("2-HIGH", 0.6, None, None, 2.2), ("3-MEDIUM", 3.0, 0.3, 3.75, 15.0), ("4-NOT SPECIFIED", 0.3, 0.03, 0.4, 2.5)]


@query(
    f"""WITH {_CHUNKS_SQL}, price AS (SELECT * FROM {dims.sql_values(_PRICES, "v(model, p_in, p_cached, p_write, p_out)")}),
c AS (SELECT u.*, p_in::DOUBLE AS p_in, p_cached::DOUBLE AS p_cached, p_write::DOUBLE AS p_write, p_out::DOUBLE AS p_out, least(coalesce(cached_tokens, 0), prompt_tokens) AS c FROM u LEFT JOIN price ON u.model = price.model),
w AS (SELECT *, least(coalesce(written_tokens, 0), prompt_tokens - c) AS w FROM c)
SELECT chunk, CASE WHEN p_in IS NOT NULL AND prompt_tokens IS NOT NULL THEN round((prompt_tokens - c - w) / 1e6 * p_in + c / 1e6 * coalesce(p_cached, p_in) + w / 1e6 * coalesce(p_write, p_in) + completion_tokens / 1e6 * p_out, 9) END AS usd FROM w"""
)
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USD per call; models without a price stay unpriced."""
    prices = spark.createDataFrame(_PRICES, "model string, input double, cached_input double, cache_write double, output double").select("model", F.struct("input", "cached_input", "cache_write", "output").alias("price"))
    rows = _chunks(spark, sf_dir).join(prices, "model", "left")
    usd = B.cost(F.col("price"), F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_tokens"), F.col("written_tokens"))
    return rows.select("chunk", F.when(F.col("prompt_tokens").isNotNull(), F.round(usd, 9)).alias("usd"))


_SEGMENTS_SQL = """s AS (SELECT l_orderkey AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos,
    concat('part-', l_linenumber % 4) AS kind, CAST(l_quantity AS BIGINT) AS chars, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_orderkey * 7 % 5000 END AS prompt_tokens FROM lineitem),
t AS (SELECT *, CAST(floor(prompt_tokens * (chars::DOUBLE / sum(chars) OVER (PARTITION BY chunk)) + 0.5) AS BIGINT) AS share, sum(chars) OVER (PARTITION BY chunk) AS total FROM s),
a AS (SELECT chunk, pos, kind, chars, CASE WHEN coalesce(prompt_tokens, 0) <> 0 AND total <> 0 THEN CASE WHEN pos = max(pos) OVER (PARTITION BY chunk) THEN prompt_tokens - coalesce(sum(share) OVER (PARTITION BY chunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END END::BIGINT AS derived_tokens FROM t)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    items = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = dealt(items, items.count(), "l_orderkey").select(
        F.col("l_orderkey").alias("chunk"),
        F.row_number().over(order).cast("long").alias("pos"),
        F.expr("concat('part-', l_linenumber % 4)").alias("kind"),
        F.col("l_quantity").cast("long").alias("chars"),
        F.expr("CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_orderkey * 7 % 5000 END").alias("prompt_tokens"),
    )
    return B.attributed(rows, ["chunk"])


@query(f"WITH {_SEGMENTS_SQL} SELECT chunk, pos, derived_tokens FROM a")
def segment_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("chunk", "pos", "derived_tokens")


@query(f"WITH {_SEGMENTS_SQL} SELECT kind, count(*) AS segments, sum(chars)::BIGINT AS chars, sum(derived_tokens)::BIGINT AS tokens, round(sum(derived_tokens)::DOUBLE / sum(chars), 6) AS tokens_per_char FROM a GROUP BY 1")
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _segments(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("segments"), F.sum("chars").alias("chars"), F.sum("derived_tokens").alias("tokens"))
    return sums.withColumn("tokens_per_char", F.round(F.col("tokens") / F.col("chars"), 6))


@query(
    f"""WITH {_SEGMENTS_SQL}, m AS (SELECT chunk, sum(derived_tokens)::BIGINT AS tokens, coalesce(sum(CASE WHEN kind = 'part-1' THEN derived_tokens END), 0)::BIGINT AS part_1,
    coalesce(sum(CASE WHEN kind = 'part-2' THEN derived_tokens END), 0)::BIGINT AS part_2 FROM a WHERE derived_tokens IS NOT NULL GROUP BY 1) SELECT * FROM m ORDER BY tokens DESC, chunk LIMIT 20"""
)
def top_lanes_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest measured chunks with their tokens by kind of segment."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("derived_tokens"))), F.lit(0))
    sums = _segments(spark, sf_dir).where("derived_tokens IS NOT NULL").groupBy("chunk").agg(F.sum("derived_tokens").alias("tokens"), of("part-1").alias("part_1"), of("part-2").alias("part_2"))
    return sums.orderBy(F.desc("tokens"), "chunk").limit(20)


_USAGE_SQL = """x AS (SELECT o_orderpriority AS bucket, CAST(floor(o_totalprice) AS BIGINT) AS predicted, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(floor(o_totalprice * (80 + o_orderkey % 40) / 100) AS BIGINT) END AS actual, o_orderstatus <> 'P' AS completed FROM orders)"""


@query(
    f"""WITH {_USAGE_SQL} SELECT bucket, count(*) AS lanes, sum(predicted)::BIGINT AS predicted, sum(actual)::BIGINT AS actual, count_if(actual > predicted)::BIGINT AS over, count_if(actual <= predicted)::BIGINT AS under,
    CASE WHEN sum(predicted) > 0 THEN sum(actual)::DOUBLE / sum(predicted)::DOUBLE END AS accuracy FROM x WHERE completed AND actual IS NOT NULL GROUP BY 1"""
)
def predicted_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = F.when(F.col("o_orderkey") % 13 != 0, F.floor(F.col("o_totalprice") * (80 + F.col("o_orderkey") % 40) / 100).cast("long"))
    lanes = V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("bucket"), F.floor("o_totalprice").cast("long").alias("predicted"), actual.alias("actual"), (F.col("o_orderstatus") != "P").alias("completed"))
    return B.predicted_against_actual(lanes, ["bucket"])


_B = lambda name, share: f"{name} AS (SELECT CAST(ceil(list_sort(list(bytes))[CAST(floor(count(*) * {share}) AS BIGINT) + 1] / 1024.0) * 1024 AS BIGINT) AS t FROM v_file WHERE ord % 6 > 0)"
_BUCKETS = f"""{_B("b25", 0.25)}, {_B("b50", 0.5)}, {_B("b75", 0.75)}, {_B("b90", 0.9)},
k AS (SELECT v_file.*, ord % 6 = 0 AS skipped, (bytes >= b25.t)::INT + (bytes >= b50.t)::INT + (bytes >= b75.t)::INT + (bytes >= b90.t)::INT AS bucket FROM v_file, b25, b50, b75, b90),
g AS (SELECT bucket, count_if(NOT skipped)::BIGINT AS hunted, count_if(skipped)::BIGINT AS skips, CAST(floor(sum(CASE WHEN NOT skipped THEN bytes END)::DOUBLE / count_if(NOT skipped)) AS BIGINT) AS avg_bytes FROM k GROUP BY 1),
h AS (SELECT *, greatest(1, avg_bytes // 40) AS avg_lines FROM g WHERE hunted > 0),
i AS (SELECT *, CASE WHEN avg_lines <= 500 THEN 1 ELSE CAST(ceil((avg_lines - 500) / 480.0) AS BIGINT) + 1 END AS avg_chunks FROM h),
j AS (SELECT *, CASE WHEN avg_chunks <= 1 THEN avg_bytes + avg_lines * 6 + 10 ELSE (avg_chunks - 1) * 23010 + greatest(1, avg_lines - (avg_chunks - 2) * 480 - 20) * 46 + 10 END AS seed FROM i)"""


@query(
    V.with_views(
        "v_file",
        f"""{_BUCKETS} SELECT bucket, hunted, skips, avg_bytes, avg_lines, avg_chunks::BIGINT AS avg_chunks, round((3060::DOUBLE + seed + 1.5::DOUBLE * 2263) * 0.342::DOUBLE * hunted, 3) AS narrow_input,
    round((3060::DOUBLE + seed + 25::DOUBLE * 2263) * 0.342::DOUBLE * hunted, 3) AS broad_input FROM j""",
    )
)
def size_bucket_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.files(spark, sf_dir).select("bytes", (F.col("ord") % 6 == 0).alias("skipped"))
    return B.bucket_costs(files).withColumns({name: F.round(name, 3) for name in ("narrow_input", "broad_input")})


@query(
    V.with_views(
        "v_file",
        f"""{_BUCKETS} SELECT round(sum((3060::DOUBLE + seed + 1.5::DOUBLE * 2263) * 0.342::DOUBLE * hunted), 2) AS narrow, round(sum((3060::DOUBLE + seed + 25::DOUBLE * 2263) * 0.342::DOUBLE * hunted), 2) AS broad,
    round(sum((3060::DOUBLE + seed + 1.5::DOUBLE * 2263) * 0.342::DOUBLE * skips), 2) AS skip_savings FROM j""",
    )
)
def skip_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = V.files(spark, sf_dir).select("bytes", (F.col("ord") % 6 == 0).alias("skipped"))
    total = lambda value, name: F.round(F.sum(value), 2).alias(name)
    return B.bucket_costs(files).agg(total("narrow_input", "narrow"), total("broad_input", "broad"), total(F.col("narrow_input") / F.col("hunted") * F.col("skips"), "skip_savings"))


@query(f"WITH {_CHUNKS_SQL} SELECT sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))::BIGINT AS tokens FROM u")
def tokens_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).agg(F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))


@query("WITH r AS (SELECT concat(event_type, ': ', props) AS reason FROM events) SELECT reason, count(*) AS lanes FROM r GROUP BY 1")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = V.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(": "), "props").alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("lanes"))


@query(
    """WITH r AS (SELECT DISTINCT p_brand AS class, concat('C', p_partkey % 97) AS code, concat('playbook-', p_type) AS playbook FROM part WHERE p_partkey % 2 = 0),
want AS (SELECT DISTINCT concat('C', s_suppkey % 120) AS code FROM supplier), c AS (SELECT code, count(DISTINCT class) AS n FROM r GROUP BY 1), p AS (SELECT playbook, count(DISTINCT class) AS n FROM r GROUP BY 1)
SELECT 'duplicate code' AS problem, code AS subject FROM c WHERE n > 1 UNION ALL SELECT 'missing code', code FROM want WHERE code NOT IN (SELECT code FROM r) UNION ALL SELECT 'shared playbook', playbook FROM p WHERE n > 1"""
)
def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two classes, wanted codes of none, and playbooks of two classes, of a registry made of the parts."""
    known = V.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_brand").alias("class"), F.expr("concat('C', p_partkey % 97)").alias("code"), F.concat(F.lit("playbook-"), "p_type").alias("playbook"))
    return C.registry_problems(known.distinct(), V.table(spark, sf_dir, "supplier").select(F.expr("concat('C', s_suppkey % 120)").alias("code")))


@query(
    """WITH price AS (SELECT s_suppkey AS model, s_acctbal AS i, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal * 0.1 + 100 END AS c, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal + 500 END AS o, 1000 - s_suppkey % 1100 AS most FROM supplier)
SELECT model, CASE WHEN i IS NULL OR o IS NULL THEN 'incomplete' WHEN i < 0 OR o < 0 OR c < 0 THEN 'negative' WHEN c > i THEN 'cached above fresh' WHEN most <= 0 THEN 'no output tokens' END AS problem FROM price
WHERE i IS NULL OR o IS NULL OR i < 0 OR o < 0 OR c < 0 OR c > i OR most <= 0"""
)
def price_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the prices of a registry made of the suppliers."""
    prices = V.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS model", "s_acctbal AS input", "CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal * 0.1 + 100 END AS cached_input", "CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal + 500 END AS output", "1000 - s_suppkey % 1100 AS max_output_tokens"
    )
    return B.price_problems(prices).select("model", "problem")


@query(f"WITH {_CHUNKS_SQL} SELECT model, sum(prompt_tokens + coalesce(cached_tokens, 0) + coalesce(written_tokens, 0))::BIGINT AS prompt FROM u WHERE model <> '5-LOW' GROUP BY 1 UNION ALL SELECT '5-LOW', NULL")
def call_usage_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt = fresh + cache reads + cache writes per model; a model without usage stays null."""
    used = _chunks(spark, sf_dir).withColumn("prompt", F.when(F.col("model") != "5-LOW", F.col("prompt_tokens") + F.coalesce("cached_tokens", F.lit(0)) + F.coalesce("written_tokens", F.lit(0))))
    return used.groupBy("model").agg(F.sum("prompt").alias("prompt"))
