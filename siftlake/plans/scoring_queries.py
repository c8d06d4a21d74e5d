"""Queries of the scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions.paths import normalized
from siftlake.functions.rounding import percent
from siftlake.functions.text import codes_in
from siftlake.operators import scoring as S
from siftlake.plans import views as V
from siftlake.plans.registry import query

_PAIRS = """v_finding AS (SELECT finding_id, list(DISTINCT code) AS codes FROM v_step GROUP BY 1),
pairs AS (SELECT g.key, s.finding_id, min(abs(s.line - g.line)) AS delta FROM v_step s JOIN v_gt g ON s.file = g.file GROUP BY 1, 2),
judged AS (SELECT p.key, p.finding_id, p.delta, list_contains(f.codes, g.code) AS same FROM pairs p JOIN v_finding f ON f.finding_id = p.finding_id JOIN v_gt g ON g.key = p.key),
verdict AS (SELECT g.key, any_value(g.file) AS file, any_value(g.line) AS line, any_value(g.code) AS code, min(j.delta) AS least_delta,
    coalesce(bool_or(j.delta = 0 AND j.same), false) AS recall, coalesce(bool_or(j.delta = 0), false) AS recall_blind,
    coalesce(bool_or(j.delta <= 15 AND j.same), false) AS localized, coalesce(bool_or(j.delta <= 15), false) AS localized_blind,
    count(j.key) > 0 AS file_hit FROM v_gt g LEFT JOIN judged j ON j.key = g.key GROUP BY g.key)"""
_PCT = lambda part, whole: f"round_even(CAST({part} AS DOUBLE) / {whole} * 100.0, 1)"
_CARD = """SELECT count(*) AS entries, count_if(recall)::BIGINT AS recall_hits, count_if(recall_blind)::BIGINT AS recall_blind_hits, count_if(localized)::BIGINT AS localized_hits,
    count_if(localized_blind)::BIGINT AS localized_blind_hits, count_if(file_hit)::BIGINT AS file_hit_hits, """ + ", ".join(
    f"{_PCT(f'count_if({name})', 'count(*)')} AS {name}_pct" for name in ("recall", "recall_blind", "localized", "localized_blind", "file_hit")
)


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    steps, truth = V.finding_steps(spark, sf_dir), V.ground_truth(spark, sf_dir)
    pairs = S.judged_pairs(steps, truth)
    return steps, pairs, S.verdicts(truth, pairs)


@query(V.with_views("v_gt v_step", f"{_PAIRS}\n{_CARD} FROM verdict"))
def recall_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scorecard(_judged(spark, sf_dir)[2])


@query(V.with_views("v_gt v_step", f"{_PAIRS}\nSELECT key, least_delta, recall, recall_blind, localized, localized_blind, file_hit FROM verdict"))
def entry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[2].select("key", "least_delta", "recall", "recall_blind", "localized", "localized_blind", "file_hit")


_ALIASED = _PAIRS.replace("list_contains(f.codes, g.code)", "len(list_intersect(f.kin, g.kin)) > 0").replace(
    "v_finding AS (SELECT finding_id, list(DISTINCT code) AS codes FROM v_step GROUP BY 1)",
    """kin AS (SELECT a.code, list(DISTINCT b.code) AS kin FROM class_code a JOIN class_code b ON a.class = b.class GROUP BY 1),
v_finding AS (SELECT s.finding_id, list_distinct(flatten(list(k.kin))) AS kin FROM v_step s JOIN kin k ON k.code = s.code GROUP BY 1),
v_truth AS (SELECT g.*, k.kin FROM v_gt g JOIN kin k ON k.code = g.code)""",
).replace("JOIN v_gt g ON g.key = p.key)", "JOIN v_truth g ON g.key = p.key)")


@query(V.with_views("v_gt v_step class_code", f"{_ALIASED}\n{_CARD} FROM verdict"))
def recall_alias_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, truth, classes = V.finding_steps(spark, sf_dir), V.ground_truth(spark, sf_dir), dims.class_codes(spark)
    return S.scorecard(S.verdicts(truth, S.judged_pairs(steps, truth, classes)))


@query(
    V.with_views(
        "v_gt v_step class_code",
        f"""{_PAIRS}
SELECT coalesce(c.class, '<unmapped>') AS class, count(*) AS entries, count_if(recall)::BIGINT AS recall, count_if(localized)::BIGINT AS localized,
    {_PCT("count_if(recall)", "count(*)")} AS recall_pct FROM verdict v LEFT JOIN class_code c ON c.code = v.code GROUP BY 1""",
    )
)
def per_class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.per_class(_judged(spark, sf_dir)[2], dims.class_codes(spark))


@query(
    V.with_views(
        "v_gt v_step",
        f"""{_PAIRS}, n AS (SELECT count(DISTINCT finding_id) AS findings FROM v_step), h AS (SELECT count(DISTINCT CASE WHEN delta <= 15 THEN finding_id END) AS localized_findings,
    count(DISTINCT CASE WHEN delta <= 15 AND same THEN finding_id END) AS matched_findings FROM judged)
SELECT findings, localized_findings, matched_findings, {_PCT("localized_findings", "findings")} AS blind_pct, {_PCT("matched_findings", "findings")} AS aware_pct FROM n, h""",
    )
)
def precision_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, pairs, _ = _judged(spark, sf_dir)
    return S.precision_proxy(steps.select("finding_id").distinct(), pairs)


_CLASSES = "f AS (SELECT s.finding_id, count(DISTINCT c.class) AS n_classes, count(DISTINCT s.code) AS n_codes FROM v_step s LEFT JOIN class_code c ON c.code = s.code GROUP BY 1)"


def _class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = V.finding_steps(spark, sf_dir).join(dims.class_codes(spark), "code", "left")
    return named.groupBy("finding_id").agg(F.count_distinct("class").alias("n_classes"), F.count_distinct("code").alias("n_codes"))


@query(V.with_views("v_step class_code", f"{_CLASSES} SELECT n_classes, count(*) AS findings FROM f GROUP BY 1"))
def hedging_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_counts(spark, sf_dir).groupBy("n_classes").agg(F.count("*").alias("findings"))


@query(
    V.with_views(
        "v_step class_code",
        f"""{_CLASSES} SELECT round_even(sum(n_classes)::DOUBLE / count(*), 3) AS mean_classes, max(n_classes) AS max_classes,
    round_even(sum(n_codes)::DOUBLE / count(*), 3) AS mean_codes, count_if(n_classes > 1)::BIGINT AS multi_class FROM f""",
    )
)
def hedging_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda name: F.bround(F.sum(name).cast("double") / F.count("*"), 3)
    return _class_counts(spark, sf_dir).agg(mean("n_classes").alias("mean_classes"), F.max("n_classes").alias("max_classes"), mean("n_codes").alias("mean_codes"), F.count_if(F.col("n_classes") > 1).alias("multi_class"))


@query(V.with_views("v_step class_code", "SELECT c.class, count(DISTINCT s.finding_id) AS findings FROM v_step s JOIN class_code c ON c.code = s.code GROUP BY 1"))
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = V.finding_steps(spark, sf_dir).join(dims.class_codes(spark), "code")
    return named.groupBy("class").agg(F.count_distinct("finding_id").alias("findings"))


_LABELS = r"""lab AS (SELECT l_orderkey, l_linenumber, concat(CASE l_suppkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'A03: injection' WHEN 2 THEN 'API10 and A0' WHEN 3 THEN 'LLM05/LLM11' ELSE 'xA01 A10' END, ' ', l_returnflag) AS label FROM lineitem),
coded AS (SELECT *, len(regexp_extract_all(label, '\b(?:A0[1-9]|A10|API[1-9]0?|LLM0[1-9]|LLM10)\b')) AS n FROM lab)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(CASE l_suppkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'A03: injection' WHEN 2 THEN 'API10 and A0' WHEN 3 THEN 'LLM05/LLM11' ELSE 'xA01 A10' END, ' ', l_returnflag)")
    return V.table(spark, sf_dir, "lineitem").select(codes_in(text).alias("codes"))


@query(f"WITH {_LABELS} SELECT count(*) AS findings, count_if(n > 0)::BIGINT AS with_code, count_if(n > 0)::DOUBLE / count(*) >= 0.95 AS passes FROM coded")
def code_extraction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labels(spark, sf_dir).agg(F.count("*").alias("findings"), F.count_if(F.size("codes") > 0).alias("with_code"))
    return found.withColumn("passes", F.col("with_code") / F.col("findings") >= 0.95)


@query(
    V.with_views(
        "v_gt v_step",
        f"""per AS (SELECT s.provider, g.key, min(abs(s.line - g.line)) AS delta FROM v_step s JOIN v_gt g ON s.file = g.file GROUP BY 1, 2), n AS (SELECT count(*) AS entries FROM v_gt)
SELECT provider, count(*) AS file_hits, count_if(delta <= 15)::BIGINT AS localized, entries, {_PCT("count(*)", "entries")} AS recall_pct, {_PCT("count_if(delta <= 15)", "count(*)")} AS localized_pct
FROM per, n GROUP BY provider, entries""",
    )
)
def tool_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tool's file-level recall, and localization among its file hits."""
    truth = V.ground_truth(spark, sf_dir).select("key", F.col("file").alias("_file"), F.col("line").alias("_line"))
    met = S.file_join(V.finding_steps(spark, sf_dir), truth, "file", "_file")
    per = met.groupBy("provider", "key").agg(F.min(F.abs(F.col("line") - F.col("_line"))).alias("delta"))
    tools = per.groupBy("provider").agg(F.count("*").alias("file_hits"), F.count_if(F.col("delta") <= 15).alias("localized"))
    total = truth.agg(F.count("*").alias("entries"))
    return tools.crossJoin(total).withColumns({"recall_pct": percent(F.col("file_hits"), F.col("entries")), "localized_pct": percent(F.col("localized"), F.col("file_hits"))})


@query(V.with_views("v_gt v_step", "SELECT provider, count(*) AS steps FROM v_step WHERE file IN (SELECT file FROM v_gt) GROUP BY 1"))
def in_scope_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.ground_truth(spark, sf_dir).select(F.col("file").alias("_file")).distinct()
    return S.file_join(V.finding_steps(spark, sf_dir), known, "file", "_file", "left_semi").groupBy("provider").agg(F.count("*").alias("steps"))


@query(
    V.with_views(
        "v_gt v_step",
        f"""{_PAIRS}
SELECT CASE WHEN recall THEN 'HIT' WHEN recall_blind OR (localized_blind AND NOT localized) THEN 'CATEGORY_MISS' WHEN localized THEN 'LINE_MISS_NEAR'
    WHEN file_hit AND least_delta IS NOT NULL THEN 'LINE_MISS_FAR' WHEN file_hit THEN 'FILE_ONLY' ELSE 'NOT_FOUND' END AS bucket, count(*) AS entries FROM verdict GROUP BY 1""",
    )
)
def residual_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[2].groupBy(S.residual_bucket().alias("bucket")).agg(F.count("*").alias("entries"))


@query(
    V.with_views(
        "v_gt v_step",
        f"""{_PAIRS}, places AS (SELECT file, line, count(*) AS entries, bool_or(recall) AS recall, bool_or(localized) AS localized FROM verdict GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY entries DESC, file, line) AS crowd FROM places)
SELECT count(*) AS locations, count_if(recall)::BIGINT AS recall, count_if(localized)::BIGINT AS localized FROM ranked WHERE crowd > 5""",
    )
)
def distinct_location_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over distinct (file, line), without the five most crowded. The ranking needs only those five."""
    places = _judged(spark, sf_dir)[2].groupBy("file", "line").agg(F.count("*").alias("entries"), F.max("recall").alias("recall"), F.max("localized").alias("localized"))
    crowded = places.orderBy(F.desc("entries"), "file", "line").limit(5).select("file", "line")
    return places.join(crowded, ["file", "line"], "left_anti").agg(F.count("*").alias("locations"), F.count_if("recall").alias("recall"), F.count_if("localized").alias("localized"))


@query(V.with_views("v_gt v_step", f"{_PAIRS}\n{_CARD} FROM verdict WHERE file NOT IN (SELECT file FROM v_gt WHERE key % 100 = 0)"))
def rebased_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard without entries of deny-listed files."""
    judged = _judged(spark, sf_dir)[2]
    denied = V.ground_truth(spark, sf_dir).where("key % 100 = 0").select("file").distinct()
    return S.scorecard(judged.join(denied, "file", "left_anti"))


@query(V.with_views("v_step", "t AS (SELECT finding_id, count(*) AS n FROM v_step GROUP BY 1), d AS (SELECT count(*) AS distinct_lines FROM (SELECT DISTINCT file, line FROM v_step)) SELECT distinct_lines, count(*) AS findings, sum(n)::BIGINT AS steps, max(n) AS longest FROM t, d GROUP BY 1"))
def line_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = V.finding_steps(spark, sf_dir).select("finding_id", normalized(F.col("file")).alias("file"), "line")
    traces = steps.groupBy("finding_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("findings"), F.sum("n").alias("steps"), F.max("n").alias("longest"))
    return steps.select("file", "line").distinct().agg(F.count("*").alias("distinct_lines")).crossJoin(traces)


@query(
    V.with_views(
        "v_step",
        """sp AS (SELECT file, line AS start, line + 10 AS stop, finding_id AS tag FROM v_step), o AS (SELECT *, max(stop) OVER (PARTITION BY file ORDER BY start, stop, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR start > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, stop, tag ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT file, min(start) AS start, max(stop) AS stop, string_agg(tag::VARCHAR, ',' ORDER BY start, stop, tag) AS tags FROM i GROUP BY file, island""",
    )
)
def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = V.finding_steps(spark, sf_dir).select(normalized(F.col("file")).alias("file"), F.col("line").alias("start"), (F.col("line") + 10).alias("stop"), F.col("finding_id").alias("tag"))
    return S.merged_spans(spans)


@query(V.with_views("v_step", "SELECT raw_file, file, count(*) AS steps FROM v_step GROUP BY 1, 2"))
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = V.finding_steps(spark, sf_dir).groupBy(F.col("file").alias("raw_file")).agg(F.count("*").alias("steps"))
    return steps.withColumn("file", normalized(F.col("raw_file")))


@query(
    V.with_views(
        "v_step",
        """a AS (SELECT file, count(*) AS n FROM v_step WHERE provider = 'A' GROUP BY 1), r AS (SELECT file, count(*) AS n FROM v_step WHERE provider = 'R' GROUP BY 1)
SELECT coalesce(a.file, r.file) AS file, coalesce(a.n, 0) AS first_n, coalesce(r.n, 0) AS second_n FROM a FULL JOIN r ON a.file = r.file WHERE coalesce(a.n, 0) <> coalesce(r.n, 0)""",
    )
)
def provider_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per file of two providers, where they differ; a missing side counts 0. One pass over the steps instead of two and a join."""
    steps = V.finding_steps(spark, sf_dir).where(F.col("provider").isin("A", "R"))
    counts = steps.groupBy(normalized(F.col("file")).alias("file")).agg(F.count_if(F.col("provider") == "A").alias("first_n"), F.count_if(F.col("provider") == "R").alias("second_n"))
    return counts.where("first_n <> second_n")


_SETS = "a AS (SELECT DISTINCT code FROM v_step WHERE provider = 'A' AND line < 200), r AS (SELECT DISTINCT code FROM v_step WHERE provider = 'R' AND line BETWEEN 150 AND 400)"


@query(
    V.with_views(
        "v_step",
        f"""{_SETS} SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM r) UNION ALL SELECT 'union_all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM r)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM r) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM r)""",
    )
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = V.finding_steps(spark, sf_dir)
    a = steps.where("provider = 'A' AND line < 200").select("code").distinct()
    r = steps.where("provider = 'R' AND line BETWEEN 150 AND 400").select("code").distinct()
    both = {"union": a.union(r).distinct(), "union_all": a.unionByName(r), "intersect": a.intersect(r), "except": a.subtract(r)}
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, rows in both.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


@query(
    V.with_views(
        "v_step",
        "c AS (SELECT file, provider, count(*) AS n FROM v_step GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, provider) AS k FROM c) SELECT file, provider, n FROM r WHERE k = 1",
    )
)
def dominant_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent provider of each file, the first by name on a tie."""
    counts = V.finding_steps(spark, sf_dir).groupBy(normalized(F.col("file")).alias("file"), "provider").agg(F.count("*").alias("n"))
    top = Window.partitionBy("file").orderBy(F.desc("n"), "provider")
    return counts.withColumn("k", F.row_number().over(top)).where("k = 1").drop("k")
