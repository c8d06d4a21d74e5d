"""Conversations of lanes replayed under each loop mode, each against a fold in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.operators import loops
from siftlake.operators.ranking import dealt
from siftlake.plans import views as V
from siftlake.plans.registry import query

PASSES = 3
_CLASSES = list(dims.CLASS_CODES)[:7]
_LIST = "[" + ", ".join(f"'{c}'" for c in _CLASSES) + "]"
_GROUPS = "[" + ", ".join("[" + ", ".join(f"'{c}'" for c in _CLASSES[i : i + 3]) + "]" for i in range(0, 7, 3)) + "]"


def conversations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings by lane and turn, four orders a lane and a line number a turn; and the lanes with their classes."""
    name = lambda index: F.element_at(F.array(*map(F.lit, _CLASSES)), (index % len(_CLASSES)).cast("int") + 1)
    lines = F.array_sort(F.array_distinct(F.array((F.col("l_partkey") % 30).cast("int"), (F.col("l_suppkey") % 30).cast("int"), (F.col("l_quantity") % 10).cast("int"))))
    kind = lambda i: F.when(i == 0, "entrypoint").when(i == F.size("_lines") - 1, "sink").otherwise("propagation")
    rows = V.table(spark, sf_dir, "lineitem").withColumn("_lines", lines)
    names = F.array_distinct(F.array(name(F.col("l_partkey")), name(F.col("l_suppkey"))))
    found = rows.select(
        F.expr("cast(l_orderkey div 4 as string)").alias("lane"),
        (F.col("l_linenumber") - 1).cast("int").alias("turn"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("_ord"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("finding_id"),
        F.col("l_returnflag").alias("title"),
        F.lit("").alias("description"),
        F.lit(0.5).alias("confidence"),
        F.transform("_lines", lambda n, i: F.struct(kind(i).alias("kind"), F.lit("a.ts").alias("file"), n.alias("line"))).alias("trace"),
        F.transform(names, lambda c: F.struct(c.alias("class"), F.lit(0).alias("step"))).alias("classes"),
    )
    place = (((F.col("_ord.l_orderkey") * 100_000 + F.col("_ord.l_partkey")) * 1_000 + F.col("_ord.l_suppkey") % 1_000) * 100 + F.col("_ord.l_quantity")).cast("long")
    found = found.withColumn("ord", place).drop("_ord")
    return found, found.select("lane").distinct().withColumn("classes", F.array(*map(F.lit, _CLASSES)))


def summary(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Each lane's calls, what they yielded, and the findings and steps that it ends with."""
    found, lanes = conversations(spark, sf_dir)
    return loops.totals(found, lanes, mode, PASSES).where("findings > 0")


_SHARED = "len(list_intersect(k.lines, x.known[1].lines))"
_SCORES = f"""[CASE WHEN len(list_intersect(k.classes, x.known[1].classes)) > 0 AND {_SHARED} > 0 AND ({_SHARED} >= 2 OR k.title = x.known[1].title) THEN 2 * {_SHARED} + (k.title = x.known[1].title)::INT ELSE 0 END FOR k IN acc.known]"""
_AT = f"list_position({_SCORES}, list_max({_SCORES}))"
_NEWS = f"len(list_filter(x.known[1].lines, lambda n: NOT list_contains(acc.known[{_AT}].lines, n))) > 0"
_WOVEN = f"""[CASE WHEN i = {_AT} THEN {{title: acc.known[i].title, classes: list_distinct(list_concat(acc.known[i].classes, x.known[1].classes)), lines: list_distinct(list_concat(acc.known[i].lines, x.known[1].lines))}} ELSE acc.known[i] END FOR i IN range(1, len(acc.known) + 1)]"""


def _sql(mode: str) -> str:
    """acc: findings known, the turn, whether it gained, whether it was the last, and the counts."""
    fresh, gained = "(x.turn > acc.turn)", "(acc.gained AND x.turn = acc.turn)"
    state = lambda known, gain, added, revised: f"{{known: {known}, turn: x.turn, gained: {gain}, over: false, emitted: acc.emitted + 1, added: acc.added + {added}, revised: acc.revised + {revised}}}"
    stay = "{known: acc.known, turn: acc.turn, gained: acc.gained, over: true, emitted: acc.emitted, added: acc.added, revised: acc.revised}"
    append = state("list_concat(acc.known, x.known)", "true", 1, 0)
    like = state("acc.known", gained, 0, 0) if mode == "gap" else state(_WOVEN, f"({gained} OR {_NEWS})", 0, f"({_NEWS})::INT")
    stop = "false" if mode == "sweep" else f"acc.over OR x.turn > acc.turn + 1 OR ({fresh} AND acc.turn > 0 AND NOT acc.gained)"
    kept = {"none": "turn = 0", "sweep": "turn = 0 OR (turn <= 3 AND len(classes) > 0)"}.get(mode, f"turn <= {PASSES}")
    classes = f"CASE WHEN turn > 0 THEN list_intersect(own, {_GROUPS}[turn]) ELSE own END" if mode == "sweep" else "own"
    calls = {"none": "1", "sweep": "4"}.get(mode, f"1 + CASE WHEN r.turn > 0 AND NOT r.gained THEN r.turn ELSE least(r.turn + 1, {PASSES}) END")
    return f"""WITH i AS (SELECT (l_orderkey // 4)::VARCHAR AS lane, (l_linenumber - 1)::INT AS turn, l_returnflag AS title, ((((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 100 + l_quantity))::BIGINT AS ord,
list_distinct([{_LIST}[CAST(l_partkey % 7 AS INT) + 1], {_LIST}[CAST(l_suppkey % 7 AS INT) + 1]]) AS own, list_distinct([(l_partkey % 30)::INT, (l_suppkey % 30)::INT, CAST(floor(l_quantity % 10) AS INT)]) AS lines FROM lineitem),
n AS (SELECT lane, turn, ord, title, lines, {classes} AS classes FROM i), e AS (SELECT * FROM n WHERE {kept}),
l AS (SELECT lane, list({{known: [{{title: title, classes: classes, lines: lines}}], turn: turn, gained: turn = 0, over: false, emitted: 1, added: 1, revised: 0}} ORDER BY turn, ord) AS rows FROM e GROUP BY 1),
s AS (SELECT lane, list_prepend({{known: list_filter(rows[1].known, lambda k: false), turn: 0, gained: false, over: false, emitted: 0, added: 0, revised: 0}}, rows) AS rows FROM l),
r AS (SELECT lane, list_reduce(rows, lambda acc, x: CASE WHEN {stop} THEN {stay} WHEN x.turn = 0 OR coalesce(list_max({_SCORES}), 0) = 0 THEN {append} ELSE {like} END) AS r FROM s)
SELECT lane, ({calls})::BIGINT AS calls, r.emitted::BIGINT AS emitted, r.added::BIGINT AS added, r.revised::BIGINT AS revised, len(r.known)::BIGINT AS findings, list_sum([len(k.lines) FOR k IN r.known])::BIGINT AS steps FROM r WHERE len(r.known) > 0"""


@query(_sql("none"))
def loop_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir, "none")


@query(_sql("trace"))
def loop_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir, "trace")


@query(_sql("gap"))
def loop_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir, "gap")


@query(_sql("reflect"))
def loop_reflect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir, "reflect")


@query(_sql("sweep"))
def loop_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark, sf_dir, "sweep")


_CALLS = """WITH c AS (SELECT o_orderkey AS ord, (o_orderkey % 14)::BIGINT AS n FROM orders) SELECT ord, 1::BIGINT AS none, 3::BIGINT AS trace, (1 + CEIL(n / 3.0))::BIGINT AS sweep FROM c"""


@query(_CALLS)
def calls_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that one chunk costs in three modes, two passes and groups of three."""
    from siftlake.operators.budget import calls_per_chunk as calls

    n = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 14).alias("n"))
    return n.select("ord", *[calls(mode, F.col("n"), 2, 3).cast("long").alias(mode) for mode in ("none", "trace", "sweep")])


_NEW_TURN = "(x.turn > acc.turn)"
_MERGED = f"""WITH i AS (SELECT (l_orderkey // 4)::VARCHAR AS lane, (l_linenumber - 1)::INT AS turn, l_returnflag AS title, ((((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 100 + l_quantity))::BIGINT AS ord,
list_distinct([{_LIST}[CAST(l_partkey % 7 AS INT) + 1], {_LIST}[CAST(l_suppkey % 7 AS INT) + 1]]) AS classes, list_distinct([(l_partkey % 30)::INT, (l_suppkey % 30)::INT, CAST(floor(l_quantity % 10) AS INT)]) AS lines FROM lineitem),
l AS (SELECT lane, list({{known: [{{title: title, classes: classes, lines: lines}}], turn: turn, turns: 0, gained: false, over: false}} ORDER BY turn, ord) AS rows FROM i GROUP BY 1),
s AS (SELECT lane, list_prepend({{known: list_filter(rows[1].known, lambda k: false), turn: -1, turns: 0, gained: false, over: false}}, rows) AS rows FROM l),
r AS (SELECT lane, list_reduce(rows, lambda acc, x: CASE WHEN acc.over OR ({_NEW_TURN} AND acc.turns > 1 AND NOT acc.gained) THEN {{known: acc.known, turn: acc.turn, turns: acc.turns, gained: acc.gained, over: true}}
  WHEN coalesce(list_max({_SCORES}), 0) = 0 THEN {{known: list_concat(acc.known, x.known), turn: x.turn, turns: acc.turns + {_NEW_TURN}::INT, gained: true, over: false}}
  ELSE {{known: {_WOVEN}, turn: x.turn, turns: acc.turns + {_NEW_TURN}::INT, gained: (acc.gained AND NOT {_NEW_TURN}) OR {_NEWS}, over: false}} END).known AS known FROM s)
SELECT lane, len(known)::BIGINT AS findings, list_sum([len(k.lines) FOR k IN known])::BIGINT AS steps, list_sum([len(k.classes) FOR k IN known])::BIGINT AS classes FROM r"""


@query(_MERGED)
def merge_findings_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns folded by a table function that takes each lane's rows in order; what each lane ends with."""
    from siftlake.functions import tables

    tables.register(spark)
    bare = conversations(spark, sf_dir)[0].selectExpr("lane", "turn", "ord", "title", "transform(trace, s -> s.line) AS lines", "transform(classes, c -> c.class) AS classes")
    rows = dealt(bare, V.table(spark, sf_dir, "lineitem").count(), "lane", most=1 << 20).sortWithinPartitions("lane", "turn", "ord")
    return spark.sql("SELECT * FROM merged_sizes(TABLE({rows}))", rows=rows)
