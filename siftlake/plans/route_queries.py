"""Queries over routes. The routes are derived from the parts table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text as X
from siftlake.operators import coverage as C
from siftlake.operators import routes as R
from siftlake.plans import views as V
from siftlake.plans.registry import query

_SPARK = """SELECT p_partkey AS ord, element_at(array('GET', 'POST', 'PUT', 'USE'), cast(p_partkey % 4 AS int) + 1) AS method,
    concat('/api/', lower(p_brand), CASE p_partkey % 3 WHEN 0 THEN '/:id' WHEN 1 THEN concat('/', p_size) ELSE '' END) AS path,
    CASE p_partkey % 5 WHEN 0 THEN concat('handlers.f', p_size, '()') WHEN 1 THEN concat('f', p_size, '(req)') WHEN 2 THEN concat('asyncHandler(f', p_size, ')') WHEN 3 THEN concat('f', p_size) ELSE 'security.isAuthorized()' END AS handler,
    CASE p_partkey % 6 WHEN 0 THEN array('log', 'security.isAuthorized()') WHEN 1 THEN array('security.denyAll()', 'isAuthorized') WHEN 2 THEN array('log', concat('wrap(f', p_size, ')')) ELSE array('log') END AS middleware, concat('src/', p_brand, '.ts') AS file FROM part"""
_SQL = (
    "r AS (" + _SPARK.replace("element_at(array('GET', 'POST', 'PUT', 'USE'), cast(p_partkey % 4 AS int) + 1)", "list_extract(['GET', 'POST', 'PUT', 'USE'], CAST(p_partkey % 4 AS INT) + 1)")
    .replace("array('log', 'security.isAuthorized()')", "['log', 'security.isAuthorized()']").replace("array('security.denyAll()', 'isAuthorized')", "['security.denyAll()', 'isAuthorized']").replace("array('log')", "['log']").replace("array('log', concat('wrap(f', p_size, ')'))", "['log', concat('wrap(f', p_size, ')')]")
    + "), ra AS (SELECT *, CASE ord % 6 WHEN 0 THEN 'security.isAuthorized()' WHEN 1 THEN 'security.denyAll()' END AS auth FROM r)"
)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK.replace("FROM part", "FROM {part}"), part=V.table(spark, sf_dir, "part"))


@query(f"WITH {_SQL} SELECT method <> 'USE' AND path <> '*' AS hand_written, count(*) AS routes FROM r GROUP BY 1")
def route_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).groupBy(((F.col("method") != "USE") & (F.col("path") != "*")).alias("hand_written")).agg(F.count("*").alias("routes"))


@query(f"WITH {_SQL} SELECT ord, auth FROM ra")
def route_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("ord", R.auth_of(F.col("middleware")).alias("auth"))


_NAMES = "n AS (SELECT DISTINCT unnest(CASE ord % 5 WHEN 0 THEN [concat('f', s)] WHEN 1 THEN [concat('f', s)] WHEN 2 THEN ['asyncHandler'] WHEN 3 THEN [] ELSE ['isAuthorized'] END) AS name FROM (SELECT p_partkey AS ord, p_size AS s FROM part))"


@query(f"WITH {_NAMES} SELECT name FROM n")
def handler_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select(F.explode(R.handler_names(F.col("handler"))).alias("name")).distinct()


@query(f"WITH {_SQL}, s AS (SELECT p_partkey AS ord, p_size FROM part) SELECT ord, CASE ord % 5 WHEN 0 THEN 'src/handlers.ts' WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE concat('src/f', p_size, '.ts') END AS handler_file FROM r JOIN s USING (ord)")
def handler_to_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = V.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_size")).alias("name")).distinct()
    imports = sizes.unionByName(spark.createDataFrame([("handlers",)], "name string")).withColumn("file", F.concat(F.lit("src/"), "name", F.lit(".ts")))
    return R.handler_files(_routes(spark, sf_dir), imports).select("ord", "handler_file")


@query(
    f"""WITH {_SQL}, d AS (SELECT DISTINCT string_split(concat('/api/', lower(p_brand), CASE p_partkey % 2 WHEN 0 THEN concat('/', p_size) ELSE '' END), '/') AS p FROM part WHERE p_partkey % 7 = 0),
x AS (SELECT ord, method, path, string_split(path, '/') AS p FROM r WHERE method <> 'USE')
SELECT ord, method, path FROM x WHERE NOT EXISTS (SELECT 1 FROM d WHERE len(d.p) = len(x.p) AND d.p[3] = x.p[3] AND (len(x.p) < 4 OR d.p[4] = x.p[4] OR x.p[4][1] = ':' OR d.p[4][1] = ':'))"""
)
def undocumented_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part").where("p_partkey % 7 = 0")
    documented = part.select(F.expr("concat('/api/', lower(p_brand), CASE p_partkey % 2 WHEN 0 THEN concat('/', p_size) ELSE '' END)").alias("doc_path"))
    return R.undocumented(_routes(spark, sf_dir), documented).select("ord", "method", "path")


_MATCHED = "s AS (SELECT DISTINCT concat('src/f', p_size, '.ts') AS target, concat('f', p_size) AS name, p_size FROM part WHERE p_size % 2 = 0), m AS (SELECT DISTINCT s.target, ra.ord, ra.auth FROM ra JOIN part ON p_partkey = ra.ord JOIN s ON s.p_size = part.p_size WHERE ra.ord % 5 < 4 OR ra.ord % 6 = 2)"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = V.table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.concat(F.lit("f"), F.col("p_size")).alias("name")).distinct()
    symbols = symbols.withColumn("file", F.concat(F.lit("src/"), "name", F.lit(".ts")))
    routes = _routes(spark, sf_dir).select("ord", "handler", "middleware", R.auth_of(F.col("middleware")).alias("auth"))
    return R.routes_of_files(routes, symbols)


@query(
    f"""WITH {_SQL}, {_MATCHED}, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN auth IS NULL THEN 0 ELSE 1 END, ord)::INT AS rank, greatest(count(*) OVER (PARTITION BY target) - 15, 0) AS dropped FROM m)
SELECT target AS file, ord, rank, dropped FROM k WHERE rank <= 15"""
)
def route_context_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shown(_matched(spark, sf_dir)).select("file", "ord", "rank", "dropped")


@query(
    f"""WITH {_SQL}, {_MATCHED}, c AS (SELECT target, count(*) AS n FROM m WHERE ord % 3 = 0 GROUP BY 1), a AS (SELECT DISTINCT concat('src/f', p_size, '.ts') AS target FROM part), n AS (SELECT a.target, coalesce(n, 0) AS n FROM a LEFT JOIN c ON a.target = c.target)
SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 15 THEN '6-15' ELSE '>15' END AS routes, count(*) AS files FROM n GROUP BY 1"""
)
def route_match_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _matched(spark, sf_dir).where("ord % 3 = 0").groupBy("file").agg(F.count("*").alias("n"))
    every = V.table(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), F.col("p_size"), F.lit(".ts")).alias("file")).distinct()
    return R.match_distribution(every.join(counts, "file", "left").withColumn("n", F.coalesce("n", F.lit(0))))


@query(f"WITH {_SQL} SELECT ord, path FROM r WHERE string_split(path, '/')[3] IN (SELECT lower(p_brand) FROM part WHERE p_partkey % 5 = 0 AND p_brand < 'Brand#2')")
def unpaginated_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    crud = V.table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("/api/"), F.lower("p_brand")).alias("pattern"), (F.col("p_brand") >= "Brand#2").alias("paginated"))
    return R.under_crud(_routes(spark, sf_dir), crud).select("ord", "path")


@query(
    f"""WITH {_SQL}, t AS (SELECT DISTINCT concat(p_brand, '.ts') AS target FROM part WHERE p_partkey % 3 = 0), m AS (SELECT target, ord, method, coalesce(auth, 'none') AS auth, CASE method WHEN 'USE' THEN 'middleware' ELSE 'handler' END AS kind, ord % 50 AS line
    FROM ra JOIN t ON ends_with(ra.file, concat('/', target)) OR ra.file = target) SELECT target, kind, ord, auth, row_number() OVER (PARTITION BY target, kind ORDER BY CASE auth WHEN 'none' THEN 0 ELSE 1 END, line, ord)::INT AS rank FROM m"""
)
def registrar_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that a file registers, unguarded first, then by line."""
    routes = _routes(spark, sf_dir).withColumns({"auth": R.auth_of(F.col("middleware")), "line": F.col("ord") % 50})
    targets = V.table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat("p_brand", F.lit(".ts")).alias("path"))
    return R.registered_in(routes, targets).select("target", "kind", "ord", "auth", "rank")


@query(
    f"""WITH {_SQL}, gt AS (SELECT DISTINCT p_brand, concat('src/', p_brand, '.ts') AS file FROM part WHERE p_partkey % 3 = 0), s AS (SELECT DISTINCT concat('src/', p_brand, '.ts') AS file, concat('f', p_size) AS name FROM part WHERE p_partkey % 2 = 0),
w AS (SELECT ord, auth, unnest(list_distinct(list_concat([split_part(handler, '.', 1)], list_transform(list_filter(string_split(translate(array_to_string(middleware, ' '), '(),', '   '), ' '), lambda x: x <> ''), lambda x: split_part(x, '.', 1))))) AS name FROM ra),
m AS (SELECT DISTINCT gt.file, ord, auth FROM gt JOIN s ON s.file = gt.file JOIN w ON w.name = s.name) SELECT file, count(*) AS routes, bool_and(auth IS NOT NULL) AS all_guarded FROM m GROUP BY 1"""
)
def route_backed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of ground truth whose exported symbols a route or its middleware names."""
    part = V.table(spark, sf_dir, "part")
    file = F.concat(F.lit("src/"), "p_brand", F.lit(".ts")).alias("file")
    symbols = part.where("p_partkey % 2 = 0").select(file, F.concat(F.lit("f"), F.col("p_size")).alias("name"))
    routes = _routes(spark, sf_dir).withColumn("auth", R.auth_of(F.col("middleware")))
    return R.backed_files(part.where("p_partkey % 3 = 0").select(file), symbols, routes)


@query(f"WITH {_SQL} SELECT ord, CASE ord % 5 WHEN 0 THEN regexp_extract(handler, '^([a-z]+[.][a-z0-9]+)', 1) WHEN 2 THEN regexp_extract(handler, '[(]([a-z0-9]+)', 1) WHEN 4 THEN 'security.isAuthorized' ELSE regexp_extract(handler, '^([a-z0-9]+)', 1) END AS name FROM r")
def handler_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("ord", X.outermost_handler(F.col("handler")).alias("name"))


_THEMES = {"first": ["brand#1", "brand#2"], "ids": [":id"], "fours": ["4"]}


@query(f"WITH {_SQL} " + " UNION ALL ".join(f"SELECT ord, '{t}' AS theme FROM r WHERE " + " OR ".join(f"contains(path, '{w}')" for w in words) for t, words in _THEMES.items()))
def lane_routing_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.routed(_routes(spark, sf_dir), _THEMES).select("ord", "theme")


@query(f"WITH {_SQL} SELECT file, count(*) AS routes, bool_and(auth IS NOT NULL) AS all_guarded FROM ra GROUP BY 1")
def route_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = _routes(spark, sf_dir).withColumn("auth", R.auth_of(F.col("middleware")))
    return routes.groupBy("file").agg(F.count("*").alias("routes"), F.min(F.col("auth").isNotNull()).alias("all_guarded"))


@query(f"WITH {_SQL}, b AS (SELECT ord, length(handler) AS base, len(middleware) * 20 AS added FROM r) SELECT count(*) AS lanes, sum(added)::BIGINT AS added, min(added)::BIGINT AS least, max(added)::BIGINT AS most, round(avg(added * 100.0::DOUBLE / base), 6) AS mean_pct FROM b")
def prompt_size_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that route context adds to a prompt, each as a share of its own base."""
    added = (F.size("middleware") * 20).cast("long")
    rows = _routes(spark, sf_dir).select(F.length("handler").alias("base"), added.alias("added"))
    return rows.agg(F.count("*").alias("lanes"), F.sum("added").alias("added"), F.min("added").alias("least"), F.max("added").alias("most"), F.round(F.avg(F.col("added") * 100.0 / F.col("base")), 6).alias("mean_pct"))


_NAMED = "SELECT p_partkey AS ord, concat(CASE p_partkey % 3 WHEN 0 THEN concat('A0', p_partkey % 9, ': ') WHEN 1 THEN concat('LLM', p_size, ': ') ELSE ' ' END, p_name) AS name, CASE p_partkey % 4 WHEN 0 THEN 'owasp' WHEN 1 THEN 'API Security' WHEN 2 THEN ' llm' ELSE p_brand END AS framework, CASE p_partkey % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'uncertain' ELSE 'present' END AS verdict FROM part"


@query(
    f"""WITH c AS ({_NAMED}) SELECT CASE WHEN regexp_matches(name, '^[A-Za-z0-9]+:') THEN regexp_extract(name, '^([A-Za-z0-9]+):', 1) ELSE trim(name) END AS code, name,
    CASE lower(trim(framework)) WHEN 'owasp' THEN 'OWASP Top 10 2021' WHEN 'api security' THEN 'API Security Top 10' WHEN 'llm' THEN 'LLM Top 10' ELSE framework END AS framework FROM c WHERE verdict IN ('present', 'uncertain')"""
)
def category_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.universe(spark.sql(_NAMED.replace("FROM part", "FROM {part}"), part=V.table(spark, sf_dir, "part")))
