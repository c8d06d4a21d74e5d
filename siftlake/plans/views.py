"""Scan relations derived from the driver's tables, in Spark and as DuckDB text of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.operators.ranking import dealt_if_many


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXTENSIONS = ["ts", "js", "py", "html", "css", "json", "sol", "vue"]
_code = lambda index: F.element_at(F.array(*map(F.lit, dims.CODES)), (index % len(dims.CODES)).cast("int") + 1)
_CODES_SQL = "[" + ", ".join(f"'{code}'" for code in dims.CODES) + "]"


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    return part.select(
        F.col("p_partkey").alias("key"),
        F.expr("concat('src/', p_brand, '/p', p_partkey div 2, '.ts')").alias("file"),
        F.expr("p_size * 20 + cast(p_partkey % 7 as int)").alias("line"),
        F.array(_code(F.col("p_partkey"))).alias("codes"),
    )


def finding_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    items = dealt_if_many(items, items.count(), "l_partkey").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    prefix = F.expr("CASE l_orderkey % 4 WHEN 0 THEN './' WHEN 1 THEN '/work/' ELSE '' END")
    return items.select(
        F.col("l_orderkey").alias("finding_id"),
        F.concat(prefix, F.expr("concat('src/', p_brand, '/p', p_partkey div 2, '.ts')")).alias("file"),
        F.expr("cast(l_quantity as int) * 20 + cast(l_orderkey % 7 as int)").alias("line"),
        _code(F.col("l_partkey") + F.col("l_suppkey") % 3).alias("code"),
        F.col("l_returnflag").alias("provider"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("ord"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8).cast("int") + 1)
    path = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("."), ext)
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), path.alias("path"), text.alias("content"), F.octet_length(text).alias("bytes"), F.size(F.split(text, "\n", -1)).alias("lines"), F.col("source").alias("dir")
    )


#: DuckDB views of the same names, to be put behind WITH.
SQL = {
    "v_gt": f"""v_gt AS (SELECT p_partkey AS key, concat('src/', p_brand, '/p', p_partkey // 2, '.ts') AS file,
        p_size * 20 + CAST(p_partkey % 7 AS INT) AS line, list_extract({_CODES_SQL}, CAST(p_partkey % 25 AS INT) + 1) AS code FROM part WHERE p_partkey % 3 = 0)""",
    "v_step": f"""v_step AS (SELECT l_orderkey AS finding_id,
        concat(CASE l_orderkey % 4 WHEN 0 THEN './' WHEN 1 THEN '/work/' ELSE '' END, 'src/', p_brand, '/p', p_partkey // 2, '.ts') AS raw_file,
        concat('src/', p_brand, '/p', p_partkey // 2, '.ts') AS file, CAST(floor(l_quantity) AS INT) * 20 + CAST(l_orderkey % 7 AS INT) AS line,
        list_extract({_CODES_SQL}, CAST((l_partkey + l_suppkey % 3) % 25 AS INT) + 1) AS code, l_returnflag AS provider,
        l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "v_file": """v_file AS (SELECT doc_id AS ord, concat(source, '/d', doc_id, '.', list_extract(['ts', 'js', 'py', 'html', 'css', 'json', 'sol', 'vue'], CAST(doc_id % 8 AS INT) + 1)) AS path,
        list_extract(['ts', 'js', 'py', 'html', 'css', 'json', 'sol', 'vue'], CAST(doc_id % 8 AS INT) + 1) AS ext,
        coalesce(text, '') AS content, strlen(coalesce(text, ''))::INT AS bytes, len(string_split(coalesce(text, ''), chr(10)))::INT AS lines, source AS dir FROM documents)""",
    "class_code": "class_code AS (SELECT * FROM " + dims.sql_values([(c, k) for c, ks in dims.CLASS_CODES.items() for k in ks], "v(class, code)") + ")",
    "signal_class": "signal_class AS (SELECT * FROM " + dims.sql_values([(s, c) for s, cs in dims.SIGNAL_CLASSES.items() for c in cs], "v(signal, class)") + ")",
}


def with_views(names: str, body: str) -> str:
    return "WITH " + ",\n".join(SQL[name] for name in names.split()) + ("\n" if body.lstrip().startswith("SELECT") else ",\n") + body
