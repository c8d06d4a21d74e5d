"""Queries over a source tree that Spark writes from the documents and the tree source walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import text as X
from siftlake.operators import recon as R
from siftlake.plans import views as V
from siftlake.plans.registry import query
from siftlake.sources import tree
from siftlake.sources.folders import kept, shared_folder

_LANG = "lang AS (SELECT * FROM " + dims.sql_values([(e[1:], n) for e, n in dims.INVENTORY_LANGUAGES.items()], "v(ext, language)") + ")"
_FOLDER = "CASE ord % 6 WHEN 0 THEN 'node_modules/pkg/' WHEN 1 THEN 'src/build/' WHEN 2 THEN 'lib/' ELSE 'src/' END"
_TREE = f"""t AS (SELECT concat({_FOLDER}, dir, '/n', ord // 100, '/d', ord, '.', CASE ord % 9 WHEN 8 THEN 'txt' ELSE ext END) AS path, CASE ord % 9 WHEN 8 THEN 'txt' ELSE ext END AS ext, content, bytes, lines FROM v_file WHERE ord % 6 > 1)"""


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a tree with a file for each document, some of them below names that a walk leaves out."""
    files = V.files(spark, sf_dir)
    name = F.concat(F.expr(_FOLDER), "dir", F.lit("/n"), F.expr("cast(ord div 100 as string)"), F.lit("/d"), F.col("ord").cast("string"))
    ext = F.when(F.col("ord") % 9 == 8, ".txt").otherwise(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    root = shared_folder(spark, "tree")
    tree.write(files.select(F.concat(name, ext).alias("path"), "content"), root)
    return root


def _read(rows: DataFrame, root: str) -> DataFrame:
    out = kept(rows)
    tree.remove(rows.sparkSession, root)
    return out


@query(V.with_views("v_file", f"{_LANG}, {_TREE} SELECT language, count(*) AS files, sum(bytes)::BIGINT AS total_bytes, min(path) AS first_path FROM t JOIN lang USING (ext) GROUP BY 1"))
def source_tree_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each language, from the listing alone: no file is opened."""
    root = _written(spark, sf_dir)
    found = R.scan_tree(spark, root, content=False)
    return _read(found.groupBy("language").agg(F.count("*").alias("files"), F.sum("bytes").alias("total_bytes"), F.min("path").alias("first_path")), root)


@query(V.with_views("v_file", f"{_LANG}, {_TREE} SELECT path, language, bytes::BIGINT AS bytes, lines, sha256(content) AS sha256 FROM t JOIN lang USING (ext) WHERE starts_with(path, 'src/')"))
def source_tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the files below one folder; the folder and the extensions are filters that the walk takes."""
    root = _written(spark, sf_dir)
    found = R.scan_tree(spark, root).where(F.col("path").startswith("src/"))
    return _read(found.select("path", "language", "bytes", X.line_count(F.col("content")).alias("lines"), F.sha2("content", 256).alias("sha256")), root)
