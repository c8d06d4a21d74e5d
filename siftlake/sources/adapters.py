"""Readers of findings, ground truth, ledgers and manifests in the shapes that tools write them.

Documents are read from a file, a folder of files, or a bundle of them (`bundles`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.paths import basename, resolved
from siftlake.sources.bundles import is_bundle, texts

STEP = "struct<kind: string, file: string, line: int, description: string>"
FINDING = f"struct<finding_id: string, title: string, description: string, verdict: string, categories: array<string>, trace: array<{STEP}>>"
SARIF = "runs array<struct<results: array<struct<ruleId: string, message: struct<text: string>, locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>>>>>>>"
PLACE = r"([\w./-]+\.\w+):(\d+)"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one row each; of an array at the top, one row for each element."""
    if is_bundle(path):
        kind = T.StructType.fromDDL(schema)
        listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(kind))).otherwise(F.array(F.from_json("value", kind)))
        return texts(spark, path).select(F.inline(listed))
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a document: a bare array, or under one of three names."""
    text = texts(spark, path)
    wrapped = F.from_json("value", f"findings array<{FINDING}>, candidate_findings array<{FINDING}>, validated_findings array<{FINDING}>")
    bare = F.from_json("value", f"array<{FINDING}>")
    rows = text.withColumn("doc", wrapped).withColumn("bare", F.when(F.ltrim("value").startswith("["), bare))
    every = F.coalesce("bare", "doc.findings", "doc.candidate_findings", "doc.validated_findings")
    return rows.select(F.posexplode(every).alias("ord", "f")).select("ord", "f.*")


def confirmed(rows: DataFrame) -> DataFrame:
    """file, line and title of confirmed findings: their first sink, else their last step."""
    sink = F.coalesce(F.try_element_at(F.filter("trace", lambda s: s["kind"] == "sink"), F.lit(1)), F.try_element_at("trace", F.lit(-1)))
    return rows.where("verdict = 'confirmed'").withColumn("_s", sink).select("_s.file", "_s.line", "title", "description")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    doc = json_documents(spark, path, "entries array<struct<challengeKey: string, file: string, line: int, owasp_codes: array<string>, category: string>>")
    return doc.select(F.inline("entries")).select(F.col("challengeKey").alias("key"), "file", "line", F.coalesce("owasp_codes", F.array("category")).alias("codes"))


def sarif(spark: SparkSession, path: str) -> DataFrame:
    """First location of each result; the title is the message, else the rule. A folder's files are read together."""
    results = json_documents(spark, path, SARIF).select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.try_element_at("r.locations", F.lit(1))["physicalLocation"]
    title = F.coalesce(F.nullif("r.message.text", F.lit("")), "r.ruleId")
    return results.select(place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), title.alias("title"), F.col("r.message.text").alias("description"))


def _number(column):
    return F.nullif(column, F.lit("")).cast("int")


def markdown_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Findings of reports that hold many: `## [..] Title` blocks with a Location line, else the first file:line of the block."""
    blocks = texts(spark, path).select(F.explode(F.split("value", r"(?m)^(?=## \[)")).alias("block")).where("block RLIKE '^## \\\\['")
    named = rf"\*\*Location\*\*:\s*`?{PLACE}"
    file = lambda group: F.coalesce(F.nullif(F.regexp_extract("block", named, group), F.lit("")), F.regexp_extract("block", PLACE, group))
    return blocks.select(file(1).alias("file"), _number(file(2)).alias("line"), F.trim(F.regexp_extract("block", r"^## \[[^\]]*\]\s*(.*)", 1)).alias("title"), F.substring("block", 1, 2000).alias("description"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Reports of one finding each: `# [..] Title` and a **File:** line."""
    text = texts(spark, path)
    file = r"\*\*File:\*\*\s*`([^`]+)`"
    return text.select(F.regexp_extract("value", file, 1).alias("file"), _number(F.regexp_extract("value", file + r"\s*\(lines?\s+(\d+)", 2)).alias("line"), F.trim(F.regexp_extract("value", r"(?m)^# \[[^\]]*\]\s*(.*)$", 1)).alias("title"), F.substring("value", 1, 2000).alias("description"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Runs of an append-only JSON-lines ledger; flat and nested metrics become one shape."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("v"))
    get = lambda kind, *paths: F.coalesce(*[F.try_variant_get("v", p, kind) for p in paths])
    return rows.select(
        get("string", "$.run_id").alias("run_id"),
        get("string", "$.timestamp").alias("timestamp"),
        get("string", "$.component").alias("component"),
        get("bigint", "$.tokens", "$.metrics.tokens").alias("tokens"),
        get("double", "$.est_cost_usd", "$.metrics.cost_usd").alias("cost_usd"),
        get("double", "$.metrics.recall.pct", "$.metrics.recall", "$.recall").alias("recall_pct"),
        get("double", "$.metrics.localization.pct", "$.metrics.localization", "$.localization").alias("localization_pct"),
    )


def consumption(spark: SparkSession, path: str) -> DataFrame:
    """Reports as a bare array, or as an object of lanes with older entries beside them."""
    entry = "struct<lane_id: string, tokens_used: bigint, seconds_elapsed: double, ceiling_hit: boolean, failed: boolean>"
    text = texts(spark, path)
    doc = F.from_json("value", f"lanes array<{entry}>, legacy_entries array<{entry}>")
    none = F.array().cast(f"array<{entry}>")
    rows = text.withColumn("doc", doc).withColumn("bare", F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{entry}>")))
    every = F.coalesce("bare", F.concat(F.coalesce("doc.lanes", none), F.coalesce("doc.legacy_entries", none)))
    return rows.select(F.posexplode(every).alias("ord", "e")).select("ord", "e.*").withColumn("failed", F.coalesce("failed", F.lit(False)))


def lane_usage(spark: SparkSession, folder: str) -> DataFrame:
    schema = "laneId string, sizeBucket string, predictedTotalTokens bigint, actualTotalTokens bigint, wallClockSeconds double, completedAt timestamp"
    rows = json_documents(spark, folder, schema)
    return rows.select(F.col("laneId").alias("lane_id"), F.col("sizeBucket").alias("bucket"), F.col("predictedTotalTokens").alias("predicted"), F.col("actualTotalTokens").alias("actual"), F.col("completedAt").isNotNull().alias("completed"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """Name and version of every dependency in manifests (path, content)."""
    doc = F.from_json("content", "dependencies map<string, string>, devDependencies map<string, string>")
    empty = F.create_map().cast("map<string, string>")
    both = F.concat(F.map_entries(F.coalesce(doc["dependencies"], empty)), F.map_entries(F.coalesce(doc["devDependencies"], empty)))
    return manifests.select("path", F.inline(both)).select("path", F.col("key").alias("name"), F.col("value").alias("version"))


def spec_paths(spark: SparkSession, path: str) -> DataFrame:
    """Documented paths of API descriptions in YAML, behind their first server's URL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            for text in batch["value"]:
                spec = yaml.safe_load(text) or {}
                servers = spec.get("servers") or [{}]
                base = (servers[0].get("url") or "").rstrip("/")
                yield pd.DataFrame({"doc_path": [base + p for p in spec.get("paths") or {}]}, dtype="object")

    return texts(spark, path).mapInPandas(run, "doc_path string")


def imports(files: DataFrame) -> DataFrame:
    """Names that files import from relative modules, with the module's file: the first of five candidates that exists."""
    found = F.regexp_extract_all("content", F.lit(r"import\s+(?:\*\s+as\s+|\{?\s*)([\w$, ]+?)\s*\}?\s+from\s+['\"]\.{1,2}/[^'\"]+['\"]"), F.lit(1))
    modules = F.regexp_extract_all("content", F.lit(r"import\s+(?:\*\s+as\s+|\{?\s*)[\w$, ]+?\s*\}?\s+from\s+['\"](\.{1,2}/[^'\"]+)['\"]"), F.lit(1))
    rows = files.select("path", F.explode(F.arrays_zip(found.alias("names"), modules.alias("module"))).alias("i"))
    names = rows.select("path", "i.module", F.explode(F.split("i.names", r"\s*,\s*")).alias("name")).where("name <> ''")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    joined = resolved(F.concat(folder, "module"))
    ends = F.posexplode(F.array(*map(F.lit, ["", ".ts", ".tsx", ".js", "/index.ts"])))
    tried = names.select("path", "name", joined.alias("base"), ends.alias("rank", "end")).withColumn("file", F.concat("base", "end"))
    return tried.join(files.select(F.col("path").alias("file")), "file").groupBy("path", "name").agg(F.min_by("file", "rank").alias("file"))


def dependency_names(manifests: DataFrame, name: str = "package.json", deepest: int = 3) -> DataFrame:
    """Distinct names of the dependencies of all manifests at most `deepest` folders down."""
    near = (basename(F.col("path")) == name) & (F.size(F.split("path", "/")) <= deepest + 1)
    return dependencies(manifests.where(near)).select("name").distinct()


def guarded(paths: DataFrame, roots: list[str], denied: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Each path with `allowed`: below a root once dots are resolved, and not denied.

    links (path, target): symbolic links; what a path stands for must be below a root and not denied too.
    """
    marked = paths.withColumn("clean", resolved(F.col("path"))).withColumn("_real", F.col("clean"))
    if links is not None:
        known = links.select(resolved(F.col("path")).alias("clean"), resolved(F.col("target")).alias("_target"))
        marked = marked.join(known, "clean", "left").withColumn("_real", F.coalesce("_target", "clean")).drop("_target")
    refused = denied.select(F.col("path").alias("_real"), F.lit(True).alias("_no")).distinct()
    marked = marked.join(refused, "_real", "left").join(refused.withColumnsRenamed({"_real": "clean", "_no": "_no_link"}), "clean", "left")
    below = F.lit(True)
    for name in ("clean", "_real"):
        inside = F.lit(False)
        for root in roots:
            inside = inside | (F.col(name) == root) | F.col(name).startswith(root.rstrip("/") + "/")
        below = below & inside
    return marked.withColumn("allowed", below & F.col("_no").isNull() & F.col("_no_link").isNull()).drop("_no", "_no_link", "_real")


def blocked(guarded_paths: DataFrame) -> DataFrame:
    """One row: reads asked for, and those refused."""
    return guarded_paths.agg(F.count("*").alias("reads"), F.count_if(~F.col("allowed")).alias("blocked"))


#: Adapter of each kind of report: a function of (spark, path) that gives file, line, title and description.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sarif": sarif,
    "markdown-blocks": markdown_blocks,
    "markdown-files": markdown_files,
    "confirmed-json": lambda spark, path: confirmed(findings(spark, path)),
}
