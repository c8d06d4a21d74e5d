"""Inventory of a source tree and the signals of its files."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import text as X
from siftlake.functions.paths import basename, extension
from siftlake.operators.ranking import first_of_group, numbered
from siftlake.sources import tree


def pruned(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with no excluded name in their path. Looks at paths alone, before any content is read."""
    return files.where(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, dims.EXCLUDED_NAMES))))


def with_language(files: DataFrame, table: dict[str, str] | None = None, keep_unknown: bool = False) -> DataFrame:
    """`language` by extension or a bare Dockerfile; files of unknown languages go unless kept."""
    ext = F.when(F.lower(basename(F.col("path"))) == "dockerfile", F.lit(".dockerfile")).otherwise(extension(F.col("path")))
    known = dims.languages(files.sparkSession, {".dockerfile": "docker"} | (table or dims.INVENTORY_LANGUAGES))
    return files.withColumn("ext", ext).join(known, "ext", "left" if keep_unknown else "inner")


def legacy_sources(files: DataFrame) -> DataFrame:
    """Files that the older walk takes: by its own extensions, and Dockerfile, .env and .env.* by name."""
    name = F.lower(basename(F.col("path")))
    return files.where(extension(F.col("path")).isin(dims.LEGACY_EXTENSIONS) | name.isin("dockerfile", ".env") | name.startswith(".env."))


def with_metrics(files: DataFrame) -> DataFrame:
    return files.withColumns({"bytes": X.byte_count(F.col("content")), "lines": X.line_count(F.col("content"))})


def by_language(files: DataFrame, samples: int = 5) -> DataFrame:
    """Files of each language and its first paths by ord."""
    counts = files.groupBy("language").agg(F.count("*").alias("files"))
    first = first_of_group(files.select("language", "ord", "path"), ["language"], ["ord"], samples)
    paths = first.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("p"))
    return counts.join(paths, "language").select("language", "files", F.col("p.path").alias("sample_paths"))


def unclassified_surface(files: DataFrame, covered: list[str]) -> DataFrame:
    """Languages that no extractor covers: files and bytes."""
    return files.where(~F.col("language").isin(covered)).groupBy("language").agg(F.count("*").alias("files"), F.sum("bytes").alias("total_bytes"), F.min("path").alias("first_path"))


def unclassified_files(files: DataFrame, classified: DataFrame) -> DataFrame:
    """Files (path, language, bytes) that no extractor claimed, by place in their language's list sorted by path, with the
    language's totals beside them. The list is rows, not one array: a language may hold most of a tree."""
    left = files.select("path", "language", "bytes").join(classified.select("path").distinct(), "path", "left_anti")
    totals = left.groupBy("language").agg(F.count("*").alias("files"), F.sum("bytes").alias("total_bytes"))
    return numbered(left, ["language"], ["path"], "place").join(totals, "language")


def supplemental_files(spark_files: DataFrame, inventory: DataFrame, listed: DataFrame) -> DataFrame:
    """Files of languages whose inventory count exceeds the listed one, without the listed files."""
    have = inventory.groupBy("language").agg(F.count("*").alias("n"))
    seen = listed.groupBy("language").agg(F.count("*").alias("m"))
    short = have.join(seen, "language", "left").where(F.col("n") > F.coalesce("m", F.lit(0))).select("language")
    return spark_files.join(short, "language", "left_semi").join(listed.select("path"), "path", "left_anti")


def is_config(path: Column) -> Column:
    lower = F.lower(path)
    stem = F.regexp_replace(basename(lower), r"(?<=.)\.[^.]*$", "")
    ends = [lower.endswith(end) for end in dims.CONFIG_ENDS]
    names = [(stem == name) | stem.startswith(f"{name}.") for name in dims.CONFIG_NAMES]
    out = F.lit(False)
    for test in ends + names:
        out = out | test
    return out


def is_manifest(path: Column, strict: bool = True) -> Column:
    """strict: names with capitals are compared as they stand with the lower-cased path, so never match."""
    name = basename(F.lower(path))
    return name.isin(dims.MANIFESTS if strict else [m.lower() for m in dims.MANIFESTS])


def required_word(pattern: str) -> str:
    """The longest run of letters that every match of a pattern holds; empty if none is sure. Patterns have no alternation outside groups."""
    bare = re.sub(r"\([^()]*\)[?*]?|\[[^\]]*\][?*+]?|\\[A-Za-z][*+?]?|\\[^A-Za-z][*+?]?", " ", pattern.removeprefix("(?i)"))
    return max(re.findall(r"[A-Za-z_-]+", re.sub(r".[?*]", " ", bare)), key=len, default="")


def word_finder(words: list[str]) -> Callable[[Column], Column]:
    """A column function from text to those of the words that it holds.

    One walk of an automaton over Arrow batches: for the hundred words of the signals that took a tenth of the time of as
    many `contains`, and of one regular expression over all of them.
    """

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({word for _, word in automaton.iter(text)}) for text in texts])

    return lambda text: found(F.coalesce(text, F.lit("")))


def has_any(content: Column, patterns: list[str], found: Column) -> Column:
    """Whether one of the patterns is found. Each is searched for only where its required word is, which rules most texts out.

    found: the required words that the content holds in lower case.
    """
    out = F.lit(False)
    for pattern in patterns:
        word = required_word(pattern)
        test = F.contains(content, F.lit(word)) if word == pattern else content.rlike(pattern)
        out = out | (F.array_contains(found, word.lower()) & test if word else test)
    return out


def signal_counts(signals: DataFrame) -> DataFrame:
    """How many files have how many signals."""
    return signals.groupBy(F.size("signals").alias("signals")).agg(F.count("*").alias("files"))


def signals(files: DataFrame, handler_names: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """path and signals. Manifests and config files have that signal alone; the others are independent."""
    content, words = F.col("content"), F.col("_words")
    called = r"exec\s*\("
    needed = {required_word(p).lower() for p in [*itertools.chain(*dims.SIGNAL_PATTERNS.values()), *dims.DYNAMIC_EXEC, called]} - {""}
    flags = [F.when(has_any(content, patterns, words), F.lit(name)) for name, patterns in dims.SIGNAL_PATTERNS.items()]
    dynamic = has_any(content, dims.DYNAMIC_EXEC, words) | (has_any(content, [called], words) & ~content.rlike(r"exec\s*\(\s*\)"))
    flags.append(F.when(dynamic, F.lit("dynamic_exec")))
    found = files
    if handler_names is not None:  # a file that exports a route's handler
        exported = files.select("path", F.explode(X.exported_symbols(content)).alias("name")).join(handler_names, "name", "left_semi").select("path").distinct()
        found = files.join(exported.withColumn("_route", F.lit("route_handler")), "path", "left")
        flags.insert(0, F.col("_route"))
    by_content = F.array_compact(F.array(*flags))
    alone = F.when(is_manifest(F.col("path"), strict), F.array(F.lit("dep_manifest"))).when(is_config(F.col("path")), F.array(F.lit("config_file")))
    return found.withColumn("_words", word_finder(sorted(needed))(F.lower("content"))).select("path", F.coalesce(alone, by_content).alias("signals"))


def escape_hatches(files: DataFrame, snippet: int = 200) -> DataFrame:
    """One row per line and pattern of unsafe template sinks; test files are left out, and the named Html bypass hides the general one."""
    line = F.col("at.line")
    hits = [F.when(line.rlike(regex), F.struct(F.lit(framework).alias("framework"), F.lit(kind).alias("kind"))) for framework, kind, regex in dims.ESCAPE_HATCHES]
    rows = files.where(~F.col("path").endswith(".spec.ts")).select("path", F.posexplode(X.lines(F.col("content"))).alias("pos", "line")).select("path", F.struct((F.col("pos") + 1).alias("line_no"), "line").alias("at"))
    found = rows.withColumn("hits", F.array_compact(F.array(*hits))).where(F.size("hits") > 0)
    named = F.exists("hits", lambda h: h["kind"] == "bypassSecurityTrustHtml")
    kept = F.filter("hits", lambda h: ~(named & (h["kind"] == "bypassSecurityTrust*")))
    return found.select("path", "at.line_no", F.substring(F.trim(line), 1, snippet).alias("snippet"), F.explode(kept).alias("hit")).select("path", "line_no", "hit.framework", "hit.kind", "snippet")


def grep(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """path, line_no and kind for every line that a pattern is found in."""
    line = F.col("line")
    hits = F.array_compact(F.array(*[F.when(line.rlike(regex), F.lit(kind)) for kind, regex in patterns.items()]))
    rows = files.select("path", F.posexplode(X.lines(F.col("content"))).alias("pos", "line"))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), F.explode(hits).alias("kind"))


def security_dependencies(names: DataFrame) -> DataFrame:
    lower = F.lower("name")
    return names.where(F.exists(F.array(*map(F.lit, dims.SECURITY_KEYWORDS)), lambda word: F.contains(lower, word)))


def scan_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Source files under a folder: path below it, bytes and language, and content if asked for.

    Excluded folders are never listed and files of unknown languages never opened: both are left out while the tree is walked.
    """
    found = tree.read(spark, root, content).where(F.col("ext").isin(".dockerfile", *dims.INVENTORY_LANGUAGES))
    rows = with_language(found.select("path", "ext", "bytes", *["content"] * content))
    return rows.withColumn("content", F.col("content").cast("string")) if content else rows
