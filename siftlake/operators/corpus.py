"""Batch rewrites of source trees, and approximations of syntax by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions.text import lines

TAG = r"\s*//\s*vuln-code-snippet\s+(?:start|end|vuln-line|neutral-line|hide-line|hide-start|hide-end)\b(.*)$"


def stripped_tags(files: DataFrame, tag: str = TAG) -> tuple[DataFrame, DataFrame]:
    """Files without tag comments, and one row (path, line_no, keys) per comment. A line that holds nothing else goes."""
    rows = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    keys = F.filter(F.split(F.trim(F.regexp_extract("line", tag, 1)), r"\s+"), lambda k: k != "")
    found = rows.where(F.col("line").rlike(tag)).select("path", (F.col("pos") + 1).alias("line_no"), keys.alias("keys"))
    kept = F.filter(lines(F.col("content")), lambda line: ~(line.rlike(tag) & (F.trim(F.regexp_replace(line, tag, "")) == "")))
    text = F.array_join(F.transform(kept, lambda line: F.regexp_replace(line, tag, "")), "\n")
    return files.withColumn("content", text), found


def moved(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files under new folders: moves (prefix, target). The longest prefix wins; prefixes are joined on every folder of a path."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = files.select("path", F.explode(prefixes).alias("prefix")).join(moves, "prefix")
    best = hit.groupBy("path").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("m"))
    new = F.concat("m.target", F.expr("substring(path, length(m.prefix) + 1)"))
    return files.join(best, "path", "left").withColumn("moved_to", new).drop("m")


def patched(files: DataFrame, patches: DataFrame) -> DataFrame:
    """Literal replacements (path, find, put) that must each occur exactly once; `applied` is false, and the text unchanged, where one does not."""
    listed = patches.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("find", "put"))).alias("_patches"))
    rows = files.join(listed, "path", "left")
    many = lambda text, word: (F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)

    def step(done: Column, patch: Column) -> Column:
        fine = done["fine"] & F.coalesce(many(done["text"], patch["find"]) == 1, F.lit(False))
        return F.struct(F.when(fine, F.replace(done["text"], patch["find"], patch["put"])).otherwise(done["text"]).alias("text"), fine.alias("fine"))

    start = F.struct(F.col("content").alias("text"), F.lit(True).alias("fine"))
    none = F.array().cast("array<struct<find: string, put: string>>")
    done = F.aggregate(F.coalesce("_patches", none), start, step)
    made = rows.withColumn("_done", done)
    return made.withColumns({"content": F.when(F.col("_done.fine"), F.col("_done.text")).otherwise(F.col("content")), "applied": F.col("_done.fine")}).drop("_done", "_patches")


def sink_hits(files: DataFrame, patterns: dict[str, list[str]] = dims.SINK_PATTERNS, endings: dict[str, list[str]] = dims.SINK_FILES) -> DataFrame:
    """One row per line and pattern of calls that leave the program or run code: path, line_no, kind, pattern and the line.

    Only files of a kind's endings are looked at. A call whose argument is known to be a quoted text or a setting is none.
    """
    line = F.col("line")
    rows = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "line"))
    hits = []
    for kind, listed in patterns.items():
        of_kind = F.lit(False)
        for ending in endings[kind]:
            of_kind = of_kind | F.col("path").endswith(ending)
        for at, pattern in enumerate(listed):
            test = of_kind & line.rlike(pattern)
            if not at and "(" in pattern.replace(r"\(", ""):
                argument = F.regexp_extract(line, pattern, 1)
                test = test & ~argument.rlike("^['\"`]") & ~argument.contains("config.get")
            hits.append(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"))))
    found = rows.select("path", (F.col("pos") + 1).alias("line_no"), F.trim(line).alias("snippet"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select("path", "line_no", "hit.kind", "hit.pattern", "snippet")


def is_exploit_test(title: Column, body: Column) -> Column:
    """Whether a test case shows an attack: by a word of its title, or by an assignment of a secret in its body."""
    return F.coalesce(title.rlike("(?i)attack|exploit|inject"), F.lit(False)) | F.coalesce(body.rlike(r"(password|token)\s*="), F.lit(False))


def blanked_fields(files: DataFrame, field: str) -> DataFrame:
    """YAML values of one field replaced by an empty string, line by line, the layout kept."""
    return files.withColumn("content", F.regexp_replace("content", rf"(?m)^(\s*(?:- )?{field}:).*$", "$1 ''"))


def approximate_routes(files: DataFrame) -> DataFrame:
    """Route registrations `app.METHOD('path', a, b)` on one line: method, path, middleware, handler and line.

    An approximation by regular expression: calls over several lines and computed paths are missed.
    """
    call = r"\b(?:app|router)\.(get|post|put|patch|delete|use|all)\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*(.+?)\)\s*;?\s*$"
    rows = files.select("path", F.posexplode(lines(F.col("content"))).alias("pos", "line")).where(F.col("line").rlike(call))
    args = F.transform(F.split(F.regexp_extract("line", call, 3), r",\s*(?![^()]*\))"), lambda a: F.trim(a))
    parsed = rows.select(F.upper(F.regexp_extract("line", call, 1)).alias("method"), F.regexp_extract("line", call, 2).alias("route"), args.alias("args"), F.col("path").alias("file"), (F.col("pos") + 1).alias("line_no"))
    last = F.size("args") - 1
    return parsed.select("method", "route", F.slice("args", F.lit(1), last).alias("middleware"), F.element_at("args", -1).alias("handler"), "file", "line_no")


def persistence(files: DataFrame) -> DataFrame:
    """One row: which mapper and database are imported, and files with raw queries."""
    has = lambda name: F.coalesce(F.bool_or(F.col("content").rlike(rf"(?:from|require\()\s*['\"]{name}['\"]")), F.lit(False))
    raw = F.col("content").rlike(r"\.(?:query|raw)\s*\(")
    return files.agg(has("sequelize").alias("sequelize"), has("mongoose").alias("mongoose"), has("typeorm").alias("typeorm"), F.count_if(raw).alias("raw_files"))


def frontend_frameworks(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """One row: frameworks by dependency name or configuration file."""
    by_name = dependencies.agg(*(F.coalesce(F.bool_or(F.col("name").rlike(rule)), F.lit(False)).alias(name) for name, rule in {"angular": "^@angular/core$", "react": "^react$", "vue": "^vue$"}.items()))
    config = files.agg(F.coalesce(F.bool_or(F.col("path").rlike(r"(^|/)angular\.json$")), F.lit(False)).alias("_config"))
    return by_name.crossJoin(config).select((F.col("angular") | F.col("_config")).alias("angular"), "react", "vue")  # one row each


def entry_file(dependencies: DataFrame, files: DataFrame, framework: str = "express", candidates: tuple[str, ...] = ("app.ts", "app.js", "server.ts", "server.js", "index.ts", "index.js", "src/app.ts", "src/index.ts")) -> DataFrame:
    """The first candidate that exists, if the framework is a dependency; else no row."""
    ranked = files.withColumn("rank", F.array_position(F.array(*map(F.lit, candidates)), F.col("path"))).where("rank > 0")
    uses = dependencies.where(F.col("name") == framework).select(F.lit(True).alias("_uses")).limit(1)
    return ranked.agg(F.min_by("path", "rank").alias("entry")).where("entry IS NOT NULL").join(uses, F.lit(True), "left_semi")
