"""Routes of a web application against files, handlers and documented paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.operators.ranking import first_of_group, numbered


def handler_names(text: Column) -> Column:
    """Names of handlers in a registration text: after a dot, bare at the start, and called without arguments."""
    name = r"([A-Za-z_$][A-Za-z0-9_$]*)"
    found = [F.regexp_extract(text, pattern, 1) for pattern in (rf"\.{name}\s*\(", rf"^{name}\s*\(", rf"\.{name}\s*\(\)")]
    return F.array_distinct(F.filter(F.array(*found), lambda n: n != ""))


def auth_of(middleware: Column, words: tuple[str, ...] = dims.AUTH_WORDS) -> Column:
    """The first middleware that names an authorisation check."""
    named = F.filter(middleware, lambda m: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(m, w)))
    return F.try_element_at(named, F.lit(1))


def is_unguarded(auth: Column, empties: tuple[str, ...] = ("", "none")) -> Column:
    return auth.isNull() | auth.isin(*empties)


def segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "/+$", ""), "/", -1)


def undocumented(routes: DataFrame, documented: DataFrame) -> DataFrame:
    """Routes that no documented path matches, segment by segment; a `:name` on either side matches anything.

    The join hashes on the number of segments and on the two after the root. A fixed name goes to its own key and to the
    key that parameters of the other side go to, so two sides share a key if they match there.
    """

    def keyed(rows: DataFrame, parts: str, beside_fixed: str, of_parameter: list[str]) -> DataFrame:
        for i in (2, 3):
            part = F.try_element_at(F.col(parts), F.lit(i))
            keys = F.when(part.isNull(), F.array(F.lit(""))).when(part.startswith(":"), F.array(*map(F.lit, of_parameter))).otherwise(F.array(part, F.lit(beside_fixed)))
            rows = rows.withColumn(f"_k{i}", F.explode(keys))
        return rows.withColumn("_n", F.size(parts))

    left = routes.where("method <> 'USE' AND path <> '*'")
    paths = keyed(left.select("path").distinct().withColumn("_l", segments(F.col("path"))), "_l", ":documented", [":route", ":documented"])
    known = keyed(documented.select(segments(F.col("doc_path")).alias("_r")).distinct(), "_r", ":route", [":documented"])
    pairs = F.zip_with("_l", "_r", lambda a, b: (a == b) | a.startswith(":") | b.startswith(":"))
    same = (paths["_n"] == known["_n"]) & (paths["_k2"] == known["_k2"]) & (paths["_k3"] == known["_k3"]) & F.forall(pairs, lambda fits: fits)
    return left.join(paths.join(known, same, "left_semi").select("path").distinct(), "path", "left_anti").select(*routes.columns)


def words_of(*texts: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))


def routes_of_files(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes whose handler or middleware has an exported symbol of a file as a whole word: an equi-join on the words."""
    words = routes.withColumn("name", F.explode(words_of(F.col("handler"), F.array_join("middleware", " "))))
    return words.join(symbols.select("file", "name"), "name").drop("name").distinct()


def registered_in(routes: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """Routes that each target file registers: its path is the route's file, or its end after a slash.

    Every end of a route's file is a key, so the test is an equi-join. Per target, hand-written routes and middleware
    apart, unguarded ones come first, then by line; `auth` says none where there is none.
    """
    parts = F.split(F.col("file"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts) - n + 1), "/"))
    bare = is_unguarded(F.col("auth"))
    kind = F.when(F.col("method") == "USE", "middleware").otherwise("handler")
    rows = routes.select("*", F.explode(ends).alias("target")).join(targets.select(F.col("path").alias("target")).distinct(), "target")
    shown_rows = rows.withColumns({"kind": kind, "_bare": F.when(bare, 0).otherwise(1), "auth": F.when(bare, "none").otherwise(F.col("auth"))})
    group, order = ["target", "kind"], ["_bare", "line", "ord"]
    return (first_of_group(shown_rows, group, order, most) if most else numbered(shown_rows, group, order)).drop("_bare")


def backed_files(truth: DataFrame, symbols: DataFrame, routes: DataFrame) -> DataFrame:
    """Files of ground truth that a route stands behind: an exported symbol is the first part of its handler or of a word of its
    middleware. `routes` of each, and whether all say who may call."""
    first = lambda text: F.substring_index(text, ".", 1)
    tokens = F.filter(F.split(F.translate(F.array_join("middleware", " "), "(),", "   "), r"\s+"), lambda word: word != "")
    names = F.filter(F.array_compact(F.concat(F.array(first(F.col("handler"))), F.transform(tokens, first))), lambda name: name != "")
    # Routes of the same names meet the same files, so the few sets of names are joined and not the routes.
    own = routes.select("ord", "auth", names.alias("names")).groupBy("ord", "auth").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    sets = own.groupBy("names", F.col("auth").isNotNull().alias("guarded")).agg(F.count("*").alias("n"))
    files = truth.select("file").distinct().join(symbols.select("file", "name").distinct(), "file")
    met = sets.withColumn("name", F.explode("names")).join(files, "name").select("file", "names", "guarded", "n").distinct()
    return met.groupBy("file").agg(F.sum("n").alias("routes"), F.min("guarded").alias("all_guarded"))


def crud_of_files(crud: DataFrame, symbols: DataFrame) -> DataFrame:
    """Auto-CRUD models met by an exported symbol or by the file's own name: the union of two equi-joins."""
    by_name = crud.join(symbols.select("file", F.col("name").alias("model")), "model").select("model", "file")
    stems = symbols.select("file", F.lower(F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "")).alias("_stem")).distinct()
    by_file = crud.join(stems, F.lower("model") == F.col("_stem")).select("model", "file")
    return by_name.unionByName(by_file).distinct()


def shown(routes: DataFrame, most: int = 15) -> DataFrame:
    """Per file, unguarded routes first, at most `most`, with the number of those left out."""
    unguarded = routes.withColumn("_bare", F.when(is_unguarded(F.col("auth"), ("", "null")), 0).otherwise(1))
    counts = routes.groupBy("file").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))
    return first_of_group(unguarded, ["file"], ["_bare", "ord"], most).drop("_bare").join(counts, "file")


def match_distribution(counts: DataFrame, n: str = "n") -> DataFrame:
    bucket = F.when(F.col(n) == 0, "0").when(F.col(n) == 1, "1").when(F.col(n) <= 5, "2-5").when(F.col(n) <= 15, "6-15").otherwise(">15")
    return counts.groupBy(bucket.alias("routes")).agg(F.count("*").alias("files"))


def handler_files(routes: DataFrame, imports: DataFrame) -> DataFrame:
    """The file of each handler: by its own name, else by the namespace before its dot, else by what asyncHandler wraps."""
    inner = F.regexp_extract("handler", r"asyncHandler\(([\w$]+)", 1)
    names = {"_direct": F.regexp_extract("handler", r"^([\w$]+)$", 1), "_space": F.regexp_extract("handler", r"^([\w$]+)\.", 1), "_inner": inner}
    out = routes
    for column, name in names.items():
        side = imports.select(F.col("name").alias(f"{column}_name"), F.col("file").alias(column))
        out = out.withColumn(f"{column}_key", name).join(side, F.col(f"{column}_key") == F.col(f"{column}_name"), "left").drop(f"{column}_key", f"{column}_name")
    return out.withColumn("handler_file", F.coalesce("_direct", "_inner", "_space")).drop(*names)


def under_crud(routes: DataFrame, crud: DataFrame) -> DataFrame:
    """Routes below an auto-CRUD path without pagination.

    Prefixes are cut at slashes, so the prefix test becomes an equi-join on every prefix of a route.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    bare = crud.where("NOT paginated").select(F.col("pattern").alias("_prefix")).distinct()
    hit = routes.select("ord", F.explode(prefixes).alias("_prefix")).join(bare, "_prefix", "left_semi").select("ord").distinct()
    return routes.join(hit, "ord", "left_semi")


def routed(routes: DataFrame, themes: dict[str, list[str]]) -> DataFrame:
    """One row per route and theme whose words its path holds. The themes are a fixed list, so each is one expression."""
    hit = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("path"), w)), F.lit(theme)) for theme, words in themes.items()]
    return routes.withColumn("theme", F.explode(F.array_compact(F.array(*hit))))
