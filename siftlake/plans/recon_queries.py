"""Queries of inventory, signals and lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import text as X
from siftlake.operators import lanes as L
from siftlake.operators import recon as R
from siftlake.operators.ranking import first_of_group
from siftlake.plans import views as V
from siftlake.plans.registry import query

_LANG = "lang AS (SELECT * FROM " + dims.sql_values([(e[1:], n) for e, n in dims.INVENTORY_LANGUAGES.items()], "v(ext, language)") + ")"
_FILES = "f AS (SELECT v_file.*, language FROM v_file JOIN lang USING (ext))"
_WITH = lambda body: V.with_views("v_file", f"{_LANG},\n{_FILES}{body}")
_SKIPPED = "(" + ", ".join(f"'{n}'" for n in dims.NON_EXECUTABLE) + ")"
_EXCLUDED = "[" + ", ".join(f"'{n}'" for n in dims.EXCLUDED_NAMES) + "]"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_language(V.files(spark, sf_dir))


@query(_WITH(" SELECT language, count(*) AS files, list(path ORDER BY ord)[1:5] AS sample_paths FROM f GROUP BY 1"))
def inventory_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_language(_files(spark, sf_dir))


@query(_WITH(" SELECT language, count(*) AS files, sum(bytes)::BIGINT AS total_bytes, min(path) AS first_path FROM f WHERE language NOT IN ('typescript', 'javascript') GROUP BY 1"))
def unclassified_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unclassified_surface(_files(spark, sf_dir), ["typescript", "javascript"])


@query(V.with_views("v_file", "SELECT path, bytes, lines FROM v_file"))
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_metrics(V.files(spark, sf_dir).drop("bytes", "lines")).select("path", "bytes", "lines")


@query(
    f"""WITH p AS (SELECT concat(CASE p_partkey % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/build/' ELSE 'lib/' END, p_name, '.ts') AS path FROM part)
SELECT path FROM p WHERE len(list_intersect(string_split(path, '/'), {_EXCLUDED})) = 0"""
)
def inventory_scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = "CASE p_partkey % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/build/' ELSE 'lib/' END"
    return R.pruned(V.table(spark, sf_dir, "part").select(F.expr(f"concat({folder}, p_name, '.ts')").alias("path")))


@query(
    _WITH(
        """, listed AS (SELECT * FROM f WHERE ord % 3 > 0 OR language IN ('css', 'json')), n AS (SELECT language, count(*) AS n FROM f GROUP BY 1), m AS (SELECT language, count(*) AS m FROM listed GROUP BY 1)
SELECT path, language FROM f WHERE language IN (SELECT n.language FROM n LEFT JOIN m ON n.language = m.language WHERE n > coalesce(m, 0)) AND path NOT IN (SELECT path FROM listed)"""
    )
)
def supplemental_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path", "language", "ord")
    return R.supplemental_files(files, files, files.where("ord % 3 > 0 OR language IN ('css', 'json')")).select("path", "language")


def _sql_any(patterns: list[str]) -> str:
    return " OR ".join("regexp_matches(content, '" + p.replace("(?i)", "").replace("'", "''") + "'" + (", 'i')" if p.startswith("(?i)") else ")") for p in patterns)


_FLAGS = ", ".join(f"CASE WHEN {_sql_any(p)} THEN '{s}' END" for s, p in dims.SIGNAL_PATTERNS.items())
_FLAGS += f", CASE WHEN {_sql_any(dims.DYNAMIC_EXEC)} OR (regexp_matches(content, 'exec\\s*\\(') AND NOT regexp_matches(content, 'exec\\s*\\(\\s*\\)')) THEN 'dynamic_exec' END"
#: Documents say little of code, so every tenth gets a line that some signals are found in.
_CODE = [
    "db.query(sql)", "await User.create(x)", "fetch(url)", "if (hasRole(u)) login(u)", "crypto.createHash(a)", "el.innerHTML = v", "eval(x)", "JSON.parse(body)", "fs.open(p)",
    "openai.chat.completions", "console.error(e)", "class A extends Model", "obj.exec()",
]
_CODE_SQL = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in _CODE) + "]"
_SRC = f"src AS (SELECT path, ord, ext, concat(content, chr(10), list_extract({_CODE_SQL}, CAST(ord % {len(_CODE)} AS INT) + 1)) AS content FROM v_file)"
_SIGNALS = f"sig AS (SELECT path, ord, CASE WHEN path ILIKE '%.toml' THEN ['config_file'] ELSE list_filter([{_FLAGS}], lambda x: x IS NOT NULL) END AS signals FROM src)"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, _CODE)), (F.col("ord") % len(_CODE)).cast("int") + 1)
    return V.files(spark, sf_dir).select("ord", "path", F.concat_ws("\n", "content", line).alias("content"))


@query(V.with_views("v_file", f"{_SRC}, {_SIGNALS} SELECT path, signals FROM sig"))
def file_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.signals(_sources(spark, sf_dir))


@query(V.with_views("v_file", f"{_SRC}, {_SIGNALS}, e AS (SELECT unnest(signals) AS signal FROM sig) SELECT signal, count(*) AS files FROM e GROUP BY 1"))
def signal_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.signals(_sources(spark, sf_dir)).select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("files"))


@query(V.with_views("v_file signal_class", f"{_SRC}, {_SIGNALS} SELECT DISTINCT signal FROM signal_class WHERE signal NOT IN (SELECT unnest(signals) FROM sig)"))
def dead_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = R.signals(_sources(spark, sf_dir)).select(F.explode("signals").alias("signal")).distinct()
    return dims.signal_classes(spark).select("signal").subtract(seen)


_FLOOR = "['" + "', '".join(dims.FLOOR_CLASSES) + "']"
_CLASSES = f"""x AS (SELECT path, unnest(signals) AS signal FROM sig), c AS (SELECT path, list(DISTINCT class) AS more FROM x JOIN signal_class USING (signal) GROUP BY 1),
lane AS (SELECT s.path, s.ord, s.signals, list_sort(list_distinct(list_concat({_FLOOR}, coalesce(more, [])))) AS classes FROM sig s LEFT JOIN c ON s.path = c.path)"""


@query(V.with_views("v_file signal_class", f"{_SRC}, {_SIGNALS}, {_CLASSES} SELECT path, classes FROM lane"))
def lane_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_classes(R.signals(_sources(spark, sf_dir))).select("path", "classes")


@query(V.with_views("v_file signal_class", f"{_SRC}, {_SIGNALS}, {_CLASSES} SELECT len(classes)::INT AS classes, count(*) AS lanes FROM lane GROUP BY 1"))
def classes_per_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_classes(R.signals(_sources(spark, sf_dir))).groupBy(F.size("classes").alias("classes")).agg(F.count("*").alias("lanes"))


@query(V.with_views("v_file signal_class", f"{_SRC}, {_SIGNALS}, {_CLASSES} SELECT path, [classes[i:i+2] FOR i IN range(1, len(classes) + 1, 3)] AS groups FROM lane"))
def class_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_groups(L.with_classes(R.signals(_sources(spark, sf_dir))), 3).select("path", "groups")


@query(
    V.with_views(
        "v_file signal_class",
        f"""{_SRC}, {_SIGNALS}, {_CLASSES}, want AS (SELECT path, list_extract(['injection', 'ssrf', 'crypto-auth', 'client-side'], CAST(ord % 4 AS INT) + 1) AS wanted FROM lane)
SELECT wanted, count(*) AS entries, count_if(NOT list_contains(classes, wanted))::BIGINT AS gaps FROM lane JOIN want USING (path) GROUP BY 1""",
    )
)
def class_blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted classes that no signal of the file implies."""
    lanes = L.with_classes(R.signals(_sources(spark, sf_dir)))
    wanted = V.files(spark, sf_dir).select("path", F.expr("element_at(array('injection', 'ssrf', 'crypto-auth', 'client-side'), cast(ord % 4 AS int) + 1)").alias("wanted"))
    return lanes.join(wanted, "path").groupBy("wanted").agg(F.count("*").alias("entries"), F.count_if(~F.array_contains("classes", F.col("wanted"))).alias("gaps"))


_GREP = {"mail": r"[\w.]+@[\w.]+", "secret": r"(?i)\b(password|token|secret)\b", "digits": r"\d{3}-\d{4}"}


@query(
    V.with_views(
        "v_file",
        "l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM v_file)\n"
        + " UNION ALL ".join(f"SELECT path, line_no, '{k}' AS kind FROM l WHERE regexp_matches(line, '{p.replace('(?i)', '')}'{', ' + chr(39) + 'i' + chr(39) if p.startswith('(?i)') else ''})" for k, p in _GREP.items()),
    )
)
def line_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grep(V.files(spark, sf_dir), _GREP)


@query(
    V.with_views(
        "v_file",
        r"""h AS (SELECT path, concat(content, chr(10), list_extract(['x.bypassSecurityTrustHtml(v)', 'x.bypassSecurityTrustUrl(v)', '<p [innerHTML]="v">', 'dangerouslySetInnerHTML={v}', '<p v-html="v">', 'none'], CAST(ord % 6 AS INT) + 1)) AS content FROM v_file),
l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM h)
SELECT path, line_no, framework, kind, substring(trim(line), 1, 200) AS snippet FROM l JOIN """
        + dims.sql_values(dims.ESCAPE_HATCHES, "p(framework, kind, regex)")
        + " ON regexp_matches(line, regex) WHERE NOT (kind = 'bypassSecurityTrust*' AND regexp_matches(line, '\\.bypassSecurityTrustHtml\\s*\\('))",
    )
)
def escape_hatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "element_at(array('x.bypassSecurityTrustHtml(v)', 'x.bypassSecurityTrustUrl(v)', '<p [innerHTML]=\"v\">', 'dangerouslySetInnerHTML={v}', '<p v-html=\"v\">', 'none'), cast(ord % 6 AS int) + 1)"
    return R.escape_hatches(V.files(spark, sf_dir).select("path", F.concat_ws("\n", "content", F.expr(code)).alias("content")))


_LANES = f"""lane AS (SELECT f.*, CASE WHEN ord % 50 = 0 OR language IN {_SKIPPED} THEN 'skip' ELSE 'hunt' END AS disposition,
    CASE WHEN ord % 50 = 0 THEN 'deny-listed' WHEN language IN {_SKIPPED} THEN concat('no executable logic: ', language) END AS skip_reason FROM f)"""


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return L.disposition(files, files.where("ord % 50 = 0").select("path"))


@query(_WITH(f", {_LANES} SELECT path, disposition, skip_reason FROM lane"))
def lane_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).select("path", "disposition", "skip_reason")


@query(_WITH(f", {_LANES} SELECT disposition, skip_reason, count(*) AS lanes FROM lane GROUP BY 1, 2"))
def disposition_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).groupBy("disposition", "skip_reason").agg(F.count("*").alias("lanes"))


@query(_WITH(f", {_LANES} SELECT count(*) AS total, count_if(disposition = 'hunt')::BIGINT AS hunt, count_if(disposition = 'skip')::BIGINT AS skip, 0::BIGINT AS unaccounted FROM lane"))
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger(_lanes(spark, sf_dir))


@query(_WITH(f", {_LANES} SELECT path, concat('file-', lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0')) AS lane_id FROM (SELECT path, row_number() OVER (ORDER BY ord) AS n FROM lane)"))
def lane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lane_ids(_lanes(spark, sf_dir), ["ord"]).select("path", "lane_id")


_CHUNKS = "SELECT path, i::INT AS index, ((i - 1) * 15 + 1)::INT AS start_line, least(lines, (i - 1) * 15 + 20)::INT AS end_line FROM (SELECT *, unnest(range(1, CASE WHEN lines <= 20 THEN 2 ELSE CAST(ceil((lines - 20) / 15.0) AS INT) + 2 END)) AS i FROM v_file)"


@query(V.with_views("v_file", _CHUNKS))
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of 20 lines, 5 shared: the texts are too short for the default budget."""
    return L.chunks(V.files(spark, sf_dir), 20, 5).select("path", "index", "start_line", "end_line")


@query(_WITH(f", {_LANES}, done AS (SELECT DISTINCT path FROM lane WHERE ord % 5 IN (1, 2) AND ord % 7 > 0) SELECT path FROM lane WHERE disposition = 'hunt' AND path NOT IN (SELECT path FROM done) ORDER BY ord LIMIT 200"))
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    lanes = _lanes(spark, sf_dir).withColumn("lane_id", F.col("path"))
    reports = lanes.where("ord % 5 IN (1, 2)").select("lane_id", (F.col("ord") % 7 == 0).alias("failed"))
    return L.pending(lanes, reports, most=200).select("path")


@query(_WITH(" SELECT language, path, rank FROM (SELECT language, path, row_number() OVER (PARTITION BY language ORDER BY bytes DESC, ord)::INT AS rank FROM f) WHERE rank <= 3"))
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("language", "path", "bytes", "ord")
    return first_of_group(files, ["language"], [F.desc("bytes"), "ord"], 3).select("language", "path", "rank")


@query(
    V.with_views(
        "v_file",
        r"""n AS (SELECT path, string_split(content, chr(10)) AS l FROM v_file) SELECT path, array_to_string([concat(lpad(i::VARCHAR, length(len(l)::VARCHAR)::INT, ' '), ': ', l[i]) FOR i IN range(1, len(l) + 1)], chr(10)) AS numbered FROM n""",
    )
)
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select("path", X.numbered(F.col("content")).alias("numbered"))


_EXPORTED = "concat(content, {n}, 'export const f', ord, ' = 1', {n}, 'export {{ a as b', ord % 3, ', c }}', {n}, 'export default class K', ord % 2, ' {{}}')"


@query(
    V.with_views(
        "v_file",
        "s AS (SELECT path, " + _EXPORTED.format(n="chr(10)") + r""" AS c FROM v_file), d AS (SELECT path, regexp_extract_all(c, 'export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)', 1) AS declared,
    list_transform(flatten(list_transform(regexp_extract_all(c, 'export\s*\{([^}]*)\}', 1), lambda x: string_split(x, ','))), lambda x: regexp_extract(trim(x), '([A-Za-z_$][\w$]*)$', 1)) AS listed FROM s),
e AS (SELECT path, list_concat(declared, list_filter(listed, lambda x: x <> '')) AS names FROM d) SELECT path, list_filter(names, lambda x, i: list_position(names, x) = i) AS symbols FROM e""",
    )
)
def exported_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr(_EXPORTED.format(n="'\\n'"))
    return V.files(spark, sf_dir).select("path", X.exported_symbols(code).alias("symbols"))


@query(
    "WITH n AS (SELECT p_name AS name FROM part UNION ALL SELECT concat(p_type, ' ai') FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT concat('express-', lower(p_brand), '-jwt') FROM part WHERE p_partkey % 11 = 0) SELECT name FROM n WHERE "
    + " OR ".join(f"contains(lower(name), '{w}')" for w in dims.SECURITY_KEYWORDS)
)
def security_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = V.table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name")).unionByName(part.where("p_partkey % 9 = 0").select(F.concat("p_type", F.lit(" ai")).alias("name")))
    return R.security_dependencies(names.unionByName(part.where("p_partkey % 11 = 0").select(F.concat(F.lit("express-"), F.lower("p_brand"), F.lit("-jwt")).alias("name"))))


@query(
    V.with_views(
        "v_gt v_file",
        """lane AS (SELECT key AS ord, file AS path, CASE key % 10 WHEN 0 THEN 'skip' ELSE 'hunt' END AS disposition FROM v_gt WHERE key % 4 > 0), first AS (SELECT path, arg_min(disposition, ord) AS disposition FROM lane GROUP BY 1)
SELECT CASE WHEN f.path IS NULL THEN 'NO LANE' WHEN disposition = 'skip' THEN 'SKIPPED' ELSE 'ok' END AS reach, count(*) AS entries FROM v_gt g LEFT JOIN first f ON g.file = f.path GROUP BY 1""",
    )
)
def preflight_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first lane of each entry's file hunts it."""
    truth = V.ground_truth(spark, sf_dir)
    lanes = truth.where("key % 4 > 0").select(F.col("key").alias("ord"), F.col("file").alias("path"), F.expr("CASE key % 10 WHEN 0 THEN 'skip' ELSE 'hunt' END").alias("disposition"))
    first = lanes.groupBy("path").agg(F.min_by("disposition", "ord").alias("disposition"))
    reach = F.when(F.col("path").isNull(), "NO LANE").when(F.col("disposition") == "skip", "SKIPPED").otherwise("ok")
    return truth.join(first, F.col("file") == F.col("path"), "left").groupBy(reach.alias("reach")).agg(F.count("*").alias("entries"))


@query(V.with_views("v_file", "lang AS (SELECT * FROM " + dims.sql_values([(e[1:], n) for e, n in dims.SELECTOR_LANGUAGES.items()], "v(ext, language)") + ") SELECT language, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM v_file JOIN lang USING (ext) GROUP BY 1"))
def selector_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each language under the selector's wider map."""
    return R.with_language(V.files(spark, sf_dir), dims.SELECTOR_LANGUAGES).groupBy("language").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query(_WITH(f", {_LANES}, old AS (SELECT max(ord + 20000) AS top FROM f WHERE ord % 2 = 0) SELECT path, concat('file-', lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0')) AS lane_id FROM (SELECT path, row_number() OVER (ORDER BY ord) + top AS n FROM lane, old WHERE ord % 2 = 1)"))
def lane_ids_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New lanes numbered from the highest id of those that are done."""
    lanes = _lanes(spark, sf_dir)
    done = lanes.where("ord % 2 = 0").select(F.concat(F.lit("file-"), (F.col("ord") + 20_000).cast("string")).alias("lane_id"))
    return L.lane_ids(lanes.where("ord % 2 = 1"), ["ord"], after=done).select("path", "lane_id")
