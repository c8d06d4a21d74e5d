"""Queries of coverage, corpus rewriting and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.operators import corpus as K
from siftlake.operators import coverage as C
from siftlake.operators import lanes as L
from siftlake.operators import recon as R
from siftlake.plans import views as V
from siftlake.plans.registry import query
from siftlake.sources import adapters

_FLAGS = ["has_routes", "has_crypto", "has_auth", "has_queries", "has_exec", "has_config", "has_parsers", "has_logging", "has_outbound", "has_model_calls"]


@query(
    "WITH f AS (SELECT "
    + ", ".join(f"bool_or(p_partkey % {i + 2} = 0 AND p_size = {i * 9}) AS {flag}" for i, flag in enumerate(_FLAGS))
    + " FROM part) "
    + " UNION ALL ".join(f"SELECT '{n}' AS name, CASE WHEN {' OR '.join(fs)} THEN 'present' ELSE 'absent' END AS verdict, CASE WHEN {' OR '.join(fs)} THEN {y}::DOUBLE ELSE {no}::DOUBLE END AS confidence FROM f" for n, fs, y, no in C.VERDICT_RULES)
)
def category_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [F.bool_or((F.col("p_partkey") % (i + 2) == 0) & (F.col("p_size") == i * 9)).alias(flag) for i, flag in enumerate(_FLAGS)]
    return C.category_verdicts(V.table(spark, sf_dir, "part").agg(*flags))


@query(V.with_views("v_step", f"u AS (SELECT unnest({V._CODES_SQL}) AS code UNION ALL SELECT 'X01') SELECT DISTINCT regexp_replace(code, '[0-9]+$', '') AS family FROM u WHERE regexp_replace(code, '[0-9]+$', '') NOT IN (SELECT regexp_replace(code, '[0-9]+$', '') FROM v_step)"))
def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = spark.createDataFrame([(code,) for code in [*dims.CODES, "X01"]], "code string")
    return C.missing_families(V.finding_steps(spark, sf_dir).select(F.array("code").alias("codes")).distinct(), universe)


_VERDICTS = [(code, ("present", "absent", "uncertain")[i % 3]) for i, code in enumerate(dims.CODES[:20])]


@query(
    V.with_views(
        "v_gt",
        f"v AS (SELECT * FROM {dims.sql_values(_VERDICTS, 'v(code, verdict)')}), e AS (SELECT DISTINCT code FROM v_gt WHERE key % 2 = 0) SELECT e.code IS NOT NULL AS exercised, coalesce(verdict, 'missing') AS verdict, count(*) AS codes FROM v FULL JOIN e ON v.code = e.code GROUP BY 1, 2",
    )
)
def applicability_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    exercised = V.ground_truth(spark, sf_dir).where("key % 2 = 0").select(F.explode("codes").alias("code"))
    return C.applicability(exercised, spark.createDataFrame(_VERDICTS, "code string, verdict string"))


@query(
    V.with_views(
        "v_gt",
        """lane AS (SELECT key AS ord, file AS path, CASE WHEN key % 10 < 3 THEN 'skip' ELSE 'hunt' END AS disposition FROM v_gt WHERE key % 6 > 0), f AS (SELECT path, arg_min(disposition, ord) AS disposition FROM lane GROUP BY 1)
SELECT CASE WHEN f.path IS NULL THEN 'no lane' WHEN disposition = 'hunt' THEN 'scanned' ELSE 'skipped' END AS state, count(*) AS entries FROM v_gt g LEFT JOIN f ON g.file = f.path GROUP BY 1""",
    )
)
def inventory_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = V.ground_truth(spark, sf_dir)
    lanes = truth.where("key % 6 > 0").select(F.col("key").alias("ord"), F.col("file").alias("path"), F.expr("CASE WHEN key % 10 < 3 THEN 'skip' ELSE 'hunt' END").alias("disposition"))
    return C.inventory_coverage(truth.select("key", "file"), lanes)


@query(V.with_views("v_step class_code", "SELECT file AS path, list_sort(list(DISTINCT concat('playbook-', class))) AS playbooks FROM v_step JOIN class_code USING (code) GROUP BY 1"))
def playbooks_per_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.functions.paths import normalized

    classes = V.finding_steps(spark, sf_dir).join(dims.class_codes(spark), "code").groupBy(normalized(F.col("file")).alias("path")).agg(F.collect_set("class").alias("classes"))
    registry = spark.createDataFrame([(name, f"playbook-{name}") for name in dims.CLASS_CODES], "class string, playbook string")
    return C.playbooks(classes, registry)


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'urgent' ELSE o_orderpriority END AS provider, count(*) AS runs FROM orders GROUP BY 1")
def provider_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("1-URGENT", "urgent"), ("2-HIGH", "urgent")], "alias string, canonical string")
    names = V.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("provider"))
    return C.canonical(names, aliases).groupBy("provider").agg(F.count("*").alias("runs"))


@query(V.with_views("v_file", "SELECT path, concat('File: ', path, chr(10), CASE WHEN ord % 3 > 0 THEN concat('Chunk 1 of ', ord % 3 + 1, chr(10)) ELSE '' END, 'injection, ssrf', chr(10), content) AS prompt, true AS reconciled FROM v_file"))
def prompt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = V.files(spark, sf_dir).select("path", F.lit(1).alias("index"), (F.col("ord") % 3 + 1).alias("total"), F.array(F.lit("injection"), F.lit("ssrf")).alias("classes"), F.col("content").alias("source"))
    return C.prompts(chunks).select("path", "prompt", "reconciled")


@query(V.with_views("v_step", "b AS (SELECT finding_id, l_suppkey AS lane_id FROM v_step WHERE provider = 'A' AND l_suppkey % 3 = 0), a AS (SELECT finding_id, l_suppkey AS lane_id FROM v_step WHERE provider = 'R' AND l_suppkey % 2 = 0) SELECT * FROM b UNION ALL SELECT * FROM a WHERE lane_id NOT IN (SELECT lane_id FROM b)"))
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = V.finding_steps(spark, sf_dir).select("finding_id", F.col("ord.l_suppkey").alias("lane_id"), "provider")
    before = steps.where("provider = 'A' AND lane_id % 3 = 0").drop("provider")
    return C.resumed(before, steps.where("provider = 'R' AND lane_id % 2 = 0").drop("provider"))


_TAGGED = "concat(content, {n}, 'a = 1 // vuln-code-snippet vuln-line key', ord % 5, {n}, '// vuln-code-snippet start one two', {n}, 'b', {n}, ord)"
_TAG_SQL = K.TAG.replace("'", "''")
_TAGGED_LINES = V.with_views("v_file", "t AS (SELECT path, " + _TAGGED.format(n="chr(10)") + " AS c FROM v_file)")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select("path", F.expr(_TAGGED.format(n="'\\n'")).alias("content"))


@query(f"""{_TAGGED_LINES} SELECT path, array_to_string([regexp_replace(l, '{_TAG_SQL}', '') FOR l IN string_split(c, chr(10)) IF NOT (regexp_matches(l, '{_TAG_SQL}') AND trim(regexp_replace(l, '{_TAG_SQL}', '')) = '')], chr(10)) AS content FROM t""")
def corpus_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stripped_tags(_tagged(spark, sf_dir))[0].select("path", "content")


@query(
    f"""{_TAGGED_LINES}, l AS (SELECT path, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1)::INT AS line_no FROM t)
SELECT path, line_no, list_filter(string_split_regex(trim(regexp_extract(line, '{_TAG_SQL}', 1)), '\\s+'), lambda k: k <> '') AS keys FROM l WHERE regexp_matches(line, '{_TAG_SQL}')"""
)
def corpus_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stripped_tags(_tagged(spark, sf_dir))[1]


@query(V.with_views("v_file", "SELECT path, CASE WHEN dir = 'src1' THEN concat('public/one/', substring(path, 6)) WHEN dir LIKE 'src1%' THEN NULL WHEN dir = 'src2' THEN concat('private/', substring(path, 6)) END AS moved_to FROM v_file"))
def corpus_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = spark.createDataFrame([("src1", "public/one"), ("src2", "private")], "prefix string, target string")
    return K.moved(V.files(spark, sf_dir).select("path"), moves).select("path", "moved_to")


_MANIFEST = """to_json(named_struct('description', content, 'dependencies', map('express', concat('^', ord % 5), concat('lib', ord % 7), '1.0'), 'devDependencies', map('jwt-simple', '0.5')))"""


@query(V.with_views("v_file", "SELECT 'express' AS name, concat('^', ord % 5) AS version, count(*) AS files FROM v_file GROUP BY 2 UNION ALL SELECT concat('lib', ord % 7), '1.0', count(*) FROM v_file GROUP BY 1 UNION ALL SELECT 'jwt-simple', '0.5', count(*) FROM v_file"))
def dependency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = V.files(spark, sf_dir).select("path", F.expr(_MANIFEST).alias("content"))
    return adapters.dependencies(manifests).groupBy("name", "version").agg(F.count("*").alias("files"))


#: Dependency names and paths made of every row, with the words that are looked for among them.
_NAME = "CASE WHEN p_size = 7 THEN 'vue' WHEN p_size = 9 THEN 'react-dom' WHEN p_size = 11 THEN 'express' ELSE p_name END"
_PATH = "CASE ord % 50 WHEN 3 THEN 'src/index.ts' WHEN 7 THEN 'server.ts' WHEN 9 THEN concat(dir, '/angular.json') ELSE path END"


def _names_and_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return V.table(spark, sf_dir, "part").select(F.expr(_NAME).alias("name")), V.files(spark, sf_dir).select(F.expr(_PATH).alias("path"))


@query(
    V.with_views(
        "v_file",
        f"""n AS (SELECT {_NAME} AS name FROM part), p AS (SELECT {_PATH} AS path FROM v_file)
SELECT EXISTS (SELECT 1 FROM n WHERE name = '@angular/core') OR EXISTS (SELECT 1 FROM p WHERE path = 'angular.json' OR ends_with(path, '/angular.json')) AS angular, EXISTS (SELECT 1 FROM n WHERE name = 'react') AS react, EXISTS (SELECT 1 FROM n WHERE name = 'vue') AS vue""",
    )
)
def frontend_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.frontend_frameworks(*_names_and_paths(spark, sf_dir))


@query(
    V.with_views(
        "v_file",
        f"""n AS (SELECT {_NAME} AS name FROM part), p AS (SELECT DISTINCT {_PATH} AS path FROM v_file), c AS (SELECT path, list_position(['app.ts', 'app.js', 'server.ts', 'server.js', 'index.ts', 'index.js', 'src/app.ts', 'src/index.ts'], path) AS rank FROM p)
SELECT arg_min(path, rank) AS entry FROM c WHERE rank > 0 AND EXISTS (SELECT 1 FROM n WHERE name = 'express') HAVING count(*) > 0""",
    )
)
def express_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.entry_file(*_names_and_paths(spark, sf_dir))


_ROUTED = "concat(content, {n}, 'app.', CASE ord % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'use' END, '({q}/p', ord % 9, '/:id{q}, security.isAuthorized(), handlers.f', ord % 4, '())')"
_CALL = r"""\b(?:app|router)\.(get|post|put|patch|delete|use|all)\s*\(\s*[''"]([^''"]+)[''"]\s*,\s*(.+?)\)\s*;?\s*$"""


@query(
    V.with_views(
        "v_file",
        "t AS (SELECT path, " + _ROUTED.format(n="chr(10)", q="''") + " AS c FROM v_file), l AS (SELECT path, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1)::INT AS line_no FROM t)"
        + f" SELECT path AS file, line_no, upper(regexp_extract(line, '{_CALL}', 1)) AS method, regexp_extract(line, '{_CALL}', 2) AS route, trim(regexp_extract(regexp_extract(line, '{_CALL}', 3), '([^,]*)$', 1)) AS handler FROM l WHERE regexp_matches(line, '{_CALL}')",
    )
)
def approximate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr(_ROUTED.format(n="'\\n'", q="\\'"))
    return K.approximate_routes(V.files(spark, sf_dir).select("path", code.alias("content"))).select("file", "line_no", "method", "route", "handler")


_CALLS = ["await fetch(url)", 'await fetch("/fixed")', 'await fetch(config.get("x"))', "axios(opts); eval(x)", "http.get(u)", "new Function(body)", "pug.compile(t)", "nothing"]
_CALLED_SQL = "concat(content, chr(10), '  ', list_extract([" + ", ".join(f"'{c}'" for c in _CALLS) + "], CAST((ord // 8) % 8 AS INT) + 1), ' ')"
_HITS_SQL = []
for _kind, _listed in dims.SINK_PATTERNS.items():
    for _at, _pattern in enumerate(_listed):
        _where = "(" + " OR ".join(f"ends_with(path, '{e}')" for e in dims.SINK_FILES[_kind]) + f") AND regexp_matches(line, '{_pattern}')"
        if _kind == "outbound" and not _at:
            _where += f" AND NOT regexp_matches(regexp_extract(line, '{_pattern}', 1), '^[''\"`]') AND NOT contains(regexp_extract(line, '{_pattern}', 1), 'config.get')"
        _HITS_SQL.append(f"SELECT path, line_no, '{_kind}' AS kind, '{_pattern}' AS pattern, trim(line) AS snippet FROM l WHERE {_where}")


@query(V.with_views("v_file", f"t AS (SELECT path, {_CALLED_SQL} AS c FROM v_file), l AS (SELECT path, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1)::INT AS line_no FROM t) " + " UNION ALL ".join(_HITS_SQL)))
def sink_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.element_at(F.array(*map(F.lit, _CALLS)), (F.floor(F.col("ord") / 8) % 8).cast("int") + 1)
    return K.sink_hits(V.files(spark, sf_dir).select("path", F.concat("content", F.lit("\n  "), call, F.lit(" ")).alias("content")))


_TOOLS = ["x: tool({ execute: f }) streamText(m) db.findAll(q)", "a: tool({}), b: tool({}) streamText(", "streamText(", "User.update(x)"]
_TOOL_SQL = (
    "t AS (SELECT path, concat(content, chr(10), list_extract([" + ", ".join(f"'{t}'" for t in _TOOLS) + r"], CAST(ord % 4 AS INT) + 1)) AS c FROM v_file), u AS (SELECT path, c, regexp_extract_all(c, '(\w+):\s*tool\(\{', 1) AS tools FROM t), "
    "g AS (SELECT *, contains(c, 'streamText(') AND contains(c, 'tool({') AND contains(c, 'execute:') AND len(tools) > 0 AS genuine FROM u)"
)


def _tooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("ord") % 4).cast("int") + 1)
    return C.tool_calling(V.files(spark, sf_dir).select("path", F.concat("content", F.lit("\n"), line).alias("content")))


@query(
    V.with_views(
        "v_file",
        f"""{_TOOL_SQL} SELECT path, tools, genuine, CASE WHEN genuine THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence, array_to_string(list_filter([
    CASE WHEN contains(c, 'streamText(') THEN 'streams text from a model' END, CASE WHEN contains(c, 'tool({{') THEN concat('defines ', len(tools), ' tools') END, CASE WHEN contains(c, 'execute:') THEN 'executes tools' END,
    CASE WHEN contains(c, '.create(') OR contains(c, '.update(') OR contains(c, '.delete(') OR contains(c, 'generateCoupon') THEN 'changes state' END,
    CASE WHEN contains(c, '.findAll(') OR contains(c, '.findOne(') OR contains(c, '.findByPk(') OR contains(c, 'find({{') THEN 'reads data' END], lambda x: x IS NOT NULL), '; ') AS evidence FROM g""",
    )
)
def tool_calling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files call tools of a model."""
    return _tooled(spark, sf_dir)


@query(
    V.with_views(
        "v_file",
        f"{_TOOL_SQL}, f AS (SELECT bool_or(genuine) AS has_tools, (SELECT count(*) > 0 FROM part WHERE p_size > 25) AS has_api FROM g), c AS (SELECT * FROM "
        + dims.sql_values([(kind, *row) for kind, rows in dims.CATEGORIES.items() for row in rows], "v(kind, name, framework)")
        + ") SELECT name, framework FROM c, f WHERE kind = 'always' OR (kind = 'api' AND has_api) OR (kind = 'tools' AND has_tools)",
    )
)
def category_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories to judge: those of tool calling if files call tools, and those of an API if large parts are there."""
    flags = _tooled(spark, sf_dir).agg(F.coalesce(F.bool_or("genuine"), F.lit(False)).alias("has_tools"))
    api = V.table(spark, sf_dir, "part").agg((F.count_if(F.col("p_size") > 25) > 0).alias("has_api"))
    return C.category_list(flags.crossJoin(api))  # one row each


_PATCHABLE = "concat(content, {n}, CASE ord % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'OLD mark' ELSE 'OLD mark, OLD mark' END)"


@query(
    V.with_views(
        "v_file",
        "t AS (SELECT path, " + _PATCHABLE.format(n="chr(10)") + " AS c FROM v_file), n AS (SELECT *, len(string_split(c, 'OLD mark')) = 2 AND len(string_split(c, ', ')) = 2 AS applied FROM t) SELECT path, CASE WHEN applied THEN replace(replace(c, ', ', '; '), 'OLD mark', 'new') ELSE c END AS content, applied FROM n",
    )
)
def corpus_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two literal patches that must each occur exactly once: files where one does not are left as they are."""
    files = V.files(spark, sf_dir).select("path", F.expr(_PATCHABLE.format(n="'\\n'")).alias("content"))
    wanted = F.array(F.struct(F.lit("OLD mark").alias("find"), F.lit("new").alias("put")), F.struct(F.lit(", ").alias("find"), F.lit("; ").alias("put")))
    return K.patched(files, files.select("path", F.inline(wanted))).select("path", "content", "applied")


_FIELDS = "concat(content, {n}, 'a: 1', {n}, '  fix: secret ', ord, {n}, '- fix: more', {n}, 'other: ', ord)"


@query(V.with_views("v_file", "SELECT path, regexp_replace(" + _FIELDS.format(n="chr(10)") + r", '(?m)^(\s*(?:- )?fix:).*$', '\1 ''''', 'g') AS content FROM v_file"))
def corpus_blank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.blanked_fields(V.files(spark, sf_dir).select("path", F.expr(_FIELDS.format(n="'\\n'")).alias("content")), "fix").select("path", "content")


@query(
    """WITH c AS (SELECT DISTINCT concat('M', p_size) AS model, p_size FROM part WHERE p_size % 2 = 0), s AS (SELECT DISTINCT concat('src/', CASE p_partkey % 2 WHEN 0 THEN 'm' ELSE 'q' END, p_size, '.ts') AS file, concat('M', p_size + 1) AS name, p_size, p_partkey % 2 AS odd FROM part)
SELECT c.model, s.file FROM c JOIN s ON s.name = c.model UNION SELECT c.model, s.file FROM c JOIN s ON s.p_size = c.p_size AND s.odd = 0"""
)
def crud_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auto-CRUD models met by an exported symbol or by the file's own name."""
    from siftlake.operators.routes import crud_of_files

    part = V.table(spark, sf_dir, "part")
    crud = part.where("p_size % 2 = 0").select(F.concat(F.lit("M"), "p_size").alias("model")).distinct()
    symbols = part.select(F.expr("concat('src/', CASE p_partkey % 2 WHEN 0 THEN 'm' ELSE 'q' END, p_size, '.ts')").alias("file"), F.expr("concat('M', p_size + 1)").alias("name")).distinct()
    return crud_of_files(crud, symbols).select("model", "file")


@query(V.with_views("v_file", "SELECT dir AS lane_id, list_sort(list(DISTINCT path))[1:3] AS seed_files FROM v_file WHERE ord % 2 = 0 OR ord % 7 = 0 GROUP BY 1"))
def seed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each lane's handlers and extras, once each, the first three in order."""
    files = V.files(spark, sf_dir).select(F.col("dir").alias("lane_id"), "path", "ord")
    return L.seed_files(files.where("ord % 2 = 0"), files.where("ord % 7 = 0"), 3)


_IMPORTS = ['import S from "sequelize"', 'const t = require("typeorm")', "db.query(sql)", 'import x from "./mongoose"']


@query(
    V.with_views(
        "v_file",
        "t AS (SELECT concat(content, chr(10), list_extract([" + ", ".join(f"'{i}'" for i in _IMPORTS) + "], CAST(ord % 4 AS INT) + 1)) AS c FROM v_file) SELECT "
        + ", ".join(rf"""bool_or(regexp_matches(c, '(?:from|require\()\s*[''"]{name}[''"]')) AS {name}""" for name in ("sequelize", "mongoose", "typeorm"))
        + r", count_if(regexp_matches(c, '\.(?:query|raw)\s*\('))::BIGINT AS raw_files FROM t",
    )
)
def persistence_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.element_at(F.array(*map(F.lit, _IMPORTS)), (F.col("ord") % 4).cast("int") + 1)
    return K.persistence(V.files(spark, sf_dir).select("path", F.concat("content", F.lit("\n"), line).alias("content")))


@query("WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) > 100 THEN concat(substring(t, 1, 100), chr(10), '[truncated]') ELSE t END AS section FROM t")
def seed_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at a length with a notice."""
    from siftlake.functions.text import truncated

    talk = V.table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", truncated(F.coalesce("text", F.lit("")), 100).alias("section"))
