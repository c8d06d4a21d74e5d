"""Queries over findings, folds and model text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions import text as X
from siftlake.functions.paths import normalized
from siftlake.operators import corpus as K
from siftlake.operators import findings as G
from siftlake.operators import lanes as L
from siftlake.operators.ranking import dealt, members_by_cube
from siftlake.plans import views as V
from siftlake.plans.registry import query
from siftlake.streaming import budget as T

_CLASSES = list(dims.CLASS_CODES)
_LIST = "[" + ", ".join(f"'{c}'" for c in _CLASSES) + "]"
_ALLOWED = _CLASSES[::2]
_ALLOWED_SQL = "[" + ", ".join(f"'{c}'" for c in _ALLOWED) + "]"


@query(
    f"""WITH f AS (SELECT o_orderkey AS ord, o_orderkey % 4 AS n, o_custkey % 5 > 0 AS enters, o_custkey % 7 > 0 AS sinks, list_extract({_LIST}, CAST(o_orderkey % 14 AS INT) + 1) AS c1,
    list_extract({_LIST}, CAST(o_custkey % 14 AS INT) + 1) AS c2, o_orderkey % 5 - 1 AS step, o_custkey % 11 = 0 AS bare FROM orders),
k AS (SELECT *, list_filter(CASE WHEN bare THEN [] ELSE [c1, c2] END, lambda c: list_contains({_ALLOWED_SQL}, c)) AS kept FROM f)
SELECT ord, CASE WHEN n = 0 THEN 'empty trace' WHEN NOT enters THEN 'no entrypoint first' WHEN NOT sinks OR (n = 1) THEN 'no sink last' WHEN bare THEN 'no classes' WHEN len(kept) = 0 THEN 'no class of the lane' END AS drop_reason,
    kept AS classes, [CASE WHEN step >= 0 AND step < n THEN step ELSE 0 END FOR c IN kept] AS steps FROM k"""
)
def finding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why findings are dropped, and the classes and steps of each after the check."""
    found = G.validated(finding_rows(spark, sf_dir), F.array(*map(F.lit, _ALLOWED)))
    return found.select("ord", "drop_reason", F.transform("classes", lambda c: c["class"]).alias("classes"), F.transform("classes", lambda c: c["step"].cast("long")).alias("steps"))


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding for each order, with a trace and classes that are not always right."""
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.expr(
            """transform(slice(sequence(0, 3), 1, cast(o_orderkey % 4 AS int)), i -> named_struct('kind', CASE WHEN i = 0 THEN if(o_custkey % 5 > 0, 'entrypoint', 'propagation')
            WHEN i = o_orderkey % 4 - 1 THEN if(o_custkey % 7 > 0, 'sink', 'propagation') ELSE 'propagation' END, 'file', 'a.ts', 'line', i))"""
        ).alias("trace"),
        F.expr(
            f"""if(o_custkey % 11 = 0, array(), array(named_struct('class', element_at(array({_LIST[1:-1]}), cast(o_orderkey % 14 AS int) + 1), 'step', cast(o_orderkey % 5 - 1 AS int)),
            named_struct('class', element_at(array({_LIST[1:-1]}), cast(o_custkey % 14 AS int) + 1), 'step', cast(o_orderkey % 5 - 1 AS int))))"""
        ).cast(G.CLASSES).alias("classes"),
    )


#: A list's rows are folded one after another: {kept: sinks kept so far, seen: their buckets}.
_DEDUP = """s AS (SELECT file, {line: line::BIGINT, confidence: l_quantity / 50, ord: (((finding_id * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey)::BIGINT, finding_id: finding_id::VARCHAR} AS x FROM v_step),
l AS (SELECT file, list({kept: [x], seen: [x.line // 15]} ORDER BY x.ord) AS rows FROM s GROUP BY 1),
r AS (SELECT file, list_reduce(rows, lambda acc, x: CASE WHEN NOT list_contains(acc.seen, x.seen[1]) THEN {kept: list_concat(acc.kept, x.kept), seen: list_concat(acc.seen, x.seen)}
    WHEN x.kept[1].confidence > acc.kept[list_position([abs(k.line - x.kept[1].line) <= 15 FOR k IN acc.kept], true)].confidence
    THEN {kept: [CASE WHEN i = list_position([abs(k.line - x.kept[1].line) <= 15 FOR k IN acc.kept], true) THEN x.kept[1] ELSE acc.kept[i] END FOR i IN range(1, len(acc.kept) + 1)], seen: acc.seen} ELSE acc END).kept AS kept FROM l),
u AS (SELECT file, unnest(kept) AS k FROM r) SELECT file, k.line AS line, k.confidence::DOUBLE AS confidence, k.ord AS ord, k.finding_id AS finding_id FROM u"""


@query(V.with_views("v_step", _DEDUP))
def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy de-duplication of each file's sinks, in order of finding, line, part and supplier."""
    steps = V.finding_steps(spark, sf_dir)
    place = ((F.col("finding_id") * 8 + F.col("ord.l_linenumber")) * 100_000 + F.col("ord.l_partkey")) * 10_000 + F.col("ord.l_suppkey")
    rows = steps.select(
        normalized(F.col("file")).alias("file"), F.col("line").cast("long").alias("line"), (F.col("ord.l_quantity") / 50).alias("confidence"), place.cast("long").alias("ord"), F.col("finding_id").cast("string").alias("finding_id")
    )
    return G.deduplicated(rows)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as findings: a line per word of the whole text, the title the role, the description the text."""
    talk = V.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    line = lambda word: (F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int") % 997).cast("int")
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda word: word != ""))
    steps = F.transform(F.array_sort(F.array_distinct(F.transform(words, line))), lambda n: F.struct(F.lit("propagation").alias("kind"), F.lit("a.ts").alias("file"), n.alias("line")))
    return talk.select(
        F.col("conv_id").cast("string").alias("lane"),
        F.col("turn").cast("int").alias("turn"),
        F.col("turn").cast("long").alias("ord"),
        F.concat_ws("-", "conv_id", "turn").alias("finding_id"),
        F.coalesce("role", F.lit("")).alias("title"),
        F.col("text").alias("description"),
        (F.length("text") % 10 / 10).alias("confidence"),
        steps.alias("trace"),
        F.array(F.struct(F.lit("injection").alias("class"), F.lit(0).alias("step"))).alias("classes"),
    )


@query()
def trace_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation folded as findings."""
    return G.merged(turns(spark, sf_dir))


_LIKE = "[CASE WHEN len(list_intersect(k.lines, x.known[1].lines)) >= 2 OR (len(list_intersect(k.lines, x.known[1].lines)) = 1 AND k.title = x.known[1].title) THEN 2 * len(list_intersect(k.lines, x.known[1].lines)) + (k.title = x.known[1].title)::INT ELSE 0 END FOR k IN acc.known]"
_PLACE = f"list_position({_LIKE}, list_max({_LIKE}))"
_STATE = "turn: x.turn, turns: acc.turns + (x.turn > acc.turn)::INT, over: false"
_REPLAY = f"""WITH t AS (SELECT conv_id::VARCHAR AS lane, turn, trim(coalesce(role, '')) AS title, list_distinct([(concat('0x', md5(w)[1:4]))::INT % 997 FOR w IN list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')]) AS lines FROM conversations),
l AS (SELECT lane, list({{known: [{{title: title, lines: lines}}], turn: turn, turns: 1, gained: true, over: false}} ORDER BY turn) AS rows FROM t GROUP BY 1),
r AS (SELECT lane, list_reduce(rows, lambda acc, x: CASE WHEN acc.over OR (x.turn > acc.turn AND acc.turns > 1 AND NOT acc.gained) THEN {{known: acc.known, turn: acc.turn, turns: acc.turns, gained: acc.gained, over: true}}
  WHEN list_max({_LIKE}) = 0 THEN {{known: list_concat(acc.known, x.known), {_STATE.replace(", over", ", gained: true, over")}}}
  ELSE {{known: [CASE WHEN i = {_PLACE} THEN {{title: acc.known[i].title, lines: list_distinct(list_concat(acc.known[i].lines, x.known[1].lines))}} ELSE acc.known[i] END FOR i IN range(1, len(acc.known) + 1)],
    {_STATE.replace(", over", f", gained: (acc.gained AND x.turn = acc.turn) OR len(list_filter(x.known[1].lines, lambda n: NOT list_contains(acc.known[{_PLACE}].lines, n))) > 0, over")}}} END).known AS known FROM l)
SELECT lane, len(known)::BIGINT AS findings, list_sum([len(k.lines) FOR k IN known])::BIGINT AS steps FROM r"""


@query(_REPLAY)
def loop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings each conversation ends with, replaying its turns up to the first that adds nothing."""
    return trace_merge(spark, sf_dir).groupBy("lane").agg(F.count("*").alias("findings"), F.sum(F.size("trace")).alias("steps"))


#: Two folds: files of a large folder cut in order, then parts and folders dealt to the first shard with room.
_SHARDS = """f AS (SELECT dir AS zone, concat(dir, '/', ord // 100) AS dir, path, bytes::BIGINT AS bytes, ord FROM v_file), d AS (SELECT zone, dir, sum(bytes)::BIGINT AS whole, count(*) AS n, min(ord) AS first FROM f GROUP BY 1, 2),
c AS (SELECT zone, dir, list({part: 0, used: bytes, out: [{path: path, bytes: bytes, part: 0}]} ORDER BY ord, path) AS rows FROM f JOIN d USING (zone, dir) WHERE whole > 20000 AND n > 1 GROUP BY 1, 2),
r AS (SELECT zone, dir, list_reduce(rows, lambda acc, x: CASE WHEN acc.used + x.used > 20000 THEN {part: acc.part + 1, used: x.used, out: list_append(acc.out, {path: x.out[1].path, bytes: x.out[1].bytes, part: acc.part + 1})}
  ELSE {part: acc.part, used: acc.used + x.used, out: list_append(acc.out, {path: x.out[1].path, bytes: x.out[1].bytes, part: acc.part})} END).out AS out FROM c),
u AS (SELECT zone, dir, unnest(out) AS o FROM r), p AS (SELECT zone, dir, o.part AS part, sum(o.bytes)::BIGINT AS bytes FROM u GROUP BY 1, 2, 3),
i AS (SELECT zone, dir, -1 AS part, whole AS bytes, whole, first FROM d WHERE NOT (whole > 20000 AND n > 1) UNION ALL SELECT p.zone, p.dir, p.part, p.bytes, d.whole, d.first FROM p JOIN d ON p.zone = d.zone AND p.dir = d.dir),
l AS (SELECT zone, list({rooms: [0::BIGINT], out: [{dir: dir, part: part, bytes: bytes, shard: -1}]} ORDER BY whole DESC, first, dir, part) AS rows FROM i GROUP BY 1),
s AS (SELECT zone, list_prepend({rooms: list_filter([0::BIGINT], lambda v: false), out: list_filter(rows[1].out, lambda v: false)}, rows) AS rows FROM l),
k AS (SELECT zone, list_reduce(rows, lambda acc, x: CASE WHEN x.out[1].part < 0 AND len(list_filter(acc.rooms, lambda v: v >= x.out[1].bytes)) > 0
  THEN {rooms: [CASE WHEN n = list_position([v >= x.out[1].bytes FOR v IN acc.rooms], true) THEN acc.rooms[n] - x.out[1].bytes ELSE acc.rooms[n] END FOR n IN range(1, len(acc.rooms) + 1)],
    out: list_append(acc.out, {dir: x.out[1].dir, part: x.out[1].part, bytes: x.out[1].bytes, shard: (list_position([v >= x.out[1].bytes FOR v IN acc.rooms], true) - 1)::INT})}
  ELSE {rooms: list_append(acc.rooms, greatest(-1, 20000 - x.out[1].bytes)), out: list_append(acc.out, {dir: x.out[1].dir, part: x.out[1].part, bytes: x.out[1].bytes, shard: len(acc.rooms)::INT})} END).out AS out FROM s),
g AS (SELECT zone, unnest(out) AS o FROM k)
SELECT zone, o.shard AS shard, o.dir AS dir, NULL::VARCHAR AS path, o.bytes AS bytes FROM g WHERE o.part < 0
UNION ALL SELECT u.zone, g.o.shard, u.dir, u.o.path, u.o.bytes FROM u JOIN g ON g.zone = u.zone AND g.o.dir = u.dir AND g.o.part = u.o.part"""


@query(V.with_views("v_file", _SHARDS))
def shard_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a hundred documents packed first-fit into shards, per source."""
    files = V.files(spark, sf_dir).select(F.col("dir").alias("zone"), F.concat("dir", F.lit("/"), F.floor(F.col("ord") / 100)).alias("dir"), "path", F.col("bytes").cast("long").alias("bytes"), "ord")
    return G.packed_shards(files, 20_000)


#: {kept: blocks kept so far, e: the end of the last}.
_OUTERMOST = """b AS (SELECT DISTINCT file, line AS start, line + finding_id % 40 AS stop FROM v_step), l AS (SELECT file, list({kept: [{start: start, stop: stop}], e: stop} ORDER BY start, stop DESC) AS blocks FROM b GROUP BY 1),
r AS (SELECT file, list_reduce(blocks, lambda acc, x: CASE WHEN x.kept[1].start > acc.e THEN {kept: list_concat(acc.kept, x.kept), e: x.e} ELSE acc END).kept AS kept FROM l), u AS (SELECT file, unnest(kept) AS k FROM r)
SELECT file, k.start::BIGINT AS start, k.stop::BIGINT AS stop FROM u"""


@query(V.with_views("v_step", _OUTERMOST))
def outermost_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = V.finding_steps(spark, sf_dir)
    spans = steps.select(normalized(F.col("file")).alias("file"), F.col("line").cast("long").alias("start"), (F.col("line") + F.col("finding_id") % 40).cast("long").alias("stop"))
    return G.outermost(spans)


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """Cumulative reports of lanes, from events: a run per twenty users."""
    from pyspark.sql import Window

    events = V.table(spark, sf_dir, "events")
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.select(
        F.concat(F.lit("run-"), F.floor(F.col("user_id") / 20)).alias("run"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit("lane-"), F.col("user_id") % 20).alias("lane_id"),
        F.sum(F.floor("value").cast("long")).over(so_far).alias("tokens_used"),
        F.count("*").over(so_far).cast("double").alias("seconds_elapsed"),
        (F.col("event_id") % 3 == 0).alias("nearly_done"),
        (F.col("event_id") % 200).cast("long").alias("estimated_remaining"),
    )
    return rows, {f"lane-{i}": (200 + 50 * i, 30 + i) for i in range(15)}


#: {tokens: latest of each lane, stopped: of each lane, over: the run's cap was met, x: the report, out: answers}.
_TRACKED = """WITH e AS (SELECT event_id, user_id // 20 AS run, CAST(user_id % 20 AS INT) AS lane, sum(CAST(floor(value) AS BIGINT)) OVER w AS tok, count(*) OVER w AS secs, event_id % 3 = 0 AS near, event_id % 200 AS left_over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, CASE WHEN lane < 15 THEN 200 + 50 * lane END AS most, CASE WHEN lane < 15 THEN 30 + lane END AS longest FROM e),
x AS (SELECT run, event_id, lane, tok::BIGINT AS tok, coalesce(tok >= most, false) AS at_tokens, coalesce(secs >= longest, false) AS at_seconds, lane < 15 AS planned, CASE WHEN near AND left_over <= 0.25 * most THEN 'bounded_ask' ELSE 'architectural_concern' END AS framing FROM f),
l AS (SELECT run, list({tokens: [0::BIGINT FOR i IN range(20)], stopped: [false FOR i IN range(20)], over: false, x: {event_id: event_id, lane: lane, tok: tok, at_tokens: at_tokens, at_seconds: at_seconds, planned: planned, framing: framing}, out: [{ord: 0::BIGINT, lane: 0, stop: '', framing: '', total: 0::BIGINT}]} ORDER BY event_id) AS rows FROM x GROUP BY 1),
r AS (SELECT run, list_reduce(list_prepend(rows[1], rows), lambda acc, n: CASE
  WHEN acc.over THEN {tokens: acc.tokens, stopped: acc.stopped, over: true, x: n.x, out: list_append(acc.out, {ord: n.x.event_id, lane: n.x.lane, stop: 'global_cap', framing: 'architectural_concern', total: list_sum(acc.tokens)::BIGINT})}
  WHEN acc.stopped[n.x.lane + 1] THEN {tokens: acc.tokens, stopped: acc.stopped, over: false, x: n.x, out: list_append(acc.out, {ord: n.x.event_id, lane: n.x.lane, stop: 'lane_token_ceiling', framing: 'architectural_concern', total: list_sum(acc.tokens)::BIGINT})}
  ELSE {tokens: [CASE WHEN i = n.x.lane + 1 THEN n.x.tok ELSE acc.tokens[i] END FOR i IN range(1, 21)], stopped: [acc.stopped[i] OR (i = n.x.lane + 1 AND (n.x.at_tokens OR n.x.at_seconds)) FOR i IN range(1, 21)],
    over: n.x.planned AND NOT n.x.at_tokens AND NOT n.x.at_seconds AND list_sum(acc.tokens) - acc.tokens[n.x.lane + 1] + n.x.tok >= 5000, x: n.x,
    out: list_append(acc.out, {ord: n.x.event_id, lane: n.x.lane, stop: CASE WHEN n.x.at_tokens THEN 'lane_token_ceiling' WHEN n.x.at_seconds THEN 'lane_wall_clock_ceiling' WHEN n.x.planned AND list_sum(acc.tokens) - acc.tokens[n.x.lane + 1] + n.x.tok >= 5000 THEN 'global_cap' ELSE 'none' END,
      framing: CASE WHEN n.x.at_tokens OR n.x.at_seconds THEN n.x.framing WHEN n.x.planned AND list_sum(acc.tokens) - acc.tokens[n.x.lane + 1] + n.x.tok >= 5000 THEN 'architectural_concern' END,
      total: (list_sum(acc.tokens) - acc.tokens[n.x.lane + 1] + n.x.tok)::BIGINT})} END).out[2:] AS out FROM l),
u AS (SELECT run, unnest(out) AS o FROM r) SELECT concat('run-', run) AS run, o.ord AS ord, concat('lane-', o.lane) AS lane_id, o.stop = 'none' AS ok, o.stop AS stop, o.framing AS framing, o.total AS run_tokens FROM u"""


@query(_TRACKED)
def budget_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.track(*_reports(spark, sf_dir), cap=5000)


_ANSWER = """concat(coalesce(text, ''), CASE conv_id % 4 WHEN 0 THEN concat('Here: ', chr(96), chr(96), chr(96), 'json', chr(10), '{"a": ', turn, '}', chr(10), chr(96), chr(96), chr(96)) WHEN 1 THEN concat('I say {"b": [', turn, ']} so') WHEN 2 THEN 'no braces' ELSE '[{"c": {}}] ' END)"""
_FENCE = "(?s)```(?:json)?\\s*(.*?)```"
_CLEAN = "trim({}, concat(' ', chr(9), chr(10), chr(13)))"


@query(
    rf"""WITH t AS (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations) SELECT conv_id, turn,
    CASE WHEN regexp_extract(a, '{_FENCE}', 1) <> '' THEN {_CLEAN.format(f"regexp_extract(a, '{_FENCE}', 1)")} WHEN regexp_matches(a, '(?s)\{{.*\}}') THEN regexp_extract(a, '(?s)(\{{.*\}})', 1) END AS object,
    CASE WHEN regexp_matches(a, '{_FENCE}') THEN {_CLEAN.format(f"regexp_extract(a, '{_FENCE}', 1)")} WHEN regexp_matches(a, '(?s)\[.*\]|\{{.*\}}') THEN regexp_extract(a, '(?s)(\[.*\]|\{{.*\}})', 1) ELSE {_CLEAN.format("a")} END AS widest,
    CASE WHEN regexp_matches(a, '(?s)```(?:json)?\s*\n(.*?)\n```') THEN regexp_extract(a, '(?s)```(?:json)?\s*\n(.*?)\n```', 1) WHEN regexp_matches(a, '[\[{{]') THEN regexp_extract({_CLEAN.format("a")}, '(?s)[\[{{].*') ELSE '{{}}' END AS opening FROM t"""
)
def model_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of answers that follow the whole text of a turn, by the three rules."""
    answers = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("a"))
    return answers.select("conv_id", "turn", *[X.fenced_json(F.col("a"), variant).alias(variant) for variant in ("object", "widest", "opening")])


_ERRORS = ["429 Too Many", "bad schema", "status 503", "read ECONNRESET", "code 4290", "Request timed out", "connect ETIMEDOUT 10.0.0.1"]


@query(
    "WITH m AS (SELECT list_extract([" + ", ".join(f"'{e}'" for e in _ERRORS) + f"], CAST(event_id % {len(_ERRORS)} AS INT) + 1) AS message, CASE user_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 504 END AS status FROM events) "
    "SELECT message, status, message NOT IN ('bad schema', 'code 4290') OR coalesce(status IN (429, 504), false) AS transient, count(*) AS n FROM m GROUP BY 1, 2, 3"
)
def transient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS)).cast("int") + 1)
    rows = V.table(spark, sf_dir, "events").select(message.alias("message"), F.expr("CASE user_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 504 END").alias("status"))
    return rows.groupBy("message", "status", X.is_transient_error(F.col("message"), F.col("status")).alias("transient")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_matches(coalesce(text, ''), 'attack|exploit|inject', 'i') OR regexp_matches(coalesce(text, ''), '(password|token)\\s*=') AS exploit FROM documents")
def exploit_test_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", K.is_exploit_test(F.col("text"), F.col("text")).alias("exploit"))


_KEYED = "concat(coalesce(text, ''), {n}, '-----BEGIN RSA PRIVATE KEY-----', {n}, repeat(concat(doc_id, {n}), cast(doc_id % 4 AS int)), '-----END RSA PRIVATE KEY-----', CASE WHEN doc_id % 3 = 0 THEN concat({n}, 'b -----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----') ELSE '' END)"
_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----"


@query(
    f"""WITH k AS (SELECT doc_id, {_KEYED.format(n="chr(10)")} AS t FROM documents), p AS (SELECT doc_id, string_split_regex(t, '{_BLOCK}') AS rest, regexp_extract_all(t, '{_BLOCK}') AS blocks FROM k),
r AS (SELECT doc_id, array_to_string([concat(rest[i], CASE WHEN i <= len(blocks) THEN concat('[REDACTED PRIVATE KEY]', repeat(chr(10), len(string_split(blocks[i], chr(10))) - 1)) ELSE '' END) FOR i IN range(1, len(rest) + 1)], '') AS redacted FROM p)
SELECT doc_id, redacted, len(string_split(redacted, chr(10)))::INT AS lines FROM r"""
)
def pem_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with key blocks behind them."""
    rows = V.table(spark, sf_dir, "documents").select("doc_id", X.redact_keys(F.expr(_KEYED.format(n="'\\n'"))).alias("redacted"))
    return rows.withColumn("lines", X.line_count(F.col("redacted")))


@query(
    V.with_views(
        "v_file",
        """p AS (SELECT ord, concat('/work/', CASE ord % 4 WHEN 0 THEN 'src/../src/' WHEN 1 THEN '../' WHEN 2 THEN './' ELSE '' END, path) AS path FROM v_file)
SELECT ord, ord % 4 <> 1 AND ord % 10 > 0 AS allowed FROM p""",
    )
)
def read_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlake.sources.adapters import guarded

    files = V.files(spark, sf_dir)
    raw = F.concat(F.lit("/work/"), F.expr("CASE ord % 4 WHEN 0 THEN 'src/../src/' WHEN 1 THEN '../' WHEN 2 THEN './' ELSE '' END"), "path")
    denied = files.where("ord % 10 = 0").select(F.concat(F.lit("/work/"), F.expr("CASE WHEN ord % 4 = 0 THEN 'src/' ELSE '' END"), "path").alias("path"))
    return guarded(files.select("ord", raw.alias("path")), ["/work"], denied).select("ord", "allowed")


@query("WITH w AS (SELECT event_type, date_trunc('hour', ts) AS hour, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT event_type, hour, sum(v)::BIGINT AS spent, count(*) AS reports FROM w GROUP BY 1, 2")
def spend_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: spend in event-time windows of an hour."""
    events = V.table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum(F.floor("value").cast("long")).alias("spent"), F.count("*").alias("reports"))


@query(V.with_views("v_step class_code", "SELECT class, provider, count(DISTINCT finding_id) AS findings FROM v_step JOIN class_code USING (code) GROUP BY CUBE (class, provider)"))
def class_provider_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: findings by class and provider with all subtotals."""
    steps = V.finding_steps(spark, sf_dir).select("finding_id", "code", "provider")
    named = dealt(steps, V.table(spark, sf_dir, "lineitem").count(), "finding_id").join(dims.class_codes(spark), "code")
    return members_by_cube(named, "finding_id", ["class", "provider"]).withColumnRenamed("members", "findings")


@query(
    """WITH lane AS (SELECT s_suppkey AS lane_id, s_nationkey AS n FROM supplier), plan AS (SELECT lane_id, n * 100 AS ceiling FROM lane WHERE n % 6 > 0), hits AS (SELECT l_suppkey AS lane_id, count(*) AS n_found FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 5 > 0 GROUP BY 1)
SELECT l.lane_id, p.ceiling, coalesce(h.n_found, 0) AS found, p.ceiling IS NULL AS unplanned, l.lane_id % 4 = 0 AS approved FROM lane l LEFT JOIN plan p ON p.lane_id = l.lane_id LEFT JOIN hits h ON h.lane_id = l.lane_id"""
)
def lane_budget_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes with their plan (missing: skipped), phase-one counts (missing: 0) and scope decisions (missing: not approved)."""
    lanes = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lane_id"), F.col("s_nationkey").alias("n"))
    plan = lanes.where("n % 6 > 0").select("lane_id", (F.col("n") * 100).alias("ceiling"))
    hits = V.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_suppkey % 5 > 0").groupBy(F.col("l_suppkey").alias("lane_id")).agg(F.count("*").alias("found"))
    decisions = lanes.where("lane_id % 4 = 0").select("lane_id")
    return L.approved(L.escalations(L.planned(lanes, plan), hits), decisions, ["lane_id"]).select("lane_id", "ceiling", "found", "unplanned", "approved")
