"""Coverage of lanes and categories against what was exercised, verdict rules, prompts and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions.text import utf16_units

#: Verdict rules: category, flags of which one makes it present, and confidences with and without.
VERDICT_RULES = [
    ("A01: Broken Access Control", ("has_routes",), 0.9, 0.6),
    ("A02: Cryptographic Failures", ("has_crypto", "has_auth"), 0.8, 0.5),
    ("A03: Injection", ("has_queries", "has_exec"), 0.9, 0.5),
    ("A05: Misconfiguration", ("has_config",), 0.7, 0.4),
    ("A08: Integrity Failures", ("has_parsers",), 0.7, 0.4),
    ("A09: Logging", ("has_logging",), 0.6, 0.5),
    ("A10: SSRF", ("has_outbound",), 0.8, 0.5),
    ("LLM01: Prompt Injection", ("has_model_calls",), 0.8, 0.9),
]


def category_verdicts(flags: DataFrame, rules: list = VERDICT_RULES) -> DataFrame:
    """One row per rule from one row of flags: present if one of its flags is set."""
    rows = []
    for name, needed, yes, no in rules:
        hit = F.lit(False)
        for flag in needed:
            hit = hit | F.coalesce(F.col(flag), F.lit(False))
        rows.append(F.struct(F.lit(name).alias("name"), F.when(hit, "present").otherwise("absent").alias("verdict"), F.when(hit, yes).otherwise(no).alias("confidence")))
    return flags.select(F.inline(F.array(*rows)))


def tool_calling(files: DataFrame) -> DataFrame:
    """Files (path, content) with the tools that they define for a model, whether they really call tools, and why one thinks so."""
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda word: F.contains("content", word))
    tools = F.regexp_extract_all("content", F.lit(dims.TOOL_NAME), F.lit(1))
    stream, defines, executes = map(has, dims.TOOL_MARKS)
    said = [
        (stream, F.lit("streams text from a model")),
        (defines, F.concat(F.lit("defines "), F.size("tools").cast("string"), F.lit(" tools"))),
        (executes, F.lit("executes tools")),
        (has(*dims.TOOL_WRITES), F.lit("changes state")),
        (has(*dims.TOOL_READS), F.lit("reads data")),
    ]
    rows = files.select("path", "content", tools.alias("tools"))
    genuine = stream & defines & executes & (F.size("tools") > 0)
    evidence = F.array_join(F.array_compact(F.array(*[F.when(test, text) for test, text in said])), "; ")
    return rows.select("path", "tools", genuine.alias("genuine"), F.when(genuine, 0.95).otherwise(0.5).alias("confidence"), evidence.alias("evidence"))


def category_list(flags: DataFrame, categories: dict[str, list] = dims.CATEGORIES) -> DataFrame:
    """Categories to judge from one row of flags: those of an API only with has_api, those of tool calling only with has_tools."""
    listed = [(kind, name, framework) for kind, rows in categories.items() for name, framework in rows]
    known = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(framework).alias("framework")) for kind, name, framework in listed])
    wanted = lambda c: (c["kind"] == "always") | ((c["kind"] == "api") & F.col("has_api")) | ((c["kind"] == "tools") & F.col("has_tools"))
    return flags.select(F.inline(F.filter(known, wanted))).select("name", "framework")


def universe(verdicts: DataFrame) -> DataFrame:
    """Categories that may apply, with their code and the framework's full name."""
    code = F.regexp_extract("name", "^([A-Za-z0-9]+):", 1)
    full = F.expr("CASE lower(trim(framework)) WHEN 'owasp' THEN 'OWASP Top 10 2021' WHEN 'api security' THEN 'API Security Top 10' WHEN 'llm' THEN 'LLM Top 10' ELSE framework END")
    kept = verdicts.where("verdict IN ('present', 'uncertain')")
    return kept.select(F.when(code != "", code).otherwise(F.trim("name")).alias("code"), "name", full.alias("framework"))


def family(code: Column) -> Column:
    """The letters of a code: A01 and A10 are of one family."""
    return F.regexp_replace(code, "[0-9]+$", "")


def missing_families(lanes: DataFrame, universe: DataFrame) -> DataFrame:
    """Families of the universe that no lane has a code of."""
    covered = lanes.select(F.explode("codes").alias("code")).select(family(F.col("code")).alias("family"))
    return universe.select(family(F.col("code")).alias("family")).subtract(covered)


def applicability(exercised: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Codes that ground truth exercises against the verdicts: right, and exercised though absent."""
    joined = verdicts.join(exercised.select("code").distinct().withColumn("_used", F.lit(True)), "code", "full")
    used, verdict = F.coalesce("_used", F.lit(False)), F.coalesce("verdict", F.lit("missing"))
    return joined.groupBy(used.alias("exercised"), verdict.alias("verdict")).agg(F.count("*").alias("codes"))


def inventory_coverage(truth: DataFrame, lanes: DataFrame) -> DataFrame:
    """Entries by the disposition of the first lane of their file."""
    first = lanes.groupBy("path").agg(F.min_by("disposition", "ord").alias("disposition"))
    state = F.when(F.col("path").isNull(), "no lane").when(F.col("disposition") == "hunt", "scanned").otherwise("skipped")
    return truth.join(first, F.col("file") == F.col("path"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("entries"))


def playbooks(lanes: DataFrame, registry: DataFrame) -> DataFrame:
    """Playbooks that each lane loads, once each."""
    named = lanes.select("path", F.explode("classes").alias("class")).join(registry, "class")
    return named.groupBy("path").agg(F.array_sort(F.collect_set("playbook")).alias("playbooks"))


#: What a hunt is told of each class, in our own words.
PLAYBOOKS = {
    "access-control": "Access control. For each handler ask who may call it and whose record it touches. Report ids from the request that reach a query without a check of the owner, and roles that only the page checks.",
    "crypto-auth": "Cryptography and login. Look for keys and passwords in the source, fast or broken hashes, tokens that are decoded but not verified, and sessions that outlive a change of password.",
    "injection": "Injection. Follow input to every interpreter: queries built by joining text, shells, templates, evaluated code. A parameter list that a driver binds is safe; a pattern or a name of a column made of input is not.",
    "insecure-design": "Design. Ask what the feature allows if each request is valid: steps that can be skipped or repeated, limits that are never checked again, trust in what a client computed.",
    "misconfiguration": "Configuration. Report debug modes, default accounts, open origins, headers that are missing, errors that show stacks, and old routes that still answer.",
    "vulnerable-components": "Components. Compare the versions in manifests with known faults, and note packages without an owner and ones that run scripts when they are installed.",
    "integrity-failures": "Integrity. Look for objects rebuilt from untrusted bytes, updates and downloads without a signature, and builds that fetch code by a name that anyone may take.",
    "logging-monitoring": "Logging. Report secrets and personal data in logs, input written to logs with its line breaks, and logins, denials and payments that leave no trace.",
    "ssrf": "Requests of the server. For each outgoing call ask who chooses its host and path. Check what redirects, other schemes and addresses inside the network do.",
    "api-property-auth": "Properties of objects. Compare what a request may set and what an answer shows with what the user needs: whole records bound to a model, fields of price, role or owner.",
    "resource-consumption": "Consumption. Look for lists without a page size, uploads without a limit, patterns that backtrack, work that grows with the square of the input, and calls that cost money.",
    "sensitive-business-flows": "Business flows. Ask what a script gains by doing it a thousand times: coupons, reservations, invitations, reviews, and what would slow it down.",
    "ai-llm-agency": "Models. Follow outside text into prompts, and answers into tools, queries and pages. Report tools that act without asking, and secrets or other users' data in a prompt.",
    "client-side": "Pages. Follow data into markup, addresses and scripts: raw html, links made of input, messages of other windows, and answers of a model shown as they come.",
}


def with_playbooks(lanes: DataFrame, texts: dict[str, str] = PLAYBOOKS) -> DataFrame:
    """Lanes (classes) with `playbook`, the texts of their classes in order of class. The texts are a fixed few, so they are a literal map."""
    pairs = [F.lit(x) for item in texts.items() for x in item]
    found = F.transform(F.array_sort("classes"), lambda c: F.try_element_at(F.create_map(*pairs), c))
    return lanes.withColumn("playbook", F.array_join(F.array_compact(found), "\n\n"))


def canonical(names: DataFrame, aliases: DataFrame, column: str = "provider") -> DataFrame:
    """Aliases replaced by what they stand for; other names stay."""
    known = aliases.select(F.col("alias").alias(column), "canonical")
    return names.join(known, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")


def prompts(chunks: DataFrame) -> DataFrame:
    """The prompt of each chunk (path, index, total, classes, source), its segments with start and length, and whether they are it.

    Lengths are in UTF-16 units, as model prices and other tools count them. `reconciled` cuts the prompt at the segments' places and
    holds each piece against the part that it was made of.
    """
    parts = [("task", F.concat(F.lit("File: "), "path", F.lit("\n"))), ("chunk", F.when(F.col("total") > 1, F.concat(F.lit("Chunk "), "index", F.lit(" of "), "total", F.lit("\n"))).otherwise("")), ("classes", F.concat(F.array_join("classes", ", "), F.lit("\n"))), ("source", F.col("source"))]
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), utf16_units(text).alias("chars"), F.encode(text, "UTF-16BE").alias("own")) for kind, text in parts])
    rows = chunks.withColumns({"prompt": F.concat(*[text for _, text in parts]), "_parts": F.filter(made, lambda s: s["chars"] > 0)})
    start = lambda i: F.aggregate(F.slice("_parts", F.lit(1), i), F.lit(0), lambda total, s: total + s["chars"])
    placed = F.transform("_parts", lambda s, i: F.struct(s["kind"].alias("kind"), start(i).alias("start"), s["chars"].alias("chars"), s["own"].alias("own")))
    whole = F.encode("prompt", "UTF-16BE")
    fits = F.forall("_placed", lambda s: F.substring(whole, 2 * s["start"] + 1, 2 * s["chars"]) == s["own"])
    total = F.aggregate("_placed", F.lit(0), lambda total, s: total + s["chars"])
    known = rows.withColumn("_placed", placed).withColumn("reconciled", fits & (total == utf16_units(F.col("prompt"))))
    segments = F.transform("_placed", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["chars"].alias("chars")))
    return known.withColumn("segments", segments).drop("_parts", "_placed")


def segment_table(prompts: DataFrame, *keys: str) -> DataFrame:
    """A row for each segment of each prompt: keys, kind, start, chars, and the text that these places cut out of the prompt."""
    rows = prompts.select(*keys, "prompt", F.inline("segments"))
    piece = F.substring(F.encode("prompt", "UTF-16BE"), 2 * F.col("start") + 1, 2 * F.col("chars"))
    return rows.select(*keys, "kind", "start", "chars", F.decode(piece, "UTF-16BE").alias("text"))


def unreported(lanes: DataFrame, findings: DataFrame) -> DataFrame:
    """lane, classes, and those of them that no finding of the lane (lane, classes array of structs with class) carries, in the lane's order."""
    carried = findings.select("lane", F.explode("classes").alias("c")).groupBy("lane").agg(F.collect_set("c.class").alias("_carried"))
    left = F.array_except("classes", F.coalesce("_carried", F.array().cast("array<string>")))
    return lanes.join(carried, "lane", "left").withColumn("unreported", left).drop("_carried")


#: The jobs of a follow-up turn, by loop mode: our own wording of what each asks for.
TRACE_JOB = "Complete the traces. For every finding in the index, list each line that the value or the decision passes through on its way from entrypoint to sink. Keep all lines that it cites already, and add the ones left out."
GAP_JOB = "Look for what is missing. Go through the classes {classes} one by one and report each defect of theirs that the index does not hold. A weak suspicion counts as a finding of low confidence."
ONLY_NEW, RESTATE = "Answer in the same JSON as before, with the new findings only.", "Answer in the same JSON as before, with every finding of the index under its own title and lines, and the new ones after them."


def follow_ups(lanes: DataFrame, findings: DataFrame, mode: str) -> DataFrame:
    """lane and prompt: the follow-up turn of a loop mode for each lane (lane, classes), from its findings so far
    (lane, ord, title, trace, classes).

    It holds an index of the findings (title, classes and cited lines), the mode's jobs, and, where findings are asked for, the classes
    that none carries yet. A lane's index is one text, as it goes into one prompt.
    """
    if mode not in ("trace", "gap", "reflect"):
        raise ValueError(f"no follow-up turns in mode {mode!r}")
    cited = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("trace", lambda s: s["line"]))), lambda n: n.cast("string")), ", ")
    named = F.array_join(F.array_distinct(F.transform("classes", lambda c: c["class"])), ", ")
    entry = F.concat(F.lit("- "), F.coalesce(F.trim("title"), F.lit("")), F.lit(" ["), named, F.lit("] lines "), cited)
    listed = F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry"))))
    index = findings.groupBy("lane").agg(F.array_join(F.transform(listed, lambda e: e["entry"]), "\n").alias("_index"))
    rows = unreported(lanes, findings).join(index, "lane", "left")
    gap = F.replace(F.lit(GAP_JOB), F.lit("{classes}"), F.array_join("classes", ", "))
    first = F.when(F.size("unreported") > 0, F.concat(F.lit("\nStart with those that no finding carries: "), F.array_join("unreported", ", "), F.lit("."))).otherwise("")
    job = {"trace": F.lit(f"1. {TRACE_JOB}"), "gap": F.concat(F.lit("1. "), gap, first), "reflect": F.concat(F.lit(f"1. {TRACE_JOB}\n2. "), gap, first)}[mode]
    prompt = F.concat(F.lit("Index of what was reported so far:\n"), F.coalesce("_index", F.lit("(nothing)")), F.lit("\n\n"), job, F.lit(f"\n\n{ONLY_NEW if mode == 'gap' else RESTATE}"))
    return rows.select("lane", prompt.alias("prompt"))


def resumed(before: DataFrame, again: DataFrame) -> DataFrame:
    """Findings of an earlier pass and of a later one, without lanes that the earlier one reported."""
    return before.unionByName(again.join(before.select("lane_id").distinct(), "lane_id", "left_anti"))


def registry_problems(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """problem and subject of a registry (class, code, playbook): codes of two classes, wanted codes of none, playbooks of two classes."""
    shared = lambda column, name: registry.groupBy(F.col(column).alias("subject")).agg(F.count_distinct("class").alias("n")).where("n > 1").select(F.lit(name).alias("problem"), "subject")
    missing = wanted.select("code").distinct().join(registry, "code", "left_anti").select(F.lit("missing code").alias("problem"), F.col("code").alias("subject"))
    return shared("code", "duplicate code").unionByName(missing).unionByName(shared("playbook", "shared playbook"))
