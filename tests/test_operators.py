"""Behaviour of operators that SQL does not express, on rows of our own."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlake.functions import paths, rounding, text
from siftlake.operators import budget as B
from siftlake.operators import findings as G
from siftlake.operators import lanes as L
from siftlake.operators import recon as R
from siftlake.operators import scoring as S
from siftlake.sources import adapters, sinks
from siftlake.streaming import budget as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths(spark):
    cases = [("src/a.ts", "src/a.ts", True), ("./src/a.ts", "src/a.ts", True), ("file:///x/src/a.ts", "src/a.ts", True), ("\\x\\src\\a.ts", "src/a.ts", True), ("outes/a.ts", "routes/a.ts", False), ("a.ts", "src/a.ts", True), ("", "a.ts", False), (" /work/src/a.ts ", "src/a.ts", True)]
    a, b = paths.normalized(F.col("a")), paths.normalized(F.col("b"))
    assert [r[0] for r in values(spark, [c[:2] for c in cases], "a string, b string", paths.same_file(a, b))] == [c[2] for c in cases]
    left = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string")
    right = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "j int, b string")
    joined = {(r["i"], r["j"]) for r in S.file_join(left, right, "a", "b").collect()}
    both = left.crossJoin(right).where(paths.same_file(a, b))
    assert joined == {(r["i"], r["j"]) for r in both.collect()}


def test_rounding(spark):
    got = values(spark, [(-2.5,), (2.5,), (0.49,)], "x double", rounding.half_up(F.col("x")))
    assert [r[0] for r in got] == [-2, 3, 0]
    for k, n in ((1, 16), (3, 16), (65, 97), (5, 0)):
        (found,) = values(spark, [(k, n)], "k int, n int", rounding.percent(F.col("k"), F.col("n")))
        assert found[0] == (round(k / n * 100, 1) if n else None)


def test_lines_and_chunks(spark):
    counts = values(spark, [("a\nb\n",), ("",), (None,)], "t string", text.line_count(F.col("t")), text.byte_count(F.col("t")))
    assert counts == [(3, 4), (1, 0), (0, 0)]
    lines = [0, 1, 2000, 2001, 3980, 3981, 20_000]
    df = spark.createDataFrame([(n,) for n in lines], "lines int")
    found = {}
    for r in L.chunks(df).orderBy("lines", "index").collect():
        found.setdefault(r["lines"], []).append((r["start_line"], r["end_line"]))
    assert found[0] == [(0, 0)] and found[1] == [(1, 1)] and found[2000] == [(1, 2000)] and found[2001] == [(1, 2000), (1981, 2001)] and len(found[3980]) == 2 and len(found[3981]) == 3
    for n, parts in found.items():
        if n:
            assert parts[0][0] == 1 and parts[-1][1] == n and all(b[0] == a[1] - 19 for a, b in zip(parts, parts[1:]))


def test_lane_ids_run_on(spark):
    df = spark.createDataFrame([(i * i,) for i in range(300)], "ord long")
    ids = [r["lane_id"] for r in L.lane_ids(df, ["ord"], after=9900).orderBy("ord").collect()]
    assert ids == [f"file-{i:04d}" for i in range(9901, 10_201)]


def test_key_blocks_keep_their_lines(spark):
    key = "x\n-----BEGIN RSA PRIVATE KEY-----\nab\ncd\n-----END RSA PRIVATE KEY-----\ny"
    one = "-----BEGIN PRIVATE KEY-----ab-----END PRIVATE KEY-----"
    got = [r[0] for r in values(spark, [(key,), (one,), (None,)], "t string", text.redact_keys(F.col("t")))]
    assert got[0].count("\n") == key.count("\n") and "ab" not in got[0] and got[1] == "[REDACTED PRIVATE KEY]" and got[2] is None


def test_manifest_quirk(spark):
    names = [("a/package.json",), ("Cargo.toml",), ("go.mod",)]
    assert [r[0] for r in values(spark, names, "p string", R.is_manifest(F.col("p")))] == [True, False, True]
    assert [r[0] for r in values(spark, names, "p string", R.is_manifest(F.col("p"), strict=False))] == [True, True, True]


def test_signals(spark):
    rows = [("a.ts", "export function f () {}\nexec()"), ("b.ts", "exec(cmd)"), ("config.js", "eval(x)"), ("package.json", "{}"), ("c.ts", "isAuthenticated; yaml.load(x)")]
    handlers = spark.createDataFrame([("f",)], "name string")
    got = {r["path"]: r["signals"] for r in R.signals(spark.createDataFrame(rows, "path string, content string"), handlers).collect()}
    assert got == {"a.ts": ["route_handler"], "b.ts": ["dynamic_exec"], "config.js": ["config_file"], "package.json": ["dep_manifest"], "c.ts": ["auth_check", "deserialize"]}


def finding(title="t", lines=(1, 5), names=("injection",), **more):
    kinds = ["entrypoint", *["propagation"] * (len(lines) - 2), "sink"][-len(lines) :]
    row = {"lane": "L", "turn": 0, "ord": 0, "finding_id": "x", "title": title, "description": "d", "confidence": 0.5}
    row |= {"trace": [{"kind": k, "file": "a", "line": n} for k, n in zip(kinds, lines)], "classes": [{"class": c, "step": len(lines) - 1} for c in names]}
    return row | more


def lane_of(*findings):
    lane = G.LaneFindings()
    return lane, [lane.fold(f) for f in findings]


def test_merge_extends_a_trace():
    first = finding(lines=(1, 5, 9))
    lane, outcomes = lane_of(first, finding(lines=(1, 9, 7, 3, 3), description="longer", confidence=0.9))
    (known,) = lane.known
    assert outcomes == ["added", "revised"] and [s["line"] for s in known["trace"]] == [1, 5, 3, 7, 9]
    assert known["trace"][0]["kind"] == "entrypoint" and known["trace"][-1]["kind"] == "sink" and known["classes"][0]["step"] == 4
    assert known["description"] == "longer" and known["confidence"] == 0.9 and len(first["trace"]) == 3


def test_a_trace_of_one_step_gets_a_sink():
    lane, _ = lane_of(finding(lines=(4,)), finding(lines=(2, 4, 9)))
    assert [(s["line"], s["kind"]) for s in lane.known[0]["trace"]] == [(4, "sink"), (2, "propagation"), (9, "sink")]


def test_merge_tells_defects_apart():
    assert lane_of(finding(), finding(lines=(1, 8), title="other"))[1][1] == "added"  # one line, another title
    assert lane_of(finding(), finding(lines=(1, 8)))[1][1] == "revised"  # one line, the same title
    assert lane_of(finding(), finding(names=("ssrf",)))[1][1] == "added"  # no class in common
    assert lane_of(finding(), finding())[1][1] == "known"
    lane, _ = lane_of(finding(), finding(lines=(1, 5), names=("injection", "ssrf")))
    assert [c["class"] for c in lane.known[0]["classes"]] == ["injection", "ssrf"]
    lane, outcomes = lane_of(finding(lines=(1, 5), title="p"), finding(lines=(2, 6, 7), title="q"), finding(lines=(1, 5, 6, 7), title="r"), finding(lines=(6, 7, 8), title="q"))
    assert outcomes == ["added", "added", "revised", "revised"]  # equal scores go to the earlier, more lines and the title to the better
    assert [[s["line"] for s in f["trace"]] for f in lane.known] == [[1, 6, 7, 5], [2, 6, 8, 7]]


def test_replay_stops_at_a_turn_without_yield(spark):
    turns = [finding(turn=0), finding(turn=1), finding(turn=2, title="late", lines=(50, 60))]
    rows = spark.createDataFrame(pd.DataFrame(turns), G.SCHEMA)
    assert G.merged(rows).count() == 1 and G.merged(rows, stop_at_zero_yield=False).count() == 2


def plain_replay(turns):
    """The rule of merging, with a scan of all known findings for each new one."""
    known, before = [], None
    for number, turn in enumerate(sorted({t["turn"] for t in turns})):
        gained = False
        for new in sorted((t for t in turns if t["turn"] == turn), key=lambda t: t["ord"]):
            lines = [s["line"] for s in new["trace"]]
            scores = []
            for i, old in enumerate(known):
                n, same = len(set(lines) & {s["line"] for s in old["trace"]}), old["title"].strip() == new["title"].strip()
                if n and (n >= 2 or same):
                    scores.append((-(2 * n + same), i))
            if not scores:
                known.append({**new, "trace": [dict(s) for s in new["trace"]], "sink": new["classes"][0]["step"]})
                gained = True
                continue
            old = known[min(scores)[1]]
            fresh = sorted(set(lines) - {s["line"] for s in old["trace"]})
            if fresh:
                gained, last = True, len(old["trace"]) - 1
                old["trace"][last if last else 1 : last if last else 1] = [{"line": line} for line in fresh]
                old["sink"] = len(old["trace"]) - 1 if old["sink"] == last else old["sink"]
            old["description"] = max(old["description"], new["description"], key=len)
            old["confidence"] = max(old["confidence"], new["confidence"])
        if number and not gained:
            break
    return sorted((f["finding_id"], f["description"], f["confidence"], tuple(s["line"] for s in f["trace"]), f["sink"]) for f in known)


def test_registered_merge_equals_a_plain_replay(spark):
    from siftlake.plans import finding_queries as Q

    folder = "/root/testdata/sf0.001"
    lanes: dict[str, list] = {}
    for row in Q.turns(spark, folder).collect():
        lanes.setdefault(row["lane"], []).append(row.asDict(recursive=True))
    got: dict[str, list] = {lane: [] for lane in lanes}
    for r in Q.trace_merge(spark, folder).collect():
        got[r["lane"]].append((r["finding_id"], r["description"], r["confidence"], tuple(s["line"] for s in r["trace"]), r["classes"][0]["step"]))
    expected = {lane: plain_replay(turns) for lane, turns in lanes.items()}
    assert {lane: sorted(found) for lane, found in got.items()} == expected
    assert {r["lane"]: (r["findings"], r["steps"]) for r in Q.loop_replay(spark, folder).collect()} == {lane: (len(f), sum(len(x[3]) for x in f)) for lane, f in expected.items()}
    assert any(len(f) < len(lanes[lane]) for lane, f in expected.items())


def test_greedy_dedup(spark):
    rows = [("a", 3, 0.5, 1, "x"), ("a", 14, 0.9, 2, "y"), ("a", 16, 0.1, 3, "z"), ("a", 17, 0.95, 4, "w"), ("b", 3, 0.1, 5, "v")]
    df = spark.createDataFrame(rows, "file string, line long, confidence double, ord long, finding_id string").repartition(3)
    assert sorted(r["finding_id"] for r in G.deduplicated(df).collect()) == ["v", "w", "z"]


def test_greedy_dedup_equals_a_plain_scan(spark):
    draw = np.random.default_rng(0)
    rows = [(f"f{int(draw.integers(0, 4))}", int(draw.integers(0, 200)), float(draw.integers(0, 9)) / 10, i, str(i)) for i in range(600)]
    kept: dict[str, list] = {}
    seen = set()
    for row in rows:
        own = kept.setdefault(row[0], [])
        if (row[0], row[1] // 15) not in seen:
            seen.add((row[0], row[1] // 15))
            own.append(row)
            continue
        for i, other in enumerate(own):
            if abs(other[1] - row[1]) <= 15:
                if row[2] > other[2]:
                    own[i] = row
                break
    df = spark.createDataFrame(rows, "file string, line long, confidence double, ord long, finding_id string").repartition(3)
    assert sorted(tuple(r) for r in G.deduplicated(df).collect()) == sorted(r for own in kept.values() for r in own)


def test_outermost_blocks(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), ("a", 10, 12), ("a", 11, 12), ("b", 1, 1)], "file string, start long, stop long")
    assert sorted(tuple(r) for r in G.outermost(df).collect()) == [("a", 1, 10), ("a", 11, 12), ("b", 1, 1)]


def test_shards_hold_their_budget(spark):
    rows = [("z", f"d{i % 4}", f"f{i}", 30 + i, i) for i in range(12)] + [("z", "big", f"g{i}", 60, 100 + i) for i in range(4)]
    got = G.packed_shards(spark.createDataFrame(rows, "zone string, dir string, path string, bytes long, ord long"), 150).collect()
    used = {}
    for r in got:
        used[r["shard"]] = used.get(r["shard"], 0) + r["bytes"]
    assert sum(used.values()) == sum(r[3] for r in rows) and all(v <= 150 for v in used.values())


def test_shards_equal_a_plain_first_fit(spark):
    draw = np.random.default_rng(1)
    rows = [(f"z{i % 3}", f"d{int(draw.integers(0, 40))}", f"f{i}", int(draw.integers(1, 90)), i) for i in range(700)]
    rows += [("z0", "wide", f"w{i}", 70, 1000 + i) for i in range(9)] + [("z1", "one", "huge", 900, 2000)]
    expected = set()
    for zone in ("z0", "z1", "z2"):
        folders: dict[str, list] = {}
        for _, folder, path, size, order in (r for r in rows if r[0] == zone):
            folders.setdefault(folder, []).append((order, path, size))
        shards: list[int] = []
        for folder, files in sorted(folders.items(), key=lambda f: (-sum(x[2] for x in f[1]), min(x[0] for x in f[1]))):
            size = sum(x[2] for x in files)
            if size > 200 and len(files) > 1:
                shards.append(0)
                for _, path, own in sorted(files):
                    if shards[-1] and shards[-1] + own > 200:
                        shards.append(0)
                    shards[-1] += own
                    expected.add((zone, len(shards) - 1, folder, path, own))
                continue
            at = next((i for i, used in enumerate(shards) if used + size <= 200), len(shards))
            shards[at:] = shards[at:] or [0]
            shards[at] += size
            expected.add((zone, at, folder, None, size))
    got = G.packed_shards(spark.createDataFrame(rows, "zone string, dir string, path string, bytes long, ord long").repartition(3), 200).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


REPORTS = [("r", 1, "a", 50, 1.0, False, None), ("r", 2, "a", 100, 2.0, True, 25), ("r", 3, "a", 120, 3.0, False, None), ("r", 4, "b", 10, 99.0, True, 3), ("r", 5, "b", 11, 100.0, False, None), ("r", 6, "zz", 10, 1.0, False, None), ("r", 7, "c", 500, 1.0, True, 1), ("r", 8, "d", 1, 1.0, False, None)]
REPORT_SCHEMA = "run string, ord long, lane_id string, tokens_used long, seconds_elapsed double, nearly_done boolean, estimated_remaining long"
PLAN = {"a": (100, 60), "b": (1000, 60), "c": (1000, 60), "d": (1000, 60)}
STOPS = ["none", "lane_token_ceiling", "lane_token_ceiling", "lane_wall_clock_ceiling", "lane_token_ceiling", "none", "global_cap", "global_cap"]


def test_budget_tracker(spark):
    got = sorted(T.track(spark.createDataFrame(REPORTS, REPORT_SCHEMA), PLAN, 600).collect(), key=lambda r: r["ord"])
    assert [r["stop"] for r in got] == STOPS
    assert [r["framing"] for r in got] == [None, "bounded_ask", "architectural_concern", "bounded_ask", "architectural_concern", None, "architectural_concern", "architectural_concern"]
    assert got[-1]["run_tokens"] == 100 + 10 + 10 + 500


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i in range(2):
        spark.createDataFrame(REPORTS[4 * i : 4 * i + 4], REPORT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(REPORT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = T.track_stream(stream, PLAN, 600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r["ord"])
    assert [r["stop"] for r in got] == STOPS


def test_adapters(spark, tmp_path):
    place = lambda uri, line: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}
    sarif = {"runs": [{"results": [{"ruleId": "R1", "message": {"text": "bad"}, "locations": [place("a.ts", 3), place("b.ts", 4)]}, {"ruleId": "R2", "message": {}, "locations": []}]}]}
    (tmp_path / "a.sarif").write_text(json.dumps(sarif))
    assert [(r["file"], r["line"], r["title"]) for r in adapters.sarif(spark, str(tmp_path / "a.sarif")).collect()] == [("a.ts", 3, "bad"), (None, None, "R2")]
    (tmp_path / "m.md").write_text("intro\n## [VULN-1] First\n- **Location**: src/a.ts:12\ntext\n## [VULN-2] Second\nsee lib/b.js:7 there\n## [VULN-3] None\n")
    assert [(r["file"], r["line"], r["title"]) for r in adapters.markdown_blocks(spark, str(tmp_path / "m.md")).collect()] == [("src/a.ts", 12, "First"), ("lib/b.js", 7, "Second"), ("", None, "None")]
    (tmp_path / "o.md").write_text("# [HIGH] Only one\n\n**File:** `src/x.ts` (lines 40, 41)\n")
    assert [tuple(r)[:3] for r in adapters.markdown_files(spark, str(tmp_path / "o.md")).collect()] == [("src/x.ts", 40, "Only one")]
    steps = [{"kind": "entrypoint", "file": "a", "line": 1}, {"kind": "sink", "file": "b", "line": 2}, {"kind": "propagation", "file": "c", "line": 3}]
    for name, doc in (("wrapped", {"candidate_findings": [{"title": "t", "verdict": "confirmed", "trace": steps}, {"title": "u", "verdict": "open"}]}), ("bare", [{"title": "t", "verdict": "confirmed", "trace": steps}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        assert [tuple(r)[:3] for r in adapters.confirmed(adapters.findings(spark, str(tmp_path / f"{name}.json"))).collect()] == [("b", 2, "t")]
    (tmp_path / "l.jsonl").write_text('{"run_id": "1", "tokens": 5, "metrics": {"recall": {"pct": 71.1}}}\n\n{"run_id": "2", "metrics": {"tokens": 6, "recall": 50.5}}\n')
    assert [(r["run_id"], r["tokens"], r["recall_pct"]) for r in adapters.ledger(spark, str(tmp_path / "l.jsonl")).orderBy("run_id").collect()] == [("1", 5, 71.1), ("2", 6, 50.5)]
    (tmp_path / "c.json").write_text(json.dumps({"lanes": [{"lane_id": "a", "tokens_used": 1}], "legacy_entries": [{"lane_id": "b", "failed": True}]}))
    assert [(r["lane_id"], r["failed"]) for r in adapters.consumption(spark, str(tmp_path / "c.json")).collect()] == [("a", False), ("b", True)]
    (tmp_path / "s.yml").write_text("servers: [{url: /v1/}]\npaths: {/a: {}, '/b/:id': {}}\n")
    pytest.importorskip("yaml")
    assert [r["doc_path"] for r in adapters.spec_paths(spark, str(tmp_path / "s.yml")).collect()] == ["/v1/a", "/v1/b/:id"]


def test_dependencies_and_imports(spark):
    manifests = spark.createDataFrame([("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}'), ("x", "broken")], "path string, content string")
    assert sorted((r["name"], r["version"]) for r in adapters.dependencies(manifests).collect()) == [("a", "1"), ("b", "2")]
    files = spark.createDataFrame([("src/app.ts", "import { f, g } from './lib/h'\nimport * as n from '../n'"), ("src/lib/h.ts", ""), ("src/lib/h/index.ts", ""), ("n.js", "")], "path string, content string")
    assert sorted((r["name"], r["file"]) for r in adapters.imports(files).collect()) == [("f", "src/lib/h.ts"), ("g", "src/lib/h.ts"), ("n", "n.js")]


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_places_of_sorted_values(spark, n):
    values_of = np.random.default_rng(n).zipf(1.4, n).clip(0, 10**6).tolist()
    df = spark.createDataFrame([(int(v),) for v in values_of], "v long").withColumnRenamed("v", "size").repartition(3)
    got = B.at_ranks(df, "size", {"a": 0.25, "b": 0.75, "c": 0.9}).collect()
    assert [tuple(r) for r in got] == [tuple(sorted(values_of)[int(n * share)] if n else None for share in (0.25, 0.75, 0.9))]


def test_guard(spark):
    paths = spark.createDataFrame([("/work/a/b/../../c.ts",), ("/work/" + "x/" * 12 + "../" * 12 + "d.ts",), ("/work/../etc/p",), ("/work/link",), ("/work/no",), ("/workshop/e",)], "path string")
    links = spark.createDataFrame([("/work/link", "/etc/passwd"), ("/work/d.ts", "/work/no")], "path string, target string")
    denied = spark.createDataFrame([("/work/no",)], "path string")
    got = {r["clean"]: r["allowed"] for r in adapters.guarded(paths, ["/work"], denied, links).collect()}
    assert got == {"/work/c.ts": True, "/work/d.ts": False, "/etc/p": False, "/work/link": False, "/work/no": False, "/workshop/e": False}
    assert tuple(adapters.blocked(adapters.guarded(paths, ["/work"], denied)).first()) == (6, 3)
    assert values(spark, [("../../a/./b//c",), ("a/..",), ("/..",)], "p string", paths_of("p")) == [("../../a/b/c",), ("",), ("/",)]


def paths_of(name):
    return paths.resolved(F.col(name))


def test_dependency_names(spark):
    rows = [("package.json", '{"dependencies": {"a": "1"}}'), ("x/y/z/package.json", '{"dependencies": {"b": "1", "a": "2"}}'), ("x/y/z/w/package.json", '{"dependencies": {"deep": "1"}}'), ("x/other.json", '{"dependencies": {"no": "1"}}')]
    assert sorted(r["name"] for r in adapters.dependency_names(spark.createDataFrame(rows, "path string, content string")).collect()) == ["a", "b"]


def test_imports_two_levels_up(spark):
    files = spark.createDataFrame([("a/b/c/d.ts", "import { q } from '../../lib/q'"), ("a/lib/q.ts", "")], "path string, content string")
    assert [(r["name"], r["file"]) for r in adapters.imports(files).collect()] == [("q", "a/lib/q.ts")]


def test_source_scan(spark, tmp_path):
    for name in ("src/a.ts", "src/node_modules/b.ts", "src/c.txt", "Dockerfile", "dist/d.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted((r["path"], r["language"]) for r in R.scan_tree(spark, str(tmp_path)).collect()) == [("Dockerfile", "docker"), ("src/a.ts", "typescript")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "lane_id string, n int")
    with pytest.raises(ValueError):
        sinks.write_run(rows, str(tmp_path), "no such", "hunt")
    sinks.write_run(rows, str(tmp_path / "runs"), "one", "hunt")
    sinks.seed_provider(spark, str(tmp_path / "runs"), "hunt", "one", "two")
    assert {r["seeded_from"] for r in spark.read.json(str(tmp_path / "runs/provider=two/stage=hunt")).collect()} == {"one"}
    for _ in range(2):
        sinks.append_ledger(rows, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 4
    sinks.write_by_lane(rows, str(tmp_path / "lanes"))
    sinks.write_by_lane(rows.where("lane_id = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "lanes"))
    assert sorted((r["lane_id"], r["n"]) for r in spark.read.json(str(tmp_path / "lanes")).collect()) == [("a", 9), ("b", 2)]
    assert sinks.markdown_table(rows.orderBy("n")).splitlines()[2] == "| a | 1 |"
