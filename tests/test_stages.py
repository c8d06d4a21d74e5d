"""Gates, provenance, prompts in UTF-16 units, follow-up turns, and readers of ground truth and usage."""

import json

import pytest
from pyspark.sql import functions as F

from siftlake import dims
from siftlake.functions.text import utf16_units
from siftlake.operators import budget, coverage, findings, recon
from siftlake.sources import adapters, gates, sinks


def coded(spark, yes, no):
    rows = [(i, ["A01"]) for i in range(yes)] + [(yes + i, [] if i % 2 else None) for i in range(no)]
    return spark.createDataFrame(rows, "id int, codes array<string>").repartition(3)


def test_a_run_below_the_floor_fails_and_is_refused(spark, tmp_path):
    root, holds = str(tmp_path), gates.has_code(F.col("codes"))
    gates.write_stage(coded(spark, 95, 5), root, "one", "hunt", holds=holds)
    assert gates.read_stage(spark, root, "one", "hunt").count() == 100
    with pytest.raises(gates.GateError, match="94 of 100"):
        gates.write_stage(coded(spark, 94, 6), root, "one", "hunt", holds=holds)
    with pytest.raises(gates.GateError, match="failed: only 94 of 100"):
        gates.read_stage(spark, root, "one", "hunt")
    gates.write_stage(coded(spark, 10, 0), root, "one", "hunt", holds=holds)
    assert gates.read_stage(spark, root, "one", "hunt").count() == 10
    with pytest.raises(gates.GateError, match="no rows"):
        gates.write_stage(coded(spark, 0, 0), root, "one", "hunt", holds=holds)
    meta = spark.read.schema(gates.META).json(gates.meta_path(root, "one", "hunt")).orderBy("written_at").collect()
    assert [(r["exit_code"], r["rows"], r["held"]) for r in meta] == [(0, 100, 95), (1, None, None), (0, 10, 10), (1, None, None)]


def test_foreign_failed_and_missing_provenance(spark, tmp_path):
    root = str(tmp_path)
    gates.write_stage(coded(spark, 3, 0), root, "one", "recon")
    sinks.seed_provider(spark, root, "recon", "one", "two")
    with pytest.warns(UserWarning, match="no provenance"):
        assert gates.read_stage(spark, root, "two", "recon").count() == 3
    spark.read.schema(gates.META).json(gates.meta_path(root, "one", "recon")).write.json(gates.meta_path(root, "two", "recon"))
    with pytest.raises(gates.GateError, match="made by 'one'"):
        gates.read_stage(spark, root, "two", "recon")
    broken = coded(spark, 3, 0).withColumn("x", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        gates.write_stage(broken, root, "three", "recon")
    with pytest.raises(gates.GateError, match="the write failed"):
        gates.assert_upstream(spark, root, "three", "recon")
    with pytest.raises(ValueError, match="unknown provider"):
        gates.write_stage(coded(spark, 3, 0), root, "no such", "recon")


def test_rows_are_counted_in_the_one_pass_that_writes_them(spark):
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    rows = coded(spark, 40, 0).mapInArrow(seen, "id int, codes array<string>")
    assert gates.passed(rows, gates.has_code(F.col("codes")), lambda df: df.write.format("noop").mode("overwrite").save()) == (40, 40)
    assert passes.value == 40


TEXTS = ["plain", "", "two 😀 units", "𝔘nicode 日本 é", "😀😀", "é"]


def test_utf16_units(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", utf16_units(F.col("t")).alias("n")).collect()
    assert all(r["n"] == len(r["t"].encode("utf-16-be")) // 2 for r in rows)


def test_segments_cut_the_prompt_back_into_its_parts(spark):
    rows = [(f"p{i}", 1, 1 + i % 3, ["injection", "ssrf"], t) for i, t in enumerate(TEXTS)]
    made = coverage.prompts(spark.createDataFrame(rows, "path string, index int, total int, classes array<string>, source string"))
    assert all(r["reconciled"] for r in made.collect())
    cut = {}
    for r in coverage.segment_table(made, "path").orderBy("path", "start").collect():
        units = made.where(F.col("path") == r["path"]).first()["prompt"].encode("utf-16-be")[2 * r["start"] : 2 * (r["start"] + r["chars"])]
        assert units.decode("utf-16-be") == r["text"]
        cut.setdefault(r["path"], []).append((r["kind"], r["text"]))
    for path, _, total, _, source in rows:
        parts = [("task", f"File: {path}\n"), ("chunk", f"Chunk 1 of {total}\n" if total > 1 else ""), ("classes", "injection, ssrf\n"), ("source", source)]
        assert cut[path] == [p for p in parts if p[1]]


def test_follow_up_turns(spark):
    lanes = spark.createDataFrame([("a", ["injection", "ssrf"]), ("b", ["ssrf"]), ("c", [])], "lane string, classes array<string>")
    rows = [("a", 2, "second", [("sink", "f", 9), ("sink", "f", 4)], [("injection", 0)]), ("a", 1, " first ", [("sink", "f", 7)], [("injection", 0)]), ("b", 1, None, [("sink", "f", 1)], [("ssrf", 0)])]
    found = spark.createDataFrame(rows, "lane string, ord long, title string, trace array<struct<kind: string, file: string, line: int>>, classes array<struct<class: string, step: int>>")
    text = {mode: {r["lane"]: r["prompt"] for r in coverage.follow_ups(lanes, found, mode).collect()} for mode in ("trace", "gap", "reflect")}
    assert "- first [injection] lines 7\n- second [injection] lines 4, 9\n\n1. " in text["gap"]["a"] and "Start with those that no finding carries: ssrf." in text["gap"]["a"]
    assert "Start with" not in text["gap"]["b"] and "(nothing)" in text["gap"]["c"] and text["gap"]["a"].endswith(coverage.ONLY_NEW)
    assert coverage.GAP_JOB[:20] not in text["trace"]["a"] and f"1. {coverage.TRACE_JOB}\n2. " in text["reflect"]["a"] and text["trace"]["a"].endswith(coverage.RESTATE)
    with pytest.raises(ValueError):
        coverage.follow_ups(lanes, found, "sweep")


def test_playbooks_cover_every_class(spark):
    assert set(coverage.PLAYBOOKS) == set(dims.CLASS_CODES)
    lanes = spark.createDataFrame([(["ssrf", "injection"],), ([],)], "classes array<string>")
    assert [r["playbook"] for r in coverage.with_playbooks(lanes).collect()] == [f"{coverage.PLAYBOOKS['injection']}\n\n{coverage.PLAYBOOKS['ssrf']}", ""]


def test_ground_truth_in_both_shapes(spark, tmp_path):
    entries = [{"challengeKey": "k1", "file": "a.ts", "line": 3, "owasp_codes": ["A01", "API1"]}, {"challengeKey": "k2", "file": "b.ts", "line": None, "category": "A03"}]
    (tmp_path / "truth.json").write_text(json.dumps({"entries": entries}, indent=1))
    assert sorted(tuple(r) for r in adapters.ground_truth(spark, str(tmp_path / "truth.json")).collect()) == [("k1", "a.ts", 3, ["A01", "API1"]), ("k2", "b.ts", None, ["A03"])]


def test_lane_usage_of_a_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"lane-{i}.json").write_text(json.dumps({"laneId": f"l{i}", "sizeBucket": "S", "predictedTotalTokens": 10 * i, "actualTotalTokens": 9 * i} | ({"completedAt": "2026-01-01T00:00:00Z"} if i else {})))
    rows = adapters.lane_usage(spark, str(tmp_path)).orderBy("lane_id").collect()
    assert [(r["lane_id"], r["predicted"], r["actual"], r["completed"]) for r in rows] == [("l0", 0, 0, False), ("l1", 10, 9, True), ("l2", 20, 18, True)]


def test_older_validation_and_walk(spark):
    step = lambda *kinds: [(k, "a", i) for i, k in enumerate(kinds)]
    rows = spark.createDataFrame([(1, step("entrypoint", "sink")), (2, step("sink")), (3, []), (4, None), (5, step("entrypoint"))], f"id int, trace {findings.TRACE}")
    got = {r["id"]: (r["drop_reason"], r["categories"]) for r in findings.validated_traces(rows, F.array(F.lit("A01"))).collect()}
    assert got == {1: (None, ["A01"]), 2: ("no entrypoint first", None), 3: ("empty trace", None), 4: ("empty trace", None), 5: ("no sink last", None)}
    files = spark.createDataFrame([(p,) for p in ("a.CPP", "x/.env", ".env.prod", "Dockerfile", "b.md", "c", "d.svelte")], "path string")
    assert sorted(r["path"] for r in recon.legacy_sources(files).collect()) == [".env.prod", "Dockerfile", "a.CPP", "d.svelte", "x/.env"]


def test_estimates(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 499, 500, 501, 980, 981, 5000)], "n long")
    size = F.lit(100).cast("long")
    got = {r["n"]: (r["c"], r["b"]) for r in rows.select("n", budget.estimated_chunks(F.col("n")).alias("c"), budget.estimated_seed_bytes(size, F.col("n")).alias("b")).collect()}
    for n, (chunks, seed) in got.items():
        expected = 1 if n <= 500 else -(-(n - 500) // 480) + 1
        full = 500 * 46 + 10
        last = max(1, n - (expected - 2) * 480 - 20) * 46 + 10
        assert (chunks, seed) == (expected, 0 if n <= 0 else 100 + 6 * n + 10 if expected == 1 else (expected - 1) * full + last)
