"""Loop modes against a plain loop over all known findings, and their calls against the estimate."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlake.functions import tables
from siftlake.operators import findings as G
from siftlake.operators import lanes as L
from siftlake.operators import loops
from siftlake.operators.budget import calls_per_chunk
from siftlake.plans import finding_queries as Q

CLASSES = list("ABCDEFG")


@pytest.fixture(scope="module")
def turns():
    draw = random.Random(6)
    out = []
    for lane in range(30):
        for turn in sorted(draw.sample(range(6), draw.randrange(1, 7))):
            for n in range(draw.randrange(1, 4)):
                lines = sorted(draw.sample(range(14), draw.randrange(1, 5)))
                trace = [{"kind": "propagation", "file": "a", "line": x} for x in lines]
                own = draw.sample(CLASSES, draw.randrange(1, 4))
                out.append({"lane": f"l{lane}", "turn": turn, "ord": n, "finding_id": f"{lane}-{turn}-{n}", "title": draw.choice(["t", "u "]), "description": "d", "confidence": 0.5, "trace": trace, "classes": [{"class": c, "step": 0} for c in own]})
    return out


@pytest.fixture(scope="module")
def frames(spark, turns):
    rows = spark.createDataFrame(pd.DataFrame(turns), G.SCHEMA).repartition(5)
    lanes = spark.createDataFrame([(f"l{i}", CLASSES[: i % 8]) for i in range(32)], "lane string, classes array<string>")
    return rows, lanes


def fold(known, new, only_new):
    """What a finding is to the known ones, by a scan of all of them."""
    best = None
    for place, old in enumerate(known):
        shared = len(old["lines"] & new["lines"])
        same = old["title"].strip() == new["title"].strip()
        if old["classes"] & new["classes"] and shared and (shared >= 2 or same) and (best is None or 2 * shared + same > best[0]):
            best = (2 * shared + same, place)
    if best is None:
        known.append({**new, "lines": set(new["lines"]), "classes": set(new["classes"])})
        return "added"
    if only_new:
        return "known"
    old = known[best[1]]
    more = not new["lines"] <= old["lines"]
    old["lines"] |= new["lines"]
    old["classes"] |= new["classes"]
    return "revised" if more else "known"


def plain(turns, classes, mode, passes, size=3):
    """Calls and findings of one lane."""
    by_turn = {}
    for t in sorted(turns, key=lambda t: (t["turn"], t["ord"])):
        by_turn.setdefault(t["turn"], []).append({"title": t["title"], "lines": {s["line"] for s in t["trace"]}, "classes": {c["class"] for c in t["classes"]}})
    known = [{**f, "lines": set(f["lines"]), "classes": set(f["classes"])} for f in by_turn.get(0, [])]
    calls = [(mode, len(known), len(known), 0)]
    groups = [classes[i : i + size] for i in range(0, len(classes), size)]
    for number in range(1, 1 + {"none": 0, "sweep": len(groups)}.get(mode, passes)):
        own, name = by_turn.get(number, []), mode
        if mode == "sweep":
            group, name = set(groups[number - 1]), f"sweep:{'+'.join(groups[number - 1])}"
            own = [{**f, "classes": f["classes"] & group} for f in own if f["classes"] & group]
        what = [fold(known, f, mode == "gap") for f in own]
        calls.append((name, len(own), what.count("added"), what.count("revised")))
        if mode != "sweep" and not {"added", "revised"} & set(what):
            break
    return calls, sorted((f["title"], tuple(sorted(f["lines"])), tuple(sorted(f["classes"]))) for f in known)


@pytest.mark.parametrize("mode", loops.MODES)
@pytest.mark.parametrize("passes", [1, 4])
def test_modes_equal_a_plain_loop(turns, frames, mode, passes):
    rows, lanes = frames
    calls, ends = {}, {}
    for r in loops.yields(rows, lanes, mode, passes).orderBy("lane", "turn").collect():
        calls.setdefault(r["lane"], []).append((r["mode"], r["emitted"], r["added"], r["revised"]))
    for r in loops.replayed(rows, lanes, mode, passes).collect():
        ends.setdefault(r["lane"], []).append((r["title"], tuple(sorted(s["line"] for s in r["trace"])), tuple(sorted(c["class"] for c in r["classes"]))))
    for i in range(32):
        expected_calls, expected_ends = plain([t for t in turns if t["lane"] == f"l{i}"], CLASSES[: i % 8], mode, passes)
        assert calls[f"l{i}"] == expected_calls and sorted(ends.get(f"l{i}", [])) == expected_ends
    most = {r["lane"]: r["n"] for r in lanes.select("lane", calls_per_chunk(mode, F.size("classes"), passes, 3).alias("n")).collect()}
    exact = mode in ("none", "sweep")
    assert all(len(c) == most[lane] if exact else len(c) <= most[lane] for lane, c in calls.items())


def test_gap_may_revise_if_asked(frames):
    rows, lanes = frames
    strict, loose = (loops.yields(rows, lanes, "gap", 4, gap_revises=g).agg(F.sum("revised")).first()[0] for g in (False, True))
    assert strict == 0 and loose == loops.yields(rows, lanes, "reflect", 4).agg(F.sum("revised")).first()[0] > 0


def test_unknown_modes_are_refused(frames):
    with pytest.raises(ValueError):
        loops.replayed(*frames, "sweeping")
    with pytest.raises(ValueError):
        loops.replayed(*frames, "trace", passes=0)


def test_table_functions_equal_the_dataframe_forms(spark, frames):
    rows, _ = frames
    tables.register(spark)
    for given in (rows, Q.turns(spark, "/root/testdata/sf0.001")):
        named = lambda df: sorted((tuple(r[n] for n in ("lane", "finding_id", "description")), [s["line"] for s in r["trace"]]) for r in df.collect())
        assert named(spark.sql("SELECT * FROM merge_findings(TABLE({t}))", t=given)) == named(G.merged(given))
    files = spark.createDataFrame([(f"f{i}", n) for i, n in enumerate([0, 1, 19, 20, 21, 35, 36, 5000, None])], "path string, lines int")
    got = spark.sql("SELECT * FROM chunk_plan(TABLE({t}), 'lines', 20, 5)", t=files)
    plan = lambda df: sorted(tuple(r) for r in df.where("lines IS NOT NULL").select("path", "index", "start_line", "end_line").collect())
    assert plan(got) == plan(L.chunks(files, 20, 5)) and got.where("lines IS NULL").first()["end_line"] == 0
    for wrong in ("chunk_plan(TABLE({t}), 'no_such')", "chunk_plan(TABLE({t}), 'lines', 5, 5)", "merge_findings(TABLE({t}))"):
        with pytest.raises(Exception, match="no column|overlap"):
            spark.sql(f"SELECT * FROM {wrong}", t=files).collect()
