"""Groups that hold most of the rows: the same results as plain walks, and no range or task with a whole group."""

import random

import pytest
from pyspark.sql import functions as F

from siftlake.operators import findings, ranking, routes, scoring


@pytest.fixture(scope="module")
def blocks():
    """(file, start, stop): two thirds of the rows in one file, nulls, ties, repeats, ends before starts."""
    draw = random.Random(4)
    rows = []
    for file, n, reach in (("hot", 4000, 9_000), ("a", 300, 400), ("b", 40, 50), (None, 30, 40), ("one", 1, 5)):
        for _ in range(n):
            start = draw.randrange(reach)
            rows.append((file, start, start + draw.choice([-1, 0, 1, 2, 5, 40, 300])))
    return rows + rows[:50]


def grouped(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_outermost(spark, blocks):
    df = spark.createDataFrame(blocks, "file string, start long, stop long").repartition(3)
    expected = []
    for file, rows in grouped(blocks).items():
        end = None
        for _, start, stop in sorted(rows, key=lambda r: (r[1], -r[2])):
            if end is None or start > end:
                expected.append((file, start, stop))
                end = stop
    for ranges in (1, 7, 64):
        got = [tuple(r) for r in findings.outermost(df, ranges=ranges).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_step_function_of_a_range(blocks):
    """The end after a range for any end before it, against the walk."""
    rows = sorted(((s, e) for f, s, e in blocks if f == "a"), key=lambda r: (r[0], -r[1]))
    steps = findings._Steps()
    for start, stop in rows:
        steps.take({"_group": "a", "_range": 0, "start": start, "stop": stop})
    ((_, _, starts, ends),) = steps.close()
    assert len(starts) < len(rows)
    for before in range(-2, 460, 3):
        end = before
        for start, stop in rows:
            if start > end:
                end = stop
        at = next((i for i, s in enumerate(starts) if s > before), None)
        assert end == (before if at is None else ends[at])


def test_merged_spans(spark, blocks):
    spans = [(f, s, max(s, e), i) for i, (f, s, e) in enumerate(blocks)]
    df = spark.createDataFrame(spans, "file string, start long, stop long, tag long").repartition(3)
    expected = []
    for file, rows in grouped(spans).items():
        merged = []
        for _, start, stop, tag in sorted(rows, key=lambda r: r[1:]):
            if merged and start <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], stop)
                merged[-1][2].append(tag)
            else:
                merged.append([start, stop, [tag]])
        expected += [(file, s, e, ",".join(map(str, tags))) for s, e, tags in merged]
    for ranges in (1, 9, 50):
        assert sorted((tuple(r) for r in scoring.merged_spans(df, ranges=ranges).collect()), key=repr) == sorted(expected, key=repr)
    assert scoring.merged_spans(df, tags=False).columns == ["file", "start", "stop"]
    islands = scoring.span_islands(df, ranges=9).groupBy("file").agg(F.max("_island").alias("n"))
    assert {r["file"]: r["n"] for r in islands.collect()} == {f: sum(e[0] == f for e in expected) for f in grouped(spans)}


def test_numbered_and_ranges_split_the_hot_group(spark, blocks):
    df = spark.createDataFrame(blocks, "file string, start long, stop long").repartition(5)
    ranged = ranking.in_ranges(df, ["file"], ["start", "stop"], 16)
    assert max(r["count"] for r in ranged.groupBy("_range").count().collect()) < len(blocks) / 6
    got = [tuple(r) for r in ranking.numbered(df, ["file"], ["start", "stop"], ranges=16).collect()]
    expected = [(f, s, e, i + 1) for f, rows in grouped(blocks).items() for i, (_, s, e) in enumerate(sorted(rows, key=lambda r: r[1:]))]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_registered_in_numbers_a_hot_target(spark):
    rows = [(i, "src/app.ts" if i % 3 else "app.ts", "GET" if i % 5 else "USE", None if i % 2 else "auth", i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "ord long, file string, method string, auth string, line int")
    targets = spark.createDataFrame([("app.ts",), ("other.ts",)], "path string")
    got = {(r["kind"], r["rank"]): r["ord"] for r in routes.registered_in(df, targets).collect()}
    for kind in ("handler", "middleware"):
        own = sorted(((auth is not None, line, ord_) for ord_, _, method, auth, line in rows if (method == "USE") == (kind == "middleware")))
        assert [got[kind, n + 1] for n in range(len(own))] == [ord_ for _, _, ord_ in own]
    assert len(got) == 900


@pytest.fixture(scope="module")
def paths():
    """Paths of which a third are called index.ts, at several depths, and few ends of each other."""
    draw = random.Random(9)
    folder = lambda: "/".join(draw.choice(["a", "b", "c", "d", "lib", "src"]) for _ in range(draw.randrange(0, 6)))
    made = []
    for i in range(900):
        name = "index.ts" if i % 3 == 0 else f"f{draw.randrange(40)}.ts"
        made.append(f"{folder()}/{name}".lstrip("/"))
    return made


def alike(a, b):
    return a != "" and (a == b or a.endswith(f"/{b}") or b.endswith(f"/{a}"))


def test_met_files(spark, paths):
    left, right = paths[:500] + ["", "x/", "index.ts"], paths[500:] + ["", "index.ts", "x/", "y/x/"]
    one = spark.createDataFrame([(i, p) for i, p in enumerate(left)], "i long, a string")
    two = spark.createDataFrame([(j, p) for j, p in enumerate(right)], "j long, b string")
    expected = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if alike(a, b))
    for hot in (0, 20, 10_000):
        assert sorted((r["i"], r["j"]) for r in scoring.met_files(one, two, "a", "b", hot).collect()) == expected


def test_hot_basename_comes_out_of_the_join_with_matches_alone(spark):
    """A thousand different files of one name on both sides make no more rows than match."""
    one = spark.createDataFrame([(i, f"p{i}/index.ts") for i in range(1000)], "i long, a string")
    two = spark.createDataFrame([(j, f"p{j}/index.ts") for j in range(1000)], "j long, b string")
    assert scoring.met_files(one, two, "a", "b", 100).count() == 1000
    ends = one.withColumn("end", F.explode(scoring.ends_of(F.col("a"))))
    assert ends.count() == 2000 and ends.join(two, F.col("end") == F.col("b")).count() == 1000


def test_judged_pairs_do_not_depend_on_hot(spark, paths):
    draw = random.Random(1)
    steps = [(draw.randrange(60), draw.choice(["", "./", "/work/"]) + p, draw.randrange(100), draw.choice("AB")) for p in paths for _ in range(2)]
    truth = [(k, p, draw.randrange(100), [draw.choice("AB")]) for k, p in enumerate(paths[::7])]
    s = spark.createDataFrame(steps, "finding_id long, file string, line int, code string")
    t = spark.createDataFrame(truth, "key long, file string, line int, codes array<string>")
    rows = lambda hot: sorted(tuple(r) for r in scoring.judged_pairs(s, t, hot=hot).collect())
    assert rows(3) == rows(10**9) and len(rows(3)) > 100
