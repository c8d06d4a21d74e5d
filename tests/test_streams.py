"""Streams that stop between write and commit, and resumption over restarts and over both shapes of a checkpoint."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql.streaming import StreamingQueryException

from siftlake.sources.adapters import consumption
from siftlake.streaming import resume, sinks

LANE = "lane_id string, ord long, tokens long"


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    """The first try of the second batch writes all of it and dies before the stream commits."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    died = []

    def start(fails):
        def put(batch, batch_id):
            sinks.write_batch(batch, batch_id, out)
            if batch_id == 1 and fails:
                died.append(batch_id)
                raise RuntimeError("stopped after the write")

        stream = spark.readStream.schema(LANE).parquet(source)
        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    arrive(spark, source, [(f"L{i}", i, 10) for i in range(5)], LANE)
    start(False).awaitTermination()
    arrive(spark, source, [(f"L{i}", i, 10) for i in range(5, 9)], LANE)
    with pytest.raises(StreamingQueryException):
        start(True).awaitTermination()
    assert died == [1] and sinks.committed(spark, out, LANE).count() == 9  # written, though not yet committed by the stream
    start(False).awaitTermination()
    rows = sinks.committed(spark, out, LANE).collect()
    assert sorted(r["lane_id"] for r in rows) == [f"L{i}" for i in range(9)] and {r["batch"] for r in rows} == {0, 1}


def test_a_batch_without_its_mark_is_passed_by(spark, tmp_path):
    out = str(tmp_path)
    rows = spark.createDataFrame([("a", 1, 1)], LANE)
    sinks.write_batch(rows, 0, out)
    sinks.write_batch(rows, 1, out)
    (tmp_path / "batch=1" / "_SUCCESS").unlink()
    assert [r["batch"] for r in sinks.committed(spark, out, LANE).collect()] == [0]
    sinks.write_batch(rows, 1, out)
    assert sinks.committed(spark, out, LANE).count() == 2
    assert sinks.committed(spark, str(tmp_path / "none"), LANE).count() == 0


def test_compaction_keeps_every_row_once(spark, tmp_path):
    out = str(tmp_path)
    for n in range(4):
        sinks.write_batch(spark.createDataFrame([(f"L{n}", n, n), ("again", n, n)], LANE), n, out)
        if n in (1, 2):
            assert sinks.compact(spark, out, LANE) == n == sinks.compact(spark, out, LANE)
    rows = sorted((r["batch"], r["lane_id"]) for r in sinks.committed(spark, out, LANE).collect())
    assert rows == sorted((n, lane) for n in range(4) for lane in (f"L{n}", "again"))
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["batch=3", "upto=2"]
    # Stopped between the compacted folder's mark and the removal of what it stands for: nothing counts twice.
    sinks.write_batch(spark.createDataFrame([("L1", 1, 1), ("again", 1, 1)], LANE), 1, out)
    assert sinks.committed(spark, out, LANE).count() == 8
    assert {r["lane_id"]: r["ord"] for r in sinks.latest(sinks.committed(spark, out, LANE)).collect()} == {"L0": 0, "L1": 1, "L2": 2, "L3": 3, "again": 3}


def test_a_folder_per_lane(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], LANE)
    sinks.write_batch(rows, 0, str(tmp_path), by="lane_id")
    assert (tmp_path / "batch=0" / "lane_id=a").is_dir()


ATTEMPT = "run string, ord long, lane_id string, failed boolean, result string"


def drawn(seed):
    draw = random.Random(seed)
    return [(f"r{draw.randrange(2)}", n, f"L{draw.randrange(40)}", draw.random() < 0.5, f"x{n}") for n in range(300)]


def plain(attempts, before=()):
    """A loop over the attempts in order."""
    done, tries, out = {(r, x) for r, x, failed in before if not failed}, {}, []
    for run, lane, _ in before:
        tries[run, lane] = tries.get((run, lane), 0) + 1
    for run, n, lane, failed, result in sorted(attempts, key=lambda a: a[1]):
        if (run, lane) in done:
            continue
        tries[run, lane] = tries.get((run, lane), 0) + 1
        if not failed:
            done.add((run, lane))
            out.append((run, n, lane, result, tries[run, lane]))
    return sorted(out)


@pytest.mark.parametrize("shape", ["none", "array", "object"])
def test_resume_over_restarts_equals_batch_and_loop(spark, tmp_path, shape):
    """Three starts of the query over one checkpoint, the state starting from an earlier run's report in either shape."""
    attempts = drawn(3)
    report = [{"lane_id": f"L{i}", "tokens_used": 1, "failed": i % 3 == 0} for i in range(0, 30, 2)]
    before, listed = None, []
    if shape != "none":
        text = report if shape == "array" else {"lanes": report[:5], "legacy_entries": report[5:]}
        (tmp_path / "consumption.json").write_text(json.dumps(text))
        before = resume.checkpointed_lanes(spark, str(tmp_path / "consumption.json"), "r0")
        listed = [("r0", r["lane_id"], r["failed"]) for r in report]
        assert sorted(map(tuple, before.collect())) == sorted(listed)
    expected = plain(attempts, listed)
    assert sorted(tuple(r) for r in resume.resume_batch(spark.createDataFrame(attempts, ATTEMPT), before).collect()) == expected
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in (attempts[:90], attempts[90:95], attempts[95:]):
        arrive(spark, source, part, ATTEMPT)
        with resume.with_rocks(spark):
            found = resume.resume_stream(spark.readStream.schema(ATTEMPT).parquet(source), before, parts=5)
            sinks.committing(found, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r)[:5] for r in sinks.committed(spark, out, resume.OUT).collect()) == expected


def test_rocks_setting_is_put_back(spark):
    before = spark.conf.get(resume.ROCKS[0], None)
    with resume.with_rocks(spark):
        assert spark.conf.get(resume.ROCKS[0]) == resume.ROCKS[1]
    assert spark.conf.get(resume.ROCKS[0], None) == before


def test_consumption_shapes(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"lane_id": "a", "failed": True}, {"lane_id": "b"}]))
    assert [(r["lane_id"], r["failed"]) for r in consumption(spark, str(tmp_path / "c.json")).orderBy("ord").collect()] == [("a", True), ("b", False)]


class Held:
    """A state variable, value or map, that counts what is asked of it."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, name, *schemas):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def called(self, out=None):
        self.calls += 1
        return out

    def get(self):
        return self.called(self.value)

    def update(self, value):
        self.value = self.called(value)

    def containsKey(self, key):  # noqa: N802
        return self.called(key in self.map)

    def getValue(self, key):  # noqa: N802
        return self.called(self.map[key])

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = self.called(value)


def test_a_batch_asks_the_state_store_once_not_for_each_attempt():
    attempts = [("r0", *a[1:]) for a in drawn(5)]
    names = ["run", "ord", "lane_id", "failed", "result"]
    before = [("r0", f"L{i}", i % 3 == 0) for i in range(0, 30, 2)] + [("r0", "L2", True)]
    held, run = Held(), resume.ResumeRun()
    run.init(held)
    run.handleInitialState(("r0", 0), pd.DataFrame(before, columns=["run", "lane_id", "failed"]), None)
    assert held.calls <= 2
    made = []
    for part in (attempts[:7], attempts[7:200], attempts[200:]):
        frames = [pd.DataFrame(part[i : i + 50], columns=names) for i in range(0, len(part), 50)]
        held.calls = 0
        made += [tuple(r) for frame in run.handleInputRows(("r0", 0), iter(frames), None) for r in frame.itertuples(index=False)]
        assert held.calls <= 2
    assert sorted(made) == plain(attempts, before)


def test_attempts_of_unknown_end_are_none(spark, tmp_path):
    """As in the batch's query and its SQL."""
    rows = [("r0", 1, "a", None, "x"), ("r0", 2, "a", True, "y"), ("r0", 3, "a", False, "z"), ("r0", 4, "b", None, "x")]
    assert [tuple(r) for r in resume.resume_batch(spark.createDataFrame(rows, ATTEMPT)).collect()] == [("r0", 3, "a", "z", 2)]
    run = resume.ResumeRun()
    run.init(Held())
    frame = pd.DataFrame(rows, columns=["run", "ord", "lane_id", "failed", "result"])
    assert [tuple(r) for out in run.handleInputRows(("r0", 0), iter([frame]), None) for r in out.itertuples(index=False)] == [("r0", 3, "a", "z", 2)]
