"""Arrow batches as Python rows, against pyarrow's own conversion."""

import pyarrow as pa

from siftlake.functions.records import parts, records
from siftlake.operators import findings as G
from siftlake.operators import loops

ROWS = [
    {"n": 1, "x": 0.5, "s": "a", "flags": [[], ["u", None]], "trace": [{"kind": "k", "line": 3}, {"kind": None, "line": None}]},
    {"n": None, "x": None, "s": None, "flags": None, "trace": None},
    {"n": 3, "x": 1.5, "s": "", "flags": [], "trace": []},
    {"n": 4, "x": 2.5, "s": "ü", "flags": [None], "trace": [None, {"kind": "z", "line": 9}]},
]
KINDS = pa.schema([("n", pa.int64()), ("x", pa.float64()), ("s", pa.string()), ("flags", pa.list_(pa.list_(pa.string()))), ("trace", pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int32())])))])


def test_records_of_slices():
    batch = pa.RecordBatch.from_pylist(ROWS, schema=KINDS)
    for size in (1, 2, 3, 9):
        assert [row for part in parts(batch, size) for row in records(part)] == ROWS
    assert records(batch.slice(2, 0)) == []


def test_lists_whose_buffers_are_empty():
    empty = pa.Array.from_buffers(pa.list_(pa.string()), 0, [None, pa.py_buffer(b"")], children=[pa.array([], pa.string())])
    assert records(pa.RecordBatch.from_arrays([empty], ["a"])) == []


def test_a_walk_holds_a_slice_of_a_batch(spark, monkeypatch):
    """Rows of long traces come in one batch; only a slice of it is Python objects at a time."""
    held = []
    monkeypatch.setattr(G, "records", lambda part: (held.append(part.num_rows), records(part))[1])
    batch = pa.RecordBatch.from_pylist([{"lane": str(n // 7), "n": n} for n in range(3000)])

    class Count:
        def __init__(self):
            self.n = 0

        def take(self, row):
            self.n += 1
            return []

        def close(self):
            return [(self.n,)]

    found = [x for b in G.Walk(["lane"], Count, pa.schema([("n", pa.int64())])).run([batch]) for x in b.column(0).to_pylist()]
    assert sum(found) == 3000 and len(found) == 429 and max(held) <= G.WALKED_ROWS


def test_totals_are_those_of_yields_and_replay(spark):
    """One walk gives what two walks gave; lanes that were not asked for and lanes without findings are told apart."""
    step = lambda *lines: [{"kind": "entrypoint", "file": "a", "line": n} for n in lines]
    rows = [(lane, turn, turn * 10 + i, f"{lane}{turn}{i}", "t", "", 0.5, step(turn + i, 1, 5), [{"class": "injection", "step": 0}]) for lane in "abx" for turn in range(3) for i in range(2)]
    findings = spark.createDataFrame(rows, G.SCHEMA)
    lanes = spark.createDataFrame([("a", ["injection", "ssrf"]), ("b", []), ("none", ["ssrf"])], "lane string, classes array<string>")
    for mode in loops.MODES:
        expected = {}
        for r in loops.yields(findings, lanes, mode, 2).collect():
            own = expected.setdefault(r["lane"], [0] * 6)
            for i, x in enumerate((1, r["emitted"], r["added"], r["revised"])):
                own[i] += x
        for r in loops.replayed(findings, lanes, mode, 2).collect():
            expected[r["lane"]][4] += 1
            expected[r["lane"]][5] += len(r["trace"])
        assert {r[0]: list(r)[1:] for r in loops.totals(findings, lanes, mode, 2).collect()} == expected
        assert set(expected) == {"a", "b", "none"}
