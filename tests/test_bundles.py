"""Documents in a bundle against the same documents in a file each."""

import json

import pytest

from siftlake.plans import reader_queries
from siftlake.sources import adapters, bundles
from tests.test_queries import SF, pytestmark  # noqa: F401

USAGE = [{"laneId": f"l{i}", "sizeBucket": "S", "predictedTotalTokens": i, "actualTotalTokens": 2 * i} | ({"completedAt": "2026-01-01T00:00:00Z"} if i % 2 else {}) for i in range(5)]
FOUND = [{"finding_id": "f", "title": "t", "verdict": "confirmed", "trace": [{"kind": "sink", "file": "a.ts", "line": 3}]}]
LANES = [{"lane_id": "a", "failed": True}, {"lane_id": "b", "tokens_used": 4}]
MD = "# [HIGH] One\n\n**File:** `src/x.ts` (lines 4, 9)\n"
CASES = {
    "lane_usage": (adapters.lane_usage, [*map(json.dumps, USAGE[:3]), json.dumps(USAGE[3:], indent=1)]),
    "findings": (adapters.findings, [json.dumps(FOUND), json.dumps({"findings": FOUND}), json.dumps({"validated_findings": FOUND * 2})]),
    "consumption": (adapters.consumption, [json.dumps(LANES), json.dumps({"lanes": LANES, "legacy_entries": LANES[:1]})]),
    "markdown_files": (adapters.markdown_files, [MD, MD.replace(" (lines 4, 9)", ""), "no finding"]),
    "markdown_blocks": (adapters.markdown_blocks, ["# Report\n## [LOW] A\nsee a/b.js:3\n## [HIGH] B\n- **Location**: `c.ts:9`\n", "empty"]),
}


@pytest.mark.parametrize("name", CASES)
def test_a_bundle_reads_as_its_files(spark, tmp_path, name):
    read, texts = CASES[name]
    (tmp_path / "files").mkdir()
    for n, text in enumerate(texts):
        (tmp_path / "files" / f"{n}.txt").write_text(text)
    bundle = bundles.write(spark.createDataFrame([(str(n), text) for n, text in enumerate(texts)], "path string, content string"), str(tmp_path / "all.parquet"))
    found, expected = read(spark, bundle), read(spark, str(tmp_path / "files"))
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect())) != []


def test_the_name_of_a_bundle(spark, tmp_path):
    with pytest.raises(ValueError, match="ends in"):
        bundles.write(spark.createDataFrame([("a", "b")], "path string, content string"), str(tmp_path / "all"))


@pytest.mark.parametrize("name", ["lane_usage_files", "markdown_file_reports"])
def test_no_file_for_each_lane_or_finding(spark, monkeypatch, name):
    """As many documents as lanes or findings go to as many files as there are tasks."""
    written = []

    def seen(df, *folders):
        written.extend(spark.read.format("binaryFile").load(folder).count() for folder in folders)
        return df

    monkeypatch.setattr(reader_queries, "kept", seen)
    assert getattr(reader_queries, name)(spark, SF).count() > 1000
    assert 0 < written[0] < 50


@pytest.mark.parametrize("name", ["consumption_reports", "markdown_block_reports", "confirmed_reports"])
def test_reports_pass_no_python(spark, monkeypatch, name):
    def refused(*_):
        raise AssertionError("batches of whole reports in a Python process")

    monkeypatch.setattr(reader_queries.tree, "write", refused)
    assert getattr(reader_queries, name)(spark, SF).count() > 1000
