"""The mix of sources against targets, schedule and blocks written out one slot and one word at a time."""

import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import mixing

from .test_operators import table

PHI = 0x9E3779B97F4A7C15


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, cap):
    """Weights 1, 2, 3 repeating; who is above the cap stands at it, and the rest shares what is left."""
    capped = set()
    while True:
        left = sum(sizes) - sum(cap * sizes[i] for i in capped)
        weight = {i: 1 + i % 3 for i in range(len(sizes)) if i not in capped}
        share = {i: Fraction(left * w, sum(weight.values())) for i, w in weight.items()}
        over = {i for i, s in share.items() if s > cap * sizes[i]}
        if not over:
            return [float(cap * sizes[i] if i in capped else share[i]) for i in range(len(sizes))]
        capped |= over


def plain_taken(rows, place, cap=3, block_words=1024, least_slots=256):
    """taken of each row number."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: [n for n, row in enumerate(rows) if row[2] == s] for s in sources}
    goal = dict(zip(sources, plain_targets([sum(words(rows[n][1]) for n in own[s]) for s in sources], cap), strict=True))
    block, stream = {}, {}
    for s in sources:
        block[s] = max(1, min(block_words, int(goal[s]) // least_slots))
        chunks = -(-len(own[s]) // 1024)
        order = sorted((n for n in own[s] if words(rows[n][1])), key=lambda n: (place[n] % chunks, place[n]))
        stream[s] = [n for n in order for _ in range(words(rows[n][1]))]  # the row of each word
    share = [goal[s] / block[s] for s in sources]
    ends = np.cumsum(np.array(share) / sum(share))
    times = {s: {} for s in sources}
    ranks = dict.fromkeys(sources, 0)
    for slot in range(round(sum(share))):
        point = slot * PHI % 2**64 / 2**64
        s = sources[min(int(np.searchsorted(ends[:-1], point, side="right")), len(sources) - 1)]
        n_blocks = -(-len(stream[s]) // block[s])
        if n_blocks and ranks[s] < cap * n_blocks:
            times[s][ranks[s] % n_blocks] = times[s].get(ranks[s] % n_blocks, 0) + 1
        ranks[s] += 1
    taken = [0] * len(rows)
    for s in sources:
        for at, n in enumerate(stream[s]):
            taken[n] += times[s].get(at // block[s], 0)
    return taken, goal


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(17)
    out = [(i, " ".join(["w"] * int(draw.integers(0, 400))), ["a", "b", "c", "d", None][int(draw.choice(5, p=[0.55, 0.2, 0.15, 0.05, 0.05]))]) for i in range(2500)]
    return [*out, (9000, None, "a"), (9001, "", "lone"), (9002, "x y", "tiny"), (None, "no id", "b"), (9003, "long " * 60_000, "d")]


@pytest.mark.parametrize("max_sources", [100_000, 2])
def test_taken_equals_the_schedule_written_out(spark, rows, max_sources):
    df = table(spark, rows)
    hashed = mixing.sized_documents(df).select("doc_id", F.xxhash64("doc_id", "size", "body", F.lit("mix")).alias("place")).collect()
    of_id = {r["doc_id"]: r["place"] for r in hashed}
    taken, goal = plain_taken(rows, [of_id[i] for i, _, _ in rows])
    got = {r["doc_id"]: r for r in mixing.mix(df, max_sources=max_sources).collect()}
    assert len(got) == len(rows)
    for (doc_id, text, source), expected in zip(rows, taken, strict=True):
        row = got[doc_id]
        assert (row["size"], row["taken"]) == (words(text), expected), doc_id
        assert row["target"] == pytest.approx(goal[source]) and row["taken"] <= 3 * row["size"]
    for source, target in goal.items():
        assert sum(t for t, row in zip(taken, rows, strict=True) if row[2] == source) == pytest.approx(target, rel=0.02, abs=2)
