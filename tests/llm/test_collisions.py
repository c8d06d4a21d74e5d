"""The inverted join of signature coordinates against all pairs of full sets."""

import re

import numpy as np
import pytest

from siftlake.llm import collisions, components, registry

from .test_operators import groups, table


def full_set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def expected(rows, width=3, percent=85):
    sets = [full_set(text, width) for _, text, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = groups(len(rows), links)
    out = []
    for at, (doc_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[at]]
        component = doc_id if not sets[at] else min([i for i in ids if i is not None], default=None)
        out.append((doc_id, len(sets[at]), component, doc_id == component))
    return sorted(out, key=repr), len(links)


@pytest.fixture(scope="module")
def rows():
    """Families of texts with more and more words changed, so that links run in chains, and a passage that many hold."""
    draw = np.random.default_rng(12)
    word = lambda: "".join(draw.choice(list("abcdefghiklmnoprstuvé"), 6))
    passage = [word() for _ in range(60)]
    out = []
    for family in range(12):
        base = [word() for _ in range(int(draw.integers(40, 160)))]
        for _ in range(14):
            words = list(base)
            for at in draw.integers(0, len(words), int(draw.integers(0, 6))):
                words[at] = word()
            out.append(" ".join(words))
        for step in range(6):  # a chain: each one like the next, the ends not
            base = [*base[max(1, len(base) // 20) :], *[word() for _ in range(max(1, len(base) // 20))]]
            out.append(" \n".join(base).upper() if step % 2 else " ".join(base))
    out += [" ".join([*passage, *[word() for _ in range(30)]]) for _ in range(60)]
    out += ["one two", "ONE  two", "one two three", "one", "", "  ", None, "", "same words again " * 3_000]
    ids = draw.permutation(len(out)).tolist()
    made = [(int(i), text, "s") for i, text in zip(ids, out, strict=True)]
    return [*made, *[(900 + i, out[5], "s") for i in range(40)], (901, out[5], "s"), (902, "another text of that id", "s"), (None, out[7], "s"), (None, "no id at all here", "s")]


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query(spark, tmp_path, rows):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    made, links = expected(rows)
    assert links > 500 and found(registry.QUERIES["op12_near_components"](spark, str(tmp_path))) == made


@pytest.mark.parametrize("cell_bytes", [3_000, 30_000])
def test_crowds_larger_than_a_cell(spark, rows, cell_bytes):
    assert found(collisions.near_components(table(spark, rows), cell_bytes=cell_bytes)) == expected(rows)[0]


def test_other_widths(spark, rows):
    assert found(collisions.near_components(table(spark, rows), width=5, percent=80)) == expected(rows, 5, 80)[0]


def test_cells_return_fewer_links_than_nodes():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, draw.integers(0, 400, 12)), draw.integers(0, 2**63, 6).astype(np.uint64)])) for _ in range(300)]
    crowd = collisions.Crowd(np.array([collisions.signature(s) for s in sets]), sets, 85, collisions.least_matches(85))
    links = [(x, y) for x in range(300) for y in crowd.joined(x, np.arange(300))]
    assert len(links) == 300 - len(set(crowd.group.tolist())) and len(set(crowd.group.tolist())) < 5


def test_threshold():
    draw = np.random.default_rng(2)
    assert collisions.least_matches(85) == 38
    for _ in range(300):
        core, own, other = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (850, 75, 75))
        one, two = np.unique(np.concatenate([core, own])), np.unique(np.concatenate([core, other]))
        assert (collisions.signature(one) == collisions.signature(two)).sum() >= 38


def test_guessed_size_stays_small_over_the_rounds_of_components(spark):
    """The size that Spark guesses for a join of joins of earlier rounds has thousands of digits, and filled the driver's memory."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    found = components.roots(edges)
    assert found.select("root").distinct().count() == 1 and found.count() == 401
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40


def test_empty_table(spark):
    assert collisions.near_components(table(spark, []).where("false")).count() == 0
