"""Each stage of the pipeline on a small table with nulls, ties, repeats and clashing names, against brute force."""

import collections
import re
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as P
from siftlake.llm import bpe, mixing

from .test_operators import brute_print, groups

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "body", "kept", "fp", "words", "times", "_rank"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, row string, body string, kept int, fp int, words int, times int, _rank int"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, "r", "b", 2, 3, 4, 5, 6) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    words = ["the", "house", "stands", "near", "water.", "and", "people", "walk", "slowly"]
    out = [(i, "\n".join([" ".join(draw.choice(words, 30)), "Shared line" if i % 2 else " ".join(draw.choice(words, 9))]), f"s{i % 3}") for i in range(60)]
    out += [(100 + i, out[5][1], None) for i in range(14)] + [(200, None, "s0"), (201, "", "s1"), (202, " ", None), (None, "no id", "s0"), (201, "", "s1"), (7, "another text for seven", "s1")]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, rows):
    folder = tmp_path_factory.mktemp("tables")
    junk = [(1000 + i, " | ".join(["BUY!!", "$$$", f"x{i}"] * 20), "s0") for i in range(40)]
    made(spark, rows + junk).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_stages_pass_empty_tables_and_keep_columns(spark, rows, sf_dir):
    docs = made(spark, rows)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == NAMES, name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
    assert P.STAGES[-1][1](spark, docs.where("false"), sf_dir).count() == 0


def test_quality_stage_drops_junk_and_keeps_clean(spark, rows, sf_dir):
    left = {r["doc_id"] for r in P.filter_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    assert not any(i is not None and i >= 1000 for i in left) and {i for i in range(60)} <= left


def test_line_stage_keeps_the_first(spark, rows, sf_dir):
    got = P.drop_common_lines(spark, made(spark, rows), sf_dir).collect()
    assert len(got) == len(rows)
    lines = collections.Counter(line.lower() for r in got for line in (r["text"] or "").split("\n"))
    assert lines["shared line"] == 1
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None) and sum(r["text"] is None for r in got) == 1
    assert next(r for r in got if r["doc_id"] == 5)["text"] == rows[5][1].replace("\nShared line", "") and all(r["text"] == "" for r in got if r["doc_id"] and 100 <= r["doc_id"] < 114)


def test_near_stage_keeps_one_of_each_group(spark, rows, sf_dir):
    got = sorted(((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, made(spark, rows), sf_dir).collect()), key=repr)
    prints = np.array([brute_print(t or "") for _, t, _ in rows], dtype=np.uint64)
    top = groups(len(rows), np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2))
    least = {}
    for (i, t, _), g in zip(rows, top, strict=True):
        if g not in least or (i is not None and (least[g][0] is None or i < least[g][0])):
            least[g] = (i, t)
    assert got == sorted(least.values(), key=repr)


def similarity(one, other):
    sets = []
    for text in (one, other):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("cell_bytes", [8 << 20, 20_000])
def test_near_stage_finds_planted_copies(spark, cell_bytes, monkeypatch):
    draw = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = []
    for group in range(30):
        base = draw.choice(words, 300)
        texts.append((group, " ".join(base)))
        for copy in range(40 if group == 0 else 3):  # some below the bound, most above it
            edited = base.copy()
            at = draw.choice(300, [1, 3, 5, 8, 20][(copy + group) % 5], replace=False)
            edited[at] = draw.choice(words, len(at))
            texts.append((group, " ".join(edited)))
    order = draw.permutation(len(texts))
    rows = [(int(i), texts[j][1], "s0") for i, j in enumerate(order)]
    group_of = {int(i): texts[j][0] for i, j in enumerate(order)}
    monkeypatch.setattr(P.collisions.distinct_documents, "__defaults__", (5, 80, cell_bytes))
    kept = {r["doc_id"] for r in P.drop_near_copies(spark, made(spark, rows), "").collect()}
    near = {(a, b): similarity(rows[a][1], rows[b][1]) >= 0.8 for a in group_of for b in group_of if a < b and group_of[a] == group_of[b]}
    assert sum(near.values()) > 100
    assert not [p for p, is_near in near.items() if is_near and set(p) <= kept]
    top = groups(len(rows), np.array([p for p, is_near in near.items() if is_near]))
    least = [min(i for i in group_of if top[i] == g) for g in sorted(set(top))]
    assert set(least) == kept
    alone = {i for i in group_of if not any(is_near for p, is_near in near.items() if i in p)}
    assert alone and alone <= kept


def test_mix_stage_repeats_by_target(spark, rows, sf_dir):
    docs = made(spark, rows)
    got = P.mix_sources(spark, docs, sf_dir).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    for r in got:
        taken[r["source"]] += size(r["text"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, goal in zip(order, mixing.targets([sizes[s] for s in order]), strict=True):
        assert taken[s] == pytest.approx(goal, rel=0.35)
    assert max(collections.Counter((r["doc_id"], r["text"]) for r in got).values()) <= 6


def test_mix_stage_is_close_on_many_documents(spark, sf_dir):
    """Unlike documents of three sources: every source within a twentieth of its target, none more than three times."""
    draw = np.random.default_rng(23)
    many = [(i, " ".join(f"w{i}x{j}" for j in range(int(draw.integers(1, 60)))), ["a", "b", "c"][int(draw.choice(3, p=[0.7, 0.2, 0.1]))]) for i in range(3000)]
    got = P.mix_sources(spark, made(spark, many), sf_dir).select("doc_id", "source", "text").collect()
    size = {i: len(t.split()) for i, t, _ in many}
    total = {s: sum(size[i] for i, _, own in many if own == s) for s in "abc"}
    for s, goal in zip("abc", mixing.targets(list(total.values())), strict=True):
        assert sum(size[r["doc_id"]] for r in got if r["source"] == s) == pytest.approx(goal, rel=0.05)
    assert max(collections.Counter(r["doc_id"] for r in got).values()) <= 3


def lines_without_repeats(texts, least=10):
    """Texts in order of (doc_id, hash), lines of many documents where they come first alone: what the line stage does."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holders = collections.defaultdict(set)
    for n, text in enumerate(texts):
        for line in text.split("\n"):
            holders[key(line)].add(n)
    return {k for k, n in holders.items() if k and len(n) >= least}


def test_run_stage_by_stage(spark, sf_dir, rows, monkeypatch):
    """Each stage's table, kept for the test, against what the one before it wrote."""
    monkeypatch.setattr(P.common, "removed", lambda spark, folder: None)
    found = P.run(spark, sf_dir)
    (folder,) = {file.rsplit("/", 2)[0] for file in found.inputFiles()}
    tables = {name: spark.read.parquet(f"{folder}/{name}").collect() for name, _ in P.STAGES}
    pairs = lambda table: collections.Counter((r["doc_id"], r["text"]) for r in table)
    given = pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    quality = pairs(tables["quality"])
    assert not quality - given and not any(i is not None and i >= 1000 for i, _ in quality) and all(quality[i, t] == given[i, t] for i, t in given if i is not None and i < 60)
    texts = [r["text"] or "" for r in tables["quality"]]
    common = lines_without_repeats(list(dict.fromkeys(texts)) + [t for t in texts if texts.count(t) > 1])
    assert len(tables["line_dedup"]) == len(tables["quality"])
    held = collections.Counter(line.strip().lower() for r in tables["line_dedup"] for line in (r["text"] or "").split("\n"))
    assert common and all(held[k] == 1 for k in common)
    dropped = sum(len(t.split("\n")) for t in texts) - sum(len((r["text"] or "").split("\n")) for r in tables["line_dedup"] if r["text"])
    assert dropped > 0
    before, kept = [(r["doc_id"], r["text"]) for r in tables["line_dedup"]], pairs(tables["near_dedup"])
    sets = [five(t) for _, t in before]
    near = [(i, j) for i in range(len(before)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    top, least = groups(len(before), near), {}
    for (i, t), g in zip(before, top, strict=True):
        if g not in least or (i is not None and (least[g] is None or i < least[g])):
            least[g] = i
    assert sorted((i for i, _ in kept.elements()), key=repr) == sorted(least.values(), key=repr) and not set(kept) - set(before)
    mixed = pairs(tables["mix"])
    assert set(mixed) <= set(kept) and all(n <= 3 * kept[k] for k, n in mixed.items())
    tokens = collections.Counter()
    for r in tables["pack"]:
        tokens[r["doc_id"]] += r["length"]
    encoder = bpe.load()
    assert tokens == collections.Counter({i: sum((len(encoder.encode(t or "")) + 1) * n for (j, t), n in mixed.items() if j == i) for i in {i for i, _ in mixed}})


def five(text):
    """Five-word shingles; texts without words are alike."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_run(spark, sf_dir):
    found = P.run(spark, sf_dir)
    got = found.collect()
    (folder,) = {file.rsplit("/", 2)[0] for file in found.inputFiles()}
    assert sorted(p.name for p in Path(folder.removeprefix("file:")).iterdir()) == ["pack"]  # what other stages made is gone
    assert got and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got[0].asDict())


def test_near_dedup_plans_with_sizes_that_do_not_grow_with_its_rounds(spark):
    """Chains of near copies take several rounds of components; the size guessed for what comes of them filled the driver's memory."""
    texts = [(1000 * c + i, " ".join(f"w{c}x{k}" for k in range(5 * i, 5 * i + 100)), "s") for c in range(30) for i in range(40)]
    found = P.collisions.distinct_documents(made(spark, texts))
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 400
    assert sorted(r["id"] for r in found.collect()) == [1000 * c for c in range(30)]
