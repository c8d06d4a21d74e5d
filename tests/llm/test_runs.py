"""Run detection against all periods and starts written out."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from siftlake.llm import registry, runs

from .test_operators import table


def brute(words, least=6, times=4):
    """Every stretch and period, smallest periods alone."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(least, times * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn(seed, n=700):
    draw = np.random.default_rng(seed)
    for turn in range(n):
        words = [b"%d" % x for x in draw.integers(0, int(draw.integers(1, 5)), int(draw.integers(0, 60)))]
        if turn % 2 and len(words) > 4:
            a = int(draw.integers(0, len(words)))
            p = 1 + int(draw.integers(0, max(1, (len(words) - a) // 4)))
            words = words[:a] + (words[a : a + p] * len(words))[: len(words) - a]
            if turn % 4 == 1:
                words[int(draw.integers(0, len(words)))] = b"x"
        yield words


def test_runs_equal_brute_force():
    seen = 0
    for words in drawn(0):
        expected = brute(words)
        assert runs.runs_of_words(words) == expected
        assert runs.runs_of([int(w, 36) for w in words]) == expected  # without cutting stretches first
        seen += len(expected)
    assert seen > 300


@pytest.mark.parametrize(("least", "times"), [(2, 2), (6, 2), (5, 3), (12, 4)])
def test_other_bounds(least, times):
    for words in drawn(1, 200):
        assert runs.runs_of_words(words, least, times) == brute(words, least, times)


def test_long_stretches():
    one = [b"a"] * 50_000
    assert runs.runs_of_words(one) == [(0, 50_000, 1)]
    word = ([b"a", b"b", b"a", b"c"] * 3 + [b"d"]) * 2_000
    assert (0, 26_000, 13) in runs.runs_of_words(word)
    fib, last = ["a", "b"], ["a"]
    while len(fib) < 3_000:
        fib, last = fib + last, fib
    assert all(fib[s + q : s + n] == fib[s : s + n - q] for s, n, q in runs.runs_of_words([w.encode() for w in fib], 6, 3))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    words = ["alpha", "béta", "gamma,", "日本", "x y", "\x1c"]
    out = [(i, "\t\n ".join(draw.choice(words, int(draw.integers(0, 80)))), "s") for i in range(150)]
    out += [(i, " ".join(draw.choice(words, 6)) + " ha" * 9, "s") for i in range(150, 160)]
    return [*out, (160, None, "s"), (161, "", None), (162, "   ", "s"), (163, "go on " * 40_000, "s"), (3, out[3][1], "s"), (3, "other", "s"), (None, "no no no no no no no", "s")]


def test_query(spark, tmp_path, rows):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    expected, planted = [], 0
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        found = brute(words) if n < 1000 else [(0, n, 2)]
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        exponent = 1000 * best[1] // best[2] if found else None
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        expected.append((doc_id, len(found), *best, exponent, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(expected, key=repr) and planted > 9


def test_empty_table(spark):
    assert runs.find_runs(table(spark, []).where("false")).count() == 0
