"""Token alignment against whole-text encoding by both libraries and loops over all links."""

import collections
import hashlib

import numpy as np
import pytest

from siftlake.llm import alignment, bpe, registry

from .test_operators import table


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(8)
    words = ["alpha", "béta", "gamma,", "delta's", "  ", "\n", "\n ", " \n", "\t", "日本", "x_y", "12345", "<s>", "<|endoftext|>", "a b", " ", "\x1c", "é", "🙂", "'ll", "...", "　", "\x00"]
    out = [(i, " ".join(draw.choice(words, int(draw.integers(0, 60)))), "s") for i in range(120)]
    out += [(200 + i, "".join(draw.choice(words, 30)), "s") for i in range(30)]
    out += [(300, None, "s"), (301, "", None), (302, " ", "s"), (303, "     ", "s"), (304, "a ▁ b", "s"), (305, "▁", "s"), (306, "end  ", "s"), (307, "the cat " * 20_000, "s"), (308, "x" * 5_000, "s")]
    return [*out, *[(400 + i, out[3][1], "s") for i in range(20)], (3, out[3][1], "s"), (None, "no id here", "s")]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))


def byte_level():
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def plain(text, sides):
    """Ids of both sides and the links as places in them; None without tokens."""
    if not text:
        return None
    whole, pieces = sides
    chars, target = byte_level(), f" {text}".encode()
    a = whole.encode(f" {text}", add_special_tokens=False)
    b = pieces.encode(text)
    bytes_a = [bytes(chars[c] for c in token) for token in a.tokens]
    names = [pieces.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") else n.replace("▁", " ").encode() for n in names]
    if b"".join(bytes_a) != target or b"".join(bytes_b) != target:
        return None
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    at_a = {end: i for i, end in enumerate(ends(bytes_a))}
    links = [(at_a[end], j) for j, end in enumerate(ends(bytes_b)) if end in at_a]
    return a.ids, b, links


def expected(rows, sides):
    made = [(doc_id, plain(text, sides)) for doc_id, text, _ in rows]
    count = collections.Counter((a[i], b[j]) for _, found in made if found for a, b, links in [found] for i, j in links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, found in made:
        if not found:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links = found
        counts = [(count[a[i], b[j]], b[j]) for i, j in links]
        groups, x, y = [], 0, 0
        for i, j in links:
            groups.append(f"{','.join(map(str, a[x : i + 1]))}|{','.join(map(str, b[y : j + 1]))}")
            x, y = i + 1, j + 1
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(n == best[k] for n, k in counts), sum(n for n, _ in counts), digest))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query(spark, tmp_path, rows, sides):
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert tuple(got.columns) == NAMES
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, sides)


def test_small_cells_and_whole_texts_give_the_same(spark, rows, sides, monkeypatch):
    docs = table(spark, rows, parts=7)
    got = alignment.align(docs, with_groups=True, groups=3, cell=50).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=repr) == expected(rows, sides)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_links"])
    aligner = alignment.Aligner()
    assert aligner._cuts
    for cuts in (True, False):
        aligner.forget()
        aligner._cuts = cuts
        for _, text, _ in rows[:60]:
            found = plain(text, sides)
            if found:
                own = np.array(aligner.numbers([text])[0])
                assert (aligner.n_a[own].sum(), aligner.n_b[own].sum(), aligner.links[own].sum()) == (len(found[0]), len(found[1]), len(found[2]))
    monkeypatch.setattr(alignment, "KEPT", 5)
    assert sorted((tuple(r[n] for n in NAMES) for r in alignment.align(docs).collect()), key=repr) == expected(rows, sides)


def test_hot_ids_are_split():
    held = {0: 9_000_000, **{i: 1_000 for i in range(1, 2_000)}}
    cells = alignment.dealt(held, 32, 1_000_000)
    assert len(cells) == len(held) and max(n for _, _, n in cells) == 9
    load = collections.Counter()
    for b, first, n in cells:
        for c in range(first, first + n):
            load[c] += held[b] / n
    assert max(load.values()) <= 1_000_000


def test_empty_table(spark):
    assert alignment.align(table(spark, []).where("false")).count() == 0
