"""Every registered query of the training-data operators on a written table, all columns against brute force."""

import collections
import hashlib
import io
import re
import wave
import zlib

import duckdb
import numpy as np
import pytest

from siftlake.llm import bpe, fingerprint, media, mixing, pii, quality, registry, repeats

from .test_operators import BASE, brute_cut, brute_print, brute_spans, groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(21)
    words = ["alpha", "béta", "gamma,", "delta.", "Epsilon", "zeta", "+1 (234) 555-6789", "a.b@c.example", "10.0.0.255", "4111 1111 1111 1111", "password=hunter2222", "日本"]
    out = []
    for i in range(40):
        lines = [" ".join(draw.choice(words, int(draw.integers(0, 30)))) for _ in range(int(draw.integers(1, 6)))]
        out.append((int(i * 7 + 3), "\n".join([*lines, "  Common Line  " if i % 3 == 0 else f"other {i}"]), f"s{i % 3}"))
    out += [(500 + i, out[4][1], None) for i in range(12)] + [(600, None, "s0"), (601, "", None), (602, "BUY!! $$$ | " * 40, "s1"), (603, "word and more " * 3_000, "s1")]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, rows):
    folder = tmp_path_factory.mktemp("registered")
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(len(t or "") % 5 > 1), 0) for i, t, _ in rows] + [(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def found(spark, sf_dir, name):
    return {r["doc_id"]: r.asDict(recursive=True) for r in registry.QUERIES[name](spark, sf_dir).collect()}


def plain_sample(sampler, terms, k):
    """The formula for one sample, a term at a time."""
    best = None
    for term, weight in collections.Counter(terms.tolist()).items():
        i, j = term & int(sampler.rows), term >> 20 & int(sampler.rows)
        r, b = sampler.r[j, k], sampler.b[j, k]
        t = np.floor(np.float32(np.log(weight)) / r + b) if weight > 1 else np.float32(0)
        a = sampler.log_c[i, k] - r * (t - b + 1)
        if best is None or a < best[0]:
            best = (a, term, int(t))
    return best


def test_op1(spark, sf_dir, rows):
    got, sampler = found(spark, sf_dir, "op1_weighted_fingerprints"), fingerprint.WeightedSampler()
    order = sorted(rows, reverse=True)
    prints = {}
    for (doc_id, text, _), (after_id, after, _) in zip(order, order[1:] + order[:1], strict=True):
        text, after, row = text or "", after or "", got[doc_id]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"] and len(row["fingerprint"]) == 4 * fingerprint.SAMPLES
        cut = lambda s: [s[i : i + 4] for i in range(0, len(s), 4)]
        alike = lambda a, b: np.mean([x == y for x, y in zip(cut(a), cut(b), strict=True)])
        assert row["near_edited"] == pytest.approx(alike(row["fingerprint"], row["edited_fingerprint"])) and row["near_next"] == pytest.approx(alike(row["fingerprint"], got[after_id]["fingerprint"]))
        assert row["edited_fingerprint"] == sampler.fingerprint(fingerprint.shingle_hashes(edited)).tobytes().hex()
    assert len(got) == len(rows)
    for text in [t for _, t, _ in rows if t][:8] + ["a b a b a b a b a b a b"]:
        terms = fingerprint.shingle_hashes(text)
        made = sampler.fingerprint(terms)
        for k in range(0, fingerprint.SAMPLES, 9):
            _, term, t = plain_sample(sampler, terms, k)
            code = fingerprint.mixed(np.array([term], dtype=np.uint64) + np.uint64(t) * np.uint64(fingerprint._BASE))[0] >> np.uint64(48)
            assert int(made[k]) == int(code)


def test_op1_cuts_ties_by_hash(spark):
    rows = [(None, f"text {i} of none", "s") for i in range(400)] + [(i % 3, f"text {i} of three", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = [r["count"] for r in fingerprint.in_ranges(df, 12).where("spare = 0").groupBy("range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 150
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), repeats.tag_of(r[1].encode())))
    expected = collections.Counter()
    for (doc_id, text, _), (_, after, _) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        expected[(doc_id, hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.neighbour_fingerprints(df, ranges=12).collect()) == expected


def test_op2(spark, sf_dir, rows):
    """Against means, covariances and log densities written out."""
    got = found(spark, sf_dir, "op2_quality_scores")
    x = {i: quality.statistics(t or "") for i, t, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    pairs = {(i, int(len(t or "") % 5 > 1)) for i, t, _ in rows} | {(3, 1)}
    members = {k: np.array([x[i] for i, label in sorted(pairs) if label == k and not held[i]]) for k in (0, 1)}
    n = sum(map(len, members.values()))
    covs = {k: np.cov(m.T, bias=True) for k, m in members.items()}
    pooled = sum(len(members[k]) / n * covs[k] for k in (0, 1))
    density = {}
    for k, m in members.items():
        cov = 0.9 * covs[k] + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
        inverse, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        density[k] = {i: np.log(len(m) / n) - 0.5 * logdet - 0.5 * (v - m.mean(axis=0)) @ inverse @ (v - m.mean(axis=0)) for i, v in x.items()}
    for i, row in got.items():
        score = 1 / (1 + np.exp(np.clip(density[0][i] - density[1][i], -500, 500)))
        assert row["held_out"] == held[i] and row["score"] == pytest.approx(score, abs=1e-6) and row["predicted"] == int(row["score"] >= 0.5)
    assert len(got) == len(rows)


def test_op3(spark, sf_dir, rows):
    got = found(spark, sf_dir, "op3_mixed_sources")
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, s in rows:
        assert got[i]["size"] == len(WORD.findall(t or "")) and got[i]["taken"] <= 3 * got[i]["size"]
        sizes[s] += got[i]["size"]
        taken[s] += got[i]["taken"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    for i, _, s in rows:
        assert got[i]["source_size"] == sizes[s] and got[i]["target"] == pytest.approx(goal[s])
    assert all(taken[s] == pytest.approx(goal[s], rel=0.05) for s in order)


def test_op4(spark, sf_dir, rows):
    got = found(spark, sf_dir, "op4_personal_data")
    for i, t, _ in rows:
        spans = brute_spans(t or "")
        row = got[i]
        assert all(row[f"n_{kind}"] == sum(s[0] == kind for s in spans) for kind in BASE)
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        every = [s.split(":") for s in row["spans"].split(",") if s]
        assert every == sorted(every, key=lambda s: (int(s[1]), pii.KINDS.index(s[0]))) and [(k, int(a), int(b)) for k, a, b in every if k in BASE] == spans
        assert row["n_secret"] == (t or "").count("password=hunter2222") == sum(s[0] == "secret" for s in every)


def plain_pairs(payload):
    """The fingerprint, frame by frame with a loop."""
    window = np.hanning(media.FRAME).astype(np.float32)
    samples = np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128
    peaks = []
    for frame, at in enumerate(range(0, len(samples) - media.FRAME + 1, media.HOP)):
        power = np.abs(np.fft.rfft(samples[at : at + media.FRAME] * window)).astype(np.float32)
        tops = [(power[b], b) for b in range(1, len(power) - 1) if power[b] > power[b - 1] and power[b] >= power[b + 1] and power[b] > 1.0]
        peaks += [(frame, b) for b in sorted(b for _, b in sorted(tops)[-2:])]
    pairs = [(t, b << 14 | c << 7 | u - t) for i, (t, b) in enumerate(peaks) for u, c in peaks[i + 1 : i + 4] if u - t <= media.MAX_GAP]
    return sorted(pairs)


def test_op5(spark, sf_dir, rows):
    got = found(spark, sf_dir, "op5_media_columns")
    for i, t, _ in rows:
        data, row = (t or "").encode(), got[i]
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        out = io.BytesIO()
        with wave.open(out, "wb") as sound:
            sound.setparams((1, 1, 8000, len(payload), "NONE", "not compressed"))
            sound.writeframes(payload)
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (row["media_bytes"], row["media_sha256"]) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        pairs = list(zip(row["peak_times"], row["peak_codes"], strict=True))
        assert row["n_peak_pairs"] == len(pairs)
        if len(payload) < 10_000:
            assert pairs == plain_pairs(payload)
        joined = lambda values: ",".join(map(str, values))
        assert row["feature"] == f"{len(pairs)}:{hashlib.md5(f'{joined(row["peak_times"])};{joined(row["peak_codes"])}'.encode()).hexdigest()}"


def test_op6(spark, sf_dir, rows):
    got = found(spark, sf_dir, "op6_simhash_components")
    prints = np.array([brute_print(t or "") for _, t, _ in rows], dtype=np.uint64)
    top = groups(len(rows), np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2))
    for at, (i, _, _) in enumerate(rows):
        assert got[i]["fingerprint"] == f"{int(prints[at]):016x}" and got[i]["component_id"] == min(rows[j][0] for j in range(len(rows)) if top[j] == top[at])


def test_op7(spark, sf_dir, rows):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    expected = con.sql(registry.ORACLE_SQL["op7_line_dedup"])
    got = found(spark, sf_dir, "op7_line_dedup")
    assert sorted(expected.fetchall()) == sorted(tuple(r[c] for c in expected.columns) for r in got.values()) and sum(r["n_dropped"] for r in got.values()) > 12


def test_op8(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    got = collections.defaultdict(dict)
    for r in registry.QUERIES["op8_token_counts"](spark, sf_dir).collect():
        got[r["doc_id"]][r["section"]] = r
    for i, t, _ in rows:
        text = t or ""
        made = whole.encode(text, add_special_tokens=False)
        count, crossing = collections.Counter(), collections.Counter()
        for a, b in made.offsets:
            line = text[:a].count("\n")
            count[line] += 1
            crossing[line] += "\n" in text[a : b - 1]
        lines = text.split("\n")[: len(text.split("\n")) - (text.endswith("\n"))] or [""]
        assert len(got[i]) == len(lines)
        at = 0
        for n, line in enumerate(lines):
            r = got[i][n]
            stop = min(at + len(line.encode()) + 1, len(text.encode()))
            assert (r["start_byte"], r["end_byte"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]) == (at, stop, count[n], crossing[n], len(made.ids))
            at = stop


def test_op9(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in registry.QUERIES["op9_pack_sequences"](spark, sf_dir).collect():
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    for i, t, _ in rows:
        ids, at = [*whole.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part.tobytes()), len(ids))
            at += r["length"]
        assert at == len(ids)
    for held in windows.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [0, *np.cumsum([r["length"] for r in held]).tolist()[:-1]] and sum(r["length"] for r in held) <= 2048


def test_op10(spark, sf_dir, rows):
    got = found(spark, sf_dir, "op10_repeated_strings")
    assert sorted(((i, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()), key=repr) == brute_cut([(i, t) for i, t, _ in rows], 100)
    seen = set()
    for i, t, _ in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, dtype=np.int8)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = 1
            seen.add(data[s : s + 100])
        assert got[i]["n_spans"] == int((np.diff(gone, prepend=0) == 1).sum())
