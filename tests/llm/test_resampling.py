"""Importance resampling, whitening and substring dedup against brute-force versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ALNUM, SPACE, docs, empty, frame, lower, odd, odd_texts, ordered  # noqa: F401

from tidemark.llm import crc, importance, recompression, shared, substring_dedup, whitening

# shared ----------------------------------------------------------------------------------------------------------


def test_rows_are_numbered_and_dealt(spark, monkeypatch):
    monkeypatch.setattr(shared, "STEP_COPIES", 4)
    table = spark.range(50).select(F.col("id").alias("k"), (F.col("id") % 11 + 1).alias("copies"), F.lit("x").alias("step"))
    dealt = shared.each_copy(table, "copies", "copy").collect()
    assert Counter((r.k, r.copy) for r in dealt) == Counter((k, c) for k in range(50) for c in range(k % 11 + 1))
    plain = sorted(r.i for r in shared.numbered(table.repartition(7), "i").collect())
    assert plain == list(range(50))
    at = 0
    for r in sorted(shared.numbered(table.repartition(7), "i", "copies").collect(), key=lambda r: r.i):
        assert r.i == at
        at += r.copies


# 11 --------------------------------------------------------------------------------------------------------------


def test_crc_of_spans_and_of_joined_spans():
    r = np.random.default_rng(1)
    raw = r.integers(0, 256, 4000).astype(np.uint8)
    start = np.sort(r.integers(0, 3800, 200))
    end = start + r.integers(0, 3 * crc.IN_STEP, 200)
    own = crc.from_zero(raw, start, end)
    states = crc.advance(np.full(200, crc.INIT), end - start) ^ own
    assert [int(x ^ crc.INIT) for x in states] == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    both = crc.joined(states[:-1], own[1:], (end - start)[1:], 0x20)
    parts = [raw[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    assert [int(x ^ crc.INIT) for x in both] == [zlib.crc32(a + b" " + b) for a, b in zip(parts, parts[1:], strict=False)]


def brute_draw(rows, target):
    def features(text):
        w = ALNUM.findall(lower(text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    own = [(key, *features(text)) for key, text in rows]
    s, t = Counter(bucket(x) for *_, f in own for x in f), Counter(bucket(x) for text in target for x in features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    scored = []
    for key, n, f in own:
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    ranked = [(*x[:4], i + 1 if i < 5 * len(able) // 100 else None) for i, x in enumerate(able)]
    return ranked + [(*x[:4], None) for x in scored if x[4] < 20]


def test_resampling_documents(spark, docs, data):  # noqa: F811
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in benchmark.collect()])
    got = importance.resample(docs, benchmark)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert ordered(got.collect()) == ordered(want)


def test_resampling_odd_rows(spark, odd, empty, monkeypatch):  # noqa: F811
    target = frame(spark, [(1, odd_texts()[9][1]), (2, None), (3, "x " * 40)])
    many = [*odd_texts(), *[(5, odd_texts()[9][1])] * 40, *[(None, "w " * 25)] * 30, (77, "long" * 30_000 + " w" * 30)]
    for block in (1 << 20, 3):
        monkeypatch.setattr(importance, "BLOCK", block)
        for rows in (odd_texts(), many):
            got = importance.resample(frame(spark, rows).repartition(7), target)
            assert ordered(got.collect()) == ordered(brute_draw(rows, [r.text for r in target.collect()]))
    assert ordered(importance.resample(odd, empty).collect()) == ordered(brute_draw(odd_texts(), []))
    assert importance.resample(empty, target).count() == 0
    few = importance.resample(frame(spark, [(1, "a b c")]), target).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in few] == [(1, 6, None)]


@pytest.mark.parametrize("kind", ["random", "ascending", "equal", "copies"])
def test_cutoff_key_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(importance, "BLOCK", 40)
    r = random.Random(5)
    rows = [(r.randint(-50, 50) if kind == "random" else 7 if kind == "equal" else i, i % 5 == 0, 0 if i % 5 == 0 else i, i % 3, r.randint(1, 2000) if kind == "copies" else 1) for i in range(600)]
    table = spark.createDataFrame([(a, int(b), c, d, e) for a, b, c, d, e in rows], "minus_score long, no_id long, id long, n_features long, copies long").repartition(5)
    order = sorted((importance.Key(a, int(b), c, d), e) for a, b, c, d, e in rows)
    total = sum(e for _, e in order)
    for wanted in (1, 2, total // 20, total // 2, total):
        at = 0
        for key, copies in order:
            at += copies
            if at >= wanted:
                break
        assert importance.select_key(table, wanted) == key


def test_a_pivot_discards_a_quarter():
    r = np.random.default_rng(3)
    blocks = [np.stack([r.integers(0, 1000, n) + 3000 * (n % 2), np.zeros(n, np.int64), r.integers(0, 9, n), np.zeros(n, np.int64)], axis=1) for n in (400, 31, 7, 1, 250)]
    medians = [importance._weighted_median(b, np.ones(len(b), np.int64)) for b in blocks]
    pivot, size = importance._weighted_median(np.array([m for m, _ in medians]), np.array([s for _, s in medians]))
    earlier, equal = importance._before(np.concatenate(blocks), pivot)
    assert (earlier | equal).sum() * 4 >= size and (~earlier).sum() * 4 >= size


# 12 --------------------------------------------------------------------------------------------------------------


def brute_whitening(rows, components=16):
    sound = [(key, [math.floor(64 * float(c)) + 1000000 for c in v]) for key, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centre = lambda x: np.array((n * np.array(x, object) - sums) / n, float)
    v = centre(fit).T @ centre(fit) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return n, e / e.sum(), [(key, int(((n * np.array(x, object) - sums) ** 2).sum()), centre(x) @ u[:, :components] / np.sqrt(e[:components])) for key, x in sound]


def same_whitening(frame_, rows, components=16):
    got = {}
    for r in frame_.collect():
        got.setdefault((r.vec_id is None, r.vec_id, r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained, r.n, r.identity_error))
    n, explained, want = brute_whitening(rows, components)
    size = min(components, len(explained))
    assert Counter((k[1], k[2]) for k, v in got.items() for _ in v[1]) == Counter((k, d) for k, d, _ in want)
    of = {(k is None, k, d): w for k, d, w in want}
    keys = list(got)
    a = np.array([[got[k][c][0][0] for c in range(1, size + 1)] for k in keys])
    b = np.array([of[k][:size] for k in keys])
    assert np.abs(a * np.sign((a * b).sum(axis=0)) - b).max() < 1e-7
    for values in got.values():
        for c, copies in values.items():
            assert len({x[0] for x in copies}) == 1
            assert all(abs(x[1] / explained[c - 1] - 1) < 1e-9 and x[2] == n and x[3] < 1e-9 for x in copies)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, index long, id long, x string, row long"


def embeddings(spark, rows):
    return spark.createDataFrame([(k, v, 1, 2, 3, "x", 4) for k, v in rows], EMBEDDINGS).repartition(5)


def test_whitening_table(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    same_whitening(whitening.whiten(table), [(r.vec_id, r.embedding) for r in table.collect()])


def test_whitening_odd_rows(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=5) * [1, 2, 3, 4, 50])]) for i in range(60)]
    rows += [rows[3]] * 30 + [(None, rows[4][1]), (90, rows[5][1]), (91, None), (92, [1.0, None, 0.0, 0.0, 0.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [])]
    kept = [x for x in rows if x[0] not in (95, 96)]
    for height in (1 << 10, 4):
        monkeypatch.setattr(whitening, "TILE_ROWS", height)
        same_whitening(whitening.whiten(embeddings(spark, rows)), kept)
        same_whitening(whitening.whiten(embeddings(spark, rows), 2), kept, 2)
    none = embeddings(spark, [])
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(none).dtypes == whitening.whiten(embeddings(spark, rows)).dtypes
    assert whitening.whiten(embeddings(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    line = whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, 4.0])])).collect()
    assert sorted((x.vec_id, x.component, x.n, round(abs(x.whitened), 9), x.deviation) for x in line) == [(1, 1, 2, 1.0, 64**2 + 128**2), (2, 1, 2, 1.0, 64**2 + 128**2), (3, 1, 2, 1.0, 64**2 + 128**2)]
    wide = whitening.whiten(embeddings(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {x.vec_id for x in wide} == {1, 2, 3} and any(x.deviation is None for x in wide)


# 13 --------------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    words = [SPACE.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        rest = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return out


def test_substring_dedup_documents(docs):  # noqa: F811
    got = substring_dedup.remove_repeats(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")]
    assert ordered(got.collect()) == ordered(brute_repeats([(r.doc_id, r.text) for r in docs.collect()]))


def repeats():
    """Passages shared at several offsets, runs, periods, overlaps with themselves, and windows that reach both ends."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    fill = lambda n: [word() for _ in range(n)]
    passages = [fill(35), fill(34), fill(60), ["ha"] * 80, ["ho", "hi"] * 40, ["la", "la", "lo"] * 20]
    texts = []
    for p in passages:
        texts += [p, fill(20) + p + fill(3), p + fill(9), fill(7) + p, fill(5) + p + fill(2) + p, p[5:] + fill(30), [x.upper() for x in p]]
    texts += [["a"] * 35, ["a"] * 36, ["b"] * 34, fill(3000) + passages[2] + fill(2000), fill(34), ["x" * 5000] * 40]
    return [(i, r.choice([" ", "\n", " \t "]).join(t)) for i, t in enumerate(texts)]


def test_substring_dedup_odd_rows(spark, odd, empty):  # noqa: F811
    rows = [*odd_texts(), *((1000 + i, t) for i, t in repeats())]
    assert ordered(substring_dedup.remove_repeats(frame(spark, rows).repartition(7)).collect()) == ordered(brute_repeats(rows))
    assert ordered(substring_dedup.remove_repeats(odd).collect()) == ordered(brute_repeats(odd_texts()))
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("rounds", [((6, 1),), ((1, 1), (2, 1), (5, 2))])
def test_rounds_never_strike_a_repeated_window(spark, monkeypatch, rounds):
    monkeypatch.setattr(substring_dedup, "ROUNDS", rounds)
    assert ordered(substring_dedup.remove_repeats(frame(spark, repeats())).collect()) == ordered(brute_repeats(repeats()))


def test_a_symbol_stands_wherever_its_context_does():
    r = np.random.default_rng(4)
    names = r.integers(1, 5, 4000).astype(np.uint64)
    offsets = np.array([0, 1000, 1000, 1001, 4000])
    for rounds in (1, 2, 4):
        p = recompression.parse(names, offsets, rounds)
        after = np.append(p.start[1:], len(names))
        inside = (p.low >= offsets[p.row]) & (p.high <= offsets[p.row + 1]) & (p.high - p.low <= 40)
        found = {}
        for i in np.flatnonzero(inside):
            context = names[p.low[i] : p.high[i]].tobytes()
            found.setdefault((context, p.start[i] - p.low[i]), set()).add((int(p.name[i]), int(after[i] - p.start[i])))
        assert all(len(x) == 1 for x in found.values())
        # and a name stands for one sequence of words
        spelled = {}
        for i in range(len(p.name)):
            spelled.setdefault(int(p.name[i]), set()).add(names[p.start[i] : after[i]].tobytes())
        assert all(len(x) == 1 for x in spelled.values())
        assert len(p.name) < len(names)
