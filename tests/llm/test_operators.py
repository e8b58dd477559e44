"""Each operator against a brute-force version, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import (
    components, decontaminate, hashing, jaccard_join, language_model, license_scan, media, progressive_jpeg, quality_classifier, sentence_pieces, sharding, token_counts, url_filter,
)

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, hash string, k int, score double, key long, _node string, _id long, _key long, _one boolean, _rep long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, pattern=SPACE):
    w = pattern.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def frame(spark, texts):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, None, f"s{i % 3}" if i and i % 5 else None, None, -1, "x", "y", 1, 0.5, 66, "z", 77, 88, True, 99) for i, t in texts], SCHEMA)


def odd_texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    base = [word() for _ in range(60)]
    texts = [None, "", "   \n\t", "one", "One", "two words", "a b c d e", "a b c d e f", " ".join(base), " ".join(base)]
    for _ in range(25):
        own = list(base)
        for _ in range(r.randint(1, 4)):
            own[r.randrange(60)] = word()
        texts.append(" ".join(own).upper() if r.random() < 0.3 else "  ".join(own))
    shared = " ".join(word() for _ in range(55))
    texts += [" ".join(word() for _ in range(r.randint(20, 90))) + " " + shared for _ in range(12)]
    texts.append(" ".join(word() for _ in range(20000)))
    rows = list(enumerate(texts))
    return [*rows, rows[8], rows[8], (None, texts[9]), (None, None), (None, "lonely null id")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_texts()).repartition(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def brute_components(rows):
    """Smallest id reachable over links, by row; rows are nodes."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                parent[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(find(i), []).append(key)
    return [(key, len(sets[i]), key if not sets[i] else min((x for x in least[find(i)] if x is not None), default=None)) for i, (key, _) in enumerate(rows)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


# 1 ---------------------------------------------------------------------------------------------------------------


def test_jaccard_join_odd_rows(odd):
    assert ordered(jaccard_join.jaccard_components(odd).collect()) == ordered(brute_components(odd_texts()))


def test_jaccard_join_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ordered(jaccard_join.jaccard_components(docs).collect()) == ordered(brute_components(rows))


def test_jaccard_join_chain_through_unlinked_hub(spark):
    """A family in which neighbours link but the ends don't must become one component."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(12)]
    assert ordered(jaccard_join.jaccard_components(frame(spark, rows)).collect()) == ordered(brute_components(rows))


def near_copies(n, size=70, seed=5):
    """Copies of one text with words exchanged, so that many pairs lie on either side of 0.75."""
    r = random.Random(seed)
    base, rows = [f"w{i}" for i in range(size)], []
    for i in range(n):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4])):
            own[r.randrange(size)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [6])
def test_jaccard_join_large_family(spark, seed, monkeypatch):
    """Components are whole, and the pairs whose sets are compared grow in proportion to the rows."""
    compared, overlaps = [], jaccard_join._overlaps

    def counting(pairs, sets):
        compared.append(pairs.count())
        return overlaps(pairs, sets)

    monkeypatch.setattr(jaccard_join, "_overlaps", counting)
    sums = []
    for n in (300, 600):
        compared.clear()
        rows = near_copies(n, seed=seed)
        assert ordered(jaccard_join.jaccard_components(frame(spark, rows)).collect()) == ordered(brute_components(rows))
        sums.append(sum(compared))
    assert sums[0] <= 3 * 300 and sums[1] <= 3 * 600


def test_equal_hash_of_a_polynomial_is_told_apart():
    """Thue-Morse words and their complements, which every polynomial modulo 2^64 confuses."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    raw = np.frombuffer((one + " " + other).encode(), np.uint8)
    hashed = hashing.words(raw, np.array([0, len(raw)]))[0]
    assert len(set(hashed.tolist())) == 2


def test_distinct_spans_compare_bytes(monkeypatch):
    """Spans of one hash but different bytes stay apart."""
    r = np.random.default_rng(1)
    raw = r.integers(97, 99, 4000).astype(np.uint8)
    cuts = np.unique(np.concatenate([[0, 4000], r.integers(0, 4000, 700)]))
    monkeypatch.setattr(hashing, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64) & np.uint64(3))
    example, same = hashing.distinct_spans(raw, cuts[:-1], cuts[1:])
    text = raw.tobytes()
    spans = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert all(spans[example[same[i]]] == x for i, x in enumerate(spans))


def test_deduplicate_keeps_one_of_each(odd, empty):
    rows = odd_texts()
    want = {}
    for (key, n, component), (_, text) in zip(brute_components(rows), rows, strict=True):
        if n:
            want.setdefault(component if component is not None else text, component)
    kept = jaccard_join.deduplicate(odd)
    assert kept.columns == odd.columns
    assert {tuple(r)[5:] for r in kept.collect()} == {tuple(r)[5:] for r in odd.collect()}
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert ordered((k,) for k, t in texts if shingle_set(t)) == ordered((v,) for v in want.values())
    assert sum(not shingle_set(t) for _, t in texts) == sum(not shingle_set(t) for _, t in rows)
    assert jaccard_join.deduplicate(empty).count() == 0


def test_components_of_a_path_and_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components.connected_components(links.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def test_quality_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality_classifier.score_quality(docs, quality_classifier.train(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert scored.count() == docs.count()


def test_quality_classifier_odd_rows(spark, odd, empty, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    network = quality_classifier.train(docs, labels)
    got = quality_classifier.score_quality(odd, network).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 8}) == 1
    assert quality_classifier.score_quality(empty, network).count() == 0
    alone = quality_classifier.train(docs, labels.where("quality = 1"))
    assert quality_classifier.score_quality(odd, alone).where("predicted = 1").count() == len(got)
    nothing = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score_quality(odd, nothing).collect()} == {0.5}
    kept = quality_classifier.keep_quality(odd, network)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in got)


def plain_score(network, text):
    """The forward pass window by window and chunk by chunk, in doubles."""
    w = {k: v.astype(np.float64) for k, v in network.weights.items()}
    cuts = [0]
    while cuts[-1] + quality_classifier.CHUNK < len(text):
        cuts.append(cuts[-1] + quality_classifier.STRIDE)
    hidden = []
    for a in cuts:
        symbols = [b + 1 for b in text[a : a + quality_classifier.CHUNK]]
        symbols += [0] * (quality_classifier.CHUNK - len(symbols))
        best = np.full(quality_classifier.FILTERS, -np.inf)
        for i in range(0, quality_classifier.CHUNK - quality_classifier.WIDTH + 1, quality_classifier.STEP):
            window = np.concatenate([w["embed"][s] for s in symbols[i : i + quality_classifier.WIDTH]])
            best = np.maximum(best, window @ w["filter"])
        hidden.append(np.maximum(np.maximum(best + w["filter_bias"], 0) @ w["dense"] + w["dense_bias"], 0))
    both = np.concatenate([np.mean(hidden, 0), np.max(hidden, 0)])
    return 1 / (1 + math.exp(-(both @ w["out"] + w["out_bias"][0] + network.bias_shift)))


def test_classifier_scores_match_a_plain_forward_pass(spark):
    random_ = random.Random(2)
    texts = ["", "a", "short text", "é" * 700, "x" * 1024, "y" * 1025, "".join(random_.choice("abc de") for _ in range(3000)), None]
    network = quality_classifier.Network.fresh(7)
    network.bias_shift = 0.25
    got = {r.doc_id: r for r in quality_classifier.score_quality(frame(spark, enumerate(texts)), network).collect()}
    for i, text in enumerate(texts):
        assert math.isclose(got[i].score, plain_score(network, (text or "").encode()), rel_tol=1e-4)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == (got[i].score >= 0.3)


def test_classifier_fits_whole_texts(spark, monkeypatch):
    """A mark at the end of long texts is learned, and a sample holds whole texts of so many bytes together."""
    plain = "".join(random.Random(1).choice("abcdefgh ") for _ in range(30_000))
    rows = [(i, plain[i:] + (" GOOD GOOD GOOD" if i % 2 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    network = quality_classifier.train(frame(spark, rows), labels)
    scores = {r.doc_id: r.score for r in quality_classifier.score_quality(frame(spark, rows), network).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > max(scores[i] for i in range(0, 60, 2))
    seen = []
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 200_000)
    monkeypatch.setattr(quality_classifier, "fit", lambda texts, given, *_: seen.append((texts, given)))
    quality_classifier.train(frame(spark, rows), labels)
    (texts, given), whole = seen[0], {t.encode() for _, t in rows}
    assert set(texts) <= whole and all(0 < sum(len(t) for t, g in zip(texts, given, strict=True) if g == v) <= 200_000 for v in (0, 1))


def test_classifier_gradient_is_the_same_in_groups(monkeypatch):
    network, r = quality_classifier.Network.fresh(1), np.random.default_rng(3)
    raw, offsets = r.integers(0, 256, 40_000).astype(np.uint8), np.array([0, 30_000, 30_000, 30_500, 40_000])
    whole = network.gradients(raw, offsets, np.array([1.0, 0.0, 1.0, 0.0]))
    monkeypatch.setattr(quality_classifier, "TOGETHER", 3)
    for k, g in network.gradients(raw, offsets, np.array([1.0, 0.0, 1.0, 0.0])).items():
        assert np.allclose(g, whole[k], atol=1e-6)


def test_classifier_takes_one_text_an_id(spark):
    """Repeated documents of an id give the same network whatever their order."""
    rows = [(i, ("good words here " if i % 2 else "BAD JUNK!! ") * (1 + i % 7)) for i in range(40)] + [(i, f"other {i}") for i in range(10)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one = quality_classifier.train(frame(spark, rows), labels)
    other = quality_classifier.train(frame(spark, rows[::-1]).repartition(5), labels)
    assert all(np.array_equal(one.weights[k], other.weights[k]) for k in one.weights)


def test_classifier_scores_a_row_alike_in_any_company():
    random = np.random.default_rng(4)
    texts = [random.integers(0, 256, n, np.uint8).tobytes() for n in [0, 1, 11, 700, 1024, 1025, 5000, 20_000, 40] * 4]
    network = quality_classifier.Network.fresh(3)

    def score(some):
        return network.score(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))

    together, order = score(texts), random.permutation(len(texts))
    assert (np.concatenate([score([t]) for t in texts]) == together).all()
    assert (score([texts[i] for i in order]) == together[order]).all()


def test_classifier_gradient_matches_differences():
    network = quality_classifier.Network.fresh(1)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    texts, labels = [b"some text " * 150, b"JUNK!! " * 30, b""], np.array([1.0, 0.0, 1.0])
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def loss():
        p = network.score(raw, offsets)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    gradients, random_ = network.gradients(raw, offsets, labels), np.random.default_rng(0)
    for name, g in gradients.items():
        flat, at = network.weights[name].reshape(-1), int(random_.choice(np.flatnonzero(np.abs(g.reshape(-1)) > 1e-4)))
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert math.isclose((up - down) / 2e-5, g.reshape(-1)[at], rel_tol=2e-2, abs_tol=1e-5)


# 3 ---------------------------------------------------------------------------------------------------------------


def brute_lm(rows, mixtures=None):
    tokens = {i: [*SPACE.findall(lower(t or "")), "</s>"] for i, (_, t) in enumerate(rows)}
    fold = [None if k is None else zlib.crc32(str(k).encode()) % 5 for k, _ in rows]
    train = [i for i, f in enumerate(fold) if f is not None and f != 1]
    main = [i for i in train if fold[i] != 2]

    def count(ids):
        one, two = Counter(), Counter()
        for i in ids:
            one.update(tokens[i])
            two.update(zip(["<s>", *tokens[i]], tokens[i]))
        one["<s>"] = len(ids)
        return one, two

    def ratios(ids, one, two):
        n = sum(v for k, v in one.items() if k != "<s>")
        types = len(train_one) - 1
        for i in ids:
            for v, w in zip(["<s>", *tokens[i]], tokens[i]):
                base = (one[w] + 0.5) / (n + 0.5 * (types + 1))
                yield i, one[v], two[v, w] / one[v] if one[v] else 0.0, one[w] / n if n else 0.0, base, one[w]

    train_one, train_two = count(train)
    if mixtures is None:
        data = [(one.bit_length() if one else 0, 1.0, a / base, b / base) for _, one, a, b, base, _ in ratios([i for i in train if fold[i] == 2], *count(main))]
        mixtures = language_model.learn_mixtures(data)
    out = {i: [0, 0, 0.0, 0.0] for i in tokens}
    for i, one, a, b, base, known in ratios(tokens, train_one, train_two):
        mix = mixtures[one.bit_length() if one else 0]
        out[i][0] += 1
        out[i][1] += known > 0
        out[i][2] += math.log10(base)
        out[i][3] += math.log10(mix[0] * a + mix[1] * b + mix[2] * base)
    n = sum(v for k, v in train_one.items() if k != "<s>")
    return [(k, fold[i] == 1, out[i][0], out[i][1], n, out[i][2], out[i][3]) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("small", [False, True])
def test_lm_scoring(spark, docs, odd, small, monkeypatch):
    if small:  # many chunks and buckets
        monkeypatch.setattr(language_model, "CHUNK_BYTES", 5000)
        monkeypatch.setattr(language_model, "BUCKET_KEYS", 500)
    table, rows = (odd, odd_texts()) if small else (docs, [(r.doc_id, r.text) for r in docs.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[2])
    got = sorted(map(tuple, language_model.score_documents(table).collect()), key=key)
    want = sorted(brute_lm(rows), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=2e-3)  # the mixtures come from binned ratios


@pytest.mark.parametrize("arity", [2, 3])
def test_lm_scoring_through_groups(spark, odd, arity, monkeypatch):
    """Several levels of groups, and rows so often repeated that they are counted first."""
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 9000)
    monkeypatch.setattr(language_model, "BUCKET_KEYS", 200)
    monkeypatch.setattr(language_model, "ARITY", arity)
    monkeypatch.setattr(language_model, "REPEATS", 5)
    again = [(None, "again and again"), (12, "again and once more"), (None, None)] * 9
    key = lambda r: (r[0] is None, r[0] or 0, r[5], r[2])
    got = sorted(map(tuple, language_model.score_documents(odd.union(frame(spark, again))).collect()), key=key)
    for a, b in zip(got, sorted(brute_lm(odd_texts() + again), key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=2e-3)


def test_lm_beats_base_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_model.score_documents(docs).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert r[1] > r[0] + 0.3 * r[2]


def test_lm_mixture_is_a_distribution():
    mixtures = language_model.learn_mixtures([(0, 5.0, 0.0, 1.0), (3, 10.0, 40.0, 1.2), (3, 2.0, 0.0, 0.9), (9, 1.0, 0.0, 0.0)])
    assert np.allclose(mixtures.sum(1), 1) and (mixtures >= 0).all() and (mixtures[:, 2] > 0).all()
    assert mixtures[3][0] > 0.5 and mixtures[0][0] == 0


def test_lm_empty_and_untrained(spark, empty):
    assert language_model.score_documents(empty).count() == 0
    r = language_model.score_documents(frame(spark, [(None, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# 4 ---------------------------------------------------------------------------------------------------------------


def test_media_digests(odd, empty):
    rows = {(r.doc_id, r.payload_sha256): r for r in media.media_digests(odd).collect()}
    for key, text in odd_texts():
        payload = media.padded((text or "").encode())
        r = rows[key, hashlib.sha256(payload).hexdigest()]
        stored = progressive_jpeg.encode(payload)
        assert len(payload) % 576 == 0 and len(payload) > 0
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len((text or "").encode()), len(payload), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert progressive_jpeg.payload(progressive_jpeg.decode(stored)) == payload
    assert media.media_digests(empty).count() == 0


def plain_pixels(image):
    """RGB of a decoded file by the transform's definition, each chroma sample repeated, colours in doubles."""
    x = np.arange(8)
    wave = np.where(x == 0, math.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * x[None, :] + 1) * x[:, None] * math.pi / 16)
    planes, tall, wide = [], max(c.v for c in image.components.values()), max(c.h for c in image.components.values())
    for c in image.components.values():
        rows, columns, _ = c.coefficients.shape
        natural = np.zeros((rows, columns, 64))
        natural[..., progressive_jpeg.ZIGZAG] = c.coefficients * image.quantisers[c.table]
        blocks = np.einsum("rcuv,ux,vy->rxcy", natural.reshape(rows, columns, 8, 8), wave, wave).reshape(rows * 8, columns * 8)
        samples = np.clip(np.floor(blocks + 128.5), 0, 255)
        planes.append(np.kron(samples, np.ones((tall // c.v, wide // c.h)))[: image.height, : image.width])
    y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], axis=-1)
    return np.clip(np.floor(rgb + 0.5), 0, 255)


def test_media_round_trip_and_tensor(spark, odd):
    stored = media.store_media(odd)
    r = media.read_media(stored.where("doc_id = 5")).first()
    assert len(r.tensor) == r.width * r.height * 3 and r.payload == media.padded(odd_texts()[5][1].encode())
    pixels = plain_pixels(progressive_jpeg.decode(r.media))
    got = np.frombuffer(r.tensor, np.uint8).reshape(r.height, r.width, 3)
    assert np.abs(got.astype(int) - pixels).max() <= 2
    digest = media.media_digests(odd.where("doc_id = 5")).first().feature
    mean = [int(got[..., c].astype(int).sum()) * 1000 // (r.width * r.height) for c in range(3)]
    full = [sum(v in (0, 255) for v in got[..., c].ravel().tolist()) * 1000 // (r.width * r.height) for c in range(3)]
    assert digest == f"{r.width}x{r.height} mean {','.join(map(str, mean))} saturated {','.join(map(str, full))}"
    assert media.read_media(stored.limit(1).withColumn("media", F.lit(None).cast("binary"))).first().tensor is None


@pytest.mark.parametrize("size", [0, 1, 377, 378, 379, 5000, 378 * 33000])
def test_jpeg_payload_sizes(size):
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    assert progressive_jpeg.payload(progressive_jpeg.decode(progressive_jpeg.encode(data))) == data


class Writer:
    """A plain progressive encoder of one-component images, with fixed 8-bit codes for the symbols in use."""

    def __init__(self, symbols):
        self.codes, self.bits = {s: i for i, s in enumerate(symbols)}, []

    def symbol(self, s):
        self.put(self.codes[s], 8)

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.bits = []
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def first_scan(w, blocks, low):
    for b in blocks:
        run, values = 0, [int(np.sign(c)) * (abs(int(c)) >> low) for c in b[1:]]
        last = max((i for i, v in enumerate(values) if v), default=-1)
        for v in values[: last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            w.symbol(run << 4 | abs(v).bit_length())
            w.signed(v)
            run = 0
        if last < 62:
            w.symbol(0x00)


def refine_scan(w, blocks, low):
    for b in blocks:
        sizes = [abs(int(c)) >> low for c in b[1:]]
        last = max((i for i, s in enumerate(sizes) if s == 1), default=-1)
        run, held = 0, []
        for i, s in enumerate(sizes):
            if s == 0:
                run += 1
                continue
            while run > 15 and i <= last:
                w.symbol(0xF0)
                w.bits += held
                run, held = run - 16, []
            if s > 1:
                held.append(s & 1)
                continue
            w.symbol(run << 4 | 1)
            w.bits.append(int(b[1 + i] > 0))
            w.bits += held
            run, held = 0, []
        if run or held:
            w.symbol(0x00)
            w.bits += held


@pytest.mark.parametrize("interval", [0, 2])
def test_jpeg_general_scans(interval):
    random_ = np.random.default_rng(4)
    blocks = np.where(random_.random((6, 64)) < 0.25, random_.integers(-90, 90, (6, 64)), 0)
    blocks[2, 1:] = 0
    symbols = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 9) if (r, s) != (15, 0))][:255]
    seg = progressive_jpeg._segment
    tables = [seg(0xC4, bytes([t, 0, 0, 0, 0, 0, 0, 0, len(symbols), 0, 0, 0, 0, 0, 0, 0, 0, *symbols])) for t in (0x00, 0x10)]
    dc = [0, *range(1, 9)]
    tables[0] = seg(0xC4, bytes([0x00, 0, 0, 0, 0, 0, 0, 0, len(dc), 0, 0, 0, 0, 0, 0, 0, 0, *dc]))
    restart = seg(0xDD, interval.to_bytes(2, "big")) if interval else b""
    out = [b"\xff\xd8", seg(0xDB, b"\x00" + b"\x02" * 64), seg(0xC2, bytes([8, 0, 12, 0, 20, 1, 1, 0x11, 0])), *tables, restart]
    groups = [blocks[a : a + interval] for a in range(0, 6, interval)] if interval else [blocks]
    for number, (start, end, high, low) in enumerate([(0, 0, 0, 1), (0, 0, 1, 0), (1, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)]):
        parts = []
        for group in groups:
            w = Writer(dc if start == 0 else symbols)
            if number == 0:
                before = 0
                for b in group:
                    now = int(b[0]) >> low
                    w.symbol(abs(now - before).bit_length())
                    if now != before:
                        w.signed(now - before)
                    before = now
            elif number == 1:
                w.bits = [int(b[0]) & 1 for b in group]
            elif high == 0:
                first_scan(w, group, low)
            else:
                refine_scan(w, group, low)
            parts.append(w.done())
        body = parts[0] + b"".join(b"\xff" + bytes([0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))
        out += [progressive_jpeg._sos([1], 0, start, end, high, low), body]
    image = progressive_jpeg.decode(b"".join(out) + b"\xff\xd9")
    assert np.array_equal(image.components[1].coefficients.reshape(-1, 64), blocks)
    (tensor,) = progressive_jpeg.tensors([image])
    assert tensor.shape == (12, 20, 3)
    natural = np.zeros((6, 64))
    natural[:, progressive_jpeg.ZIGZAG] = blocks * 2
    x = np.arange(8)
    c = np.where(x == 0, math.sqrt(1 / 8), 0.5)
    wave = c[:, None] * np.cos((2 * x[None, :] + 1) * x[:, None] * math.pi / 16)
    pixels = np.clip(np.floor(np.einsum("buv,ux,vy->bxy", natural.reshape(6, 8, 8), wave, wave) + 128.5), 0, 255).reshape(2, 3, 8, 8).swapaxes(1, 2).reshape(16, 24)
    assert np.abs(tensor[..., 0].astype(int) - pixels[:12, :20]).max() <= 1


def test_jpeg_rejects_other_files():
    for bad in (b"", b"GIF89a", b"\xff\xd8" + progressive_jpeg._segment(0xC0, bytes(9)) + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            progressive_jpeg.decode(bad)


# 5 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    return sentence_pieces.read_model(spark)


def brute_viterbi(m, text):
    score = {m.names[i].decode(): (m.scores[i], i) for i, k in enumerate(m.kinds) if k in (1, 4)}
    text = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0.0, None)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 48), end):
            piece = text[start:end]
            gain = score[piece][0] if piece in score else m.unknown if end - start == 1 else None
            if gain is not None and (best[end] is None or best[start][0] + gain > best[end][0]):
                best[end] = (best[start][0] + gain, start)
    return best[-1][0]


def test_sentence_pieces(spark, odd, empty, model):
    m = sentence_pieces.Model(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    extra = [(900, "漢字かな🎉 x"), (901, "  two  spaces\n\ttab "), (902, "a▁b"), (903, "\x00\x01 odd"), (904, "▁")]
    table = odd.union(frame(spark, extra))
    rows = sentence_pieces.encode_pieces(table, model).collect()
    texts = odd_texts() + extra
    assert len(rows) == len(texts)
    assert ordered((r.doc_id, r.n_pieces) for r in rows if r.n_pieces == 0) == ordered((k, 0) for k, t in texts if not t)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for key, text in texts:
        if key is None:
            continue
        r, text = by_id[key], text or ""
        assert r.n_pieces == len(r.ids) and r.round_trip == ("▁" not in text)
        if "▁" not in text:
            assert library.decode(r.ids) == text
        # A character that is no piece counts once, however many byte pieces stand for it.
        cost = [m.scores[i] if m.kinds[i] != sentence_pieces.BYTE else 0.0 if int(m.names[i][3:5], 16) & 0xC0 == 0x80 else m.unknown for i in r.ids]
        assert math.isclose(sum(cost), brute_viterbi(m, text), rel_tol=1e-9)
    decoded = {r.doc_id: r.text for r in sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(table, model), model).collect()}
    assert all(decoded[k] == (t or "") for k, t in texts if k is not None and "▁" not in (t or ""))
    assert sentence_pieces.encode_pieces(empty, model).count() == 0


def test_sentence_pieces_documents_round_trip(docs, model):
    assert sentence_pieces.encode_pieces(docs, model).where("not round_trip or n_pieces = 0").count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------


def brute_licenses(text):
    words = ALNUM.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    every, score = set(labels), 0.0
    for line in (text or "").split("\n"):
        own = set(ALNUM.findall(lower(line)))
        for label, template in license_scan.TEMPLATES:
            want = set(ALNUM.findall(lower(template)))
            share = len(own & want) / len(want)
            if len(own & want) >= math.ceil(round(license_scan.THRESHOLD * len(want), 9)):
                every.add(label)
                score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score


def test_license_scans(spark, odd, empty, docs):
    extra = [
        (1000, "Intro\nLicensed under the Apache License, Version 2.0.\nmore"), (1001, "all RIGHTS\nreserved"), (1002, "CC BY-NC 4.0 licensed; under, cc by cc by"), (1003, "Released under the  MIT  License"),
        (1004, "general public"), (1005, "license\n\nThis work is licensed under the GNU General Public License, version 3."), (1006, "released mit license"), (1007, "\nAll rights reserved"),
    ]
    table = odd.union(frame(spark, extra)).union(docs.select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes[2:])))
    rows = odd_texts() + extra + [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r)[:8] for r in license_scan.scan_licenses(table).collect()]
    assert ordered(got) == ordered((k, *brute_licenses(t)) for k, t in rows)
    blocks = license_scan.scan_licenses(frame(spark, extra)).where("doc_id = 1000").first().blocks
    assert [(b.line, b.label, b.containment) for b in blocks] == [(1, "apache-2.0", 1.0)]
    assert license_scan.scan_licenses(empty).count() == 0


def brute_wrapped(text):
    """Labels and score of lines and of every window of words / THRESHOLD words."""
    *_, labels, score = brute_licenses(text)
    words, every = ALNUM.findall(lower(text or "")), set(filter(None, labels.split(",")))
    for label, template in license_scan.TEMPLATES:
        own = ALNUM.findall(lower(template))
        want, width = set(own), math.floor(round(len(own) / license_scan.THRESHOLD, 9))
        for i in range(len(words)):
            shared = len(want & set(words[i : i + width]))
            if shared >= math.ceil(round(license_scan.THRESHOLD * len(want), 9)):
                every.add(label)
                score = max(score, shared / len(want))
    return ",".join(sorted(every)), score


def test_wrapped_license_notices(spark, odd, empty, docs):
    wrap = lambda text, size, lead="": "\n".join(lead + x for x in textwrap.wrap(text, size))
    rows = [(2000 + i, "Some code\n\n" + wrap(text, 72, "# ") + "\n\nmore") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    r, words = random.Random(6), sorted({w for _, text in license_scan.TEMPLATES for w in text.split()})
    for i in range(150):
        parts = [r.choice(license_scan.TEMPLATES)[1].split() for _ in range(r.randint(1, 3))]
        parts = [w for p in parts for w in [*[r.choice(words) for _ in range(r.randint(0, 9))], *p]]
        for _ in range(r.randint(0, 6)):
            parts[r.randrange(len(parts))] = r.choice(["zz", "the zz", "", *words])
        rows.append((3000 + i, wrap(" ".join(parts), r.choice([20, 40, 72]), r.choice(["", " * ", "rem "]))))
    table = frame(spark, rows).union(odd).union(docs.select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes[2:])))
    every = rows + odd_texts() + [(r.doc_id, r.text) for r in docs.collect()]
    got = license_scan.scan_licenses(table, wrapped=True).collect()
    assert ordered((x.doc_id, x.labels, x.score) for x in got) == ordered((k, *brute_wrapped(t)) for k, t in every)
    found = {x.doc_id: x for x in got}
    for i, (label, text) in enumerate(license_scan.TEMPLATES):
        lines = len(textwrap.wrap(text, 72))
        assert (2, 1 + lines, label, 1.0) in [tuple(b) for b in found[2000 + i].blocks]
    assert license_scan.scan_licenses(empty, wrapped=True).count() == 0


def test_license_position_filter_spares_counting(monkeypatch):
    """A block that holds a rare token of each template but too few after it is not counted; a whole notice is, once."""
    index = license_scan.Index([("x", "a b c d e f")], {}, 0.85)
    counted, count = [], np.intersect1d
    monkeypatch.setattr(license_scan.np, "intersect1d", lambda *a, **k: counted.append(1) or count(*a, **k))
    for text, want, n in [("z y x w v u " + "abcdef"[i], [], 0) for i in range(6)] + [("a b c d e f", [(0, 0, 1.0)], 1)]:
        hashed = license_scan.tokens(text)
        counted.clear()
        assert list(index.blocks(hashed, np.zeros(len(hashed), np.int64))) == want
        assert len(counted) == n


# 7 ---------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, odd, empty, docs):
    pieces = token_counts.read_vocabulary(spark)
    known, longest = set(pieces), max(map(len, pieces))
    pattern = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z\x80-\xff0-9\x20\x09-\x0d]+")

    def greedy(word):
        n = at = 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known), 1)
            n, at = n + 1, at + size
        return n

    rows = odd_texts() + [(7000, "a\x00b 12.5e3!!! don't ÉÀ\x1c")] + [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in token_counts.count_tokens(frame(spark, rows), pieces).collect()]
    want = []
    for key, text in rows:
        words = pattern.findall(lower(text or "").encode())
        want.append((key, len(words), sum(map(greedy, words))))
    assert ordered(got) == ordered(want)
    assert token_counts.count_tokens(empty, pieces).count() == 0
    few = token_counts.count_tokens(frame(spark, [(1, "abcab zz")]), [b"ab", b"abc", b"abcd", b"ca"]).first()
    assert (few.n_words, few.n_tokens) == (2, 4)


@pytest.mark.parametrize("longest", [200, 255, 256, 300, 600])
def test_token_counts_of_long_pieces(spark, longest):
    """A vocabulary's longest piece fails at its last byte: all the pieces before it are popped at once."""
    word = "a" * (longest - 1) + "b"
    row = token_counts.count_tokens(frame(spark, [(1, word + " " + "a" * longest + " " + "a" * (longest + 1))]), [b"a" * longest]).first()
    assert (row.n_words, row.n_tokens) == (3, longest + 1 + 2)


# 8 ---------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, odd, empty, data, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 600)  # several blocks
    texts = dict((k, t) for k, t in odd_texts() if k is not None)
    w = texts[8].split()
    items = [(0, texts[8]), (1, " ".join(w[10:40]).upper().replace(" ", ", ")), (2, " ".join(w[:20] + ["zzz"] + w[21:40])), (3, "two words"), (4, ""), (5, None), (6, "nowhere to be found at all"), (7, w[0]), (None, texts[8]), (1, " ".join(w[10:40])), (8, "a b c d e")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for key, text in odd_texts():
        own = ALNUM.findall(lower(text or ""))
        for item, passage in items:
            words = ALNUM.findall(lower(passage or ""))
            if item is None or not words:
                continue
            size = min(5, len(words))
            grams = lambda x: {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} or ({tuple(x)} if x and size == 5 else set())  # noqa: B023, E731
            shared = len(grams(own) & grams(words))
            if 4 * shared >= 3 * len(grams(words)):
                want.add((key, item, len(grams(words)), shared))
    got = {tuple(r)[:4] for r in decontaminate.contaminated(odd, benchmark).collect()}
    assert got == want and len(got) > 20
    dirty = {k for k, *_ in want}
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == ({k for k, _ in odd_texts()} - {k for k in dirty if k is not None}) | {None}
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0 and decontaminate.decontaminate(odd, benchmark.limit(0)).count() == odd.count()


# 9 ---------------------------------------------------------------------------------------------------------------


def test_url_filters(spark, monkeypatch):
    pages = [
        (1, "http://A.Example.NET/en/x.html?q#f", "a.example.net", "/en/x.html", "example.net/en/", "allow"), (2, "https://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        (3, "x://b.org/fr", "b.org", "/fr", None, "allow"), (4, "x://b.org/fr/1", "b.org", "/fr/1", "org/fr/", "allow"), (5, "x://net", "net", "", None, "allow"), (6, "x://net/", "net", "/", "net/", "block"),
        (7, "x://notnet/", "notnet", "/", None, "allow"), (8, None, "", "", None, "allow"), (9, "no scheme", "", "", None, "allow"), (10, "", "", "", None, "allow"),
        (11, "https://m.bad.com/p/?x://y", "m.bad.com", "/p/", None, "block"), (12, "http://bad.com/p.html", "bad.com", "/p.html", None, "block"), (13, "http://bad.com/q", "bad.com", "/q", None, "allow"),
        (None, "http://bad.com/p", "bad.com", "/p", None, "block"), (12, "http://bad.com/p.html", "bad.com", "/p.html", None, "block"), (14, "a://b\nc/d\ne", "b\nc", "/d\ne", None, "allow"),
    ]
    table = spark.createDataFrame([(p[0], p[1], "h", "v", "l", "c") for p in pages], "page_id long, url string, host string, verdict string, listed string, canonical string")
    listed = spark.createDataFrame([("bad.com/p",), ("bad.com/p",), (None,), ("",)], "canonical string")
    for most in (1 << 19, 0):  # broadcast and shuffled filters
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_BLOCKS", most)
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(table, listed).collect()]
        assert ordered(got) == ordered((p[0], *p[2:]) for p in pages)
    assert url_filter.filter_urls(table.limit(0), listed).count() == 0
    assert url_filter.filter_urls(table, listed.limit(0)).where("listed").count() == 0


def test_only_possible_hits_are_joined_with_the_list(spark):
    """No shuffle holds the pages that the filter settles, so no partition does either."""
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), "id").alias("url"))
    listed = spark.createDataFrame([(f"h.com/{i}",) for i in range(20)], "canonical string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = url_filter.filter_urls(pages, listed)
        node = found._jdf.queryExecution().executedPlan()
        assert found.where("listed").count() == 20 and found.count() == 20_000
        joins = [line for line in node.toString().splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
        assert len(joins) == 1 and "canonical" in joins[0]
        parts = found.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        assert max(r["count"] for r in parts) < 20_000 / 4
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_bloom_has_no_false_negatives(spark):
    urls = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    blocks = url_filter.bloom_blocks(urls, 1 << 10)
    probe = urls.withColumns({"block": url_filter._block(F.col("canonical"), 1 << 10), "want": url_filter._bits(F.col("canonical"))}).join(blocks, "block", "left")
    assert probe.where(F.col("bits").bitwiseAND(F.col("want")) == F.col("want")).count() == 3000


# 10 --------------------------------------------------------------------------------------------------------------


def brute_shards(rows, shards=24):
    """(id, shard, slot) by ranking each source's rows and sorting all by fractional rank in plain Python."""
    by = {}
    for key, text, source in rows:
        crc, stratum = zlib.crc32((text or "").encode()), "" if source is None else f"s{source}"
        h = hashlib.md5(f"{sharding.SEED}|{stratum}|{'' if key is None else key}|{crc}".encode()).hexdigest()[:16]
        by.setdefault(stratum, []).append((h, key is not None, key or 0, crc, len((text or "").encode())))
    order = []
    for stratum, own in by.items():
        order += [((2 * i + 1) / len(own), x[0], stratum, *x[1:]) for i, x in enumerate(sorted(own))]
    out, seen = [], Counter()
    for place, (_, _, _, held, key, *_) in enumerate(sorted(order)):
        shard = place * shards // len(order)
        out.append((key if held else None, shard, seen[shard]))
        seen[shard] += 1
    return out


@pytest.mark.parametrize("rows_per_range", [10_000, 8])
def test_shards_match_a_plain_ranking(spark, odd, docs, rows_per_range, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(sharding, "BLOCK", 4)
    many = frame(spark, [(None, "same")] * 300 + [(i, "x") for i in range(50)])
    for table in (odd, docs.select("doc_id", "text", "source"), many):
        rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
        got = [(r.doc_id, r.shard, r.slot) for r in sharding.stratified_shards(table).collect()]
        assert ordered(got) == ordered(brute_shards(rows))


def test_sharding(spark, odd, empty, docs, monkeypatch):
    for rows_per_range in (10_000, 8):
        monkeypatch.setattr(sharding, "ROWS_PER_RANGE", rows_per_range)
        for table in (odd, docs):
            rows = sharding.stratified_shards(table).collect()
            assert len(rows) == table.count() and {r.law for r in rows} == {"rows"}
            by_shard = Counter(r.shard for r in rows)
            sizes = [by_shard.get(i, 0) for i in range(24)]
            assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
            for shard in by_shard:
                assert sorted(r.slot for r in rows if r.shard == shard) == list(range(by_shard[shard]))
    layouts = []
    for n in (10_000, 8):
        monkeypatch.setattr(sharding, "ROWS_PER_RANGE", n)
        layouts.append(sorted((r.doc_id, r.shard, r.slot) for r in sharding.stratified_shards(docs.repartition(5 if n == 8 else 1)).collect()))
    assert layouts[0] == layouts[1]
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in sharding.stratified_shards(docs).collect()}
    assert all(sizes[r.doc_id] == (len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert sharding.stratified_shards(empty).count() == 0


def test_shards_match_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise("other"))
    shares = sharding.stratified_shards(docs, shards=8).join(docs.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.count_if(F.col("source") == "hot").alias("hot"), F.count("*").alias("n")).collect()
    assert all(abs(r.hot - r.n * 334 / 1000) <= 2 for r in shares)
