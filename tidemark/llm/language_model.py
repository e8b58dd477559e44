"""LM scoring by deleted interpolation (operator 3): bigram, unigram and smoothed unigram, mixed.

P(w | v) = a_k c(v, w) / c(v) + b_k c(w) / N + d_k (c(w) + 0.5) / (N + 0.5 (V + 1)), with one
mixture (a_k, b_k, d_k) for each frequency bucket k of the context v (doubling bounds).  The
mixtures are learned by expectation-maximisation on held-out counts: documents of one training
fold are deleted from the counts, and their tokens weigh the mixtures.  The final counts are
those of all training documents.

Counts are exchanged, not broadcast.  Documents are dealt into chunks of bounded size by a
hash.  A chunk asks for each distinct word and bigram once, its own counts attached, sorted
and cut by hash range (bucket); a bucket sums what all chunks sent and answers each; the chunk
then holds the global counts of all it needs.  So a frequent word costs one entry per chunk,
and each vocabulary part sits in one task of bounded size.

No task ever meets more than ``ARITY`` askers of a bucket: beyond that, chunks are summed by
groups first, which ask in the chunks' stead with finer ranges, and pass the answers on; groups
of groups likewise.  Rows repeated very often are counted before they are dealt into chunks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .shared import cut, fold, step

#: Bytes of text in a chunk, and about so many keys in a bucket.
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20
#: Askers that one sum takes.
ARITY = 4096
#: Copies of one row that a chunk may hold; with more, rows are dealt with their number.
REPEATS = 1000
#: What asks: a chunk of test, deleted or other training documents, or a group of askers.
TEST, HELD, MAIN, GROUP = 0, 1, 2, 3
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
ROUNDS = 60
#: Likelihood ratios are binned by eighths of a power of two for the mixtures.
FINE = 8

REQUEST = "bucket long, chunk long, kind int, keys binary, train binary, main binary"
REPLY = "bucket long, chunk long, train binary, main binary, tokens long, types long, main_tokens long"


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys with an end after each row, bigram keys (row starts after ``BEGIN``), n + 1 offsets."""
    raw, offsets = hashing.text_bytes(texts)
    parts, sizes = [], []
    for a, b in hashing.slices(offsets):
        part = offsets[a : b + 1]
        hashed, _, _, by_row = hashing.words(raw[part[0] : part[-1]], part - part[0])
        parts.append(np.insert(hashed, by_row[1:], END))
        sizes.append(np.diff(by_row) + 1)
    ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64)
    word = np.concatenate([np.zeros(0, np.uint64), *parts])
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[ends[:-1]] = BEGIN
    return word, hashing.mix(before * hashing.BASE + word + hashing.M1), ends


def _planes(values: np.ndarray) -> bytes:
    """Sorted keys byte plane by byte plane, so that the leading planes compress."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the sorted keys begins, and the end."""
    bounds = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def _weights(times: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """The number of copies of each token's row; None if all are single."""
    return None if (times == 1).all() else np.repeat(times, np.diff(ends))


def _asked(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.table([pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "kind", "keys", "train", "main"])


def _request(ranges: tuple[int, int]):
    def request(key: tuple, table: pa.Table) -> pa.Table:
        chunk, kind = key[0].as_py(), table["kind"][0].as_py()
        word, pair, ends = tokens(table["text"])
        weights = _weights(table["times"].to_numpy(), ends)
        rows, first = [], 0
        for values, n in zip((word, pair), ranges, strict=True):
            if weights is None:
                keys, counts = np.unique(values, return_counts=True)
            else:
                keys, place = np.unique(values, return_inverse=True)
                counts = np.bincount(place, weights, len(keys))
            cuts = _cuts(keys, n)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[i], cuts[i + 1])
                packed = _pack(counts[part]) if kind != TEST else None
                rows.append((first + i, chunk, kind, _planes(keys[part]), packed, packed if kind == MAIN else None))
            first += n
        return _asked(rows)

    return request


class Sums:
    """The distinct keys of a bucket's askers, their summed counts, and where each asker's keys are among them."""

    def __init__(self, table: pa.Table):
        self.kinds, self.askers = table["kind"].to_pylist(), table["chunk"].to_pylist()
        lists = [_from_planes(k.as_py()) for k in table["keys"]]
        self.ends = np.cumsum([0, *map(len, lists)])
        self.keys, self.place = np.unique(np.concatenate(lists), return_inverse=True)
        self.train, self.main = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        for i in range(len(lists)):
            for sums, packed in ((self.train, table["train"][i].as_py()), (self.main, table["main"][i].as_py())):
                if packed is not None:
                    sums[self.of(i)] += _unpack(packed)  # an asker's keys are distinct

    def of(self, i: int) -> np.ndarray:
        return self.place[self.ends[i] : self.ends[i + 1]]

    def answers(self, bucket: int, train: np.ndarray, main: np.ndarray) -> list[tuple]:
        """What each asker gets: counts of its keys, in its order."""
        return [(bucket, asker, _pack(train[self.of(i)]), _pack(main[self.of(i)]) if kind in (HELD, GROUP) else None, 0, 0, 0) for i, (asker, kind) in enumerate(zip(self.askers, self.kinds, strict=True))]


def _answered(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(v, k) for v, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=["bucket", "chunk", "train", "main", "tokens", "types", "main_tokens"])


def _reply(words: int):
    """Sums of a bucket's keys over all askers, for each in its own order; a row of chunk -1 has totals."""

    def reply(key: tuple, table: pa.Table) -> pa.Table:
        bucket, sums = key[0].as_py(), Sums(table)
        totals = (int(sums.train.sum()), int((sums.train > 0).sum()), int(sums.main.sum())) if bucket < words else (0, 0, 0)
        return _answered([*sums.answers(bucket, sums.train, sums.main), (bucket, -1, None, None, *totals)])

    return reply


def _merge(ranges: tuple[int, int], ratio: int):
    """A group's sums of one bucket, asked for in ``ratio`` finer ranges."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        group, bucket = (k.as_py() for k in key)
        sums = Sums(table)
        whole = ranges[0] if bucket < ranges[0] else ranges[1]
        own = bucket if bucket < ranges[0] else bucket - ranges[0]
        cuts = _cuts(sums.keys, whole * ratio)[own * ratio : (own + 1) * ratio + 1]
        rows = []
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[i], cuts[i + 1])
            rows.append((bucket * ratio + i, group, GROUP, _planes(sums.keys[part]), _pack(sums.train[part]), _pack(sums.main[part])))
        return _asked(rows)

    return merge


def _pass_on(key: tuple, asked: pa.Table, replies: pa.Table) -> pa.Table:
    """The answers that a group got for one bucket, given to its askers."""
    if not asked.num_rows:
        return _answered([])
    sums, order = Sums(asked), np.argsort(replies["bucket"].to_numpy())
    train, main = (np.concatenate([_unpack(replies[c][int(i)].as_py()) for i in order]) for c in ("train", "main"))
    return _answered(sums.answers(key[1].as_py(), train, main))


def _exchange(asked: DataFrame, askers: int, ranges: tuple[int, int]) -> DataFrame:
    """``REPLY`` rows for the ``REQUEST`` rows of so many askers, through as many levels of groups as they need."""
    if askers <= ARITY:
        return cut(asked.groupBy("bucket").applyInArrow(_reply(ranges[0]), REPLY))
    ratio = min(ARITY, -(-askers // ARITY))
    asked = cut(asked.withColumn("group", F.expr(f"chunk div {ARITY}L")))  # read twice
    merged = asked.groupBy("group", "bucket").applyInArrow(_merge(ranges, ratio), REQUEST)
    replies = _exchange(merged, -(-askers // ARITY), (ranges[0] * ratio, ranges[1] * ratio))
    back = replies.where("chunk >= 0").select(F.col("chunk").alias("group"), F.expr(f"bucket div {ratio}L").alias("coarse"), "bucket", "train", "main")
    passed = asked.groupBy("group", "bucket").cogroup(back.groupBy("group", "coarse")).applyInArrow(_pass_on, REPLY)
    return cut(passed.union(replies.where("chunk < 0")))


def _counts(replies: pa.Table, column: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Global counts of the chunk's sorted distinct words and bigrams."""
    order = np.argsort(replies["bucket"].to_numpy())
    buckets = replies["bucket"].to_numpy()[order]
    parts = [_unpack(replies[column][int(i)].as_py()) for i in order]
    at = int(np.searchsorted(buckets, words))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parts[:at]]), np.concatenate([none, *parts[at:]])


def _token_counts(texts: pa.ChunkedArray, replies: pa.Table, column: str, words: int, starts: int):
    """By token: count of the word, of the bigram, and of its context; and the row offsets."""
    word, pair, ends = tokens(texts)
    by_word, by_pair = _counts(replies, column, words)
    single = by_word[np.unique(word, return_inverse=True)[1]]
    double = by_pair[np.unique(pair, return_inverse=True)[1]]
    context = np.empty_like(single)
    context[1:] = single[:-1]
    context[ends[:-1]] = starts
    return single, double, context, ends


def context_bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1).astype(np.float64))[1], 0)


def base_probability(count: np.ndarray, tokens_: int, types: int) -> np.ndarray:
    return (count + 0.5) / (tokens_ + 0.5 * (types + 1))


def learn_mixtures(rows: list[tuple[int, float, float, float]], rounds: int = ROUNDS) -> np.ndarray:
    """(bucket, 3) mixtures by EM: rows of (bucket, weight, mean bigram ratio, mean unigram ratio), the third part 1.

    A bucket without held-out tokens takes the mixture of the nearest lower one with some.
    """
    mixtures = np.tile(np.array([0.3, 0.4, 0.3]), (66, 1))
    data = np.array(rows, np.float64).reshape(-1, 4)
    last = mixtures[0]
    for bucket in range(len(mixtures)):
        mine = data[data[:, 0] == bucket]
        if len(mine):
            weight, ratios = mine[:, 1], np.column_stack([mine[:, 2], mine[:, 3], np.ones(len(mine))])
            mix = np.array([0.3, 0.4, 0.3])
            for _ in range(rounds):
                share = ratios * mix
                share /= share.sum(1, keepdims=True)
                mix = weight @ share / weight.sum()
            # The third part never vanishes: an unseen word keeps a probability.
            last = 0.999 * mix + 0.001 * np.array([0.0, 0.0, 1.0])
        mixtures[bucket] = last
    mixtures[0] = [0.0, mixtures[0][1] / (mixtures[0][1] + mixtures[0][2]), mixtures[0][2] / (mixtures[0][1] + mixtures[0][2])]
    return mixtures


def _held_out(words: int, main_tokens: int, main_types: int, starts: int):
    """Binned likelihood ratios of a held-out chunk's tokens under the counts without its fold."""

    def held_out(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["bucket", "r2", "r1", "n", "sum2", "sum1"]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        single, double, context, ends = _token_counts(texts["text"], replies, "main", words, starts)
        base = base_probability(single, main_tokens, main_types)
        two = np.where(context > 0, double / np.maximum(context, 1), 0.0) / base
        one = single / max(main_tokens, 1) / base
        floor = -200 * FINE
        bins = [np.where(r > 0, np.floor(np.log2(np.maximum(r, 1e-60)) * FINE), floor).astype(np.int64) for r in (two, one)]
        weights = _weights(texts["times"].to_numpy(), ends)
        if weights is not None:
            two, one = two * weights, one * weights
        cell, place = np.unique((context_bucket(context).astype(np.int64) << 24) + (bins[0] + 2048 << 12) + bins[1] + 2048, return_inverse=True)
        return pa.table([pa.array(cell >> 24), pa.array((cell >> 12 & 4095) - 2048), pa.array((cell & 4095) - 2048), pa.array(np.bincount(place, weights).astype(np.int64)), pa.array(np.bincount(place, two)), pa.array(np.bincount(place, one))], names=names)

    return held_out


def _score(words: int, tokens_: int, types: int, starts: int, mixtures: np.ndarray):
    def score(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["id", "mark", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        single, double, context, ends = _token_counts(texts["text"], replies, "train", words, starts)
        base = base_probability(single, tokens_, types)
        mix = mixtures[context_bucket(context)]
        mixed = mix[:, 0] * (double / np.maximum(context, 1)) + mix[:, 1] * (single / max(tokens_, 1)) + mix[:, 2] * base
        if not tokens_:
            mixed = base
        sums = [np.add.reduceat(x, ends[:-1]) for x in ((single > 0).astype(np.int64), np.log10(base), np.log10(mixed))]
        return pa.table([texts["id"], texts["mark"], texts["held_out"], pa.array(np.diff(ends)), *(pa.array(s) for s in sums)], names=names)

    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) mod 5 is 1 are held out and never counted; fold 2 is deleted to
    learn the mixtures.  A row with a null id is neither: scored only.  Tokens are words (A-Z
    lower-cased, parted at space and \\x09-\\x0D) and one end, so a null or empty text has one.
    Scores are log10 probabilities of whole texts: ``base_score`` of the smoothed unigrams,
    ``score`` of the mixture.  Its mixtures are learned from likelihood ratios binned by eighths
    of a power of two, which moves a text's score by less than 0.2 percent.  Repeated rows each
    count and each have their scores, other columns are ignored; an empty table gives none, and
    without training rows both scores are 0.  Ids must be numbers.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("fold", fold("id"))
    by_row = every.groupBy("fold", F.xxhash64("id", "text").alias("h")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows"))
    sizes = by_row.groupBy("fold").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("rows").alias("most"), F.max(F.when(F.col("rows") > 1, F.col("bytes"))).alias("widest")).collect()
    size = {kind: sum(r.bytes or 0 for r in sizes if kind == _kind(r.fold)) for kind in (TEST, HELD, MAIN)}
    starts = {kind: sum(r["rows"] for r in sizes if kind == _kind(r.fold)) for kind in (TEST, HELD, MAIN)}
    chunks = {kind: max(1, -(-size[kind] // CHUNK_BYTES)) for kind in size}
    askers = sum(chunks.values())
    # Of a text of n bytes, about n / 6 tokens; bigrams are mostly distinct, words mostly not.  Groups ask in finer ranges.
    finer, left = 1, askers
    while left > ARITY:
        finer, left = finer * min(ARITY, -(-left // ARITY)), -(-left // ARITY)
    ranges = tuple(max(1, sum(size.values()) // of // BUCKET_KEYS // finer) for of in (40, 8))
    finest = ranges[0]  # the chunks' own ranges of words; their answers come in these

    # Copies of a row share a chunk, unless they are too many or too long for it: then they are counted first.
    repeated = any(r.most > REPEATS or (r.widest or 0) > CHUNK_BYTES for r in sizes)
    mark = F.md5("text") if repeated else F.lit(None).cast("string")
    rows = every.groupBy("id", "text", "fold").agg(F.count("*").alias("times")) if repeated else every.withColumn("times", F.lit(1).cast("long"))
    kind = F.when(F.col("fold") == 2, HELD).when(F.col("fold") != 1, MAIN).otherwise(TEST)
    hashed = F.xxhash64("id", "text")
    first, chunk = 0, F.lit(None).cast("long")
    for k in (HELD, MAIN, TEST):
        chunk = F.when(kind == k, first + F.pmod(hashed, F.lit(chunks[k]))).otherwise(chunk)
        first += chunks[k]
    rows = rows.select("id", mark.alias("mark"), F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out"), "text", "times", kind.alias("kind"), chunk.alias("chunk"))

    asked = rows.select("chunk", "kind", "text", "times").groupBy("chunk").applyInArrow(_request(ranges), REQUEST)
    replies = _exchange(asked, askers, ranges)
    total = replies.where("chunk = -1").agg(F.sum("tokens"), F.sum("types"), F.sum("main_tokens")).first()
    n_tokens, n_types, n_main = (int(x or 0) for x in total)
    replies = replies.where("chunk >= 0").select("bucket", "chunk", "train", "main")

    held = rows.where(F.col("kind") == HELD).select("chunk", "text", "times").groupBy("chunk")
    answers = replies.where(F.col("chunk") < chunks[HELD]).select("bucket", "chunk", "main").groupBy("chunk")
    binned = held.cogroup(answers).applyInArrow(_held_out(finest, n_main, n_types, starts[MAIN]), "bucket long, r2 long, r1 long, n long, sum2 double, sum1 double")
    with step(docs.sparkSession):
        binned = binned.groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"), F.sum("sum2").alias("s2"), F.sum("sum1").alias("s1")).collect()
    mixtures = learn_mixtures([(r.bucket, r.n, r.s2 / r.n, r.s1 / r.n) for r in sorted(binned)])

    texts = rows.select("id", "mark", "held_out", "text", "chunk").groupBy("chunk")
    answers = replies.select("bucket", "chunk", "train").groupBy("chunk")
    scored = texts.cogroup(answers).applyInArrow(_score(finest, n_tokens, n_types, starts[MAIN] + starts[HELD], mixtures), "id long, mark string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    if repeated:
        own = every.select(F.col("id").alias("key"), F.md5("text").alias("its"))
        scored = own.join(scored, F.col("key").eqNullSafe(F.col("id")) & (F.col("its") == F.col("mark")))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _kind(fold_: int | None) -> int:
    return TEST if fold_ is None or fold_ == 1 else HELD if fold_ == 2 else MAIN
