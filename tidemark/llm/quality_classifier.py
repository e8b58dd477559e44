"""Quality classifier (operator 2): a byte-level convolutional network in numpy.

Every document is cut into overlapping chunks that cover all of it.  Learned filters run
over the embedded bytes of a chunk and are max-pooled to one vector; a dense layer scores
each chunk, and the mean and maximum over the chunks combine to one probability.

The network is fitted on the driver to a bounded sample of labelled rows: of each label the
first ``SAMPLE`` by a seeded hash of the id, as far as they hold ``SAMPLE_BYTES`` together.  A
text of the sample is fitted whole.  Scoring is one pass over all documents with the broadcast
weights, a few ten kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .shared import cut, fold

CHUNK, STRIDE = 1024, 960
EMBEDDED, WIDTH, STEP, FILTERS, HIDDEN = 6, 12, 2, 32, 16
SAMPLE, SAMPLE_BYTES = 1000, 24 << 20
EPOCHS, BATCH, RATE, SEED = 14, 16, 0.008, 5
THRESHOLD = 0.3
#: Chunks that pass the network together.
TOGETHER = 128


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each chunk, and n + 1 chunk offsets by row; an empty row has one empty chunk."""
    sizes = np.diff(offsets)
    counts = 1 + np.maximum(0, -(-(sizes - CHUNK) // STRIDE))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return np.repeat(offsets[:-1] - ends[:-1] * STRIDE, counts) + np.arange(ends[-1]) * STRIDE, ends


def gather(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) symbols: bytes plus one, 0 behind the end of the row."""
    at = start[:, None] + np.arange(CHUNK)
    held = at < stop[:, None]
    if not len(raw):
        return np.zeros(at.shape, np.int64)
    return np.where(held, raw[np.minimum(at, len(raw) - 1)].astype(np.int64) + 1, 0)


@dataclass
class Network:
    """``bias_shift`` moves the logit from the balanced sample to the labels' true proportions."""

    weights: dict[str, np.ndarray]
    bias_shift: float = 0.0
    constant: float | None = None  # set where one label or none was given

    @staticmethod
    def fresh(seed: int) -> "Network":
        random = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (random.standard_normal(shape) * scale).astype(np.float32)

        return Network({
            "embed": normal(257, EMBEDDED, scale=0.5), "filter": normal(WIDTH * EMBEDDED, FILTERS, scale=(WIDTH * EMBEDDED) ** -0.5 * 2), "filter_bias": np.zeros(FILTERS, np.float32),
            "dense": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5), "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, scale=0.3), "out_bias": np.zeros(1, np.float32),
        })

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * EMBEDDED)."""
        embedded = self.weights["embed"][symbols]
        view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=1)[:, ::STEP]  # (chunks, positions, EMBEDDED, WIDTH)
        return view.transpose(0, 1, 3, 2).reshape(len(symbols), view.shape[1], WIDTH * EMBEDDED)

    def pooled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pooled filters, where each has its maximum, windows)."""
        w = self.weights
        windows = self.windows(symbols)
        answers = windows @ w["filter"]  # one product of the same shape a chunk, so that neighbours don't change its rounding
        where = answers.argmax(1)
        top = np.take_along_axis(answers, where[:, None], 1)[:, 0] + w["filter_bias"]
        return np.maximum(top, 0), where, windows

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum((pooled[:, :, None] * self.weights["dense"]).sum(1) + self.weights["dense_bias"], 0)

    def combine(self, hidden: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(rows, 2 * HIDDEN): mean and maximum over each row's chunks."""
        mean = np.add.reduceat(hidden, ends[:-1], axis=0) / np.diff(ends)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(hidden, ends[:-1], axis=0)], axis=1)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each whole row, the same to the last bit whatever other rows come with it."""
        rows = len(offsets) - 1
        if self.constant is not None or not rows:
            return np.full(rows, self.constant if self.constant is not None else 0.5)
        start, ends = chunks(offsets)
        stop = np.repeat(offsets[1:], np.diff(ends))
        hidden = np.concatenate([self.hidden(self.pooled(gather(raw, start[a : a + TOGETHER], stop[a : a + TOGETHER]))[0]) for a in range(0, len(start), TOGETHER)])
        logit = (self.combine(hidden, ends) * self.weights["out"]).sum(1) + self.weights["out_bias"][0] + self.bias_shift
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over the rows; their chunks pass the network ``TOGETHER`` at a time, forth and back."""
        w = self.weights
        start, ends = chunks(offsets)
        counts = np.diff(ends)
        row = np.repeat(np.arange(len(counts)), counts)
        stop = offsets[1:][row]
        groups = [slice(a, a + TOGETHER) for a in range(0, len(start), TOGETHER)]
        forth = [self.pooled(gather(raw, start[g], stop[g]))[:2] for g in groups]
        pooled, where = (np.concatenate(x) for x in zip(*forth, strict=True))
        hidden = self.hidden(pooled)
        both = self.combine(hidden, ends)
        wrong = (1 / (1 + np.exp(-(both @ w["out"] + w["out_bias"][0]))) - labels) / len(labels)
        to_both = (wrong[:, None] * w["out"]).astype(np.float32)
        largest = hidden == both[row, HIDDEN:]
        to_hidden = to_both[row, :HIDDEN] / counts[row][:, None] + to_both[row, HIDDEN:] * largest / np.add.reduceat(largest, ends[:-1], axis=0)[row]
        to_hidden = (to_hidden * (hidden > 0)).astype(np.float32)
        to_pooled = (to_hidden @ w["dense"].T) * (pooled > 0)
        to_filter, to_embed = np.zeros((FILTERS, WIDTH * EMBEDDED)), np.zeros((257, EMBEDDED))
        for g in groups:
            symbols = gather(raw, start[g], stop[g])
            held = symbols[np.arange(len(symbols))[:, None, None], where[g][:, :, None] * STEP + np.arange(WIDTH)]  # what each filter answered to
            to_filter += np.einsum("cf,cfk->fk", to_pooled[g], w["embed"][held].reshape(len(symbols), FILTERS, -1))
            to_bytes = (to_pooled[g][:, :, None] * w["filter"].T).reshape(-1, EMBEDDED)
            to_embed += np.stack([np.bincount(held.ravel(), to_bytes[:, k], minlength=257) for k in range(EMBEDDED)], axis=1)
        return {
            "out": both.T @ wrong, "out_bias": wrong.sum(keepdims=True), "dense": pooled.T @ to_hidden, "dense_bias": to_hidden.sum(0),
            "filter": to_filter.T, "filter_bias": to_pooled.sum(0), "embed": to_embed,
        }


def fit(texts: list[bytes], labels: np.ndarray, ones: int, zeros: int, seed: int = SEED) -> Network:
    """Adam on the sample's whole texts, in a seeded order; ``ones`` and ``zeros`` count all labelled training rows."""
    if not ones or not zeros:
        return Network({}, constant=(ones + 1) / (ones + zeros + 2))
    network, random = Network.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    steps, total = 0, EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        order = random.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            mine = order[a : a + BATCH]
            raw = np.frombuffer(b"".join(texts[i] for i in mine), np.uint8)
            offsets = np.cumsum([0, *(len(texts[i]) for i in mine)])
            steps += 1
            rate = RATE * (1 - 0.9 * steps / total)
            for k, g in network.gradients(raw, offsets, labels[mine]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.99**steps)) + 1e-8)
                network.weights[k] = (network.weights[k] - move).astype(np.float32)
    own = labels.mean()
    network.bias_shift = float(np.log(ones / zeros) - np.log(own / (1 - own))) if 0 < own < 1 else 0.0
    return network


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Network:
    """A network fitted to labelled documents whose crc32(id as text) mod 5 is not 0.

    Labels other than 0 and 1, null ids and ids without a document are left out; of repeated
    labels of an id the larger counts, of its repeated documents the least text.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64(F.lit(SEED), "id")).limit(sample) for v in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = cut(texts.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text")))
    before = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(SEED), "id"), "id")  # of 2 * sample rows at most
    within = texts.select("id", "label", F.octet_length("text").alias("bytes")).withColumn("bytes", F.sum("bytes").over(before)).where(F.col("bytes") <= SAMPLE_BYTES)
    rows = {r.id: (r.text.encode(), r.label) for r in texts.join(F.broadcast(within.select("id")), "id").collect()}  # 2 * SAMPLE_BYTES at most
    ids = sorted(rows)
    given = np.array([rows[i][1] for i in ids], np.float64)
    if len(set(given.tolist())) < 2:
        counts = {1: int((given == 1).sum()), 0: int((given == 0).sum())}
    return fit([rows[i][0] for i in ids], given, counts.get(1, 0), counts.get(0, 0))


def score_quality(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row: the probability that its whole text is of quality 1.

    ``held_out`` is true where crc32(id as text) mod 5 is 0, so for a null id false; predicted
    is 1 from a score of 0.3 on.  Null and empty texts get the score of one empty chunk,
    repeated rows the same score, and a network trained without both labels scores all rows
    alike.  Other columns are ignored; an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(shipped.value, batch.column("text")), pa.float64())], ["id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scores(network: Network, texts: pa.Array) -> np.ndarray:
    raw, offsets = hashing.text_bytes(texts)
    parts = [np.zeros(0)]
    for a, b in hashing.slices(offsets):
        parts.append(network.score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
    return np.concatenate(parts)


def keep_quality(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores 0.3 or more, without a shuffle."""
    index, shipped = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(network)
    if not isinstance(docs.schema[index].dataType, T.StringType):
        raise TypeError(f"{text_col} must be a string column")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shipped.value, batch.column(index)) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
