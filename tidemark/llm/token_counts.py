"""Token counts (operator 7): greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's trie has failure links, and each carries the number of pieces that
following it pops.  With all moves tabulated, a word costs one table look-up a byte and
no piece is ever built.  All distinct words of a slice of texts step together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .automaton import LongestMatch

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
SLICE = 2 << 20
END_OF_WORD = "</w>"

#: Byte classes: 0 parts words, runs of 1 (letters, non-ASCII) and of 3 (other signs) are words, each 2 (digit) is one.
CLASS = np.full(256, 3, np.uint8)
CLASS[hashing.SPACE] = 0
CLASS[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = 1
CLASS[ord("0") : ord("9") + 1] = 2


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> list[bytes]:
    """The distinct pieces of a tokenizer file as bytes, without the mark of a word's end."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    alphabet = byte_alphabet()
    names = json.loads(content)["model"]["vocab"]
    pieces = {bytes(alphabet[c] for c in name.removesuffix(END_OF_WORD)) for name in names}
    return sorted(pieces - {b""})


def split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    kind = CLASS[raw]
    new = np.ones(len(raw), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    new[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(raw))
    held = kind[start] != 0 if len(start) else np.zeros(0, dtype=bool)
    return start[held], end[held]


def piece_counts(automaton: LongestMatch, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Greedy pieces of each word ``low[start:end]``, all words in step."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    first, falling = start[order], -size[order]
    state, pieces = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
    for i in range(int(size.max(initial=0))):
        n = int(np.searchsorted(falling, -i, "left"))  # words longer than i
        symbol, now = low[first[:n] + i], state[:n]
        pieces[:n] += automaton.popped[now, symbol]
        state[:n] = automaton.step[now, symbol]
    out = np.empty(len(order), np.int64)
    out[order] = pieces + automaton.close[state]
    return out


def count_tokens(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of every row: words, and their greedy longest-match pieces.

    A-Z is lower-cased; words part at space and \\x09-\\x0D; runs of letters and non-ASCII
    bytes, single digits, and runs of other signs are words.  A byte outside the vocabulary
    is one piece.  Null and empty texts have none, repeated rows are counted one by one,
    other columns are ignored, and an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(shipped.value)  # not kept between tasks: its tables would stay with the worker
        for batch in batches:
            raw, offsets = hashing.text_bytes(batch.column("text"))
            for a, b in hashing.slices(offsets, SLICE):
                part = offsets[a : b + 1] - offsets[a]
                low = hashing.LOWER[raw[offsets[a] : offsets[b]]]
                start, end = split(low, part)
                example, same = hashing.distinct_spans(low, start, end)
                pieces_of = piece_counts(automaton, low, start[example], end[example])[same]
                by_row = np.searchsorted(start, part)
                sums = np.concatenate([[0], np.cumsum(pieces_of)])
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], pa.array(np.diff(by_row)), pa.array(sums[by_row[1:]] - sums[by_row[:-1]])], ["id", "n_words", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
