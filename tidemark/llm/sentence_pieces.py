"""SentencePiece encoding and decoding (operator 5).

An Aho-Corasick automaton over the model's pieces drives a single-pass Viterbi: at each
byte it steps once, then follows the output links to every piece that ends there, longest
first, and relaxes the best score of that position.  A character that is no piece of its
own costs the model's least score less ten and falls back to byte pieces.

Texts are cut between two characters that stand side by side in no piece; the best path
never crosses such a cut.  All distinct segments of a slice of texts step together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .automaton import AhoCorasick

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 2 << 20
CELLS = 1 << 20
UNKNOWN_PENALTY = 10.0
#: Piece types in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK = "▁".encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size, code = (4, "<f") if key & 7 == 5 else (8, "<d")
            yield key >> 3, struct.unpack(code, data[at : at + size])[0]
            at += size


class Model:
    """Pieces, scores and normaliser of a model file; blanks are kept as spaces."""

    def __init__(self, content: bytes):
        self.names: list[bytes] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.dummy_prefix, chars_map = True, b""
        for number, value in _fields(content):
            if number == 1:
                piece = dict(_fields(value))
                self.names.append(piece.get(1, b""))
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                normaliser = dict(_fields(value))
                chars_map = normaliser.get(2, b"")
                self.dummy_prefix = bool(normaliser.get(3, 1))
                if chars_map or normaliser.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep extra white space are lossless")
        self.byte_ids = np.full(256, -1, np.int32)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_ids[int(self.names[i][3:5], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model must have a piece for every byte")
        usable = [i for i, kind in enumerate(self.kinds) if kind in (NORMAL, USER_DEFINED)]
        patterns = [self.names[i].replace(BLANK, b" ") for i in usable]
        self.automaton = AhoCorasick(patterns)
        nodes = self.automaton.pattern
        self.piece = np.where(nodes >= 0, np.array(usable)[nodes], -1).astype(np.int32)
        self.length = np.where(nodes >= 0, np.array([len(p) for p in patterns])[nodes], 0).astype(np.int32)
        scores = np.array([self.scores[i] for i in usable])
        self.score = np.where(nodes >= 0, scores[nodes], 0.0)
        self.unknown = float(scores.min()) - UNKNOWN_PENALTY
        self.joined = np.zeros((256, 256), dtype=bool)
        for p in patterns:
            pair = np.frombuffer(p, np.uint8)
            self.joined[pair[:-1], pair[1:]] = True
        self.joined[:, 0x80:0xC0] = True  # inside a character
        decoded = [bytes([int(n[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else n.replace(BLANK, b" ") for n, k in zip(self.names, self.kinds, strict=True)]
        self.decoded = np.frombuffer(b"".join(decoded), np.uint8)
        self.decoded_ends = np.cumsum([0, *map(len, decoded)])

    def viterbi(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets) of the best segmentation of each ``data[start:end]``."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        counts = np.zeros(len(order), np.int64)
        parts, at = [], 0
        while at < len(order):
            lanes = order[at : at + max(1, CELLS // int(size[order[at]] + 1))]
            ids, counts[lanes] = self._together(data, start[lanes], size[lanes])
            parts.append((lanes, ids))
            at += len(lanes)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], np.int32)
        for lanes, ids in parts:
            out[ranges(offsets[:-1][lanes], counts[lanes])] = ids
        return out, offsets

    def _together(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        automaton, n, width = self.automaton, len(start), int(size[0]) + 1
        best = np.full((width, n), -np.inf)
        best[0] = 0
        came = np.zeros((width, n), np.int32)  # the node of the last piece; 0: an unknown character
        pieces = np.zeros((width, n), np.int32)
        opened = np.zeros(n, np.int32)  # where the character at hand starts
        state = np.zeros(n, np.int32)
        falling = -size
        for i in range(width - 1):
            m = int(np.searchsorted(falling, -i, "left"))
            at = start[:m] + i
            symbol = data[at]
            np.copyto(opened[:m], i, where=(symbol & 0xC0) != 0x80)
            state[:m] = automaton.step[state[:m], symbol]
            node = automaton.out[state[:m]]
            alone = np.zeros(m, dtype=bool)
            lane = np.flatnonzero(node)
            node = node[lane]
            while len(lane):
                begin = i + 1 - self.length[node]
                score = best[begin, lane] + self.score[node]
                better = score > best[i + 1, lane]
                to = lane[better]
                best[i + 1, to] = score[better]
                came[i + 1, to] = node[better]
                pieces[i + 1, to] = pieces[begin[better], to] + 1
                alone[lane[begin == opened[lane]]] = True
                node = automaton.more[node]
                held = node > 0
                lane, node = lane[held], node[held]
            if alone.all():
                continue
            follows = data[np.minimum(at + 1, len(data) - 1)]
            closes = (i + 1 == size[:m]) | ((follows & 0xC0) != 0x80)
            lane = np.flatnonzero(closes & ~alone)
            begin = opened[lane]
            score = best[begin, lane] + self.unknown
            better = score > best[i + 1, lane]
            lane, begin = lane[better], begin[better]
            best[i + 1, lane] = score[better]
            came[i + 1, lane] = 0
            pieces[i + 1, lane] = pieces[begin, lane] + (i + 1 - begin)
        counts = pieces[size, np.arange(n)].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offsets[-1], np.int32)
        lane, at = np.arange(n), size.copy()
        while len(lane):
            node = came[at, lane]
            last = offsets[lane] + pieces[at, lane] - 1
            known = node > 0
            out[last[known]] = self.piece[node[known]]
            at = at - np.where(known, self.length[node], 1)
            for j in np.flatnonzero(~known):  # an unknown character, byte by byte
                base, stop, k = start[lane[j]], at[j] + 1, 0
                while True:
                    byte = data[base + stop - 1 - k]
                    out[last[j] - k] = self.byte_ids[byte]
                    k += 1
                    if byte & 0xC0 != 0x80:
                        break
                at[j] = stop - k
            open_ = at > 0
            lane, at = lane[open_], at[open_]
        return out, counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets) by row of whole texts, and the normalised bytes with their offsets."""
        if bytes(BLANK) in raw.tobytes():
            texts = [raw[a:b].tobytes().replace(BLANK, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        if self.dummy_prefix:
            filled = np.diff(offsets) > 0
            raw = np.insert(raw, offsets[:-1][filled], 0x20)
            offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), raw, offsets
        new = np.ones(len(raw), dtype=bool)
        new[1:] = ~self.joined[raw[:-1], raw[1:]]
        new[offsets[offsets < len(raw)]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(raw))
        example, same = hashing.distinct_spans(raw, start, end)
        ids, at = self.viterbi(raw, start[example], end[example])
        count = np.diff(at)[same]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids[ranges(at[:-1][same], count)], ends[np.searchsorted(start, offsets)], raw, offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, n + 1 offsets): pieces joined; the dummy prefix, if any, still in front."""
        size = np.diff(self.decoded_ends)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.decoded[ranges(self.decoded_ends[ids], size)], ends[offsets]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """A model file's content, through Spark's own reader; it has the size of one vocabulary."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids, round_trip) of every row: its piece ids, and whether they decode to the text.

    Null and empty texts have no pieces.  A text with U+2581, which the format can't tell from
    a blank, is encoded as if it had spaces there and its round_trip is false; any other text
    decodes to itself.  Repeated rows are encoded one by one, other columns are ignored, and
    an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shipped.value)  # not kept between tasks: its tables of some 100 MB would stay with the worker
        for batch in batches:
            raw, offsets = hashing.text_bytes(batch.column("text"))
            for a, b in hashing.slices(offsets, SLICE):
                part = offsets[a : b + 1] - offsets[a]
                own = raw[offsets[a] : offsets[b]]
                ids, ends, _, _ = m.encode(own, part)
                text, text_ends = m.decode(ids, ends)
                lead = int(m.dummy_prefix)
                equal = [np.array_equal(text[s + lead : e], own[x:y]) for s, e, x, y in zip(text_ends[:-1], text_ends[1:], part[:-1], part[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(equal)], ["id", "n_pieces", "ids", "round_trip"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(encode, "id long, n_pieces int, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row's piece ids; null and empty lists give an empty text, ids outside the model an error.

    Byte pieces that form no valid UTF-8 decode to U+FFFD; control pieces decode to nothing.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shipped.value)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            text, ends = m.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.cumsum([0, *map(len, lists)]))
            lead = b" " if m.dummy_prefix else b""
            texts = [text[s:e].tobytes().removeprefix(lead).decode("utf-8", "replace") for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    lists = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return lists.mapInArrow(decode, "id long, text string").withColumnRenamed("id", id_col)
