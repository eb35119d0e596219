"""SentencePiece encoding and decoding by weighted transducers.

A model file is compiled into three transducers: the normaliser (dummy prefix,
white space marked by U+2581), the lexicon of pieces with their weights, and
byte fallback for characters without a piece. They are composed with each
input, and the tropical shortest path through the composition gives the ids.

Two kinds of model:

* unigram: an arc weighs minus the piece's score, an unknown character ten
  more than the worst piece; ties keep the path with the earlier arc start.
* BPE: merging is local: a cut is the merged result exactly if each pair of
  neighbouring pieces, merged alone, stays that pair. So the lexicon is
  composed with a pair acceptor whose arcs weigh 0 for a stable pair and
  infinity for any other; one path of finite weight is left for each prefix.

The composition has one state wherever a word begins (no piece goes on from a
character into a new word, which is checked when the model is compiled), so
paths are found word by word and kept in a bounded table.

Defined results: a null text gives null ids and a null decoded text, an empty
text empty ones; U+2581 in a text reads back as a space, as white space and it
are one symbol to the model.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as X
from .spark import STEP_BYTES, ship, worker_state

SPACE = "▁"
#: Entries of a worker's tables; beyond them paths are found anew each time.
CACHE_WORDS = 350_000
CACHE_PAIRS = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, raw[at : at + size]
        at += size


class PieceModel:
    """A compiled model."""

    def __init__(self, raw: bytes):
        pieces, trainer, normal = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, bytes(4)))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normal.get(2) or any(t == USER for _, _, t in pieces):
            raise ValueError("only unigram and BPE models with the identity normaliser and no user-defined pieces")
        self.dummy, self.trim = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        self.open = {p[:n] for p in self.score for n in range(1, len(p) + 1)}  # the lexicon's states
        self.worst = min(self.score.values(), default=0.0) - 10
        self.inner = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # a word's start is a single state if no piece crosses it
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.score)
        self.output = [p.replace(SPACE, " ").encode() if t == NORMAL else b"" for p, _, t in pieces]
        for b, i in self.byte.items():
            self.output[i] = bytes([b])
        self.output[self.unknown] = " ⁇ ".encode()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.output_size = np.array([len(x) for x in self.output], np.int64)
        self.output_start = np.cumsum(self.output_size) - self.output_size
        self.output_bytes = np.frombuffer(b"".join(self.output), np.uint8)
        self.after_space = _AfterSpace(self)

    # -- pair acceptor

    def _merge(self, text: str) -> list[str]:
        """Highest-scored neighbours first, leftmost on ties."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stable(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            found = self._merge(a + b) == [a, b]
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[a, b] = found
        return found

    # -- shortest path through the composition with one normalised stretch

    def path(self, text: str) -> list[str]:
        return self._only_path(text) if self.kind == BPE else self._cheapest_path(text)

    def _arcs(self, text: str, i: int) -> list[int]:
        """Ends of the lexicon's arcs from place ``i``, short to long."""
        states, lexicon, n = self.open, self.score, len(text)
        ends, j = [i + 1], i + 1  # one character always passes: byte fallback
        while text[i:j] in states and j < n:
            j += 1
            if text[i:j] in lexicon:
                ends.append(j)
        return ends

    def _cheapest_path(self, text: str) -> list[str]:
        n, lexicon, worst = len(text), self.score, self.worst
        cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for i in range(n):
            for j in self._arcs(text, i):
                weight = cost[i] - lexicon.get(text[i:j], worst)
                if weight < cost[j]:
                    cost[j], back[j] = weight, i
        return self._walk(text, back)

    def _only_path(self, text: str) -> list[str]:
        """The composition is unfolded depth first, long arcs first. A place is
        entered once: one path of finite weight leads to it."""
        n, back, entered = len(text), [0] * (len(text) + 1), {0}
        stack, stable, known = [(0, 0, self._arcs(text, 0))], self._stable, self.pairs
        while stack:
            before, i, ends = stack[-1]
            if not ends:
                stack.pop()
                continue
            j = ends.pop()
            if j in entered:
                continue
            if i:
                pair = text[before:i], text[i:j]
                good = known.get(pair)
                if not (stable(*pair) if good is None else good):
                    continue
            back[j] = i
            if j == n:
                break
            entered.add(j)
            stack.append((i, j, self._arcs(text, j)))
        return self._walk(text, back)

    @staticmethod
    def _walk(text: str, back: list[int]) -> list[str]:
        out, j = [], len(text)
        while j:
            out.append(text[back[j] : j])
            j = back[j]
        return out[::-1]

    def cut(self, text: str) -> list[str]:
        """Parts of a stretch between characters that stand together in no
        piece: every path has a state there, and no pair across it merges."""
        inner, lo, out = self.inner, 0, []
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inner:
                out.append(text[lo:i])
                lo = i
        out.append(text[lo:])
        return out

    def ids_of(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.path(text):
            i = self.id.get(piece)
            if i is not None:
                ids.append(i)
            elif self.byte:
                ids += [self.byte[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, text: str) -> bytes:
        ids = self.words.get(text)
        if ids is None:
            ids = self.ids_of(text)
            if len(text) <= 64 and len(self.words) < CACHE_WORDS:
                self.words[text] = ids
        return ids

    def _stretch(self, text: str) -> bytes:
        return b"".join(map(self._part, self.cut(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32 bytes."""
        raw = self._encode(text)
        if self.byte or not raw:
            return raw
        ids = np.frombuffer(raw, "<u4")  # without byte fallback, neighbouring unknowns are one
        stay = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))
        return ids[stay].tobytes()

    def _encode(self, text: str) -> bytes:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        if self.dummy:
            text = " " + text
        if not self.by_word:
            return self._stretch(text.replace(" ", SPACE))
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self._stretch("\n"))
            words = line.split(" ")
            if "" in words[1:] or SPACE in line:
                out += map(self._stretch, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line.replace(" ", SPACE)))
            else:
                if words[0]:
                    out.append(self._stretch(words[0]))
                out += map(self.after_space.__getitem__, words[1:])
        return b"".join(out)

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin): each distinct stretch
        between single spaces takes its path once, ids are put in place by number."""
        if self.dummy and self.by_word and self.byte and not self.trim:
            data, start, bounds = X.stretches(*X.utf8(column))
            which, distinct = X.distinct_strings(data, start)
            known = self.stretches
            parts = []
            for s in distinct:
                ids = known.get(s)
                if ids is None:
                    simple = s.count(" ") == 1 and "\n" not in s and SPACE not in s
                    ids = self._stretch(SPACE + s[1:]) if simple and len(s) > 1 else self.encode(s[1:])
                    if len(s) <= 64 and len(known) < CACHE_WORDS:
                        known[s] = ids
                parts.append(ids)
        else:
            parts = [self.encode(t or "") for t in column.to_pylist()]
            which, bounds = np.arange(len(parts)), np.arange(len(parts) + 1)
        flat = np.frombuffer(b"".join(parts), "<i4")
        many = np.array([len(p) // 4 for p in parts], np.int64)
        size = many[which]
        end = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(int(end[-1])) + np.repeat((np.cumsum(many) - many)[which] - end[:-1], size)
        return flat[place], end[bounds]

    def decode_batch(self, lists: pa.Array) -> pa.Array:
        """Texts of id lists, put together from the pieces' bytes."""
        if lists.null_count:
            lists = lists.fill_null(pa.scalar([], lists.type))
        ids, off = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        size = self.output_size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(int(end[-1])) + np.repeat(self.output_start[ids] - end[:-1], size)
        data, start = self.output_bytes[place], end[off - off[0]]
        if self.dummy:  # the space put before a text
            first = start[:-1][np.diff(start) > 0]
            drop = first[data[first] == 0x20]
            stay = np.ones(len(data), bool)
            stay[drop] = False
            data, start = data[stay], start - np.searchsorted(drop, start)
        out = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(start.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids whose bytes are no UTF-8
            return pa.array([self.decode(x) for x in lists.to_pylist()], pa.string())
        return out.cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


class _AfterSpace(dict):
    """Ids of a word with one space before it."""

    def __init__(self, model: PieceModel):
        self.stretch = model._stretch

    def __missing__(self, word: str) -> bytes:
        ids = self.stretch(SPACE + word)
        if len(self) < CACHE_WORDS and len(word) <= 64:
            self[word] = ids
        return ids


def piece_model(path: str) -> PieceModel:
    state = worker_state("piece_models")
    if path not in state:
        with open(path, "rb") as f:
            state[path] = PieceModel(f.read())
    return state[path]


def encode(docs: DataFrame, model: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` added (a clashing column is replaced)."""
    ship()
    docs = docs.drop(*[c for c in (out,) if c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in X.row_slices(column, STEP_BYTES):
                flat, end = m.encode_batch(column.slice(lo, hi - lo))
                ids = pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(flat), mask=column.slice(lo, hi - lo).is_null())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, ids], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids`` added (a clashing column is replaced)."""
    ship()
    docs = docs.drop(*[c for c in (out,) if c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for lo in range(0, max(len(column), 1), 256):
                part = batch.slice(lo, 256)
                texts = m.decode_batch(column.slice(lo, 256))
                texts = pc.if_else(column.slice(lo, 256).is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))
