"""Best-fit packing by minimum bin slack.

Texts become token pieces of at most ``capacity`` tokens on executors. Packing
works on the histogram of piece lengths (at most ``capacity`` rows, whatever
the corpus): per bin the largest piece left is seated and a subset-sum bitset
over the available lengths finds the fullest feasible combination for the
rest; the combination is removed as often as the counts allow. The plan says
which ranks of each length go to which bins; executors rank the pieces of a
length (in hash buckets, so that one frequent length is spread over tasks) and
look their places up.

Defined results: a null text is empty; an empty text is one piece holding the
closing id; repeated rows are packed as often as they occur; ties between
equal pieces are broken by id, piece and checksum.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .spark import STEP_BYTES, settle, ship, worker_state

#: Entries of a worker's word cache; words beyond it are tokenized each time.
CACHE_WORDS = 200_000


class WordIds(dict):
    """Ids of a word (no white space inside) as little-endian uint32 bytes.

    The tokenizer's normaliser and splitter never join across white space, so
    a text's ids are those of its words one after the other. Words repeat, so
    their ids are kept. Words of characters below U+0250 (nothing there
    composes, and letters are the same in every Unicode version) are split
    here and given to the tokenizer's model part by part; texts with other
    characters go through the whole tokenizer, word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.parts: dict[str, bytes] = {}
        self.rare: dict[str, bytes] = {}
        low = [chr(c) for c in range(0x250)]
        letters, numbers = ("".join(c for c in low if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in keep)}
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        # \x1c-\x1f end a word for str.split but not for the tokenizer
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *specials]
        self.high = re.compile("[\u0250-\U0010ffff]").search
        probes = "Word's naïve, ÀÉ12x a%%%b 'LL ß x\x7fy ½² İ ÿĀſ don't ... ' mm'd9 ¿Qué? ŉ ǰǅ"
        self.plain = self._short_text(probes) == self._whole(probes)

    def _whole(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _short_text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))

    def _part(self, part: str) -> bytes:
        coded = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.alphabet)
        ids = b"".join([self.packed[t.id] for t in self.tokenize(coded)])
        if len(self.parts) < CACHE_WORDS // 2:
            self.parts[part] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        low, parts = word.lower(), self.parts
        if low.isalpha():
            ids = parts.get(low) or self._part(low)
        else:
            ids = b"".join([parts.get(x) or self._part(x) for x in self.split(low)])
        if len(self) < CACHE_WORDS and len(word) <= 64:  # frequent words come early; long ones hardly repeat
            self[word] = ids
        return ids

    def _rare(self, word: str) -> bytes:
        if not self.high(word):
            return self[word]
        ids = self.rare.get(word)
        if ids is None:
            ids = self._whole(word)
            if len(self.rare) < CACHE_WORDS // 4:
                self.rare[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if not self.plain or any([x in text for x in self.odd]):
            return self._whole(text)
        if self.high(text):
            return b"".join(map(self._rare, text.split()))
        return self._short_text(text)


def word_ids(path: str) -> WordIds:
    state = worker_state("word_ids")
    if path not in state:
        state[path] = WordIds(path)
    return state[path]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut every ``capacity`` ids."""
    ship()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    close = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer).text
        for batch in batches:
            for lo, hi in X.row_slices(batch.column(1), STEP_BYTES):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, value in enumerate(batch.column(1).slice(lo, hi - lo).to_pylist()):
                    raw = encode(value or "") + close
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        row.append(lo + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (piece, start, length, crc))]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, text).mapInArrow(run, schema)


@dataclass
class Plan:
    """Runs of equal seats: ranks ``rank + 0 .. bins * many - 1`` of ``length``
    sit ``many`` to a bin from ``offset`` on, in bins ``bin, bin + 1, ...``."""

    length: np.ndarray
    rank: np.ndarray
    many: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int

    def seat(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (self.length << 44) + self.rank
        at = np.searchsorted(key, (length << 44) + rank, "right") - 1
        step = rank - self.rank[at]
        return self.bin[at] + step // self.many[at], self.offset[at] + step % self.many[at] * length


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """[(length, times)] with the largest sum up to ``room``; long pieces first.

    Bit ``s`` of ``reach`` says that sum ``s`` can be made of the lengths so
    far; the bitsets before each length lead back to the combination.
    """
    reach, steps, whole = 1, [], 1 << room
    mask = (whole << 1) - 1
    for length in sorted((x for x in available if x <= room), reverse=True):
        before, left, times = reach, min(available[length], room // length), 1
        while left:  # powers of two of the length, as many as there are
            take = min(times, left)
            reach |= reach << (take * length) & mask
            left -= take
            times *= 2
        steps.append((length, before))
        if reach & whole:
            break
    total, found = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            found.append((length, n))
    return found


def minimum_slack_plan(counts: dict[int, int], capacity: int) -> Plan:
    left = {x: n for x, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, bins = [], 0
    while left:
        seed = max(left)
        left[seed] -= 1
        rest = fullest({x: n for x, n in left.items() if n}, capacity - seed)
        left[seed] += 1
        mix = dict(rest)
        mix[seed] = mix.get(seed, 0) + 1
        times = min(left[x] // n for x, n in mix.items())
        offset = 0
        for x, n in sorted(mix.items(), reverse=True):
            rows.append((x, used[x], n, bins, offset))
            used[x] += n * times
            offset += n * x
            left[x] -= n * times
            if not left[x]:
                del left[x]
        bins += times
    rows.sort()
    return Plan(*(np.array([r[i] for r in rows], np.int64) for i in range(5)), bins)


def pack(parts: DataFrame, *, id_col: str = "doc_id", capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (written once, read twice)."""
    ship()
    spark = parts.sparkSession
    parts = settle(parts, "pack-pieces")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = parts.withColumn("__b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per_bucket = keyed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n"))
    per_bucket = settle(per_bucket, "pack-counts")  # capacity x buckets rows at most
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = minimum_slack_plan(counts, capacity)
    before = per_bucket.select("length", "__b", (F.sum("n").over(Window.partitionBy("length").orderBy("__b")) - F.col("n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__b").orderBy(id_col, "piece", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("__rank", rank).join(before, ["length", "__b"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    ranked = ranked.select(*parts.columns, "__rank")
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = parts.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, batch.num_columns - 1))
            seat = plan.seat(length, rank) if len(length) else (length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, seat)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry ``ids``; a sequence holds ``capacity`` ids at most."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(pieces(docs, tokenizer, id_col=id_col, text=text, capacity=capacity, end_id=end_id), id_col=id_col, capacity=capacity)
