"""Cross-tokenizer alignment by lockstep merging.

Two tokenizers cut the same bytes (a space and the text) at different places.
Tokens of A and B whose byte ranges overlap are linked; byte offsets where
tokens of both end cut the text into groups.

1. *Tokens*: texts are cut before a space that stands alone between two other
   characters, the second of them visible. Neither tokenizer joins anything
   across such a place, so each distinct stretch of a batch is tokenized once
   and its ids and byte lengths are put together by place.
2. *Merging*: one NumPy state holds a pointer into A's and one into B's tokens
   for every document of the batch. Each step links the two tokens pointed at,
   records a cut where they end together, and moves the pointer of whichever
   ends first, or both. Finished documents are dropped from the state. A long
   document is several entries of the state, divided at places where tokens of
   both end (found by looking up every ``STRAND``-th end), so that it does not
   hold up the others.
3. *Counts*: a block (several steps of a task) lists its distinct linked id
   pairs with the number of its documents that hold each. Spark adds these up
   by pair, finds each A id's highest count, and joins the answers back to the
   blocks, whose documents then sum over their links.

A block is one row of bounded size: documents are added until ``BLOCK_LINKS``
entries; a single document's entries are bounded by its length. Pairs are
joined by plain shuffles with one row a block and pair, however often they
occur in it.

Defined results: null and empty texts, and texts whose tokens do not join to
their bytes (B's library reads U+2581 as a space), have no tokens: zeros and
an empty digest; they count as no document of any pair. Rows without an id
count and are returned like others, repeated rows as often as they occur; an
empty table gives an empty result. Equal counts are all highest. A very long
text is one step by itself and its memory grows with its length (tokens are a
few tens of bytes each). Columns other than id and text are not read. The
tokenizer files are sent to the executors as bytes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .spark import settle, ship, worker_state

#: A long document's state entries cover about this many tokens of A.
STRAND = 64
#: Text per step: a token takes some hundred bytes of arrays until its step ends.
STEP_BYTES = 1 << 19
#: Entries (documents times distinct pairs) after which a block is closed; about ten bytes each.
BLOCK_LINKS = 1 << 18
#: Blocks of one file: a scan may hold all rows of a file's batch at once, a write all of a file.
BLOCKS_PER_FILE = 8
#: Distinct stretches a worker remembers; others are tokenized each time.
CACHE_STRETCHES = 300_000
#: B ids are below this (both ids make one 64-bit pair).
PAIR_BASE = 1 << 32
PIECE_SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """Letters of byte-level tokens: visible Latin-1 characters stand for
    themselves, the other bytes for U+0100 onwards in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {**{chr(b): b for b in seen}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class TokenizerPair:
    """Ids and byte lengths of stretches under both tokenizers."""

    def __init__(self, byte_bpe: bytes, piece_model: bytes):
        import os

        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = byte_letters()
        vocabulary = {**json.loads(byte_bpe)["model"]["vocab"]}
        size = self.a.get_vocab_size()
        self.a_bytes = [b""] * size
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(PIECE_SPACE, " ").encode())
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[str, bytes] = {}  # do both join?, number of A ids, A ids, B ids

    def _tokens(self, stretches: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """(A ids, B ids, do both join to the bytes?) of stretches that start with a space."""
        a = [e.ids for e in self.a.encode_batch(stretches, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        out = []
        for s, x, y in zip(stretches, a, b):
            raw = s.encode()
            same = b"".join([self.a_bytes[i] for i in x]) == raw and b"".join([self.b_bytes[i] for i in y]) == raw
            out.append((np.array(x, "<i4").tobytes(), np.array(y, "<i4").tobytes(), same))
        return out

    def tokens(self, stretches: list[str]) -> list[tuple[bytes, bytes, bool]]:
        found = [self._known(s) for s in stretches]
        new = [i for i, f in enumerate(found) if f is None]
        for lo in range(0, len(new), 1024):
            part = new[lo : lo + 1024]
            for i, tokens in zip(part, self._tokens([stretches[i] for i in part])):
                found[i] = a, b, same = tokens
                if len(self.known) < CACHE_STRETCHES and len(stretches[i]) <= 64:
                    self.known[stretches[i]] = bytes([same]) + (len(a) // 4).to_bytes(2, "little") + a + b  # at most 257 ids
        return found

    def _known(self, stretch: str) -> tuple[bytes, bytes, bool] | None:
        kept = self.known.get(stretch)
        if kept is None:
            return None
        end = 3 + 4 * int.from_bytes(kept[1:3], "little")
        return kept[3:end], kept[end:], bool(kept[0])


def tokenizer_pair(byte_bpe: bytes, piece_model: bytes) -> TokenizerPair:
    state = worker_state("tokenizer_pairs")
    key = hashlib.sha256(byte_bpe).digest() + hashlib.sha256(piece_model).digest()
    if key not in state:
        state[key] = TokenizerPair(byte_bpe, piece_model)
    return state[key]


@dataclass
class Tokens:
    """Token ids of a batch and the byte offsets where they end; text ``d``
    owns tokens ``bounds[d]:bounds[d + 1]``."""

    ids: np.ndarray
    end: np.ndarray
    bounds: np.ndarray


def _gather(parts: list[bytes], which: np.ndarray, owner_bounds: np.ndarray, start: np.ndarray, size: np.ndarray, stay: np.ndarray) -> Tokens:
    flat = np.frombuffer(b"".join(parts), "<i4")
    many = np.array([len(p) // 4 for p in parts], np.int64)
    first = np.cumsum(many) - many
    count = np.where(stay, many[which], 0)
    of = np.repeat(np.arange(len(which)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    ids = flat[first[which][of] + inside]
    # a kept stretch's tokens fill its bytes exactly
    total = np.cumsum(size[ids])
    before = np.concatenate([[0], total])[np.cumsum(count) - count]
    end = total - before[of] + start[of]
    bounds = np.concatenate([[0], np.cumsum(count)])[owner_bounds]
    return Tokens(ids, end, bounds)


def tokenize(column: pa.Array, pair: TokenizerPair) -> tuple[Tokens, Tokens]:
    """Tokens of A and B of each text; texts that do not round-trip have none."""
    data, off = X.utf8(column)
    raw, start, bounds = X.stretches(data, off)
    n = len(start) - 1
    which, distinct = X.distinct_strings(raw, start)
    found = pair.tokens(distinct)
    owner = X.owners(bounds)
    wrong = np.zeros(len(off) - 1, bool)
    if n:
        good = np.array([f[2] for f in found])
        wrong[owner[~good[which]]] = True
    stay = ~wrong[owner]
    return tuple(_gather([f[k] for f in found], which, bounds, start[:-1], size, stay) for k, size in ((0, pair.a_size), (1, pair.b_size)))


@dataclass
class Links:
    """Linked tokens ``a[i]``-``b[i]``, and the last tokens ``cut_a[g]``,
    ``cut_b[g]`` of each group, all in text order."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def merge(a: Tokens, b: Tokens) -> Links:
    """All links and cuts of a batch, all documents in lockstep."""
    has = np.flatnonzero(np.diff(a.bounds) > 0)
    probe = np.setdiff1d(np.arange(STRAND - 1, len(a.end), STRAND), a.bounds[1:] - 1)
    if len(probe) and len(b.end):  # ends ascend over the whole batch
        at = np.minimum(np.searchsorted(b.end, a.end[probe]), len(b.end) - 1)
        joint = b.end[at] == a.end[probe]
        probe, at = probe[joint], at[joint]
    else:
        probe = at = np.zeros(0, np.int64)
    lo_a = np.concatenate([a.bounds[:-1][has], probe + 1])
    lo_b = np.concatenate([b.bounds[:-1][has], at + 1])
    order = np.argsort(lo_a)
    i, j = lo_a[order], lo_b[order]
    stop = np.append(i[1:], len(a.end))
    out: list[tuple] = []
    while len(i):
        ea, eb = a.end[i], b.end[j]
        cut = ea == eb
        out.append((i, j, cut))
        i = i + (ea <= eb)
        j = j + (eb <= ea)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    if not out:
        none = np.zeros(0, np.int64)
        return Links(none, none, none, none)
    i, j, cut = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(i + j, kind="stable")  # grows along a text and from text to text
    i, j, cut = i[order], j[order], cut[order]
    return Links(i, j, i[cut], j[cut])


class _Decimals:
    """Decimal text of ids as rows of digits, with room for a separator."""

    def __init__(self, size: int):
        self.width = len(str(size - 1)) + 1
        text = [str(i) for i in range(size)]
        self.digits = np.frombuffer("".join(t.ljust(self.width) for t in text).encode(), np.uint8).reshape(size, self.width)
        self.count = np.array([len(t) for t in text], np.int64)


def group_texts(a: Tokens, b: Tokens, links: Links) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of each text: bytes and offsets (a closing
    ``;`` follows each text's last group)."""
    state = worker_state("decimals")
    size = int(max(a.ids.max(initial=0), b.ids.max(initial=0))) + 1
    if state.get("size", 0) < size:
        state["size"], state["table"] = size, _Decimals(max(size, 1 << 16))
    table = state["table"]
    group_a = np.searchsorted(links.cut_a, np.arange(len(a.ids)))
    group_b = np.searchsorted(links.cut_b, np.arange(len(b.ids)))
    place_a = np.arange(len(a.ids)) + np.concatenate([[0], links.cut_b + 1])[group_a]
    place_b = np.arange(len(b.ids)) + links.cut_a[group_b] + 1
    n = len(a.ids) + len(b.ids)
    ids, separator = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    separator[place_a[links.cut_a]] = ord("|")
    separator[place_b[links.cut_b]] = ord(";")
    count = table.count[ids]
    end = np.cumsum(count + 1)
    out = np.empty(int(end[-1]) if n else 0, np.uint8)
    for lo in range(0, n, 1 << 18):
        some = ids[lo : lo + (1 << 18)]
        c = count[lo : lo + (1 << 18)]
        rows = table.digits[some]
        rows[np.arange(len(some)), c] = separator[lo : lo + (1 << 18)]
        first = int(end[lo - 1]) if lo else 0
        out[first : int(end[lo + len(some) - 1])] = rows[np.arange(table.width) <= c[:, None]]
    return out.tobytes(), np.concatenate([[0], end])[a.bounds + b.bounds]


class _Block:
    """Documents of one task, gathered until the block is closed."""

    def __init__(self):
        self.ids, self.stats, self.sha, self.texts = [], [], [], []
        self.pairs, self.times, self.sizes = [], [], []
        self.entries = 0

    def add(self, ids: pa.Array, a: Tokens, b: Tokens, links: Links, with_ids: bool) -> None:
        n = len(ids)
        owner = X.owners(a.bounds)[links.a] if len(links.a) else np.zeros(0, np.int64)
        pair = a.ids[links.a].astype(np.int64) * PAIR_BASE + b.ids[links.b]
        order = np.lexsort((pair, owner))
        pair, owner = pair[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])])) if len(pair) else np.zeros(0, np.int64)
        self.pairs.append(pair[first])
        self.times.append(np.diff(np.append(first, len(pair))))
        self.sizes.append(np.bincount(owner[first], minlength=n))
        groups = np.searchsorted(links.cut_a, a.bounds)
        self.stats.append(np.stack([np.diff(a.bounds), np.diff(b.bounds), np.diff(groups), np.bincount(owner, minlength=n)]))
        raw, off = group_texts(a, b, links)
        view = memoryview(raw)
        self.sha += ["" if y == x else hashlib.sha256(view[x : y - 1]).hexdigest() for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        if with_ids:
            self.texts += [(a.ids[p:q], b.ids[r:s]) for p, q, r, s in zip(a.bounds[:-1], a.bounds[1:], b.bounds[:-1], b.bounds[1:])]
        self.ids.append(ids)
        self.entries += len(first)

    def close(self, schema: pa.Schema, number: int) -> pa.RecordBatch:
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        ids = pa.chunked_array(self.ids).combine_chunks()
        n_a, n_b, n_groups, n_links = np.concatenate(self.stats, axis=1)
        columns = {"id": ids, "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links), "sha": pa.array(self.sha, pa.string())}
        columns["entries"] = pa.array(np.concatenate(self.sizes).astype(np.int32))
        if self.texts:
            columns["a_ids"] = pa.array([x for x, _ in self.texts], pa.list_(pa.int32()))
            columns["b_ids"] = pa.array([x for _, x in self.texts], pa.list_(pa.int32()))
        docs = schema.field("docs").type.value_type
        struct = pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in docs], fields=list(docs))

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        arrays = [
            pa.array([number], pa.int64()),
            one(struct),
            one(pa.array(pairs)),
            one(pa.array(np.bincount(at, minlength=len(pairs)).astype(np.int32))),
            one(pa.array(at.reshape(-1).astype(np.int32))),
            one(pa.array(np.concatenate(self.times).astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema)], schema=schema)


def blocks(docs: DataFrame, byte_bpe: bytes, piece_model: bytes, *, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Aligned blocks: ``docs`` (per document: id, counts, digest, number of
    entries, token ids if asked for), ``pairs`` with ``holders`` (documents of
    the block that hold each), and per document and distinct pair its place
    in ``pairs`` (``at``) and how often it is linked (``times``)."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    ship()
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((byte_bpe, piece_model))
    long, ints = T.LongType(), T.ArrayType(T.IntegerType())
    one = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("sha", T.StringType()), T.StructField("entries", T.IntegerType())])
    if with_ids:
        one = one.add("a_ids", ints).add("b_ids", ints)
    schema = T.StructType([T.StructField("block", long), T.StructField("docs", T.ArrayType(one)), T.StructField("pairs", T.ArrayType(long)), T.StructField("holders", ints), T.StructField("at", ints), T.StructField("times", ints)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(*files.value)
        task, number, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for lo, hi in X.row_slices(batch.column(1), STEP_BYTES):
                a, b = tokenize(batch.column(1).slice(lo, hi - lo), pair)
                block.add(batch.column(0).slice(lo, hi - lo), a, b, merge(a, b), with_ids)
                if block.entries >= BLOCK_LINKS:
                    yield block.close(arrow, task << 32 | number)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.close(arrow, task << 32 | number)

    return docs.select(id_col, text).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents a pair is linked, and
    whether no other pair of its A id is linked in more."""
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("count"))
    mine = Window.partitionBy(F.shiftright("pair", 32))  # one A id's pairs: at most B's vocabulary
    return counts.withColumn("best", F.col("count") == F.max("count").over(mine))


def align(docs: DataFrame, byte_bpe: str, piece_model: str, *, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, a_ids, b_ids])
    of each row of ``docs``; the tokenizers are given by their files."""
    raw = []
    for path in (byte_bpe, piece_model):
        with open(path, "rb") as f:
            raw.append(f.read())
    aligned = settle(blocks(docs, *raw, id_col=id_col, text=text, with_ids=with_ids), "align-blocks", BLOCKS_PER_FILE)
    counts = settle(pair_counts(aligned), "align-counts")
    asked = aligned.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("answers"))  # one block's pairs
    more = [c for c in ("a_ids", "b_ids") if with_ids]
    doc = aligned.schema["docs"].dataType.elementType
    fields = [T.StructField(id_col, doc["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())]
    schema = T.StructType([*fields, *(doc[c] for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs_, at, times, answers_ = (batch.column(i).slice(k, 1).flatten() for i in range(4))
                place, count, best = (answers_.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                total, top = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
                total[place], top[place] = count, best
                at, times = at.to_numpy(), times.to_numpy().astype(np.int64)
                end = np.concatenate([[0], np.cumsum(docs_.field("entries").to_numpy())])

                def sums(x: np.ndarray) -> pa.Array:
                    s = np.concatenate([[0], np.cumsum(x)])[end]
                    return pa.array(np.diff(s))

                columns = [docs_.field(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
                columns += [sums(times * top[at]), sums(times * total[at]), docs_.field("sha")]
                yield pa.RecordBatch.from_arrays([*columns, *(docs_.field(c) for c in more)], names=schema.names)

    return aligned.join(answers, "block", "left").select("docs", "at", "times", "answers").mapInArrow(run, schema)
