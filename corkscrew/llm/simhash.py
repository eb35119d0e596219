"""SimHash near-duplicates: fingerprints, BK-trees, components.

A fingerprint has a bit set where over half of the text's word shingles
(XXH64) have it set. Fingerprints link at ``radius`` differing bits or fewer.

Linking: distinct fingerprints are dealt to shards by all choices of blocks
that must be equal (two differing bits spoil two of ``m`` blocks at most, so
each link lies in some shard). Every shard's BK-tree, children keyed by the
integer Hamming distance to their parent, is shared by all fingerprints of the
shard, which follow only the edges within the radius. Overfull shards are
dealt again by finer blocks: with 8 blocks, 48 bits are equal and a shard has
at most 65,536 distinct fingerprints whatever the data are. A shard reports a
spanning forest of its links, which keeps every component and stays linear.

Defined results: null or empty texts have fingerprint zero and link like any
other; rows without an id get a fingerprint but take no part in linking
(component null); repeated rows get the same answer each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .components import components
from .spark import STEP_BYTES, settle, ship

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _shingles(data: np.ndarray, off: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of shingles of each text)."""
    low = LOWER[data]
    start, end, bounds = X.words(low, off)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    # words of the step, each followed by one space
    size = end - start + 1
    to = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(int(to[-1]), 0x20, np.uint8)
    place = np.arange(len(joined)) - np.repeat(to[:-1], size)
    body = place < np.repeat(size - 1, size)
    joined[body] = low[(place + np.repeat(start, size))[body]]
    buf = joined.tobytes()
    count = np.diff(bounds)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.repeat(bounds[:-1], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    last = np.minimum(first + width, np.repeat(bounds[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(buf[a:b], seed) for a, b in zip(to[first].tolist(), (to[last + 1] - 1).tolist())), np.uint64, len(first))
    return h, n


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = (np.cumsum(n) - n)[full]
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > n[full, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of each row, as a long."""
    ship()
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in X.row_slices(batch.column(1), STEP_BYTES):
                h, n = _shingles(*X.utf8(batch.column(1).slice(lo, hi - lo)), shingle, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_majority(h, n).view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, schema)


class BKTree:
    """BK-tree over distinct 64-bit values, built and searched level by level."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.child = np.full((len(values), 65), -1, np.int32)
        point = np.arange(1, len(values))
        node = np.zeros(len(point), np.int64)
        while len(point):  # each level: distance to the node, first comer becomes the child there
            d = np.bitwise_count(values[point] ^ values[node]).astype(np.int64)
            slot, first = np.unique(node * 65 + d, return_index=True)
            self.child.reshape(-1)[slot] = point[first]
            node = self.child[node, d].astype(np.int64)
            rest = node != point
            point, node = point[rest], node[rest]

    def within(self, query: np.ndarray, radius: int, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, value number) pairs within ``radius``, in parts."""
        todo = [(np.arange(lo, min(lo + 4096, len(query))), np.zeros(min(4096, len(query) - lo), np.int64)) for lo in range(0, len(query), 4096)]
        while todo:
            q, node = todo.pop()
            if len(q) > step:
                todo += [(q[step:], node[step:])]
                q, node = q[:step], node[:step]
            d = np.bitwise_count(query[q] ^ self.values[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            qs, nodes = [], []
            for edge in range(-radius, radius + 1):
                at = d + edge
                ok = (at >= 0) & (at <= 64)
                to = self.child[node[ok], at[ok]]
                there = to >= 0
                qs.append(q[ok][there])
                nodes.append(to[there].astype(np.int64))
            q, node = np.concatenate(qs), np.concatenate(nodes)
            if len(q):
                todo.append((q, node))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest member of each of ``n`` values' component under ``pairs``."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            off = ra != rb
            if not off.any():
                break
            a, b = a[off], b[off]
            lo, hi = np.minimum(ra[off], rb[off]), np.maximum(ra[off], rb[off])
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _shard_keys(fp: str, blocks: int, radius: int) -> F.Column:
    """One (choice, equal bits) struct for each choice of blocks that are equal."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for i, spoilt in enumerate(combinations(range(blocks), radius)):
        mask = sum(((1 << (edges[j + 1] - edges[j])) - 1) << edges[j] for j in range(blocks) if j not in spoilt)
        keys.append(F.struct(F.lit(i).alias("choice"), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.explode(F.array(*keys))


def _shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """Spanning links inside each (choice, bits) shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"]

        def links(choice: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]), [True]]))
            a, b = [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = np.sort(fp[lo:hi])
                if len(own) > 1:
                    value = own.view(np.uint64)
                    root = _forest(len(own), BKTree(value).within(value, radius))
                    far = np.flatnonzero(root != np.arange(len(own)))
                    a.append(own[far])
                    b.append(own[root[far]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=names)

        rest = None  # the last shard of a batch may go on in the next one
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            choice, bits, _ = now
            if not len(choice):
                continue
            open_ = int(np.flatnonzero((choice != choice[-1]) | (bits != bits[-1]))[-1] + 1) if ((choice != choice[-1]) | (bits != bits[-1])).any() else 0
            if open_:
                yield links(*(x[:open_] for x in now))
            rest = [x[open_:] for x in now]
        if rest is not None:
            yield links(*rest)

    return shards.select("choice", "bits", "fp").repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, *, radius: int = 2, blocks: int = 4, fine_blocks: int = 8, max_shard: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints that keep every component."""
    ship()
    keyed = fps.select("fp").select("fp", _shard_keys("fp", blocks, radius).alias("k")).select("fp", "k.choice", "k.bits")
    size = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = settle(keyed.join(size, ["choice", "bits"]), "simhash-shards")
    near = _shard_links(keyed.where(F.col("n") <= max_shard), radius)
    full = keyed.where(F.col("n") > max_shard).select("fp").distinct()
    fine = full.select("fp", _shard_keys("fp", fine_blocks, radius).alias("k")).select("fp", "k.choice", "k.bits")
    return near.unionByName(_shard_links(fine, radius))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(id, fingerprint hex, component_id) of each row of ``docs``."""
    fps = settle(fingerprints(docs, id_col=id_col, text=text, shingle=shingle, seed=seed), "simhash-fp")
    distinct = settle(fps.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-distinct")
    roots = components(links(distinct, radius=radius))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    # Only members of groups with several fingerprints need the group's smallest id.
    smallest = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    out = fps.join(named, "fp", "left")
    return out.select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"),
    )
