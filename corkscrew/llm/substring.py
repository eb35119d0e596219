"""Substring dedup by anchor and window hashes, in place of relative Lempel-Ziv
parsing: no factors are matched greedily, and hashes are not checked on words.

Every 20-word window that also starts earlier in the corpus (smaller id, or
same document and earlier start) is a duplicate; words in such windows go.

The reference is the corpus itself, indexed by anchors: from each window of
``window`` words the ``gram``-word run with the smallest hash is an anchor, so
equal windows have equal anchors at equal places, and only about one position
in seven is indexed. An index block (hash partition of the anchors) holds for
each anchor its contexts, the longest stretch of words whose windows can use
that anchor, with the first place of each.

1. Factors: an occurrence whose whole context was seen earlier is a long
   factor; all windows in it are duplicates. Neighbouring ones with the same
   source and shift can be joined into one factor (``factors``, not called by
   the queries, which need the windows only).
2. Factor boundaries: where an anchor occurs in several contexts, the first
   occurrence of each context is checked window by window against the others.

Every duplicate window is found: its first copy sits at the first occurrence
of some context, so step 2 compares against it. Keys are two 64-bit hashes
(anchor, and context or window), so unequal words meet only if both agree.

Texts are shuffled by document only; hot passages are pre-aggregated (min)
and joined by plain shuffles that adaptive execution can split.

Defined results: null or empty texts have no words; rows without an id take no
part and keep all words; rows that share an id are copies of one document, of
which neither starts earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .spark import STEP_BYTES, settle, ship


def _anchors(h: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of full windows, anchor position of each): leftmost smallest gram hash."""
    start = np.flatnonzero(X.inside_text(owner, window)) if len(h) >= window else np.zeros(0, np.int64)
    if not len(start):
        return start, start
    g = X.window_hashes(h, gram)
    at = np.arange(len(g))
    best, place = g, at
    width, span = 1, window - gram + 1
    while width < span:  # sparse table: min over doubling widths, leftmost on ties
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, place = np.where(take, right, left), np.where(take, place[step:], place[: len(place) - step])
        width += step
    return start, place[start]


def _context(first: np.ndarray, anchor: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors with the first and last window start that use each.

    Windows of one anchor are consecutive in start order only if no other
    anchor cuts in; the leftmost-minimum rule makes them so.
    """
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    end = np.append(cut[1:], len(anchor)) - 1
    return anchor[cut], first[cut], first[end]


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = X.powers(X.WORD_BASE, len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
    return total, X.powers(pow(X.WORD_BASE, -1, 1 << 64), len(h) + 1)


def _range_hashes(prefix: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of words ``lo:hi`` (its length is part of the hash)."""
    total, down = prefix
    return X.mix((total[hi] - total[lo]) * down[lo] ^ (hi - lo).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def _parts(batch: pa.RecordBatch):
    for lo, hi in X.row_slices(batch.column(1), STEP_BYTES):
        data, off = X.utf8(batch.column(1).slice(lo, hi - lo))
        start, end, bounds = X.words(data, off)
        h = X.span_hashes(data, start, end)
        yield batch.slice(lo, hi - lo), data, start, end, bounds, h


def occurrences(docs: DataFrame, *, window: int = 20, gram: int = 8) -> DataFrame:
    """Anchor occurrences (anchor, context, id, lo, hi): words ``lo:hi`` of
    document ``id`` are covered by the windows that use the anchor."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, _, bounds, h in _parts(batch):
                owner = X.owners(bounds)
                start, anchor = _anchors(h, owner, window, gram)
                if not len(start):
                    continue
                at, first, last = _context(start, anchor, window, gram)
                prefix = _prefix(h)
                doc = owner[at]
                lo, hi = first, last + window
                key = _range_hashes(prefix, at, at + gram)
                # the anchor's place inside the context is part of its identity
                ctx = X.mix(_range_hashes(prefix, lo, hi) + (at - lo).astype(np.uint64))
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids[doc]), pa.array((lo - bounds[doc]).astype(np.int32)), pa.array((hi - lo).astype(np.int32))],
                    names=["anchor", "ctx", "id", "lo", "n"],
                )

    return docs.mapInArrow(run, "anchor long, ctx long, id long, lo int, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, start, win, anchor) for the windows of each row's ``spots`` (id, text, spots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, _, bounds, h in _parts(batch):
                spots = part.column(2)
                doc = np.repeat(np.arange(len(part)), np.diff(spots.offsets.to_numpy()))
                flat = spots.flatten()
                lo, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                fits = lo + n <= np.diff(bounds)[doc]  # rows that share an id may differ
                doc, lo, n, key = doc[fits], lo[fits], n[fits], flat.field(2).to_numpy()[fits]
                each = n - window + 1
                of = np.repeat(np.arange(len(doc)), each)
                start = lo[of] + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                base = bounds[:-1][doc][of]
                win = _range_hashes(_prefix(h), base + start, base + start + window)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc[of]]), pa.array(start.astype(np.int32)), pa.array(win.view(np.int64)), pa.array(key[of])],
                    names=["id", "lo", "win", "anchor"],
                )

    return docs.mapInArrow(run, "id long, lo int, win long, anchor long")


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with an equal key at an earlier (id, lo), with that first place."""
    first = rows.groupBy(*keys).agg(F.min(F.struct("id", "lo")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    here = F.struct("id", "lo")
    return rows.join(first, keys).where(here > F.col("first"))


def duplicate_spans(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = 20, gram: int = 8) -> DataFrame:
    """Spans (id, lo, n, src_id, src_lo): ``n`` words from word ``lo``
    of document ``id`` also stand at word ``src_lo`` of ``src_id``, earlier."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), text).where(F.col("id").isNotNull())
    occ = settle(occurrences(own, window=window, gram=gram), "rlz-occ")
    firsts = settle(
        occ.groupBy("anchor", "ctx").agg(F.min(F.struct("id", "lo", "n")).alias("first"), F.count(F.lit(1)).alias("copies")).select("anchor", "ctx", "first.*", "copies"),
        "rlz-index",
    )
    source = firsts.where("copies > 1").select("anchor", "ctx", F.col("id").alias("src_id"), F.col("lo").alias("src_lo"))
    long = occ.join(source, ["anchor", "ctx"]).where(F.struct("id", "lo") > F.struct("src_id", "src_lo"))
    long = settle(long.select("id", "lo", "n", "src_id", "src_lo"), "rlz-long")

    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("anchor")
    edge = firsts.join(several, "anchor").groupBy("id").agg(F.collect_list(F.struct("lo", "n", "anchor")).alias("spots"))  # within one document
    wins = settle(_windows(own.join(edge, "id").select("id", text, "spots"), window), "rlz-windows")
    short = _later(wins, ["anchor", "win"]).select("id", "lo", F.lit(window).alias("n"), F.col("first.id").alias("src_id"), F.col("first.lo").alias("src_lo"))
    return long.unionByName(short)


def factors(spans: DataFrame) -> DataFrame:
    """Greedy factors: overlapping or touching spans of a document with the
    same source and shift, joined (id, lo, n, src_id, src_lo)."""
    shift = F.col("src_lo") - F.col("lo")
    from pyspark.sql import Window

    w = Window.partitionBy("id", "src_id", "shift").orderBy("lo")
    gap = F.col("lo") > F.max(F.col("lo") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w)
    out = spans.withColumn("shift", shift).withColumn("run", run).groupBy("id", "src_id", "shift", "run")
    return out.agg(F.min("lo").alias("lo"), F.max(F.col("lo") + F.col("n")).alias("hi")).select("id", "lo", (F.col("hi") - F.col("lo")).alias("n"), "src_id", (F.col("lo") + F.col("shift")).alias("src_lo"))


def remove_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", window: int = 20, gram: int = 8) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words
    joined by one space) added; clashing columns are replaced."""
    ship()
    names = ["n_words", "n_removed", "kept_text"]
    docs = docs.drop(*[c for c in names if c in docs.columns])
    spans = settle(
        duplicate_spans(docs, id_col=id_col, text=text, window=window, gram=gram)
        .groupBy(F.col("id").alias("__id"))
        .agg(F.sort_array(F.collect_set(F.struct("lo", "n"))).alias("__spans")),  # within one document
        "rlz-spans",
    )
    key = F.col(id_col).cast("long")
    joined = docs.join(spans, key == F.col("__id"), "left").drop("__id")
    schema = T.StructType(docs.schema.fields + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            column = batch.column(at)
            for a, b in X.row_slices(column, STEP_BYTES):
                part = batch.slice(a, b - a)
                data, off = X.utf8(part.column(at))
                start, end, bounds = X.words(data, off)
                spans_ = part.column(part.num_columns - 1)
                spans_ = spans_.fill_null(pa.scalar([], spans_.type)) if spans_.null_count else spans_
                doc = np.repeat(np.arange(len(part)), np.diff(spans_.offsets.to_numpy()))
                flat = spans_.flatten()
                lo, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                lo = bounds[:-1][doc] + lo
                hi = np.minimum(lo + n, bounds[1:][doc])
                lo = np.minimum(lo, hi)
                step = np.zeros(len(start) + 1, np.int64)
                np.add.at(step, lo, 1)
                np.add.at(step, hi, -1)
                stay = np.cumsum(step)[:-1] == 0
                size = (end - start)[stay] + 1
                to = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(int(to[-1])) - np.repeat(to[:-1], size)
                body = place < np.repeat(size - 1, size)
                out = np.full(len(place), 0x20, np.uint8)
                out[body] = data[(place + np.repeat(start[stay], size))[body]]
                left = np.bincount(X.owners(bounds)[stay], minlength=len(part))
                last = np.concatenate([[0], np.cumsum(left)])
                raw = out.tobytes()
                kept = [raw[x : max(x, y - 1)].decode() for x, y in zip(to[last[:-1]].tolist(), to[last[1:]].tolist())]
                count = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(count.astype(np.int64)), pa.array((count - left).astype(np.int64)), pa.array(kept, pa.string())],
                    names=[*part.schema.names[:-1], *names],
                )

    return joined.mapInArrow(run, schema)

