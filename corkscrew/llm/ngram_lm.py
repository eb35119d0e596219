"""Stupid-backoff language-model scores, computed relationally.

    S(w | u v) = c(u v w) / c(u v)   if c(u v w) >= min_count (1: every n-gram found)
               = alpha * S(w | v)    otherwise;  S(w) = c(w) / N

Tables:

* blocks: a few thousand texts each, as word numbers with the block's distinct
  word hashes (written once);
* n-gram rows: every distinct n-gram of a block with its count there, dealt to
  hash ranges (``bucket``);
* count table of a bucket: sums over blocks, joined back to the rows that asked.

A frequent n-gram is one entry per block, so no key is hot. Every n-gram is
counted and asked for. Scores are summed per document.

Defined results: null or empty texts have no tokens and score 0; repeated rows
are scored, and counted, each; ``mean_log_score`` is null without tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .spark import STEP_BYTES, settle, ship

BLOCK_BYTES = 8 << 20
#: Tokens a hash range may hold on average; more text makes more ranges.
RANGE_TOKENS = 4_000_000
BLOCK = "block long, counts boolean, asks boolean, tokens long, ids binary, bounds binary, vocab binary, words binary"


def _planes(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Integers byte plane by byte plane, deflated: uint32 for what one block
    bounds, int64 (``<i8``) for sums over the corpus."""
    return zlib.compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, int(kind[-1])).T).tobytes(), 1)


def _unplanes(raw: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(int(kind[-1]), -1).T).view(kind).reshape(-1)


def _steps(x: np.ndarray) -> bytes:
    """Ascending uint64 values as steps, byte plane by byte plane: the high
    planes of hashes from one narrow range are nearly all zero."""
    step = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unsteps(raw: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)
    return np.cumsum(step, dtype=np.uint64)


def blocks(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", counts: bool = True, asks: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in X.row_slices(batch.column(1), BLOCK_BYTES):
                column, hashes, bounds = batch.column(1).slice(lo, hi - lo), [], [np.zeros(1, np.int64)]
                for a, b in X.row_slices(column, STEP_BYTES // 2):  # the hashing needs many times the text
                    data, off = X.utf8(column.slice(a, b - a))
                    start, end, part = X.words(data, off)
                    hashes.append(X.span_hashes(data, start, end))
                    bounds.append(part[1:] + bounds[-1][-1])
                vocab, words = np.unique(np.concatenate(hashes), return_inverse=True)
                bounds = np.concatenate(bounds)
                ids = batch.column(0).slice(lo, hi - lo)
                known = np.asarray(ids.is_valid())
                raw = np.asarray(ids.fill_null(0)).astype("<i8").tobytes() + known.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (number, counts, asks, len(words), raw, bounds.astype("<i8").tobytes(), _steps(vocab), _planes(words))],
                    names=["block", "counts", "asks", "tokens", "ids", "bounds", "vocab", "words"],
                )
                number += 1

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, BLOCK)


class _Block:
    """A block's n-grams, the same at every step."""

    def __init__(self, row: dict, buckets: int):
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.hash = _unsteps(row["vocab"])[_unplanes(row["words"])]
        self.owner = X.owners(self.bounds)
        self.buckets = buckets
        self.count: dict[int, np.ndarray] = {}  # order -> count of the n-gram that starts at each token (0: none starts there)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, distinct hashes, number of each start's hash, times) of all n-grams."""
        if len(self.hash) < n:
            at = np.zeros(0, np.int64)
        else:
            at = np.flatnonzero(X.inside_text(self.owner, n))
        h = X.window_hashes(self.hash, n)[at] if len(at) else np.zeros(0, np.uint64)
        distinct, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        return at, distinct, inverse, times

    def cuts(self, distinct: np.ndarray) -> np.ndarray:
        """Borders of the buckets (equal ranges of the hash) in sorted hashes."""
        edge = np.array([(i << 64) // self.buckets for i in range(1, self.buckets)], np.uint64)
        return np.concatenate([[0], np.searchsorted(distinct, edge), [len(distinct)]])

    def learn(self, n: int, answers: list[dict]) -> None:
        at, distinct, inverse, _ = self.grams(n)
        cut = self.cuts(distinct)
        found = np.zeros(len(distinct), np.int64)
        for a in answers:
            if a["n"] == n:
                found[cut[a["bucket"]] : cut[a["bucket"] + 1]] = _unplanes(a["found"], "<i8")
        self.count[n] = np.zeros(len(self.hash), np.int64)
        self.count[n][at] = found[inverse]


def _asked(table: DataFrame, n: int, buckets: int) -> DataFrame:
    """n-gram rows of all blocks: (bucket, block, counts, asks, grams, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _Block(row, buckets)
                _, distinct, _, times = b.grams(n)
                cut = b.cuts(distinct)
                full = np.flatnonzero(np.diff(cut))
                if len(full):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["block"])), pa.array([row["counts"]] * len(full)), pa.array([row["asks"]] * len(full)),
                            pa.array([_steps(distinct[cut[j] : cut[j + 1]]) for j in full]), pa.array([_planes(times[cut[j] : cut[j + 1]]) for j in full]),
                        ],
                        names=["bucket", "block", "counts", "asks", "grams", "times"],
                    )

    return table.mapInArrow(run, "bucket int, block long, counts boolean, asks boolean, grams binary, times binary")


def _answered(asked: DataFrame, n: int) -> DataFrame:
    """Each row's n-grams joined to the bucket's count table: (block, n, bucket, found)."""

    def run(rows: pa.Table) -> pa.Table:
        got = rows.to_pylist()
        grams = [_unsteps(r["grams"]) for r in got]
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        times = np.concatenate([_unplanes(r["times"]).astype(np.int64) * r["counts"] for r in got])
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, times)  # in integers: no rounding, no limit below a long's
        found = total[inverse]
        to = np.cumsum([len(g) for g in grams])
        out = [(r["block"], n, r["bucket"], _planes(found[b - len(g) : b], "<i8")) for r, g, b in zip(got, grams, to) if r["asks"]]
        return pa.table({c: pa.array([o[i] for o in out], kind) for i, (c, kind) in enumerate((("block", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary())))})

    return asked.groupBy("bucket").applyInArrow(run, "block long, n int, bucket int, found binary")


def score(docs: DataFrame, corpus: DataFrame | None = None, *, id_col: str = "doc_id", text: str = "text", order: int = 3, min_count: int = 1, alpha: float = 0.4, buckets: int | None = None) -> DataFrame:
    """(id, n_tokens, log_score, mean_log_score) of each row of ``docs`` under
    the n-gram counts of ``corpus`` (``docs`` itself unless given).

    ``min_count`` holds for n-grams of two words and more; a word the corpus
    lacks counts as half a token. ``buckets``: hash ranges of the count tables (as many as the tokens need,
    64 and the shuffle partitions at least).
    """
    ship()
    spark = docs.sparkSession
    if corpus is None:
        table = blocks(docs, id_col=id_col, text=text)
    else:
        own = blocks(docs, id_col=id_col, text=text, counts=False).withColumn("block", F.col("block") * 2)
        table = own.unionByName(blocks(corpus, id_col=id_col, text=text, asks=False).withColumn("block", F.col("block") * 2 + 1))
    table = settle(table, "lm-blocks")
    size = table.agg(F.sum("tokens")).first()[0] or 0
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_TOKENS))
    answers = spark.createDataFrame([], "block long, n int, bucket int, found binary")
    none = F.array().cast("array<struct<n:int,bucket:int,found:binary>>")

    def with_answers(rows: DataFrame) -> DataFrame:
        got = answers.groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "found")).alias("answers"))  # of one block
        return rows.join(got, "block", "left").withColumn("answers", F.coalesce("answers", none))

    for n in range(1, order + 1):
        answers = answers.unionByName(settle(_answered(_asked(table, n, buckets), n), f"lm-answers-{n}"))
    tokens = table.where("counts").agg(F.sum("tokens")).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = _Block(row, buckets)
                for k in range(1, order + 1):
                    b.learn(k, row["answers"])
                yield _scored(b, row, order, min_count, alpha, tokens)

    return with_answers(table.where("asks" if corpus is None else "not counts")).mapInArrow(run, "id long, n_tokens long, log_score double, mean_log_score double").withColumnRenamed("id", id_col)


def _scored(b: _Block, row: dict, order: int, min_count: int, alpha: float, tokens: int) -> pa.RecordBatch:
    size = len(b.hash)
    log = np.log(np.maximum(b.count[1], 0.5) / tokens) if size else np.zeros(0)
    back = np.log(alpha)
    place = np.arange(size) - b.bounds[b.owner]
    for n in range(2, order + 1):
        log[place >= n - 1] += back  # a text's first tokens have no longer context to back off from
        # the n-gram that ends at token i starts at i - n + 1
        last = np.arange(n - 1, size)
        first = last - n + 1
        full = b.count[n][first]
        seen = full >= min_count
        log[last[seen]] = np.log(full[seen] / b.count[n - 1][first[seen]])
    n_docs = len(b.bounds) - 1
    total = np.bincount(b.owner, weights=log, minlength=n_docs).astype(float)  # without tokens numpy counts in integers
    n_tokens = np.diff(b.bounds)
    ids, known = np.frombuffer(row["ids"][: 8 * n_docs], "<i8"), np.frombuffer(row["ids"][8 * n_docs :], np.uint8) == 1
    none = n_tokens == 0
    mean = np.divide(total, n_tokens, out=np.zeros(n_docs), where=~none)
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(n_tokens), pa.array(total), pa.array(mean, mask=none)], names=["id", "n_tokens", "log_score", "mean_log_score"])
