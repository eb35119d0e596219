"""Toxicity by a classifier chain.

Categories are predicted in a fixed order; each linear model sees the words of
the text and the probabilities of all earlier categories. While training,
those probabilities come from out-of-fold predictions, so that a later model
does not learn to trust an over-fitted earlier one.

The chain is fitted on a bounded sample of labelled rows (``sample_rows``);
words, folds and predictions of every document are computed on executors.

Defined results: a null or empty text has no words and gets the intercepts'
probabilities; a category whose sample has one class only predicts its share;
without any labelled row every probability is 0. Duplicate rows are scored
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .spark import STEP_BYTES, ship

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Shares of the text's bytes that serve as features beside the words.
SHAPES = ("upper", "digit", "symbol", "space")
#: Chi-square (one degree of freedom) that chance passes once in a thousand.
SIGNIFICANT = 10.83


@dataclass
class Category:
    name: str
    weights: np.ndarray  # words, shapes, earlier categories, intercept


@dataclass
class Chain:
    vocabulary: np.ndarray  # sorted 64-bit word hashes
    categories: list[Category]


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word hash) pairs, each once, and the shape matrix."""
    low = LOWER[data]
    start, end, bounds = X.spans(LETTER[data], off)
    h = X.span_hashes(low, start, end)
    owner = X.owners(bounds)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    kinds = np.zeros(256, np.uint8)
    kinds[65:91] = 1
    kinds[48:58] = 2
    kinds[~LETTER & ~X.SPACE] = 3
    kinds[X.SPACE] = 4
    size = np.maximum(np.diff(off), 1)
    shape = np.empty((len(off) - 1, len(SHAPES)), np.float64)
    for j in range(len(SHAPES)):
        c = np.concatenate([[0], np.cumsum(kinds[data] == j + 1)])
        shape[:, j] = (c[off[1:]] - c[off[:-1]]) / size
    return owner[new], h[new], shape


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logistic(row: np.ndarray, col: np.ndarray, size: int, dense: np.ndarray, y: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps on the pairs
    (text, word) and the dense columns behind the ``size`` words; last weight
    is the intercept."""
    n = len(y)
    share = y.mean() if n else 0.0
    w = np.zeros(size + dense.shape[1] + 1)
    if share in (0.0, 1.0):
        w[-1] = 35 if share else -35
        return w
    rest = np.hstack([dense, np.ones((n, 1))])
    forward = lambda u: np.bincount(row, weights=u[:size][col], minlength=n) + rest @ u[size:]
    back = lambda r: np.concatenate([np.bincount(col, weights=r[row], minlength=size), rest.T @ r])
    v = np.full(len(w), 1 / np.sqrt(len(w)))
    for _ in range(20):  # largest curvature by power iteration
        v = back(forward(v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1 / (0.25 * float(np.linalg.norm(forward(v))) ** 2 * 1.05 / n + l2)
    reg = np.full(len(w), l2)
    reg[-1] = 0
    ahead, t = w, 1.0
    for _ in range(steps):
        new = ahead - rate * (back(_sigmoid(forward(ahead)) - y) / n + reg * ahead)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def _select(owner: np.ndarray, h: np.ndarray, y: np.ndarray, min_texts: int) -> np.ndarray:
    """Every word in ``min_texts`` texts at least whose chi-square is
    significant (``SIGNIFICANT``) for any category."""
    vocab, code, df = np.unique(h, return_inverse=True, return_counts=True)
    n, best = len(y), np.zeros(len(vocab))
    for col in y.T:
        p = col.mean()
        if 0 < p < 1:
            hit = np.bincount(code, weights=col[owner], minlength=len(vocab))
            best = np.maximum(best, (hit - df * p) ** 2 / (df * p * (1 - p) * np.maximum(1 - df / n, 1e-9)))
    best[df < min_texts] = 0
    return vocab[best >= SIGNIFICANT]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    *,
    id_col: str = "doc_id",
    text: str = "text",
    sample_rows: int = 8000,
    folds: int = 3,
    min_texts: int = 4,
    l2: float = 1e-5,
    steps: int = 400,
) -> Chain:
    """Fit the chain on at most ``sample_rows`` labelled rows.

    The rows with the smallest hash of their id are taken: the same rows at
    every run, unrelated to their order. Rows without an id or a label take
    no part; an id labelled twice counts with its largest labels, an id on several rows of
    ``docs`` with its smallest text.
    """
    ship()
    ids = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
        .dropna()
        .orderBy(F.xxhash64(F.col(id_col)), id_col)
        .limit(sample_rows)
    )
    found = docs.select(id_col, text).join(F.broadcast(ids), id_col)
    sample = found.groupBy(id_col, *categories).agg(F.min(text).alias(text)).select(id_col, text, *categories)  # at most sample_rows rows
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("y", T.ArrayType(T.DoubleType())), T.StructField("shape", T.ArrayType(T.DoubleType())), T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for lo, hi in X.row_slices(column, STEP_BYTES):
                owner, h, shape = _features(*X.utf8(column.slice(lo, hi - lo)))
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                part = batch.slice(lo, hi - lo)
                y = np.column_stack([part.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(categories))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.string()), pa.array(list(y), pa.list_(pa.float64())), pa.array(list(shape), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))],
                    names=["id", "y", "shape", "words"],
                )

    rows = sample.mapInArrow(run, schema).toArrow()
    rows = rows.sort_by([("id", "ascending")])
    n = rows.num_rows
    if n == 0:
        return Chain(np.zeros(0, np.uint64), [Category(c, np.append(np.zeros(len(SHAPES) + i), -35.0)) for i, c in enumerate(categories)])
    lists = rows["words"].combine_chunks()
    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    h = lists.flatten().to_numpy().view(np.uint64)
    y = np.array(rows["y"].to_pylist(), float)
    vocab = _select(owner, h, y, min_texts)
    row, at = _known(owner, h, vocab)
    dense = np.array(rows["shape"].to_pylist(), float)
    fold = np.arange(n) % folds
    out = []
    for i, name in enumerate(categories):
        w = _logistic(row, at, len(vocab), dense, y[:, i], l2, steps)
        out.append(Category(name, w))
        if i + 1 < len(categories):
            score = lambda u: _sigmoid(np.bincount(row, weights=u[: len(vocab)][at], minlength=n) + dense @ u[len(vocab) : -1] + u[-1])
            held = np.empty(n)
            for f in range(folds):
                test = fold == f
                number = np.cumsum(~test) - 1  # of the texts that are left
                left = ~test[row]
                part = w if test.all() else _logistic(number[row[left]], at[left], len(vocab), dense[~test], y[~test, i], l2, steps)
                held[test] = score(part)[test]
            dense = np.hstack([dense, held[:, None]])
    return Chain(vocab, out)


def _known(owner: np.ndarray, h: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, vocabulary number) of the words that the vocabulary holds."""
    if not len(vocab):
        return owner[:0], owner[:0]
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    hit = vocab[at] == h
    return owner[hit], at[hit]


def predict(docs: DataFrame, chain: Chain, *, text: str = "text", suffix: str = "_p") -> DataFrame:
    """Add one probability column per category (``<category>_p``) to ``docs``;
    clashing columns are replaced."""
    ship()
    names = [c.name + suffix for c in chain.categories]
    docs = docs.drop(*[c for c in names if c in docs.columns])
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in X.row_slices(column, STEP_BYTES):
                owner, h, dense = _features(*X.utf8(column.slice(lo, hi - lo)))
                row, at = _known(owner, h, chain.vocabulary)
                for c in chain.categories:
                    words, rest = c.weights[: len(chain.vocabulary)], c.weights[len(chain.vocabulary) : -1]
                    p = _sigmoid(np.bincount(row, weights=words[at], minlength=hi - lo) + dense @ rest + c.weights[-1])
                    dense = np.hstack([dense, p[:, None]])
                probs = [pa.array(dense[:, len(SHAPES) + i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *probs], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
