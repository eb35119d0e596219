"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths (numpy, whole Arrow batches at once)
find n-grams and lines that occurred before in the same text; a text is
rejected when the characters inside them are too large a part of it.

Defined results: a null or empty text has no words and every measure is 0;
duplicate rows are judged one by one; extra columns pass through ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import text as X
from .spark import STEP_BYTES, ship

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    ``coverage``: n-gram length -> largest share of word characters that may
    lie inside n-grams seen before in the text (the published repetition
    limits, 0.15 for 5-grams to 0.10 for 10-grams). ``line_coverage``: the same
    for lines seen before. ``min_words`` and ``repeat_percent`` form the base
    rule on 3-word windows.
    """

    min_words: int = 50
    repeat_percent: int = 50
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    line_coverage: float = 0.30


def _measure(data: np.ndarray, off: np.ndarray, lengths: Sequence[int]) -> dict[str, np.ndarray]:
    n = len(off) - 1
    start, end, bounds = X.words(data, off)
    owner = X.owners(bounds)

    def per_text(weight: np.ndarray, of: np.ndarray = owner) -> np.ndarray:
        return np.bincount(of, weights=weight, minlength=n).astype(np.int64)

    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[end] - lead[start]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    seen = np.concatenate([[0], np.cumsum(symbol[data])])
    out = {"n_words": np.diff(bounds), "word_chars": per_text(chars), "n_symbols": seen[off[1:]] - seen[off[:-1]]}

    salt = X.mix(np.arange(1, n + 1, dtype=np.uint64))
    h = X.span_hashes(data, start, end)
    for k in (3, *lengths):
        if len(h) >= k:
            keep = np.flatnonzero(X.inside_text(owner, k))
            later, twice = X.repeats(X.window_hashes(h, k)[keep] ^ salt[owner[keep]])
            marks = np.zeros(len(h) - k + 1, bool)
            marks[keep] = twice if k == 3 else later
            hit = X.covered(marks, k, len(h))
        else:
            hit = np.zeros(len(h), bool)
        if k == 3:
            out["n_repeat_words"] = per_text(hit)
        else:
            out[f"chars_in_{k}grams"] = per_text(hit * chars)

    # Lines: runs between \n; only lines with a word count.
    lo, hi, lbounds = X.spans(data != 0x0A, off)
    lchars = (cum := np.concatenate([[0], np.cumsum(~X.SPACE[data] & ((data & 0xC0) != 0x80))]))[hi] - cum[lo]
    # an empty tail of a line holds no word, so runs without a word are dropped
    full = lchars > 0
    lowner = X.owners(lbounds)[full]
    later, _ = X.repeats(X.span_hashes(data, lo, hi)[full] ^ salt[lowner])
    out["n_dup_lines"] = per_text(later, lowner)
    out["chars_in_dup_lines"] = per_text(later * lchars[full], lowner)
    return out


def judge(docs: DataFrame, rules: QualityRules | None = None, text: str = "text") -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept`` to each row of ``docs``.

    Columns of ``docs`` that clash with a measure's name are replaced.
    """
    ship()
    rules = rules or QualityRules()
    lengths = sorted(rules.coverage)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_in_dup_lines", *(f"chars_in_{k}grams" for k in lengths)]
    docs = docs.drop(*[c for c in (*names, "base_failed", "kept") if c in docs.columns])
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in names] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for lo, hi in X.row_slices(column, STEP_BYTES):
                m = _measure(*X.utf8(column.slice(lo, hi - lo)), lengths)
                base = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])
                kept = ~base & (m["chars_in_dup_lines"] <= rules.line_coverage * m["word_chars"])
                for k in lengths:
                    kept &= m[f"chars_in_{k}grams"] <= rules.coverage[k] * m["word_chars"]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns, *(pa.array(m[c].astype(np.int64)) for c in names), pa.array(base), pa.array(kept)],
                    names=[*batch.schema.names, *names, "base_failed", "kept"],
                )

    return docs.mapInArrow(run, schema)
