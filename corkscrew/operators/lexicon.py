"""Lexicon flags: one 0/1 column per synonym group, and per-group counts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MATCH_COL, RUNS_COL, flags_from_matches, lowered, matched_terms, runs, whole_word_pattern
from ..functions.text import lexicon_flags as flag_columns


def lexicon_flags(
    df: DataFrame,
    text_col: str,
    lexicon: Mapping[str, Sequence[str]],
    mode: str = "word",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Add one flag per group (narrow, no shuffle).

    ``mode`` is ``word`` (whole words, used for training and serving),
    ``substring`` or ``group_name``; see ``functions.text.lexicon_flag``.
    In word mode a group is one linear whole-word pattern that Arrow matches
    over batches of lower-cased texts. A term that does not start and end with
    a word character has no such pattern: its lexicon is looked up in the runs
    of the text, one hash-set intersection per term width.
    """
    if mode != "word":
        return df.select(*[F.col(c) for c in keep], *flag_columns(text_col, lexicon, mode))
    if all(re.fullmatch(r"\w(.*\w)?", t, re.DOTALL) for terms in lexicon.values() for t in terms):
        return _matched_flags(df, text_col, lexicon, keep)
    with_runs = df.select(*[F.col(c) for c in keep], runs(text_col).alias(RUNS_COL))
    matched = with_runs.select(*[F.col(c) for c in keep], matched_terms(F.col(RUNS_COL), lexicon).alias(MATCH_COL))
    return matched.select(*[F.col(c) for c in keep], *flags_from_matches(lexicon))


def _matched_flags(df: DataFrame, text_col: str, lexicon: Mapping[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    kept = df.select(*[F.col(c) for c in keep])
    texts = df.select(*[F.col(c) for c in keep], lowered(text_col).alias(RUNS_COL))
    patterns = [whole_word_pattern([t.lower() for t in terms]) if terms else None for terms in lexicon.values()]
    out = T.StructType([*kept.schema.fields, *[T.StructField(g, T.IntegerType(), False) for g in lexicon]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            flags = [pc.match_substring_regex(text, p) if p else pa.repeat(False, batch.num_rows) for p in patterns]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[f.cast(pa.int32()) for f in flags]], names=out.names)

    return texts.mapInArrow(run, out)


def lexicon_counts(flags: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows per group with at least one hit: (group, documents).

    One aggregate over all flag columns, then a ``stack`` to long form.
    """
    sums = flags.agg(*[F.sum(F.col(g)).cast("bigint").alias(g) for g in groups])
    pairs = [x for g in groups for x in (F.lit(g), F.col("`" + g.replace("`", "``") + "`"))]
    long = sums.select(F.stack(F.lit(len(groups)), *pairs).alias("group", "documents"))
    return long.where(F.col("documents") > 0)
