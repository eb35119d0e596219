"""Ordered target statistics: categories as numbers without seeing the own label.

Rows stand in a seeded permutation (md5 of seed and id, then id). A category
of a training row becomes ``(sum + prior * strength) / (count + strength)``
over the rows of the same category that stand earlier; the row's own target
never enters. New rows get the same quotient over all training rows.

Prefix sums reach any group size: the permutation is cut into slices of the
hash range, so that a slice of one category holds about ``SLICE_ROWS`` rows
however frequent the category is. Sums inside (category, slice) are a window;
what earlier slices hold is added from one row a (category, slice). Slices
follow from the rows alone, so a lost task is computed again the same way.

Defined results: a null category is a category of its own; a null or NaN
target counts for nothing, its row is encoded like any other; a category's
first row gets ``prior``; an empty table gives an empty result; other columns
stay as they are. Ids should be distinct: rows that share one stand side by
side, in an order that only their targets decide.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small
from .trees import TreeEnsemble, class_number

#: Rows of one category in one window, about.
SLICE_ROWS = 100_000


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _code(c: str) -> Column:
    """Category as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), _q(c).cast("string")), F.lit("null"))


def _known(t: str) -> Column:
    y = _q(t).cast("double")
    return F.when(~F.isnan(y), y)


def encoded_name(category: str, target: str) -> str:
    return f"{category}__{target}"


def permutation_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), _q(id_col).cast("string")))


def _quotient(total: Column, n: Column, prior: float, strength: float) -> Column:
    return (F.coalesce(total, F.lit(0.0)) + prior * strength) / (F.coalesce(n, F.lit(0)) + strength)


def ordered_statistics(
    df: DataFrame, id_col: str, categories: Sequence[str], targets: Sequence[str], *, prior: float = 0.5, strength: float = 1.0, seed: int = 42, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``df`` with a column ``<category>__<target>`` for each pair of them."""
    slices = max(1, -(-df.count() // slice_rows))
    key = permutation_key(id_col, seed)
    place = F.coalesce(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(0))
    out = df.withColumns({"__key": key, "__slice": F.shiftright(place * slices, 32)})
    for c in categories:
        rows = out.withColumn("__code", _code(c))
        own = ["__code", "__slice"]
        sums = {f"__s{i}": F.sum(_known(t)) for i, t in enumerate(targets)} | {f"__n{i}": F.count(_known(t)) for i, t in enumerate(targets)}
        inside = Window.partitionBy(*own).orderBy("__key", id_col, *[_q(t) for t in targets]).rowsBetween(Window.unboundedPreceding, -1)
        # one row a (category, slice); read from the input, not from the columns added so far
        parts = df.select(_code(c).alias("__code"), F.shiftright(place * slices, 32).alias("__slice"), *[_q(t) for t in targets])
        parts = parts.groupBy(*own).agg(*[v.alias(k) for k, v in sums.items()])
        ahead = Window.partitionBy("__code").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(*own, *[F.sum(k).over(ahead).alias(f"{k}_ahead") for k in sums])
        rows = rows.withColumns({k: v.over(inside) for k, v in sums.items()}).join(parts, own)

        def both(k: str) -> Column:
            return F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"{k}_ahead"), F.lit(0))

        new = {encoded_name(c, t): _quotient(both(f"__s{i}"), both(f"__n{i}"), prior, strength) for i, t in enumerate(targets)}
        out = rows.withColumns(new).drop("__code", *sums, *[f"{k}_ahead" for k in sums])
    return out.drop("__key", "__slice")


@dataclass
class TargetTotals:
    """Sums and counts of every category over the training rows."""

    categories: list[str]
    targets: list[str]
    prior: float
    strength: float
    tables: dict[str, DataFrame]

    def apply(self, df: DataFrame) -> DataFrame:
        """Encoded columns for rows whose targets are not known; unseen categories get ``prior``."""
        for c in self.categories:
            joined = df.withColumn("__code", _code(c)).join(broadcast_if_small(self.tables[c]), "__code", "left")
            new = {encoded_name(c, t): _quotient(F.col(f"__s{i}"), F.col(f"__n{i}"), self.prior, self.strength) for i, t in enumerate(self.targets)}
            df = joined.withColumns(new).drop("__code", *[f"__{k}{i}" for k in "sn" for i in range(len(self.targets))])
        return df


def target_totals(df: DataFrame, categories: Sequence[str], targets: Sequence[str], *, prior: float = 0.5, strength: float = 1.0) -> TargetTotals:
    aggs = [a for i, t in enumerate(targets) for a in (F.sum(_known(t)).alias(f"__s{i}"), F.count(_known(t)).alias(f"__n{i}"))]
    tables = {c: df.groupBy(_code(c).alias("__code")).agg(*aggs) for c in categories}
    return TargetTotals(list(categories), list(targets), prior, strength, tables)


@dataclass
class OrderedBoosting:
    totals: TargetTotals
    ensemble: Model

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        out = self.ensemble.transform(self.totals.apply(df))
        return out.select(*[_q(c) for c in df.columns if c != "prediction"], "prediction")


def fit_ordered_boosting(
    df: DataFrame, id_col: str, categories: Sequence[str], numbers: Sequence[str], target: str, *, task: str = "classification", strength: float = 1.0, seed: int = 42, **config
) -> OrderedBoosting:
    """Second-order boosting on numbers and ordered statistics of the categories.

    Targets of the statistics: the value itself (regression, prior: its mean),
    or one indicator a class (the second one alone of two; prior: one by the
    number of classes). ``config``: numbers of ``trees.fit_boosting``. Rows
    without a target are left out. Training rows are encoded by earlier rows
    only; the gradients are those of plain boosting.
    """
    rows = df.where(_known(target).isNotNull() if task == "regression" else _q(target).isNotNull())
    if task == "regression":
        targets, prior = [target], rows.agg(F.avg(_known(target))).first()[0] or 0.0
    else:
        classes = sorted(r[0] for r in rows.select(_q(target)).distinct().collect())  # one row a class
        number = class_number(_q(target), classes)
        shown = [1] if len(classes) == 2 else range(len(classes))
        targets, prior = [f"__is{k}" for k in shown], 1.0 / max(1, len(classes))
        rows = rows.withColumns({f"__is{k}": (number == k).cast("double") for k in shown})
    encoded = ordered_statistics(rows, id_col, categories, targets, prior=prior, strength=strength, seed=seed)
    features = [*numbers, *[encoded_name(c, t) for c in categories for t in targets]]
    settings = {"kind": "boosting", "task": task, "seed": seed, **config}
    model = TreeEnsemble(inputCols=features, labelCol=target, config=json.dumps(settings)).fit(encoded)
    return OrderedBoosting(target_totals(rows, categories, targets, prior=prior, strength=strength), model)
