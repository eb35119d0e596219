"""Cleaning as fit / transform pairs.

Every ``fit`` is a few aggregations that return a small statistics record
(medians, modes, category lists, means, scales) plus, for high-cardinality
columns, a code dictionary written as a table; every ``transform`` is one
projection with those statistics as literals (plus a join to a code
dictionary, broadcast only when its checked size is small).

Steps (in order): impute (median for numbers, most frequent value for
the rest) -> encode (one 0/1 column per value when a column has at most
10 values, else the value's position in sorted order, unseen -> -1) ->
drop constant columns -> scale ((x - mean) / population std, or x / max|x|
above ``high_dim_cols`` columns, if that is set).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import BROADCAST_MAX_ROWS
from .stats import (
    categorical_columns,
    distinct_and_mode,
    exact_quantiles,
    long_values,
    moments,
    null_counts,
    numeric_columns,
    sorted_codes,
)

LOW_CARD_MAX = 10


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, distinct, nulls): the typing decision per column.

    ``kind`` is Numerical for numeric Spark types and Categorical otherwise;
    ``distinct`` excludes nulls.
    """
    cols = list(cols or df.columns)
    nums = set(numeric_columns(df, cols))
    dm = {r["column"]: r["distinct"] for r in distinct_and_mode(df, cols).collect()} if cols else {}
    nulls = null_counts(df, cols)
    rows = [(c, "Numerical" if c in nums else "Categorical", int(dm.get(c, 0)), nulls[c]) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, distinct bigint, nulls bigint")


@dataclass
class CleanStats:
    num_cols: list = field(default_factory=list)
    cat_cols: list = field(default_factory=list)
    low_card: list = field(default_factory=list)
    high_card: list = field(default_factory=list)
    high_dim: bool = False
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    clip: dict = field(default_factory=dict)        # col -> [low, high]
    categories: dict = field(default_factory=dict)  # col -> sorted values (<= 10)
    dictionaries: dict = field(default_factory=dict)  # col -> [path, size]
    encoded: list = field(default_factory=list)     # columns after encoding
    kept: list = field(default_factory=list)        # after the constant drop
    center: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)


def impute_columns(stats: CleanStats) -> dict[str, Column]:
    out = {}
    for c in stats.num_cols:
        x = _q(c).cast("double")
        out[c] = F.when(x.isNull() | F.isnan(x), F.lit(stats.medians.get(c))).otherwise(x)
    for c in stats.cat_cols:
        out[c] = F.coalesce(_q(c).cast("string"), F.lit(stats.modes.get(c)))
    return out


def winsorize_columns(stats: CleanStats) -> dict[str, Column]:
    return {c: F.least(F.greatest(_q(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in stats.clip.items()}


def one_hot_name(col: str, value: str) -> str:
    return f"{col}_{value}"


def encode(df: DataFrame, stats: CleanStats, keep: Sequence[str] = ()) -> DataFrame:
    """Numbers as they are, one-hot for low cardinality, codes for high cardinality."""
    spark = df.sparkSession
    cols = [_q(c) for c in keep]
    cols += [_q(c).cast("double").alias(c) for c in stats.num_cols]
    for c in stats.low_card:
        cols += [(_q(c) == F.lit(v)).cast("double").alias(one_hot_name(c, v)) for v in stats.categories[c]]
    cols += [_q(c).alias(f"_raw_{c}") for c in stats.high_card]
    out = df.select(*cols)
    for c in stats.high_card:
        path, size = stats.dictionaries[c]
        d = spark.read.parquet(path).select(F.col("value").alias(f"_raw_{c}"), F.col("code").cast("double").alias(c))
        d = F.broadcast(d) if size <= BROADCAST_MAX_ROWS else d
        out = out.join(d, f"_raw_{c}", "left").withColumn(c, F.coalesce(_q(c), F.lit(-1.0))).drop(f"_raw_{c}")
    return out.select(*keep, *stats.encoded)


def scale_columns(stats: CleanStats) -> list[Column]:
    return [((_q(c) - F.lit(stats.center.get(c, 0.0))) / F.lit(stats.scale.get(c, 1.0))).alias(c) for c in stats.kept]


def fit_stats(
    df: DataFrame,
    features: Sequence[str],
    winsorize: bool = False,
    feature_kinds: dict | None = None,
    high_dim_cols: int | None = None,
) -> CleanStats:
    """Learn every statistic of the cleaning on ``df`` (the training rows).

    ``high_dim_cols``: above so many feature columns nothing is winsorised and
    x / max|x| replaces standardising (the reference: 1000); off unless given.
    """
    spark = df.sparkSession
    features = list(features)
    s = CleanStats(high_dim=high_dim_cols is not None and len(features) > high_dim_cols)
    if feature_kinds:
        s.num_cols = [c for c in features if feature_kinds.get(c, "").strip().lower() == "numerical"]
        s.cat_cols = [c for c in features if c not in s.num_cols]
    else:
        s.num_cols = numeric_columns(df, features)
        s.cat_cols = categorical_columns(df, features)
    med = exact_quantiles(df, s.num_cols, [0.5])
    s.medians = {c: med[c][0] for c in s.num_cols}
    if s.cat_cols:
        dm = {r["column"]: (r["distinct"], r["mode"]) for r in distinct_and_mode(df, s.cat_cols).collect()}
        s.modes = {c: dm.get(c, (0, None))[1] for c in s.cat_cols}
        s.low_card = [c for c in s.cat_cols if dm.get(c, (0, None))[0] <= LOW_CARD_MAX]
        s.high_card = [c for c in s.cat_cols if dm.get(c, (0, None))[0] > LOW_CARD_MAX]
    imputed = df.select(*[v.alias(c) for c, v in impute_columns(s).items()])
    if winsorize and not s.high_dim and s.num_cols:
        qs = exact_quantiles(imputed, s.num_cols, [0.05, 0.95])
        for c in s.num_cols:
            q05, q95 = qs[c]
            if q05 is not None and q95 - q05 > 0:  # so more than one value
                r = q95 - q05
                s.clip[c] = [q05 - 1.5 * r, q95 + 1.5 * r]
        if s.clip:
            imputed = imputed.withColumns(winsorize_columns(s))
    if s.low_card:
        pairs = long_values(imputed, s.low_card).distinct().collect()  # at most 10 per column
        for c in s.low_card:
            s.categories[c] = sorted(p["value"] for p in pairs if p["column"] == c)
    for c in s.high_card:
        path = scratch_path(spark, f"codes-{c}")
        codes = sorted_codes(imputed.select(F.col(c).alias("value")), "value")
        codes.write.mode("overwrite").parquet(path)
        s.dictionaries[c] = [path, spark.read.parquet(path).count()]
    s.encoded = (
        list(s.num_cols)
        + [one_hot_name(c, v) for c in s.low_card for v in s.categories[c]]
        + list(s.high_card)
    )
    enc = encode(imputed, s)
    m = {r["column"]: r for r in moments(enc, s.encoded).collect()} if s.encoded else {}
    s.kept = [c for c in s.encoded if m[c]["min"] is not None and m[c]["min"] != m[c]["max"]]
    for c in s.kept:
        if s.high_dim:
            s.center[c], s.scale[c] = 0.0, (m[c]["max_abs"] or 1.0)
        else:
            s.center[c], s.scale[c] = m[c]["mean"], (m[c]["std"] or 1.0)
    return s


def apply_stats(df: DataFrame, s: CleanStats, keep: Sequence[str] = (), scaled: bool = True, plain_prefix: str | None = None) -> DataFrame:
    """Impute -> (winsorise) -> encode -> drop constants -> scale (unless not ``scaled``), as projections.

    ``plain_prefix``: the unscaled columns follow under this prefix.
    """
    keep = list(keep)
    imputed = df.select(*[_q(c) for c in keep], *[v.alias(c) for c, v in impute_columns(s).items()])
    if s.clip:
        imputed = imputed.withColumns(winsorize_columns(s))
    enc = encode(imputed, s, keep)
    plain = [_q(c).alias(f"{plain_prefix}{c}") for c in s.kept] if plain_prefix else []
    return enc.select(*[_q(c) for c in keep], *(scale_columns(s) if scaled else [_q(c) for c in s.kept]), *plain)


class _StatsParams(Params):
    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    passthrough = Param(Params._dummy(), "passthrough", "columns carried unchanged (id, target)", TypeConverters.toListString)
    winsorize = Param(Params._dummy(), "winsorize", "clip numbers to [p5 - 1.5r, p95 + 1.5r]", TypeConverters.toBoolean)
    highDimCols = Param(Params._dummy(), "highDimCols", "feature columns above which x / max|x| replaces standardising and winsorising is off (unset: never)", TypeConverters.toInt)


class Preprocessor(Estimator, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: learns the cleaning statistics on the training rows."""

    def __init__(self, features: Sequence[str] = (), passthrough: Sequence[str] = (), winsorize: bool = False, highDimCols: int | None = None):
        super().__init__()
        self._setDefault(features=[], passthrough=[], winsorize=False)
        self._set(features=list(features), passthrough=list(passthrough), winsorize=winsorize, highDimCols=highDimCols)

    def _fit(self, df: DataFrame) -> PreprocessorModel:
        feats = self.getOrDefault(self.features) or [c for c in df.columns if c not in self.getOrDefault(self.passthrough)]
        limit = self.getOrDefault(self.highDimCols) if self.isDefined(self.highDimCols) else None
        s = fit_stats(df, feats, self.getOrDefault(self.winsorize), high_dim_cols=limit)
        return PreprocessorModel(stats_json=json.dumps(asdict(s)), passthrough=self.getOrDefault(self.passthrough))


class PreprocessorModel(Model, MLReadable, MLWritable):
    """Transformer: applies the learnt statistics as one projection.

    Saving copies the code dictionaries beside the metadata, so a saved model
    needs nothing from the folder that it was fitted in.
    """

    stats_json = Param(Params._dummy(), "stats_json", "learnt statistics", TypeConverters.toString)
    passthrough = Param(Params._dummy(), "passthrough", "columns carried unchanged", TypeConverters.toListString)
    scaled = Param(Params._dummy(), "scaled", "apply the last step, scaling", TypeConverters.toBoolean)

    def __init__(self, stats_json: str = "{}", passthrough: Sequence[str] = (), scaled: bool = True):
        super().__init__()
        self._setDefault(stats_json="{}", passthrough=[], scaled=True)
        self._set(stats_json=stats_json, passthrough=list(passthrough), scaled=scaled)

    @property
    def stats(self) -> CleanStats:
        return CleanStats(**json.loads(self.getOrDefault(self.stats_json)))

    @property
    def output_columns(self) -> list[str]:
        return list(self.stats.kept)

    def unscaled(self) -> PreprocessorModel:
        """The same cleaning without scaling, for models of counts and flags."""
        return PreprocessorModel(self.getOrDefault(self.stats_json), self.getOrDefault(self.passthrough), scaled=False)

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in self.getOrDefault(self.passthrough) if c in df.columns]
        return apply_stats(df, self.stats, keep, self.getOrDefault(self.scaled))

    def write(self) -> MLWriter:
        return _PreprocessorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PreprocessorReader(cls)


class _PreprocessorWriter(MLWriter):
    def __init__(self, model: PreprocessorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        stats = self.model.stats
        for i, c in enumerate(stats.high_card):
            spark.read.parquet(stats.dictionaries[c][0]).write.parquet(f"{path}/codes/{i}")


class _PreprocessorReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        stats = model.stats
        for i, c in enumerate(stats.high_card):
            stats.dictionaries[c][0] = f"{path}/codes/{i}"
        return model._set(stats_json=json.dumps(asdict(stats)))


def split_target(columns: Sequence[str], target: str | Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(features, targets): columns named ``target*``, else the last column."""
    if target:
        targets = [target] if isinstance(target, str) else list(target)
    else:
        targets = [c for c in columns if str(c).startswith("target")] or [columns[-1]]
    return [c for c in columns if c not in targets], targets


def auto_clean(df: DataFrame, target: str | None = None, id_col: str | None = None, feature_kinds: dict | None = None) -> DataFrame:
    """One-call recipe (with winsorising): fit on all rows and transform them.

    Returns the cleaned features plus the target (and the id, if given).
    """
    cols = [c for c in df.columns if c != id_col]
    feats, targets = split_target(cols, target)
    s = fit_stats(df, feats, winsorize=True, feature_kinds=feature_kinds)
    keep = ([id_col] if id_col else []) + targets
    return apply_stats(df, s, keep)


def quality_report(before: DataFrame, after: DataFrame, before_cols: Sequence[str], after_cols: Sequence[str]) -> DataFrame:
    """One row: missing cells before / after, share of columns dropped, and
    ``round(min(100, 100 - 30 * drop_ratio), 2)``."""
    spark = before.sparkSession
    mb = sum(null_counts(before, before_cols).values())
    ma = sum(null_counts(after, after_cols).values())
    ratio = 1 - len(after_cols) / max(len(before_cols), 1)
    score = round(min(100.0, 100 - 30 * ratio), 2)
    return spark.createDataFrame(
        [(int(mb), int(ma), float(ratio), float(score))],
        "missing_before bigint, missing_after bigint, drop_ratio double, quality_score double",
    )
