"""Cleaning statistics and the fit/transform pair (FIXTURES.md §5)."""

import statistics

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from corkscrew.operators.cleaning import Preprocessor, PreprocessorModel, auto_clean, fit_stats, profile, quality_report
from corkscrew.operators.stats import distinct_and_mode, exact_quantiles, rank_within

ROWS = [
    # id, n1 (nulls, even count), n2 (outliers), n3 (constant), c_low, c_high
    (1, 1.0, 10.0, 5, "a", "h01"),
    (2, None, 11.0, 5, "b", "h02"),
    (3, 3.0, 12.0, 5, "b", "h03"),
    (4, 4.0, 13.0, 5, "a", "h04"),
    (5, None, 1000.0, 5, None, "h05"),
    (6, 8.0, -1000.0, 5, "c", "h06"),
    (7, 2.0, 14.0, 5, "c", "h07"),
    (8, 6.0, 15.0, 5, "a", "h08"),
    (9, 7.0, 16.0, 5, "d", "h09"),
    (10, 9.0, 17.0, 5, "e", "h10"),
    (11, 5.0, 18.0, 5, "f", "h11"),
    (12, 10.0, 19.0, 5, "b", None),
]
SCHEMA = "id int, n1 double, n2 double, n3 int, c_low string, c_high string"
FEATS = ["n1", "n2", "n3", "c_low", "c_high"]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_quantiles_both_paths(mixed):
    vals = [r[1] for r in ROWS if r[1] is not None]
    exp = float(np.quantile(vals, 0.5))
    assert exact_quantiles(mixed, ["n1"], [0.5])["n1"][0] == pytest.approx(exp)
    assert exact_quantiles(mixed, ["n1"], [0.5], max_distinct=0)["n1"][0] == pytest.approx(exp)
    q = exact_quantiles(mixed, ["n2"], [0.05, 0.95], max_distinct=0)["n2"]
    assert q == pytest.approx(list(np.quantile([r[2] for r in ROWS], [0.05, 0.95])))


def test_rank_within_hot_group(spark):
    # one group holds most rows: ranks stay exact and consecutive
    df = spark.createDataFrame([("hot" if i % 10 else "cold", i) for i in range(2000)], "g string, v int")
    r = rank_within(df, ["g"], ["v"], "rk", partitions=7)
    got = {(x["g"], x["v"]): x["rk"] for x in r.collect()}
    hot = sorted(v for (g, v) in got if g == "hot")
    assert [got[("hot", v)] for v in hot] == list(range(len(hot)))


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "x string")
    r = distinct_and_mode(df, ["x"]).first()
    assert r["distinct"] == 3 and r["mode"] == "a"


def test_fit_stats(mixed):
    s = fit_stats(mixed, FEATS)
    assert s.medians["n1"] == pytest.approx(statistics.median([r[1] for r in ROWS if r[1] is not None]))
    assert s.modes["c_low"] == "a" and s.low_card == ["c_low"] and s.high_card == ["c_high"]
    assert s.categories["c_low"] == ["a", "b", "c", "d", "e", "f"]
    assert "n3" not in s.kept  # constant column dropped


def test_unseen_values(spark, mixed):
    model = Preprocessor(features=FEATS, passthrough=["id"]).fit(mixed)
    new = spark.createDataFrame([(99, 1.0, 12.0, 5, "zzz", "h99")], SCHEMA)
    out = model.transform(new).first()
    s = model.stats
    onehot = [c for c in s.kept if c.startswith("c_low_")]
    # unseen low-cardinality value: every one-hot column at its "0" level
    for c in onehot:
        assert out[c] == pytest.approx((0.0 - s.center[c]) / s.scale[c])
    assert out["c_high"] == pytest.approx((-1.0 - s.center["c_high"]) / s.scale["c_high"])


def test_standardized_train_has_zero_mean_unit_std(mixed):
    model = Preprocessor(features=FEATS, passthrough=["id"]).fit(mixed)
    pdf = model.transform(mixed).toPandas()
    for c in model.output_columns:
        assert pdf[c].mean() == pytest.approx(0.0, abs=1e-9)
        assert pdf[c].std(ddof=0) == pytest.approx(1.0, abs=1e-9)


def test_save_load_same_output(spark, mixed, tmp):
    model = Preprocessor(features=FEATS, passthrough=["id"]).fit(mixed)
    model.write().overwrite().save(f"{tmp}/pre")
    again = PreprocessorModel.load(f"{tmp}/pre")
    a = sorted(tuple(r) for r in model.transform(mixed).collect())
    b = sorted(tuple(r) for r in again.transform(mixed).collect())
    assert a == b


def test_auto_clean_winsorizes(mixed):
    out = auto_clean(mixed.withColumnRenamed("c_high", "target"), target="target", id_col="id")
    assert "target" in out.columns and "n3" not in out.columns
    assert out.count() == len(ROWS)


def test_profile_and_quality(spark, mixed):
    prof = {r["column"]: (r["kind"], r["distinct"], r["nulls"]) for r in profile(mixed, FEATS).collect()}
    assert prof["n1"] == ("Numerical", 10, 2) and prof["c_low"][0] == "Categorical"
    q = quality_report(mixed, mixed, FEATS, FEATS[:4]).first()
    assert q["missing_before"] == 4 and q["drop_ratio"] == pytest.approx(0.2) and q["quality_score"] == 94.0


def test_size_switch_is_a_parameter(mixed):
    assert not fit_stats(mixed, FEATS).high_dim
    wide = fit_stats(mixed, FEATS, winsorize=True, high_dim_cols=3)
    assert wide.high_dim and not wide.clip and set(wide.center.values()) == {0.0}
    assert Preprocessor(features=FEATS, highDimCols=3).fit(mixed).stats.high_dim
    assert not Preprocessor(features=FEATS).fit(mixed).stats.high_dim
