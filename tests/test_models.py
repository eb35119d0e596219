"""Models, metrics, detection and selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corkscrew.operators import metrics, selection
from corkscrew.operators.detection import detect_task_type
from corkscrew.operators.models import ClosedFormClassifier, classification_registry, fit_pipeline, make_pipeline, regression_registry
from corkscrew.operators.sampling import holdout_split, stratified_sample
from corkscrew.plans.ml_plans import FEATS, lang_flags
from conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    return lang_flags(spark, SF_MID).cache()


@pytest.fixture(scope="module")
def split(data):
    return holdout_split(data, "id")


def acc(model, te):
    p = model.transform(te).select(F.col("target").alias("label"), F.col("prediction").cast("string"))
    return metrics.accuracy(p).first()[0]


def test_models_beat_dummy(split):
    tr, te = split
    reg = classification_registry("explo")
    dummy = acc(fit_pipeline(make_pipeline("DummyClassifier", reg["DummyClassifier"], {"kind": "prior"}, FEATS, "target", 4), tr), te)
    for name in ["MultinomialNB", "BernoulliNB", "RidgeClassifier", "RandomForestClassifier", "LogisticRegression"]:
        spec = reg[name]
        a = acc(fit_pipeline(make_pipeline(name, spec, dict(spec.defaults), FEATS, "target", 4), tr), te)
        assert a >= dummy, name


def test_regressors_beat_the_mean(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    data = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_extendedprice", "l_discount", "l_tax", net.alias("net")).cache()
    tr, te = holdout_split(data, "id")
    feats, reg = ["l_extendedprice", "l_discount", "l_tax"], regression_registry("explo")
    small = {"RandomForestRegressor": {"numTrees": 10, "maxDepth": 8}, "GBTRegressor": {"maxIter": 10}}
    for name in ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor"]:
        spec = reg[name]
        model = fit_pipeline(make_pipeline(name, spec, {**spec.defaults, **small.get(name, {})}, feats, "net", 0, tr.count()), tr)
        assert selection.evaluate(model, te, "net", "regression")["r2"] > 0.8, name


def test_forest_repeatable(split):
    tr, te = split
    spec = classification_registry()["RandomForestClassifier"]
    p = {"numTrees": 10, "maxDepth": 5}
    a = fit_pipeline(make_pipeline("RandomForestClassifier", spec, p, FEATS, "target", 4), tr).transform(te)
    b = fit_pipeline(make_pipeline("RandomForestClassifier", spec, p, FEATS, "target", 4), tr).transform(te)
    assert sorted(a.select("id", "prediction").collect()) == sorted(b.select("id", "prediction").collect())


def test_save_load_same_predictions(spark, data, tmp):
    selection.refit_and_save(data, FEATS, "target", "multi-classification", "BernoulliNB", {"kind": "bernoulli"}, tmp)
    p1 = selection.predict(data.drop("target"), tmp)
    p2 = selection.predict(data.drop("target"), tmp)
    assert p1.count() == data.count()
    assert sorted(p1.collect()) == sorted(p2.collect())


def test_metrics_against_python(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), ("c", "c")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    assert metrics.accuracy(df).first()[0] == pytest.approx(0.6)
    # per class F1: a 2/3, b 2*1/(2+2) = 0.5, c 2/3
    assert metrics.macro_f1(df).first()[0] == pytest.approx((2 / 3 + 0.5 + 2 / 3) / 3)
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, prediction double")
    assert metrics.r2(reg).first()[0] == pytest.approx(1 - 0.5 / 2.0)


def test_detection(spark):
    t = spark.createDataFrame([(i % 2, float(i), str(i % 3), i % 2) for i in range(100)], "b int, r double, s string, b2 int")
    assert detect_task_type(t, "b") == "binary-classification"
    assert detect_task_type(t, "r") == "regression"
    assert detect_task_type(t, "r", mode="as_run") == "multi-classification"
    assert detect_task_type(t, "s") == "multi-classification"
    assert detect_task_type(t, ["b", "b2"]) == "multi-label-classification"


def test_stratified_sample_keeps_every_class(data):
    s = stratified_sample(data, "id", "target", 0.3, 50_000)
    counts = {r["target"]: r["count"] for r in s.groupBy("target").count().collect()}
    full = {r["target"]: r["count"] for r in data.groupBy("target").count().collect()}
    for k, n in full.items():
        assert counts[k] == round(n * 0.3)


def test_leaderboard_failure_row_and_topn(spark, data):
    board = selection.run_models(data, FEATS, "target", "multi-classification", "lang", mode="explo",
                                 models=["DummyClassifier", "BernoulliNB"], sample=1.0, n_draws=2)
    bad = spark.createDataFrame([("lang", "explo", "Broken", {}, None, None, None, "boom")], selection.LEADERBOARD_SCHEMA)
    board = board.unionByName(bad)
    top = [r["model"] for r in selection.top_models(board, 5).orderBy("rank").collect()]
    assert top[-1] == "Broken"
    assert selection.best_model(board).first()["model"] == "BernoulliNB"


def test_ridge_gram_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3))
    y = np.where(X[:, 0] + 0.5 * X[:, 1] > 0, "pos", "neg")
    df = spark.createDataFrame([(float(a), float(b), float(c), str(t)) for (a, b, c), t in zip(X, y)], "a double, b double, c double, y string")
    m = ClosedFormClassifier(inputCols=["a", "b", "c"], labelCol="y", kind="ridge", alpha=1.0).fit(df)
    Xc = X - X.mean(0)
    t = np.where(y == "pos", 1.0, -1.0)
    w = np.linalg.solve(Xc.T @ Xc + np.eye(3), Xc.T @ (t - t.mean()))
    assert m.coef["weights"][1] == pytest.approx(list(w), rel=1e-6)
    pred = m.transform(df).select("y", "prediction").collect()
    assert sum(r["y"] == r["prediction"] for r in pred) / len(pred) > 0.9


def test_plain_sample_keeps_rows_at_tiny_ratios(spark):
    from corkscrew.operators.sampling import plain_sample

    ids = spark.range(400_000)
    assert 0 < plain_sample(ids, "id", 2.5e-5).count() < 60
    assert abs(plain_sample(ids, "id", 0.3).count() - 120_000) < 2_000


def test_statistics_of_names_with_apostrophes(spark):
    from corkscrew.operators.stats import moments

    df = spark.createDataFrame([(1.0,), (3.0,)], ["L'Aventure"])
    row = moments(df, ["L'Aventure"]).first()
    assert (row["column"], row["mean"], row["max_abs"]) == ("L'Aventure", 2.0, 3.0)


def test_fit_has_no_failed_naive_bayes(data):
    """Naive Bayes learns from unscaled flags, so no model of the run fails."""
    names = ["MultinomialNB", "BernoulliNB", "ComplementNB", "DummyClassifier"]
    out = selection.fit(data, "target", FEATS, "lang", mode="explo", n_draws=1, models=names)
    rows = {r["model"]: r for r in out["leaderboard"].collect()}
    assert set(rows) == set(names)
    assert all(r["error"] is None and r["accuracy"] is not None for r in rows.values())


def test_saved_pipeline_holds_its_dictionaries(spark, tmp):
    """More than ten values, some with apostrophes: the saved model reads nothing
    from the folder it was fitted in."""
    rows = [(i, f"L'Aven{i % 17}ture", float(i % 5), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, x double, target string")
    full = selection.refit_and_save(df, ["name", "x"], "target", "multi-classification", "RidgeClassifier", {"kind": "ridge"}, tmp)
    from pyspark.ml import PipelineModel

    back = PipelineModel.load(f"{tmp}/pipeline")
    path, size = back.stages[0].stats.dictionaries["name"]
    assert path.startswith(f"{tmp}/pipeline") and size == 17
    assert spark.read.parquet(path).count() == 17
    want = full.transform(df).select("id", "prediction").collect()
    assert sorted(back.transform(df).select("id", "prediction").collect()) == sorted(want)


def test_registry_strengths_and_modes():
    from corkscrew.operators.models import penalty, regression_registry

    assert penalty({"C": 2.0}, 50) == 0.01
    assert penalty({"alpha": 1.0}, 50) == 0.02
    assert classification_registry("explo")["GBTClassifier"].defaults["maxIter"] == 100
    assert classification_registry()["XGBClassifier"].defaults["rounds"] == 100
    assert regression_registry()["RandomForestRegressor"].defaults == {"numTrees": 100, "maxDepth": 30}
    assert "HuberRegressor" not in regression_registry()
    assert "HuberRegressor" in regression_registry("explo")


def test_queries_use_the_registry_defaults_and_draws(spark, monkeypatch):
    from corkscrew.plans import ml_plans
    from corkscrew.plans.registry import QUERIES

    seen = {}

    class Seen(Exception):
        pass

    def note(*args, **kw):
        seen["args"], seen["kw"] = args, kw
        raise Seen

    monkeypatch.setattr(ml_plans, "make_pipeline", note)
    for key, spec in [("mdl_boost_cls", classification_registry()["XGBClassifier"]), ("mdl_boost_reg", regression_registry()["XGBRegressor"]),
                      ("mdl_forest_reg", regression_registry("explo")["RandomForestRegressor"])]:
        with pytest.raises(Seen):
            QUERIES[key](spark, SF_SMALL)
        assert seen["args"][2] == spec.defaults, key
    for key, name in [("ml_search", "random_search"), ("ml_leaderboard", "run_models"), ("e2e_fit", "fit"), ("ml_fit_many", "fit_many")]:
        monkeypatch.setattr(selection, name, note)
        with pytest.raises(Seen):
            QUERIES[key](spark, SF_SMALL)
        assert seen["kw"].get("n_draws", selection.N_DRAWS) == selection.N_DRAWS and not seen["kw"].get("overrides"), key


@pytest.mark.parametrize("k", [2, 3])
def test_logistic_inside_a_task_equals_sparks(spark, k):
    """Coefficients of the Newton solver against Spark ML's under the same objective."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from corkscrew.operators.models import softmax_newton

    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) * [1.0, 4.0, 0.2]
    y = (x @ rng.normal(size=(3, k)) + rng.gumbel(size=(120, k))).argmax(1)
    w = rng.integers(1, 5, 120).astype(float)
    w1, b1, scale = softmax_newton(x, y, w, k, 0.02)
    each = [(*map(float, u), float(c)) for u, c, v in zip(x, y, w) for _ in range(int(v))]  # a weight stands for equal rows
    df = spark.createDataFrame(each, ["a", "b", "c", "y"]).coalesce(1)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df)
    m = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.02, tol=1e-12, maxIter=500).fit(df)
    want = m.coefficientMatrix.toArray()
    got = (w1 / scale)[1:] if k == 2 else w1 / scale
    np.testing.assert_allclose(got, want, atol=1e-5)
    free = np.array(m.interceptVector.toArray())
    np.testing.assert_allclose(b1[1:] if k == 2 else b1 - b1.mean(), free if k == 2 else free - free.mean(), atol=1e-4)
