"""Registered queries: task detection, models, metrics, selection, refit, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import whole_word_pattern
from ..operators.lexicon import lexicon_flags
from ..operators import metrics, selection
from ..operators.detection import task_type_df
from ..operators.cleaning import split_target
from ..operators.models import classification_registry, fit_pipeline, lars_rows, make_pipeline, regression_registry
from ..operators.ordered import fit_ordered_boosting
from ..operators.sampling import holdout_split
from ..session import scratch_path, table
from .registry import register
from .standins import EXTRA_GROUPS

FEATS = list(EXTRA_GROUPS)
R9 = 9
BUCKET = "(CAST(('0x' || substr(md5('42:' || CAST({id} AS VARCHAR)), 1, 8)) AS BIGINT) % 10000)"


def _flags_sql(col: str, groups: dict = EXTRA_GROUPS) -> str:
    return ", ".join(
        f"CAST(regexp_matches(lower(coalesce({col}, '')), '{whole_word_pattern(t)}') AS INTEGER) AS \"{g}\""
        for g, t in groups.items()
    )


LANG_SQL = f"SELECT doc_id AS id, {_flags_sql('text')}, lang AS target FROM documents"
LANG_TR = f"SELECT * FROM ({LANG_SQL}) WHERE {BUCKET.format(id='id')} >= 2000"
LANG_TE = f"SELECT * FROM ({LANG_SQL}) WHERE {BUCKET.format(id='id')} < 2000"


def lang_flags(spark, sf_dir):
    """Documents as a text-classification set: 7 lexicon flags -> language.

    Fitting and scoring pass over these rows many times, so they are a written
    table: each text is split once a query, not once a pass."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("target"))
    flags = lexicon_flags(d, "text", EXTRA_GROUPS, "word", keep=["id", "target"]).select("id", *FEATS, "target")
    path = scratch_path(spark, "lang-flags")
    flags.write.parquet(path)
    return spark.read.schema(flags.schema).parquet(path)


def quality_flags(spark, sf_dir):
    """Binary set: flags of labelled documents -> quality (and toxic)."""
    lab = table(spark, sf_dir, "labels")
    return lang_flags(spark, sf_dir).drop("target").join(lab.withColumnRenamed("doc_id", "id"), "id")


LINE_ID = "l_orderkey * 10 + l_linenumber"


def line_set(spark, sf_dir):
    """Regression set from lineitem: quantity, discount, tax -> extended price."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )


def _split(df):
    return holdout_split(df, "id")


def _nb_sql(kind: str, feats: list = FEATS, train: str = LANG_TR, test: str = LANG_TE) -> str:
    p = len(feats)
    names = [f'"{g}"' for g in feats]
    sums = ", ".join(f"CAST(sum({'CASE WHEN ' + g + ' > 0 THEN 1 ELSE 0 END' if kind == 'bernoulli' else g}) AS DOUBLE) AS s{i}" for i, g in enumerate(names))
    head = f"WITH tr AS ({train}), te AS ({test}), cs AS (SELECT target, count(*) AS n, {sums} FROM tr GROUP BY target), tot AS (SELECT sum(n) AS n FROM cs), "
    if kind == "multinomial":
        total = " + ".join(f"s{i}" for i in range(p))
        w = ", ".join(f"ln((s{i} + 1.0) / (({total}) + 1.0 * {p})) AS w{i}" for i in range(p))
        weights = f"w AS (SELECT target, ln(cs.n / tot.n) AS b, {w} FROM cs, tot), "
        xs = names
    else:
        pj = ", ".join(f"(s{i} + 1.0) / (cs.n + 2.0) AS p{i}" for i in range(p))
        b = "ln(n / tn)" + "".join(f" + ln(1 - p{i})" for i in range(p))
        w = ", ".join(f"ln(p{i}) - ln(1 - p{i}) AS w{i}" for i in range(p))
        weights = f"pp AS (SELECT target, cs.n AS n, tot.n AS tn, {pj} FROM cs, tot), w AS (SELECT target, {b} AS b, {w} FROM pp), "
        xs = [f"CASE WHEN {g} > 0 THEN 1.0 ELSE 0.0 END" for g in names]
    score = "b" + "".join(f" + CAST({x} AS DOUBLE) * w{i}" for i, x in enumerate(xs))
    return (
        head + weights
        + f"sc AS (SELECT te.id, te.target AS label, w.target AS cls, round({score}, {R9}) AS s FROM te, w), "
        "pred AS (SELECT id, label, cls AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, cls) AS rn FROM sc) WHERE rn = 1) "
    )


def _closed(kind: str, spark, sf_dir):
    tr, te = _split(lang_flags(spark, sf_dir))
    spec = classification_registry("explo")[{"multinomial": "MultinomialNB", "bernoulli": "BernoulliNB", "prior": "DummyClassifier"}[kind]]
    model = fit_pipeline(make_pipeline("x", spec, dict(spec.defaults), FEATS, "target", 0), tr)
    return model.transform(te)


@register("mdl_nb_multinomial", _nb_sql("multinomial") + "SELECT id, prediction FROM pred")
def q_nb_multinomial(spark, sf_dir):
    return _closed("multinomial", spark, sf_dir).select("id", "prediction")


@register("mdl_nb_bernoulli", _nb_sql("bernoulli") + "SELECT id, prediction FROM pred")
def q_nb_bernoulli(spark, sf_dir):
    return _closed("bernoulli", spark, sf_dir).select("id", "prediction")


DUMMY_SQL = (
    f"WITH tr AS ({LANG_TR}), te AS ({LANG_TE}), "
    "m AS (SELECT target AS prediction FROM tr GROUP BY target ORDER BY count(*) DESC, target LIMIT 1) "
)


@register("mdl_dummy_cls", DUMMY_SQL + "SELECT te.id, m.prediction FROM te, m")
def q_dummy_cls(spark, sf_dir):
    return _closed("prior", spark, sf_dir).select("id", "prediction")


LINE_SQL = f"SELECT {LINE_ID} AS id, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem"
LINE_TR = f"SELECT * FROM ({LINE_SQL}) WHERE {BUCKET.format(id='id')} >= 2000"
LINE_TE = f"SELECT * FROM ({LINE_SQL}) WHERE {BUCKET.format(id='id')} < 2000"


@register(
    "mdl_dummy_reg",
    f"WITH tr AS ({LINE_TR}), te AS ({LINE_TE}), m AS (SELECT avg(l_extendedprice) AS p FROM tr) "
    f"SELECT te.id, round(m.p, 6) AS prediction FROM te, m",
)
def q_dummy_reg(spark, sf_dir):
    tr, te = _split(line_set(spark, sf_dir))
    spec = regression_registry("explo")["DummyRegressor"]
    model = fit_pipeline(make_pipeline("DummyRegressor", spec, dict(spec.defaults), ["l_quantity"], "l_extendedprice", 0), tr)
    return model.transform(te).select("id", F.round("prediction", 6).alias("prediction"))


def _linear(spark, sf_dir):
    tr, te = _split(line_set(spark, sf_dir))
    spec = regression_registry()["LinearRegression"]
    model = fit_pipeline(make_pipeline("LinearRegression", spec, {}, ["l_quantity"], "l_extendedprice", 0), tr)
    return model, te


@register(
    "mdl_linear",
    f"WITH tr AS ({LINE_TR}) SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, "
    "round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM tr",
)
def q_linear(spark, sf_dir):
    model, _ = _linear(spark, sf_dir)
    lr = model.stages[-1]
    return spark.createDataFrame([(round(float(lr.coefficients[0]), 4), round(float(lr.intercept), 4))], "slope double, intercept double")


@register(
    "met_r2",
    f"WITH tr AS ({LINE_TR}), te AS ({LINE_TE}), c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, "
    "regr_intercept(l_extendedprice, l_quantity) AS b FROM tr), "
    "p AS (SELECT l_extendedprice AS y, b + a * l_quantity AS yhat FROM te, c) "
    "SELECT round(1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM p",
)
def q_r2(spark, sf_dir):
    model, te = _linear(spark, sf_dir)
    pred = model.transform(te).select(F.col("l_extendedprice").alias("label"), "prediction")
    return metrics.r2(pred).select(F.round("r2", 6).alias("r2"))


@register(
    "met_accuracy",
    _nb_sql("multinomial") + f"SELECT round(avg(CAST(label = prediction AS DOUBLE)), {R9}) AS accuracy FROM pred",
)
def q_accuracy(spark, sf_dir):
    p = _closed("multinomial", spark, sf_dir).select(F.col("target").alias("label"), "prediction")
    return metrics.accuracy(p).select(F.round("accuracy", R9).alias("accuracy"))


MACRO_F1_TAIL = (
    ", cl AS (SELECT label AS cls FROM pred UNION SELECT prediction FROM pred), "
    "per AS (SELECT cls, count(*) FILTER (WHERE label = cls AND prediction = cls) AS tp, "
    "count(*) FILTER (WHERE label <> cls AND prediction = cls) AS fp, "
    "count(*) FILTER (WHERE label = cls AND prediction <> cls) AS fn FROM cl, pred GROUP BY cls) "
    f"SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END), {R9}) AS macro_f1 FROM per"
)


@register("met_macro_f1", _nb_sql("multinomial").rstrip() + MACRO_F1_TAIL)
def q_macro_f1(spark, sf_dir):
    p = _closed("multinomial", spark, sf_dir).select(F.col("target").alias("label"), "prediction")
    return metrics.macro_f1(p).select(F.round("macro_f1", R9).alias("macro_f1"))


def _closed_board(spark, sf_dir):
    tr, te = _split(lang_flags(spark, sf_dir))
    reg = classification_registry("explo")
    rows = []
    for name in ["MultinomialNB", "BernoulliNB", "DummyClassifier"]:
        spec = reg[name]
        m = fit_pipeline(make_pipeline(name, spec, dict(spec.defaults), FEATS, "target", 0), tr)
        sc = selection.evaluate(m, te, "target", "multi-classification")
        rows.append(("documents.lang", "explo", name, {k: str(v) for k, v in spec.defaults.items()}, sc["accuracy"], sc["macro_f1"], None, None))
    return spark.createDataFrame(rows, selection.LEADERBOARD_SCHEMA)


BOARD_SQL = (
    "WITH a1 AS (" + _nb_sql("multinomial") + "SELECT 'MultinomialNB' AS model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM pred), "
    "a2 AS (" + _nb_sql("bernoulli") + "SELECT 'BernoulliNB' AS model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM pred), "
    "a3 AS (" + DUMMY_SQL + "SELECT 'DummyClassifier' AS model, avg(CAST(te.target = m.prediction AS DOUBLE)) AS accuracy FROM te, m), "
    "b AS (SELECT 'documents.lang' AS dataset, * FROM a1 UNION ALL SELECT 'documents.lang', * FROM a2 UNION ALL SELECT 'documents.lang', * FROM a3) "
)


@register(
    "ml_topn",
    BOARD_SQL + "SELECT dataset, model, round(accuracy, 9) AS accuracy, CAST(rank AS INTEGER) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC NULLS LAST, model) AS rank FROM b) WHERE rank <= 2",
)
def q_topn(spark, sf_dir):
    t = selection.top_models(_closed_board(spark, sf_dir), n=2)
    return t.select("dataset", "model", F.round("accuracy", R9).alias("accuracy"), "rank")


@register(
    "ml_best",
    BOARD_SQL + "SELECT dataset, model, round(accuracy, 9) AS accuracy FROM "
    "(SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, model) AS rn FROM b) WHERE rn = 1",
)
def q_best(spark, sf_dir):
    b = selection.best_model(_closed_board(spark, sf_dir))
    return b.select("dataset", "model", F.round("accuracy", R9).alias("accuracy"))


TASK_SQL = (
    "SELECT 'labels.quality' AS dataset, CASE WHEN count(DISTINCT quality) = 2 THEN 'binary-classification' "
    "WHEN count(DISTINCT quality) < 20 OR count(DISTINCT quality) / count(*) < 0.01 THEN 'multi-classification' ELSE 'regression' END AS task_type FROM labels "
    "UNION ALL SELECT 'documents.lang', CASE WHEN count(DISTINCT lang) = 2 THEN 'binary-classification' ELSE 'multi-classification' END FROM documents "
    "UNION ALL SELECT 'customer.c_acctbal', CASE WHEN count(DISTINCT c_acctbal) = 2 THEN 'binary-classification' "
    "WHEN count(DISTINCT c_acctbal) < 20 OR count(DISTINCT c_acctbal) / count(*) < 0.01 THEN 'multi-classification' ELSE 'regression' END FROM customer "
    "UNION ALL SELECT 'lineitem.l_quantity', CASE WHEN count(DISTINCT l_quantity) = 2 THEN 'binary-classification' "
    "WHEN count(DISTINCT l_quantity) < 20 OR count(DISTINCT l_quantity) / count(*) < 0.01 THEN 'multi-classification' ELSE 'regression' END FROM lineitem "
    "UNION ALL SELECT 'customer.c_acctbal (as_run)', CASE WHEN count(DISTINCT CAST(c_acctbal AS VARCHAR)) = 2 THEN 'binary-classification' ELSE 'multi-classification' END FROM customer "
    "UNION ALL SELECT 'labels.(quality, toxic)', CASE WHEN count(*) >= 0 THEN 'multi-label-classification' END FROM labels"
)


@register("ml_task_type", TASK_SQL)
def q_task_type(spark, sf_dir):
    cases = [
        ("labels.quality", table(spark, sf_dir, "labels"), ["quality"], "documented"),
        ("documents.lang", table(spark, sf_dir, "documents"), ["lang"], "documented"),
        ("customer.c_acctbal", table(spark, sf_dir, "customer"), ["c_acctbal"], "documented"),
        ("lineitem.l_quantity", table(spark, sf_dir, "lineitem"), ["l_quantity"], "documented"),
        ("customer.c_acctbal (as_run)", table(spark, sf_dir, "customer"), ["c_acctbal"], "as_run"),
        ("labels.(quality, toxic)", table(spark, sf_dir, "labels"), ["quality", "toxic"], "documented"),
    ]
    out = None
    for name, df, targets, mode in cases:
        one = task_type_df(df, targets, mode).select(F.lit(name).alias("dataset"), "task_type")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------- MLlib models


def _predict_with(name: str, spark, sf_dir, task: str = "classification", mode: str = "explo"):
    if task == "regression":
        data, feats, target = line_set(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
        spec = regression_registry(mode)[name]
        k = 0
    else:
        data, feats, target = lang_flags(spark, sf_dir), FEATS, "target"
        spec = classification_registry(mode)[name]
        k = 4
    tr, te = _split(data)
    model = fit_pipeline(make_pipeline(name, spec, dict(spec.defaults), feats, target, k, tr.count()), tr)
    return tr, model.transform(te).select("id", F.col(target).alias("label"), F.col("prediction").cast("string" if task != "regression" else "double"))


def _held_out(name: str, spark, sf_dir, task: str):
    """Each holdout row with the dummy's answer and whether the model predicts
    a class of the training rows (a finite number): an iterative fit has no SQL
    form, these have. A classifier's holdout score is also held against the
    dummy's; ``l_extendedprice`` does not depend on the features here, so that
    a regression need not beat the mean of it (tests use one that does)."""
    tr, pred = _predict_with(name, spark, sf_dir, task)
    label, p = F.col("label"), F.col("prediction")
    if task == "regression":
        dummy = tr.agg(F.avg("l_extendedprice")).first()[0]
        ok = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))
        return pred.select("id", F.round(F.lit(dummy), 6).alias("dummy"), ok.alias("valid"))
    count = tr.groupBy("target").count()
    dummy = count.orderBy(F.desc("count"), "target").first()["target"]
    s = pred.agg(F.avg((label == p).cast("double")).alias("own"), F.avg((label == F.lit(dummy)).cast("double")).alias("base")).first()
    known = count.select(F.col("target").alias("prediction"), F.lit(True).alias("known"))
    return pred.join(known, "prediction", "left").select("id", F.lit(dummy).alias("dummy"), F.coalesce("known", F.lit(False)).alias("valid"), F.lit(s["own"] >= s["base"]).alias("beats_dummy"))


HELD_OUT_SQL = {
    "classification": DUMMY_SQL + "SELECT te.id, m.prediction AS dummy, TRUE AS valid, TRUE AS beats_dummy FROM te, m",
    "regression": f"WITH tr AS ({LINE_TR}), te AS ({LINE_TE}), m AS (SELECT avg(l_extendedprice) AS p FROM tr) "
    "SELECT te.id, round(m.p, 6) AS dummy, TRUE AS valid FROM te, m",
}


def _model_query(key: str, name: str, task: str = "classification"):
    def q(spark, sf_dir):
        return _held_out(name, spark, sf_dir, task)

    q.__doc__ = f"Holdout predictions of {name} against the dummy's."
    register(key, HELD_OUT_SQL[task])(q)


for _key, _name, _task in [
    ("mdl_logistic", "LogisticRegression", "classification"),
    ("mdl_ridge_cls", "RidgeClassifier", "classification"),
    ("mdl_linear_svc", "LinearSVC", "classification"),
    ("mdl_nb_complement", "ComplementNB", "classification"),
    ("mdl_forest_cls", "RandomForestClassifier", "classification"),
    ("mdl_extra_trees_cls", "ExtraTreesClassifier", "classification"),
    ("mdl_bagging_cls", "BaggingClassifier", "classification"),
    ("mdl_adaboost_cls", "AdaBoostClassifier", "classification"),
    ("mdl_lgbm_cls", "LGBMClassifier", "classification"),
    ("mdl_mlp_cls", "MLPClassifier", "classification"),
    ("mdl_ridge_lasso", "ElasticNet", "regression"),
    ("mdl_ridge_reg", "Ridge", "regression"),
    ("mdl_lasso_reg", "Lasso", "regression"),
    ("mdl_huber", "HuberRegressor", "regression"),
    ("mdl_tree_reg", "DecisionTreeRegressor", "regression"),
    ("mdl_forest_reg", "RandomForestRegressor", "regression"),
]:
    _model_query(_key, _name, _task)


# ------------------------------------- models whose inner numbers SQL computes


def _root_sql(train: str, columns: list, values: str, g: str, h: str, l2: float = 1.0, min_h: float = 1.0) -> str:
    """Best split of the first round's roots: sums of the gradient and hessian
    on each side of every threshold, from the training rows."""
    wide = " UNION ALL ".join(f"SELECT output, '{c}' AS feature, {i} AS pos, CAST(\"{c}\" AS DOUBLE) AS x, g, h FROM r" for i, c in enumerate(columns))
    return (
        f"WITH tr AS ({train}), {values}, r AS (SELECT tr.*, v.output, {g} AS g, {h} AS h FROM tr, v), wide AS ({wide}), "
        "bins AS (SELECT output, feature, pos, x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM wide GROUP BY ALL), "
        "run AS (SELECT output, feature, pos, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER p AS ga, sum(h) OVER p AS ha FROM bins "
        "WINDOW w AS (PARTITION BY output, feature ORDER BY x), p AS (PARTITION BY output, feature)), "
        f"gains AS (SELECT *, round(0.5 * (gl * gl / (hl + {l2}) + (ga - gl) * (ga - gl) / (ha - hl + {l2}) - ga * ga / (ha + {l2})), 12) AS gain FROM run WHERE hl >= {min_h} AND ha - hl >= {min_h}), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY output ORDER BY gain DESC, pos, x) AS rn FROM gains) "
        "SELECT CAST(output AS INTEGER) AS output, feature, round(x, 6) AS threshold, round(gain, 5) AS gain, round(ha, 5) AS hessian FROM best WHERE rn = 1"
    )


def _roots(name: str, spark, sf_dir, task: str):
    if task == "regression":
        data, feats, target, spec = line_set(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", regression_registry()[name]
    else:
        data, feats, target, spec = lang_flags(spark, sf_dir), FEATS, "target", classification_registry()[name]
    tr, _ = _split(data)
    model = fit_pipeline(make_pipeline(name, spec, dict(spec.defaults), feats, target, 0), tr).stages[0]
    roots = model.trees(tr).where("round = 0 AND node = 0 AND feature IS NOT NULL")
    return roots.select("output", "feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 5).alias("gain"), F.round(F.col("sums")[1], 5).alias("hessian"))


@register("mdl_boost_cls", _root_sql(
    LANG_TR, FEATS,
    "c AS (SELECT target AS cls, count(*) / (SELECT count(*) FROM tr)::DOUBLE AS p, row_number() OVER (ORDER BY target) - 1 AS output FROM tr GROUP BY target), v AS (SELECT * FROM c)",
    "v.p - CASE WHEN tr.target = v.cls THEN 1 ELSE 0 END", "2 * v.p * (1 - v.p)"))
def q_boost_cls(spark, sf_dir):
    """Second-order boosting (all classes in one ensemble) on the language set: the first round's root splits."""
    return _roots("XGBClassifier", spark, sf_dir, "classification")


@register("mdl_boost_reg", _root_sql(
    LINE_TR, ["l_quantity", "l_discount", "l_tax"],
    "v AS (SELECT avg(l_extendedprice) AS m, 0 AS output FROM tr)", "v.m - tr.l_extendedprice", "1.0"))
def q_boost_reg(spark, sf_dir):
    """Second-order boosting of the squared error: the first round's root split."""
    return _roots("XGBRegressor", spark, sf_dir, "regression")


@register(
    "mdl_knn_reg",
    f"WITH tr AS ({LINE_TR}), te AS ({LINE_TE}), t AS (SELECT DISTINCT l_quantity AS a, l_discount AS b, l_tax AS c FROM tr), "
    "q AS (SELECT DISTINCT l_quantity AS a, l_discount AS b, l_tax AS c FROM te), "
    "d AS (SELECT q.a AS qa, q.b AS qb, q.c AS qc, t.a, t.b, t.c, round(sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c)), 9) AS d FROM q, t), "
    "near AS (SELECT *, rank() OVER (PARTITION BY qa, qb, qc ORDER BY d) AS rk FROM d QUALIFY rk <= 5), "
    "y AS (SELECT qa, qb, qc, l_extendedprice AS y, row_number() OVER (PARTITION BY qa, qb, qc ORDER BY d, l_extendedprice) AS rn FROM near JOIN tr ON l_quantity = near.a AND l_discount = near.b AND l_tax = near.c), "
    "p AS (SELECT qa, qb, qc, avg(y) AS prediction FROM y WHERE rn <= 5 GROUP BY ALL) "
    "SELECT te.id, round(prediction, 4) AS prediction FROM te JOIN p ON te.l_quantity = qa AND te.l_discount = qb AND te.l_tax = qc",
)
def q_knn_reg(spark, sf_dir):
    """Mean target of the 5 nearest training rows (quantity, discount, tax), by the metric join."""
    tr, te = _split(line_set(spark, sf_dir))
    spec = regression_registry()["KNeighborsRegressor"]
    model = fit_pipeline(make_pipeline("KNeighborsRegressor", spec, dict(spec.defaults), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 0), tr)
    return model.transform(te).select("id", F.round("prediction", 4).alias("prediction"))


LARS_FEATS = ["l_quantity", "l_discount", "l_tax"]
_pairs = [(a, b) for a in LARS_FEATS for b in [*LARS_FEATS, "l_extendedprice"]]


@register(
    "mdl_lars",
    f"WITH tr AS ({LINE_TR}), "
    "s AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, {LARS_FEATS.index(a)} AS pos, '{b}' AS b, covar_pop({a}, {b}) AS g FROM tr" for a, b in _pairs) + "), "
    "c AS (SELECT a, pos, g AS c FROM s WHERE b = 'l_extendedprice'), "
    "j AS (SELECT a, pos, abs(c) AS top, sign(c) AS sg FROM c ORDER BY abs(c) DESC, pos LIMIT 1), "
    "k AS (SELECT c.a, c.c, j.top, j.sg, j.a AS first, d.g AS gjj, e.g AS gkj FROM c, j, s d, s e "
    "WHERE c.a <> j.a AND d.a = j.a AND d.b = j.a AND e.a = c.a AND e.b = j.a), "
    "m AS (SELECT a, first, top, sg, least(CASE WHEN gjj > sg * gkj THEN (top - c) / (gjj - sg * gkj) END, CASE WHEN gjj > -sg * gkj THEN (top + c) / (gjj + sg * gkj) END) AS t, gjj FROM k), "
    "e AS (SELECT * FROM m ORDER BY t LIMIT 1) "
    "SELECT 0 AS step, first AS entered, round(top, 6) AS alpha, first AS feature, 0.0::DOUBLE AS coefficient FROM e "
    "UNION ALL SELECT 1, a, round(top - gjj * t, 6), first, round(sg * t, 6) FROM e",
)
def q_lars(spark, sf_dir):
    """First two knots of the least-angle path: who enters, at which alpha, the first feature's coefficient there."""
    tr, _ = _split(line_set(spark, sf_dir))
    path = lars_rows(tr, LARS_FEATS, "l_extendedprice")
    first = path.where("step = 0").select(F.col("entered").alias("feature")).limit(1)
    steps = path.where("step < 2").join(F.broadcast(first), "feature", "left_semi")
    return steps.select("step", "entered", F.round("alpha", 6).alias("alpha"), "feature", F.round("coefficient", 6).alias("coefficient"))


@register("ml_search")
def q_search(spark, sf_dir):
    """Seeded random search (``N_DRAWS`` draws) for a forest on the language set."""
    tr, te = _split(lang_flags(spark, sf_dir))
    spec = classification_registry()["RandomForestClassifier"]
    params, sc = selection.random_search("RandomForestClassifier", spec, tr, te, FEATS, "target", "multi-classification", 4)
    return spark.createDataFrame([({k: str(v) for k, v in params.items()}, sc["accuracy"], sc["macro_f1"])],
                                 "params map<string,string>, accuracy double, macro_f1 double")


@register("ml_leaderboard")
def q_leaderboard(spark, sf_dir):
    """Every stable classifier on the language set, ``N_DRAWS`` parameter sets each; failures are rows with an error."""
    return selection.run_models(lang_flags(spark, sf_dir), FEATS, "target", "multi-classification", "documents.lang", sample=1.0)


@register("e2e_fit")
def q_fit(spark, sf_dir):
    """Detect -> clean -> search (``N_DRAWS`` parameter sets a model) -> refit -> save; the leaderboard of the run."""
    out = scratch_path(spark, "fit")
    s = selection.fit(lang_flags(spark, sf_dir), "target", FEATS, "documents.lang", out_dir=out)
    return s["leaderboard"]


@register("ml_refit_save", "SELECT doc_id AS id, TRUE AS same, 'RandomForestClassifier' AS model FROM documents")
def q_refit_save(spark, sf_dir):
    """Refit the forest on all rows, save pipeline and metadata, read both back:
    does the reloaded pipeline answer every row as the fitted one did?"""
    out = scratch_path(spark, "refit")
    data = lang_flags(spark, sf_dir)
    fitted = selection.refit_and_save(data, FEATS, "target", "multi-classification", "RandomForestClassifier",
                                      {"numTrees": "20", "maxDepth": "10"}, out)
    before = fitted.transform(data).select("id", F.col("prediction").alias("first"))
    again = selection.predict(data.drop("target"), out)
    name = spark.read.parquet(f"{out}/meta").select("model")
    return again.join(before, "id").select("id", (F.col("first") == F.col("prediction")).alias("same")).crossJoin(F.broadcast(name))


@register("ml_predict", _nb_sql("bernoulli").replace(LANG_TR, LANG_SQL).replace(LANG_TE, LANG_SQL) + "SELECT id, prediction FROM pred")
def q_predict(spark, sf_dir):
    """Save a fitted pipeline, load it back and score every document."""
    out = scratch_path(spark, "predict")
    data = lang_flags(spark, sf_dir)
    selection.refit_and_save(data, FEATS, "target", "multi-classification", "BernoulliNB", {"kind": "bernoulli", "alpha": "1.0"}, out, mode="stable")
    return selection.predict(data.drop("target"), out)


@register("prj_target", "SELECT doc_id AS x_doc_id, quality AS y_target_quality, toxic AS y_target_toxic FROM labels")
def q_target(spark, sf_dir):
    """Columns named target... are the targets, all others features."""
    named = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target_quality"), F.col("toxic").alias("target_toxic"))
    feats, targets = split_target(named.columns)
    return named.select(*[F.col(c).alias(f"x_{c}") for c in feats], *[F.col(c).alias(f"y_{c}") for c in targets])


def _label_sql(label: str, part: str) -> str:
    return f"SELECT f.* EXCLUDE (target), CAST(l.{label} AS VARCHAR) AS target FROM ({part}) f JOIN labels l ON l.doc_id = f.id"


@register(
    "ml_multilabel",
    "WITH " + ", ".join(f"p_{y} AS ({_nb_sql('bernoulli', train=_label_sql(y, LANG_TR), test=_label_sql(y, LANG_TE))} SELECT * FROM pred)" for y in ("quality", "toxic"))
    + f" SELECT round(avg(CAST(q.label = q.prediction AND t.label = t.prediction AS DOUBLE)), {R9}) AS accuracy FROM p_quality q JOIN p_toxic t USING (id)",
)
def q_multilabel(spark, sf_dir):
    """quality and toxic: one Bernoulli naive Bayes per label, subset accuracy on the holdout."""
    data = quality_flags(spark, sf_dir).withColumn("quality", F.col("quality").cast("string")).withColumn("toxic", F.col("toxic").cast("string"))
    tr, te = _split(data)
    spec = classification_registry()["BernoulliNB"]
    pred = te
    for t in ["quality", "toxic"]:
        m = fit_pipeline(make_pipeline("BernoulliNB", spec, dict(spec.defaults), FEATS, t, 2), tr)
        pred = m.transform(pred).withColumnRenamed("prediction", f"pred_{t}")
    joint = selection.subset_accuracy(pred, ["quality", "toxic"], ["pred_quality", "pred_toxic"])
    return joint.select(F.round("accuracy", R9).alias("accuracy"))


@register("ml_fit_many")
def q_fit_many(spark, sf_dir):
    """Two data sets into one results table; the second call skips both."""
    path = scratch_path(spark, "results")
    sets = [
        ("documents.lang", lambda: lang_flags(spark, sf_dir), "target"),
        ("labels.quality", lambda: quality_flags(spark, sf_dir).drop("toxic"), "quality"),
    ]
    kw = {"models": ["BernoulliNB", "DummyClassifier", "LogisticRegression"], "mode": "explo"}
    selection.fit_many(spark, sets, path, **kw)
    return selection.fit_many(spark, sets, path, **kw)


@register(
    "snk_results",
    BOARD_SQL + "SELECT dataset, mode, model, round(accuracy, 9) AS accuracy FROM b, (VALUES ('explo'), ('stable')) AS t(mode)",
)
def q_results(spark, sf_dir):
    """Leaderboard rows appended to a Parquet table run after run."""
    from ..sources.writers import append_table

    path = scratch_path(spark, "board")
    board = _closed_board(spark, sf_dir)
    append_table(board, path, partition_by=["dataset"])
    append_table(board.withColumn("mode", F.lit("stable")), path, partition_by=["dataset"])
    return spark.read.parquet(path).select("dataset", "mode", "model", F.round("accuracy", R9).alias("accuracy"))


@register("cln_quality_score")
def q_quality_score(spark, sf_dir):
    """Quick forest check of cleaned data: 20 trees, depth 5, on at most 2000
    sampled rows and scored on the same rows."""
    from ..operators.cleaning import Preprocessor
    from ..operators.sampling import plain_sample

    data = lang_flags(spark, sf_dir)
    n = data.count()
    sample = plain_sample(data, "id", min(1.0, 2000 / max(n, 1)))
    pre = Preprocessor(features=FEATS, passthrough=["id", "target"]).fit(sample)
    clean = pre.transform(sample)
    spec = classification_registry()["RandomForestClassifier"]
    m = fit_pipeline(make_pipeline("RandomForestClassifier", spec, {"numTrees": 20, "maxDepth": 5}, pre.output_columns, "target", 4), clean)
    sc = selection.evaluate(m, clean, "target", "multi-classification")
    return spark.createDataFrame([(sc["accuracy"],)], "score_after double")


@register("mdl_ordered_boost")
def q_ordered_boost(spark, sf_dir):
    """Boosting on ordered statistics of language and source: quality of the held-out labelled documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("target")), "id")
    train, test = _split(rows)
    model = fit_ordered_boosting(train, "id", ["lang", "source"], ["n_chars"], "target")
    return model.transform(test).select("id", "prediction")
