"""Model selection: seeded search, leaderboard, refit on all rows, prediction.

The loop over models runs on the driver; every fit and every score is a
distributed Spark job. Independent fits are submitted from a small thread
pool (``parallelism``), as ``TrainValidationSplit`` does.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import metrics
from .cleaning import Preprocessor, apply_stats
from .detection import MULTILABEL, REGRESSION, detect_task_type
from .blocks import ROWS_PER_PARTITION, WEIGHT, Held, blocks, compact
from .models import Spec, fit_pipeline, fits_in_task, make_pipeline, predict_in_task, registry
from .trees import bin_edges, class_number
from ..session import cut_lineage
from .sampling import holdout_split, plain_sample, stratified_sample
from ..sources.readers import path_exists

LEADERBOARD_SCHEMA = (
    "dataset string, mode string, model string, params map<string,string>, "
    "accuracy double, macro_f1 double, r2 double, error string"
)
# Share of the rows that the model search works on, by mode (1: all of them).
SEARCH_SHARE = {"stable": 0.3, "explo": 1.0}
# Parameter sets tried per model: the defaults and seeded draws.
N_DRAWS = 50
# Parameter sets that a halving search compares on all rows, about.
LAST_RUNG = 6
PLAIN = "__plain_"


def draw_params(spec: Spec, n_draws: int, seed: int = 42) -> list[dict]:
    """Defaults first, then ``n_draws - 1`` seeded draws from the ranges
    (integers for counts and depths, else uniform)."""
    out = [dict(spec.defaults)]
    rng = np.random.default_rng(seed)
    for _ in range(max(0, n_draws - 1)):
        p = dict(spec.defaults)
        for name, (lo, hi, integer) in spec.ranges.items():
            p[name] = int(rng.integers(lo, hi + 1)) if integer else float(rng.uniform(lo, hi))
        out.append(p)
    return out


def evaluate(model, valid: DataFrame, target: str, task_type: str, weight: str | None = None) -> dict:
    """Scores on ``valid``, whose rows may stand for several (``weight``)."""
    more = [weight] if weight else []
    pred = model.transform(valid).select(F.col(target).alias("label"), F.col("prediction"), *more)
    if task_type != REGRESSION:
        pred = pred.select(F.col("label").cast("string"), F.col("prediction").cast("string"), *more)
    return metrics.weighted(pred, weight, task_type) if weight else metrics.score(pred, task_type)


class SearchSet:
    """Training and holdout rows of a search: equal rows (features and target)
    are one weighted row, and ``share`` of the rows is drawn by id."""

    def __init__(self, train: DataFrame, valid: DataFrame, features: Sequence[str], target: str, id_col: str | None, seed: int):
        self.train, self.valid, self.features, self.target = train, valid, list(features), target
        self.id_col, self.seed = (id_col if id_col in train.columns else None), seed
        self.parts: dict = {}
        self.cached: list[DataFrame] = []
        self.lock = threading.Lock()

    def _compact(self, df: DataFrame) -> DataFrame:
        """Weighted rows in as many partitions as their number asks for: every
        step of an iterative fit is a job with a task a partition."""
        found = compact(df, [*self.features, self.target]).cache()
        self.cached.append(found)
        return found.coalesce(max(1, -(-found.count() // ROWS_PER_PARTITION)))

    def rows(self, share: float) -> tuple[DataFrame, DataFrame, float]:
        """(training rows, holdout rows, number of rows that the training rows stand for)."""
        with self.lock:
            if share not in self.parts:
                some = plain_sample(self.train, self.id_col, share, self.seed + 2) if share < 1 and self.id_col else self.train
                train = self._compact(some)
                valid = self.parts[1.0][1] if 1.0 in self.parts else self._compact(self.valid)
                self.parts[share] = (train, valid, float(train.agg(F.sum(WEIGHT)).first()[0] or 0))
                self.parts.setdefault("valid", valid)
            train, valid, n = self.parts[share]
            return train, self.parts["valid"], n

    def held(self, share: float, task_type: str):
        """The rows as arrays for fits inside tasks, None if they are many:
        (training (X, Y, w), holdout (X, Y, w), edges, classes)."""
        train, valid, _ = self.rows(share)
        with self.lock:
            key = ("held", share)
            if key not in self.parts:
                if max(train.count(), valid.count()) > ROWS_PER_PARTITION:
                    self.parts[key] = None
                else:
                    classes, number = [], F.col(f"`{self.target}`").cast("double")
                    if task_type != REGRESSION:
                        classes = sorted(r[0] for r in train.select(self.target).where(F.col(f"`{self.target}`").isNotNull()).distinct().collect())  # one row a class
                        number = F.coalesce(class_number(F.col(f"`{self.target}`"), classes), F.lit(-1.0))
                    arrays = []
                    for df in (train.where(F.col(f"`{self.target}`").isNotNull()), valid):
                        found = blocks(df.withColumn("__y", number), self.features, "__y", WEIGHT, rows=1).collect()
                        wide = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros((0, len(self.features))), np.zeros((0, 1)), np.zeros(0)]
                        arrays.append(wide)
                    self.parts[key] = (*arrays, [e.tolist() for e in bin_edges(train, self.features)], len(classes))
            return self.parts[key]

    def close(self) -> None:
        for found in self.cached:
            found.unpersist()


def array_scores(found: np.ndarray, y: np.ndarray, w: np.ndarray, task_type: str, n_classes: int) -> dict:
    """``metrics.weighted`` on arrays (class number -1: a class not trained on)."""
    if task_type == REGRESSION:
        mean = (w * y).sum() / w.sum()
        tot = (w * (y - mean) ** 2).sum()
        return {"r2": float(1 - (w * (y - found) ** 2).sum() / tot) if tot else None}
    f1 = []
    for k in range(-1, n_classes):
        tp, fp, fn = (float(w[m].sum()) for m in ((y == k) & (found == k), (y != k) & (found == k), (y == k) & (found != k)))
        if tp + fp + fn:
            f1.append(2 * tp / (2 * tp + fp + fn))
    return {"accuracy": float(w[y == found].sum() / w.sum()), "macro_f1": float(np.mean(f1))}


def _score_all(name: str, spec: Spec, tries: list[dict], rows: SearchSet, share: float, task_type: str, n_classes: int, threads: int) -> list[dict]:
    """Scores of each parameter set: one task a set where the rows are few and
    the model learns from blocks, else one pipeline a set."""
    train, valid, n = rows.rows(share)
    held = rows.held(share, task_type) if fits_in_task(spec, task_type, len(rows.features), n_classes) else None
    if held is not None and len(held[0][2]) and len(held[1][2]):
        sc = train.sparkSession.sparkContext
        shared = sc.broadcast(held)

        def one(params: dict) -> dict:
            fit, test, edges, k = shared.value
            task = "regression" if task_type == REGRESSION else "classification"
            found = predict_in_task(spec, params, Held([tuple(fit)]), [np.array(e) for e in edges], task, k, test[0])
            return array_scores(found, test[1][:, 0], test[2], task_type, k)

        return sc.parallelize(tries, len(tries)).map(one).collect()

    def fitted(params: dict) -> dict:
        weight = "" if spec.knn or name == "MLPClassifier" else WEIGHT
        part = rows.train if not weight else train
        model = fit_pipeline(make_pipeline(name, spec, params, rows.features, rows.target, n_classes, max(1, round(n)), weight), part)
        return evaluate(model, valid, rows.target, task_type, WEIGHT)

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return list(pool.map(fitted, tries))


def random_search(
    name: str, spec: Spec, train: DataFrame, valid: DataFrame, features: Sequence[str], target: str,
    task_type: str, n_classes: int, n_draws: int = N_DRAWS, seed: int = 42, metric: str | None = None, fixed_params: dict | None = None,
    halving: bool = True, id_col: str | None = "id", threads: int = 8, rows: SearchSet | None = None,
) -> tuple[dict, dict]:
    """Best (params, scores) over the drawn parameter sets, scored on ``valid``;
    ``fixed_params`` hold in all of them, and models without ranges are fitted once.

    ``halving``: all sets enter on a share of the training rows (and of a growing
    model's rounds or trees), the better half stays on twice the share, until
    the few left (the defaults always among them) are compared on all rows.
    Without it every set is fitted on all rows.
    """
    metric = metric or ("r2" if task_type == REGRESSION else "accuracy")
    own = rows or SearchSet(train, valid, features, target, id_col, seed)
    tries = [{**p, **(fixed_params or {})} for p in draw_params(spec, n_draws if spec.ranges else 1, seed)]
    rungs = max(0, int(np.log2(max(1, len(tries)) / LAST_RUNG))) if halving else 0
    left = list(range(len(tries)))
    scores: list[dict] = []
    for rung in range(rungs, -1, -1):
        share = 0.5**rung
        asked = []
        for i in left:
            p = dict(tries[i])
            if spec.growing and spec.growing in p and rung:
                p[spec.growing] = max(1, round(p[spec.growing] * share))
            asked.append(p)
        scores = _score_all(name, spec, asked, own, share, task_type, n_classes, threads)
        order = sorted(range(len(left)), key=lambda j: (scores[j][metric] is None, -(scores[j][metric] or 0.0), left[j]))
        if rung:
            keep = sorted({left[j] for j in order[: -(-len(left) // 2)]} | {0})
            left = keep
        else:
            best = order[0]
    if rows is None:
        own.close()
    return tries[left[best]], scores[best]


def run_models(
    df: DataFrame, features: Sequence[str], target: str, task_type: str, dataset: str = "data",
    mode: str = "stable", n_draws: int = N_DRAWS, parallelism: int = 2, sample: float | None = None, cap: int = 50_000,
    id_col: str = "id", models: Sequence[str] | None = None, seed: int = 42, overrides: dict[str, dict] | None = None,
    unscaled: Callable[[DataFrame], DataFrame] | None = None, halving: bool = True,
) -> DataFrame:
    """Leaderboard of every registry model on a holdout split of a sample.

    ``sample``: share of the rows, ``SEARCH_SHARE`` of the mode unless given.
    ``cap``: most rows of a classifier's stratified sample; a regression's
    sample has no cap. The winner is refitted on all rows in either case.

    ``overrides``: parameters by model that hold in place of the registry's.
    ``unscaled``: gives the same rows without scaling, for models that learn
    from counts and flags (``df`` itself unless given).

    ``halving``: see ``random_search``; False fits every parameter set on all rows.

    A model that fails becomes a row with its error and no score.
    """
    spark = df.sparkSession
    sample = SEARCH_SHARE.get(mode, 1.0) if sample is None else sample
    if task_type == REGRESSION:
        sub = plain_sample(df, id_col, sample, seed + 1) if sample < 1 else df
    else:
        sub = stratified_sample(df, id_col, target, sample, cap, seed + 1) if sample < 1 else df
    train, valid = holdout_split(sub, id_col, 0.2, seed)
    train, valid = train.cache(), valid.cache()
    n_classes = 0 if task_type == REGRESSION else train.select(target).distinct().count()
    specs = registry(task_type, mode)
    if models:
        specs = {k: v for k, v in specs.items() if k in models}

    scaled = SearchSet(train, valid, features, target, id_col, seed)
    plain = SearchSet(unscaled(train), unscaled(valid), features, target, id_col, seed) if unscaled else scaled

    def one(item):
        name, spec = item
        try:
            rows = plain if spec.unscaled else scaled
            params, sc = random_search(name, spec, rows.train, rows.valid, features, target, task_type, n_classes, n_draws, seed,
                                       fixed_params=(overrides or {}).get(name), halving=halving, id_col=id_col, rows=rows)
            return (dataset, mode, name, {k: str(v) for k, v in params.items()}, sc.get("accuracy"), sc.get("macro_f1"), sc.get("r2"), None)
        except Exception as e:  # noqa: BLE001 - a failed model is a result row
            return (dataset, mode, name, {}, None, None, None, f"{type(e).__name__}: {e}".splitlines()[0][:500])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(one, specs.items()))
    for part in {id(x): x for x in (scaled, plain)}.values():
        part.close()
    train.unpersist()
    valid.unpersist()
    return spark.createDataFrame(rows, LEADERBOARD_SCHEMA)


def score_column(task_type: str = "classification", metric: str | None = None) -> str:
    return metric or ("r2" if task_type == REGRESSION else "accuracy")


def top_models(board: DataFrame, n: int = 5, metric: str = "accuracy") -> DataFrame:
    """Top ``n`` per dataset by score (failed models last), ties by model name."""
    w = Window.partitionBy("dataset").orderBy(F.desc_nulls_last(metric), F.asc("model"))
    return board.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_model(board: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Winner per dataset (``max_by`` on the score; failed models never win)."""
    ok = board.where(F.col(metric).isNotNull())
    return ok.groupBy("dataset").agg(
        F.min_by("model", F.struct((-F.col(metric)).alias("s"), F.col("model").alias("m"))).alias("model"),
        F.max(metric).alias(metric),
    )


def refit_and_save(
    df: DataFrame, features: Sequence[str], target: str, task_type: str, model_name: str, params: dict,
    out_dir: str | None, mode: str = "stable", clean: bool = True, n_classes: int | None = None,
) -> PipelineModel:
    """Refit the winner on all rows (cleaning included) and save the pipeline."""
    spec = registry(task_type, mode)[model_name]
    stages = []
    feats = list(features)
    if clean:
        pre = Preprocessor(features=feats, passthrough=[c for c in df.columns if c not in feats]).fit(df)
        pre = pre.unscaled() if spec.unscaled else pre
        stages.append(pre)
        feats = pre.output_columns
        data = pre.transform(df)
    else:
        data = df
    if n_classes is None:
        n_classes = 0 if task_type == REGRESSION else df.select(target).distinct().count()
    typed = {k: _typed(v) for k, v in params.items()}
    model = fit_pipeline(make_pipeline(model_name, spec, typed, feats, target, n_classes, data.count()), data)
    full = PipelineModel(stages=stages + list(model.stages))
    if out_dir:
        full.write().overwrite().save(f"{out_dir}/pipeline")
        meta = df.sparkSession.createDataFrame(
            [(task_type, model_name, json.dumps(params), json.dumps(list(features)), target)],
            "task_type string, model string, params string, features string, target string",
        )
        meta.write.mode("overwrite").parquet(f"{out_dir}/meta")
    return full


def _typed(v):
    if isinstance(v, str):
        for cast in (int, float):
            try:
                return cast(v)
            except ValueError:
                pass
    return v


def predict(df: DataFrame, model_dir: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Load a saved pipeline and score new rows."""
    model = PipelineModel.load(f"{model_dir}/pipeline")
    keep = [c for c in keep if c in df.columns]
    return model.transform(df).select(*keep, "prediction")


def fit(
    df: DataFrame, target: str | Sequence[str], features: Sequence[str] | None = None, dataset: str = "data",
    mode: str = "stable", n_draws: int = N_DRAWS, parallelism: int = 4, out_dir: str | None = None,
    id_col: str = "id", detect_mode: str = "documented", models: Sequence[str] | None = None,
    sample: float | None = None, cap: int = 50_000, overrides: dict[str, dict] | None = None,
) -> dict:
    """Load -> detect -> clean -> search -> refit -> save. Returns the run summary.

    ``sample`` and ``cap`` bound the rows of the model search as in
    ``run_models``; cleaning and the refit see all rows. Models of counts and
    flags search and refit on the cleaned columns without scaling.
    """
    targets = [target] if isinstance(target, str) else list(target)
    features = list(features or [c for c in df.columns if c not in targets and c != id_col])
    task = detect_task_type(df, targets, detect_mode)
    if task == MULTILABEL:
        return fit_multilabel(df, targets, features, dataset, mode, n_draws, parallelism, out_dir, id_col, models, sample, cap, overrides)
    y = targets[0]
    keep = ([id_col] if id_col in df.columns else []) + features + [y]
    # one materialised copy of the narrow training table (reliable checkpoint):
    # cleaning statistics, the search and the refit all read it several times
    data = cut_lineage(df.select(*keep).withColumn(y, F.col(y).cast("double" if task == REGRESSION else "string")))
    pre = Preprocessor(features=features, passthrough=[id_col, y]).fit(data)
    cols = pre.output_columns
    own = [c for c in (id_col, y) if c in data.columns]
    clean = apply_stats(data, pre.stats, own, plain_prefix=PLAIN).cache()

    def plain(d: DataFrame) -> DataFrame:
        return d.select(*own, *[F.col(f"`{PLAIN}{c}`").alias(c) for c in cols])

    board = run_models(clean, cols, y, task, dataset, mode, n_draws, parallelism, sample, cap, id_col, models, overrides=overrides, unscaled=plain).cache()
    metric = score_column(task)
    winner = best_model(board, metric).first()
    summary = {"dataset": dataset, "task_type": task, "leaderboard": board, "n_models_tested": board.count()}
    if winner is None:
        return summary
    params = board.where(F.col("model") == winner["model"]).first()["params"]
    refit_and_save(data, features, y, task, winner["model"], dict(params or {}), out_dir, mode)
    summary.update(best_model=winner["model"], best_score=winner[metric])
    clean.unpersist()
    return summary


def fit_multilabel(df, targets, features, dataset, mode, n_draws, parallelism, out_dir, id_col, models=None, sample=None, cap=50_000, overrides=None) -> dict:
    """One binary model per label column; a row is right only when every label is."""
    rows = []
    for t in targets:
        sub = fit(df.drop(*[x for x in targets if x != t]), t, features, f"{dataset}:{t}", mode, n_draws, parallelism,
                  f"{out_dir}/{t}" if out_dir else None, id_col, "as_run", models, sample, cap, overrides)
        rows.append(sub)
    return {"dataset": dataset, "task_type": MULTILABEL, "per_label": rows}


def subset_accuracy(pred: DataFrame, labels: Sequence[str], preds: Sequence[str]) -> DataFrame:
    """Share of rows where every label is predicted right."""
    ok = None
    for y, p in zip(labels, preds):
        e = F.col(y).cast("string") == F.col(p).cast("string")
        ok = e if ok is None else ok & e
    return pred.agg(F.avg(ok.cast("double")).alias("accuracy"))


def fit_many(
    spark: SparkSession, datasets: Sequence[tuple[str, Callable[[], DataFrame], str]], results_path: str,
    mode: str = "stable", **kw,
) -> DataFrame:
    """Fit several data sets; ones already in the results table are skipped and
    an error becomes a result row, so a rerun resumes where it stopped."""
    if path_exists(spark, results_path):
        done = spark.read.parquet(results_path).select("dataset")
    else:
        done = spark.createDataFrame([], "dataset string")
    todo = spark.createDataFrame([(d[0],) for d in datasets], "dataset string").join(done, "dataset", "left_anti")
    todo_names = {r["dataset"] for r in todo.collect()}  # one row per requested data set
    for name, loader, target in datasets:
        if name not in todo_names:
            continue
        try:
            s = fit(loader(), target, dataset=name, mode=mode, **kw)
            row = (name, s.get("task_type"), s.get("best_model"), s.get("best_score"), s.get("n_models_tested"), None)
        except Exception as e:  # noqa: BLE001
            row = (name, None, None, None, None, f"{type(e).__name__}: {e}".splitlines()[0][:500])
        spark.createDataFrame([row], "dataset string, task_type string, best_model string, best_score double, n_models_tested bigint, error string") \
            .write.mode("append").parquet(results_path)
    return spark.read.parquet(results_path)
