"""Cleaning of wide sparse features against numpy on the dense table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corkscrew.operators.sparse import fit_sparse
from corkscrew.plans import io_plans
from corkscrew.sources import readers
from conftest import write

SCHEMA = "row_id long, idx int, val double"


def dense_truth(m, stored):
    """Filled, reduced and scaled copy of ``m`` (NaN: missing): {(row, column): value} of what is not zero."""
    out = {}
    for j in range(m.shape[1]):
        col, known = m[:, j].copy(), ~np.isnan(m[:, j])
        if not known.any() or not (stored[:, j]).any():
            continue
        col[~known] = np.median(col[known])
        if col.min() == col.max():
            continue
        # cells that are not stored stay zero; the others are filled
        out.update({(i, j): v for i, v in enumerate(col / np.abs(col).max()) if v != 0})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cleaning_equals_numpy(spark, seed):
    rng = random.Random(seed)
    n, p = rng.choice([20, 21]), 12
    m, stored = np.zeros((n, p)), np.zeros((n, p), bool)
    for i in range(n):
        for j in range(p):
            if rng.random() < (j + 1) / p:
                stored[i, j] = True
                m[i, j] = 4.0 if j == 11 else rng.choice([float("nan"), -3.0, 0.0, 1.0, 2.0, 7.0])
    m[:, 10], stored[:, 10] = float("nan"), True  # missing in every row
    cells = [(i, j, float(m[i, j])) for i in range(n) for j in range(p) if stored[i, j]]
    df = spark.createDataFrame(cells, SCHEMA)
    cleaner = fit_sparse(df, n)
    got = {(r["row_id"], r["idx"]): r["val"] for r in cleaner.clean(df).collect()}
    want = dense_truth(m, stored)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert cleaner.width == p


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    cleaner = fit_sparse(empty, 0)
    assert cleaner.width == 0 and cleaner.clean(empty).collect() == []
    df = spark.createDataFrame([(0, 3, 2.0), (1, 3, float("inf")), (1, 5, None)], SCHEMA)
    cleaner = fit_sparse(df, 3)
    # column 3: values 2 and 0 are known, their median 1 fills the infinite cell; column 5 is constant
    assert {(r["row_id"], r["idx"]): r["val"] for r in cleaner.clean(df).collect()} == {(0, 3): 1.0, (1, 3): 0.5}
    unseen = spark.createDataFrame([(0, 9, 1.0), (0, 3, -4.0)], SCHEMA)
    assert [tuple(r) for r in cleaner.clean(unseen).collect()] == [(0, 3, -2.0)]


def test_file_to_model_at_a_million_columns(spark, tmp):
    from pyspark.ml.classification import LogisticRegression

    rng = random.Random(5)
    lines = []
    for i in range(200):
        sign = 999_999 if i % 2 else 17
        lines.append(f"{sign}:{rng.randint(1, 9)} {rng.randrange(100, 900_000)}:1.5" + (" 1000000:nan" if i % 20 == 0 else " 1000000:3"))
    path = write(f"{tmp}/wide.data", "\n".join(lines) + "\n")
    cells = readers.sparse_entries(spark, path)
    rows = readers.indexed_lines(spark, path).select("row_id")
    cleaner = fit_sparse(cells, rows.count())
    assert cleaner.width == 1_000_001
    vectors = cleaner.vectors(cells, rows).withColumn("label", (F.col("row_id") % 2).cast("double"))
    first = vectors.where("row_id = 1").first()["features"]
    assert first.size == 1_000_001 and 999_999 in first.indices and 1_000_000 not in first.indices
    model = LogisticRegression(maxIter=5, regParam=0.01).fit(vectors)
    assert model.transform(vectors).where("prediction = label").count() == 200


def test_rows_without_cells(spark):
    df = spark.createDataFrame([(0, 1, 2.0)], SCHEMA)
    rows = spark.createDataFrame([(0, "x"), (1, "y")], "row_id long, idx string")
    out = {r["row_id"]: r for r in fit_sparse(df, 2).vectors(df, rows).collect()}
    assert out[0]["features"].toArray().tolist() == [0.0, 1.0] and out[1]["features"].toArray().tolist() == [0.0, 0.0]
    assert out[1]["idx"] == "y"


def test_the_file_is_read_once_for_fitting_and_cleaning(spark, tmp):
    """Cells are a written table: passes over them read no text."""
    rows = [(o, line, o * 7 + line, float(1 + (o + line) % 5)) for o in range(1, 30) for line in range(1, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp}/lineitem.parquet")
    path = io_plans._wide_file(spark, tmp)
    cells = io_plans._wide_cells(spark, path)
    assert cells.inputFiles() and not any(f.startswith(f"file:{path}") or path in f for f in cells.inputFiles())
    parsed = readers.sparse_entries(spark, path)
    assert sorted(map(repr, cells.collect())) == sorted(map(repr, parsed.collect()))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # the line and its tokens, each once


def test_tokens_are_read_as_before(spark, tmp):
    write(f"{tmp}/f/a.txt", "1:2 x 3: :4 5:6:7 +8:1e2 -1:3 9:nan 1:0.5\n\n  2:inf 99999999999:1 7 3:-0\n")
    got = {(r["row_id"], r["idx"]): r["val"] for r in readers.sparse_entries(spark, f"{tmp}/f").collect()}
    assert str(got.pop((0, 9))) == "nan"
    assert got == {(0, 1): 2.5, (0, 8): 100.0, (1, 2): float("inf"), (1, 3): 0.0}
