"""Ordered target statistics against a plain loop, and boosting on them."""

import hashlib
import random

import pytest

from corkscrew.operators import ordered


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def truth(rows, prior=0.5, strength=1.0):
    """{id: value}; rows (id, category, target) in the order of the permutation."""
    total, n, out = {}, {}, {}
    for i, c, y in sorted(rows, key=lambda r: (key(r[0]), r[0])):
        out[i] = (total.get(c, 0.0) + prior * strength) / (n.get(c, 0) + strength)
        if y is not None:
            total[c], n[c] = total.get(c, 0.0) + y, n.get(c, 0) + 1
    return out


def sample(n, seed=1):
    rng = random.Random(seed)
    # one category holds a third of all rows
    return [(i, rng.choice([None, "a", "b", "hot", "hot"]), rng.choice([0.0, 1.0, 3.0, None])) for i in range(n)]


@pytest.mark.parametrize("slice_rows", [7, 100_000])
def test_statistics_equal_loop(spark, slice_rows):
    rows = sample(300)
    df = spark.createDataFrame([(*r, "kept") for r in rows], "id long, c string, y double, __other string")
    out = ordered.ordered_statistics(df, "id", ["c"], ["y"], prior=0.25, strength=2.0, slice_rows=slice_rows)
    assert out.columns == ["id", "c", "y", "__other", "c__y"]
    got = {r["id"]: r["c__y"] for r in out.collect()}
    want = truth(rows, 0.25, 2.0)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-12) for i in want)


def test_own_label_never_enters(spark):
    rows = sample(60)
    at = 17
    changed = [(i, c, 1000.0 if i == at else y) for i, c, y in rows]
    frames = [spark.createDataFrame(r, "id long, c string, y double") for r in (rows, changed)]
    a, b = ({r["id"]: r["c__y"] for r in ordered.ordered_statistics(f, "id", ["c"], ["y"]).collect()} for f in frames)
    assert a[at] == b[at]
    earlier = [i for i, _, _ in rows if key(i) < key(at)]
    assert all(a[i] == b[i] for i in earlier)


def test_edges(spark):
    schema = "id long, c string, y double"
    assert ordered.ordered_statistics(spark.createDataFrame([], schema), "id", ["c"], ["y"]).collect() == []
    df = spark.createDataFrame([(1, None, None), (2, "x", float("nan")), (3, "x", None), (None, "x", 1.0)], schema)
    got = ordered.ordered_statistics(df, "id", ["c"], ["y"], prior=0.125).collect()
    assert len(got) == 4 and all(r["c__y"] == 0.125 for r in got if r["id"] in (1,))
    # repeated rows all stay
    twice = spark.createDataFrame([(1, "x", 1.0)] * 3, schema)
    assert sorted(r["c__y"] for r in ordered.ordered_statistics(twice, "id", ["c"], ["y"]).collect()) == pytest.approx([0.5, 0.75, 2.5 / 3])
    totals = ordered.target_totals(twice, ["c"], ["y"])
    new = totals.apply(spark.createDataFrame([(9, "x"), (8, "unseen"), (7, None)], "id long, c string"))
    assert {r["id"]: r["c__y"] for r in new.collect()} == {9: 3.5 / 4, 8: 0.5, 7: 0.5}


def test_boosting_on_a_wide_category(spark):
    """Classes follow a category of 40 values; a held-out part is told by it."""
    rng = random.Random(3)
    side = {f"v{k}": k % 2 for k in range(40)}
    rows = []
    for i in range(1200):
        v = rng.choice(list(side))
        rows.append((i, v, rng.random(), "yes" if (side[v] if rng.random() < 0.9 else 1 - side[v]) else "no"))
    df = spark.createDataFrame(rows, "id long, v string, noise double, y string")
    model = ordered.fit_ordered_boosting(df.where("id < 900"), "id", ["v"], ["noise"], "y", rounds=10, max_depth=3)
    found = model.transform(df.where("id >= 900").select("id", "v", "noise", "y")).collect()
    assert found[0].asDict().keys() == {"id", "v", "noise", "y", "prediction"}
    assert sum(r["prediction"] == r["y"] for r in found) / len(found) > 0.8


def test_boosting_regression(spark):
    rows = [(i, f"v{i % 5}", float(10 * (i % 5))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v string, y double")
    model = ordered.fit_ordered_boosting(df, "id", ["v"], [], "y", task="regression", rounds=30, max_depth=3)
    err = [abs(r["prediction"] - r["y"]) for r in model.transform(df).collect()]
    assert sum(err) / len(err) < 3
