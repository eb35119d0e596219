"""Registered queries: column statistics, cleaning steps, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import CleanStats, apply_stats, auto_clean, encode, fit_stats, impute_columns, profile, quality_report
from ..operators.ordered import ordered_statistics, target_totals
from ..operators.sampling import hash_bucket, holdout_split, plain_sample, stratified_sample
from ..operators.stats import distinct_and_mode, exact_quantiles, moments, null_counts
from ..session import table
from .registry import register

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
FEATS = ["n1", "n2", "n3", "c_low", "c_high"]
NUMS = ["n1", "n2", "n3"]
CATS = ["c_low", "c_high"]
R9 = 9

# Mixed table (FIXTURES §5) derived from customer: nulls, outliers beyond
# both fences, a constant column, a low- and a high-cardinality column.
MIXED_SQL = (
    "SELECT c_custkey AS id, "
    "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS n1, "
    "CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 1000 WHEN c_custkey % 89 = 0 THEN -abs(c_acctbal) * 1000 "
    "ELSE c_acctbal / 10 END AS n2, "
    "5 AS n3, "
    "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_low, "
    "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'rare_' || CAST(c_custkey AS VARCHAR) "
    "ELSE 'nation_' || CAST(c_nationkey AS VARCHAR) END AS c_high "
    "FROM customer"
)


def mixed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.when(k % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("n1"),
        F.when(k % 97 == 0, F.col("c_acctbal") * 1000)
        .when(k % 89 == 0, -F.abs(F.col("c_acctbal")) * 1000)
        .otherwise(F.col("c_acctbal") / 10)
        .alias("n2"),
        F.lit(5).alias("n3"),
        F.when(k % 11 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_low"),
        F.when(k % 13 == 0, None)
        .when(k % 17 == 0, F.concat(F.lit("rare_"), k.cast("string")))
        .otherwise(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")))
        .alias("c_high"),
    )


BUCKET_SQL = "(CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 10000)"
TRAIN_SQL = f"SELECT * FROM ({MIXED_SQL}) WHERE {BUCKET_SQL} >= 2000"
TEST_SQL = f"SELECT * FROM ({MIXED_SQL}) WHERE {BUCKET_SQL} < 2000"


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _union(parts):
    return " UNION ALL ".join(parts)


@register(
    "agg_nulls",
    f"WITH m AS ({MIXED_SQL}) "
    + _union([f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM m" for c in FEATS]),
)
def q_nulls(spark, sf_dir):
    n = null_counts(mixed(spark, sf_dir), FEATS)
    return _rows(spark, list(n.items()), "column string, nulls bigint")


@register(
    "agg_sparsity",
    f"WITH m AS ({MIXED_SQL}) SELECT "
    + " + ".join(f"count(*) FILTER (WHERE {c} = 0)" for c in NUMS)
    + f" AS zero_cells, count(*) * {len(FEATS)} AS cells, round(("
    + " + ".join(f"count(*) FILTER (WHERE {c} = 0)" for c in NUMS)
    + f") / CAST(count(*) * {len(FEATS)} AS DOUBLE), {R9}) AS sparsity FROM m",
)
def q_sparsity(spark, sf_dir):
    m = mixed(spark, sf_dir)
    zeros = sum(F.count_if(F.col(c) == 0) for c in NUMS)
    cells = F.count(F.lit(1)) * len(FEATS)
    return m.agg(zeros.alias("zero_cells"), cells.alias("cells"), F.round(zeros / cells.cast("double"), R9).alias("sparsity"))


@register(
    "agg_cardinality",
    f"WITH m AS ({MIXED_SQL}) "
    + _union([f"SELECT '{c}' AS column, count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) <= 10 AS low_card FROM m" for c in FEATS]),
)
def q_cardinality(spark, sf_dir):
    d = distinct_and_mode(mixed(spark, sf_dir), FEATS)
    return d.select("column", F.col("distinct").alias("distinct_values"), (F.col("distinct") <= 10).alias("low_card"))


@register(
    "agg_median",
    f"WITH m AS ({MIXED_SQL}) "
    + _union([f"SELECT '{c}' AS column, round(quantile_cont({c}, 0.5), {R9}) AS median FROM m" for c in NUMS]),
)
def q_median(spark, sf_dir):
    q = exact_quantiles(mixed(spark, sf_dir), NUMS, [0.5])
    return _rows(spark, [(c, round(q[c][0], R9)) for c in NUMS], "column string, median double")


@register(
    "agg_median_sorted",
    f"WITH m AS ({MIXED_SQL}) "
    + _union([f"SELECT '{c}' AS column, round(quantile_cont({c}, 0.05), {R9}) AS p05, "
              f"round(quantile_cont({c}, 0.5), {R9}) AS p50, round(quantile_cont({c}, 0.95), {R9}) AS p95 FROM m" for c in NUMS]),
)
def q_median_sorted(spark, sf_dir):
    """Same quantiles through the distributed sort path (forced by a zero distinct budget)."""
    q = exact_quantiles(mixed(spark, sf_dir), NUMS, [0.05, 0.5, 0.95], max_distinct=0)
    return _rows(spark, [(c, *[round(v, R9) for v in q[c]]) for c in NUMS], "column string, p05 double, p50 double, p95 double")


def _mode_sql(c: str, src: str = "m") -> str:
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)"


@register(
    "agg_most_frequent",
    f"WITH m AS ({MIXED_SQL}) " + _union([f"SELECT '{c}' AS column, {_mode_sql(c)} AS mode" for c in CATS]),
)
def q_most_frequent(spark, sf_dir):
    return distinct_and_mode(mixed(spark, sf_dir), CATS).select("column", "mode")


@register(
    "agg_moments",
    f"WITH m AS ({MIXED_SQL}) "
    + _union([f"SELECT '{c}' AS column, round(avg({c}), {R9}) AS mean, round(stddev_pop({c}), {R9}) AS std FROM m" for c in NUMS]),
)
def q_moments(spark, sf_dir):
    m = moments(mixed(spark, sf_dir), NUMS)
    return m.select("column", F.round("mean", R9).alias("mean"), F.round("std", R9).alias("std"))


@register(
    "agg_max_abs",
    f"WITH m AS ({MIXED_SQL}) " + _union([f"SELECT '{c}' AS column, CAST(max(abs({c})) AS DOUBLE) AS max_abs FROM m" for c in NUMS]),
)
def q_max_abs(spark, sf_dir):
    return moments(mixed(spark, sf_dir), NUMS).select("column", "max_abs")


@register(
    "cln_typing",
    f"WITH m AS ({MIXED_SQL}) "
    + _union([
        f"SELECT '{c}' AS column, '{'Numerical' if c in NUMS else 'Categorical'}' AS kind, "
        f"count(DISTINCT {c}) AS distinct, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM m"
        for c in FEATS
    ]),
)
def q_typing(spark, sf_dir):
    return profile(mixed(spark, sf_dir), FEATS)


def _stats_sql(src: str) -> str:
    return (
        f"SELECT quantile_cont(n1, 0.5) AS m1, quantile_cont(n2, 0.5) AS m2, quantile_cont(n3, 0.5) AS m3, "
        f"{_mode_sql('c_low', src)} AS mode_low, {_mode_sql('c_high', src)} AS mode_high FROM {src}"
    )


def _imputed_sql(src: str) -> str:
    return (
        "SELECT id, coalesce(n1, st.m1) AS n1, coalesce(n2, st.m2) AS n2, CAST(coalesce(n3, st.m3) AS DOUBLE) AS n3, "
        f"coalesce(c_low, st.mode_low) AS c_low, coalesce(c_high, st.mode_high) AS c_high FROM {src}, st"
    )


@register(
    "cln_impute",
    f"WITH m AS ({MIXED_SQL}), st AS ({_stats_sql('m')}) "
    f"SELECT id, round(n1, {R9}) AS n1, round(n2, {R9}) AS n2, n3, c_low, c_high FROM ({_imputed_sql('m')})",
)
def q_impute(spark, sf_dir):
    m = mixed(spark, sf_dir)
    s = fit_stats(m, FEATS)
    imp = m.select("id", *[v.alias(c) for c, v in impute_columns(s).items()])
    return imp.select("id", F.round("n1", R9).alias("n1"), F.round("n2", R9).alias("n2"), "n3", "c_low", "c_high")


WINSOR_SQL = (
    f"WITH m AS ({MIXED_SQL}), st AS ({_stats_sql('m')}), i AS ({_imputed_sql('m')}), "
    "q AS (SELECT quantile_cont(n1, 0.05) AS a1, quantile_cont(n1, 0.95) AS b1, "
    "quantile_cont(n2, 0.05) AS a2, quantile_cont(n2, 0.95) AS b2 FROM i), "
    "w AS (SELECT id, "
    "CASE WHEN b1 - a1 > 0 THEN least(greatest(n1, a1 - 1.5 * (b1 - a1)), b1 + 1.5 * (b1 - a1)) ELSE n1 END AS n1, "
    "CASE WHEN b2 - a2 > 0 THEN least(greatest(n2, a2 - 1.5 * (b2 - a2)), b2 + 1.5 * (b2 - a2)) ELSE n2 END AS n2, "
    "n3, c_low, c_high FROM i, q) "
)


@register("cln_winsorize", WINSOR_SQL + f"SELECT id, round(n1, {R9}) AS n1, round(n2, {R9}) AS n2, n3 FROM w")
def q_winsorize(spark, sf_dir):
    m = mixed(spark, sf_dir)
    s = fit_stats(m, FEATS, winsorize=True)
    imp = m.select("id", *[v.alias(c) for c, v in impute_columns(s).items()])
    from ..operators.cleaning import winsorize_columns

    w = imp.withColumns(winsorize_columns(s))
    return w.select("id", F.round("n1", R9).alias("n1"), F.round("n2", R9).alias("n2"), "n3")


def _onehot_sql() -> str:
    return ", ".join(f"CASE WHEN c_low = '{v}' THEN 1.0 ELSE 0.0 END AS c_low_{v}" for v in SEGMENTS)


@register(
    "cln_one_hot",
    f"WITH m AS ({MIXED_SQL}), st AS ({_stats_sql('m')}), i AS ({_imputed_sql('m')}) SELECT id, {_onehot_sql()} FROM i",
)
def q_one_hot(spark, sf_dir):
    m = mixed(spark, sf_dir)
    s = fit_stats(m, FEATS)
    imp = m.select("id", *[v.alias(c) for c, v in impute_columns(s).items()])
    enc = encode(imp, s, ["id"])
    return enc.select("id", *[f"c_low_{v}" for v in s.categories["c_low"]])


def _train_encoded_ctes() -> str:
    return (
        f"tr AS ({TRAIN_SQL}), te AS ({TEST_SQL}), st AS ({_stats_sql('tr')}), "
        f"itr AS ({_imputed_sql('tr')}), ite AS ({_imputed_sql('te')}), "
        "dict AS (SELECT c_high AS v, CAST(row_number() OVER (ORDER BY c_high) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT c_high FROM itr)), "
        f"etr AS (SELECT id, n1, n2, n3, {_onehot_sql()}, coalesce(dict.code, -1.0) AS c_high FROM itr LEFT JOIN dict ON itr.c_high = dict.v), "
        f"ete AS (SELECT id, n1, n2, n3, {_onehot_sql()}, coalesce(dict.code, -1.0) AS c_high FROM ite LEFT JOIN dict ON ite.c_high = dict.v)"
    )


def _fit_train(spark, sf_dir):
    m = mixed(spark, sf_dir)
    tr, te = holdout_split(m, "id")
    return fit_stats(tr, FEATS), tr, te


@register(
    "cln_ordinal",
    f"WITH {_train_encoded_ctes()} SELECT id, c_high FROM ete",
)
def q_ordinal(spark, sf_dir):
    """Codes learnt on the training rows, applied to the test rows (unseen -> -1)."""
    s, tr, te = _fit_train(spark, sf_dir)
    imp = te.select("id", *[v.alias(c) for c, v in impute_columns(s).items()])
    return encode(imp, s, ["id"]).select("id", "c_high")


KEPT = ["n1", "n2"] + [f"c_low_{v}" for v in SEGMENTS] + ["c_high"]


@register(
    "cln_drop_constant",
    f"WITH {_train_encoded_ctes()} SELECT id, " + ", ".join(f"round({c}, {R9}) AS {c}" for c in KEPT) + " FROM ete",
)
def q_drop_constant(spark, sf_dir):
    """Encoded test rows without the constant column (n3)."""
    s, tr, te = _fit_train(spark, sf_dir)
    imp = te.select("id", *[v.alias(c) for c, v in impute_columns(s).items()])
    enc = encode(imp, s, ["id"])
    return enc.select("id", *[F.round(c, R9).alias(c) for c in s.kept])


def _scaled_sql(how: str) -> str:
    if how == "standard":
        stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in KEPT)
        cols = ", ".join(f"round(({c} - a_{c}) / s_{c}, {R9}) AS {c}" for c in KEPT)
    else:
        stats = ", ".join(f"max(abs({c})) AS s_{c}" for c in KEPT)
        cols = ", ".join(f"round({c} / s_{c}, {R9}) AS {c}" for c in KEPT)
    return f"WITH {_train_encoded_ctes()}, sc AS (SELECT {stats} FROM etr) SELECT id, {cols} FROM ete, sc"


def _rounded(df, cols):
    return df.select("id", *[F.round(c, R9).alias(c) for c in cols])


@register("cln_standardize", _scaled_sql("standard"))
def q_standardize(spark, sf_dir):
    s, tr, te = _fit_train(spark, sf_dir)
    return _rounded(apply_stats(te, s, ["id"]), s.kept)


@register("cln_preprocessor", _scaled_sql("standard"))
def q_preprocessor(spark, sf_dir):
    """The composed Spark ML estimator: fit on the training rows, transform the test rows."""
    from ..operators.cleaning import Preprocessor

    m = mixed(spark, sf_dir)
    tr, te = holdout_split(m, "id")
    model = Preprocessor(features=FEATS, passthrough=["id"]).fit(tr)
    return _rounded(model.transform(te), model.output_columns)


@register("cln_maxabs", _scaled_sql("maxabs"))
def q_maxabs(spark, sf_dir):
    s, tr, te = _fit_train(spark, sf_dir)
    s2 = CleanStats(**{**s.__dict__})
    enc_tr = encode(tr.select("id", *[v.alias(c) for c, v in impute_columns(s).items()]), s, ["id"])
    m = {r["column"]: r["max_abs"] for r in moments(enc_tr, s.kept).collect()}
    s2.center = {c: 0.0 for c in s.kept}
    s2.scale = {c: m[c] or 1.0 for c in s.kept}
    return _rounded(apply_stats(te, s2, ["id"]), s.kept)


AUTO_KEPT = ["n1", "n2", "c_high"] + [f"c_low_{v}" for v in SEGMENTS]


@register(
    "cln_auto",
    WINSOR_SQL
    + ", dict AS (SELECT c_high AS v, CAST(row_number() OVER (ORDER BY c_high) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT c_high FROM w)), "
    f"e AS (SELECT id, n1, n2, {_onehot_sql()}, dict.code AS c_high FROM w LEFT JOIN dict ON w.c_high = dict.v), "
    "sc AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in AUTO_KEPT) + " FROM e) "
    "SELECT id, " + ", ".join(f"round(({c} - a_{c}) / s_{c}, {R9}) AS {c}" for c in AUTO_KEPT) + " FROM e, sc",
)
def q_auto(spark, sf_dir):
    """One-call recipe on all rows (with winsorising); the last column (c_high) is
    a feature here, so the target is named explicitly: none (id only)."""
    m = mixed(spark, sf_dir).withColumn("target", F.lit("x"))
    out = auto_clean(m, target="target", id_col="id")
    return _rounded(out, [c for c in out.columns if c not in ("id", "target")])


@register(
    "cln_quality",
    f"WITH m AS ({MIXED_SQL}) SELECT CAST(("
    + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FEATS)
    + f") AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after, "
    f"CAST(1 - {len(KEPT)} / {len(FEATS)} AS DOUBLE) AS drop_ratio, "
    f"CAST(round(least(100, 100 - 30 * (1 - {len(KEPT)} / {len(FEATS)})), 2) AS DOUBLE) AS quality_score FROM m",
)
def q_quality(spark, sf_dir):
    m = mixed(spark, sf_dir)
    tr, te = holdout_split(m, "id")
    s = fit_stats(tr, FEATS)
    after = apply_stats(m, s, ["id"])
    return quality_report(m, after, FEATS, s.kept)


SPLIT_SQL = f"SELECT id, {BUCKET_SQL} < 2000 AS is_test FROM ({MIXED_SQL})"


@register("smp_holdout", SPLIT_SQL)
def q_holdout(spark, sf_dir):
    m = mixed(spark, sf_dir)
    return m.select("id", (hash_bucket("id", 42) < 2000).alias("is_test"))


@register(
    "smp_plain",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
    "CAST(('0x' || substr(md5('42:' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 15)) AS BIGINT) < 345876451382054080",
)
def q_plain(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    li = li.withColumn("_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return plain_sample(li, "_id", 0.3).select("l_orderkey", "l_linenumber")


STRAT_SQL = (
    "WITH o AS (SELECT o_orderkey, o_orderpriority, md5('42:' || CAST(o_orderkey AS VARCHAR)) AS draw FROM orders), "
    "sz AS (SELECT o_orderpriority, count(*) AS size FROM o GROUP BY o_orderpriority), "
    "n AS (SELECT sum(size) AS n FROM sz), "
    "r AS (SELECT CASE WHEN n * 0.3 > 2000 THEN 2000.0 / n ELSE 0.3 END AS r FROM n), "
    "k AS (SELECT o.*, row_number() OVER (PARTITION BY o.o_orderpriority ORDER BY draw, o_orderkey) - 1 AS rk FROM o) "
    "SELECT o_orderkey, k.o_orderpriority FROM k JOIN sz USING (o_orderpriority), r WHERE rk < round(size * r.r)"
)


@register("smp_stratified_cap", STRAT_SQL)
def q_stratified(spark, sf_dir):
    """Orders stratified by priority at ratio 0.3, capped at 2000 rows in all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return stratified_sample(o, "o_orderkey", "o_orderpriority", ratio=0.3, cap=2000)


ORDERED_CATS = ["c_low", "c_high"]
ORDERED_SQL = (
    f"WITH m AS (SELECT id, c_low, c_high, CASE WHEN n1 > 4000 THEN 1.0 WHEN n1 IS NOT NULL THEN 0.0 END AS y, md5('42:' || CAST(id AS VARCHAR)) AS k, {BUCKET_SQL} < 2000 AS is_test FROM ({MIXED_SQL})), "
    "tr AS (SELECT * FROM m WHERE NOT is_test), te AS (SELECT * FROM m WHERE is_test), "
    + ", ".join(f"t_{c} AS (SELECT {c}, sum(y) AS s, count(y) AS n FROM tr GROUP BY {c})" for c in ORDERED_CATS)
    + " SELECT id, is_test, "
    + ", ".join(
        f"round((coalesce(sum(y) OVER {c}_w, 0) + 0.5) / (count(y) OVER {c}_w + 1), {R9}) AS {c}__y" for c in ORDERED_CATS
    )
    + " FROM tr WINDOW "
    + ", ".join(f"{c}_w AS (PARTITION BY {c} ORDER BY k, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for c in ORDERED_CATS)
    + " UNION ALL SELECT id, is_test, "
    + ", ".join(f"round((coalesce(t_{c}.s, 0) + 0.5) / (coalesce(t_{c}.n, 0) + 1), {R9})" for c in ORDERED_CATS)
    + " FROM te " + " ".join(f"LEFT JOIN t_{c} ON te.{c} IS NOT DISTINCT FROM t_{c}.{c}" for c in ORDERED_CATS)
)


@register("cln_ordered_target", ORDERED_SQL)
def q_ordered_target(spark, sf_dir):
    """Categories as ordered target statistics (training rows: earlier rows of
    the permutation only; test rows: all training rows)."""
    m = mixed(spark, sf_dir).select("id", *ORDERED_CATS, (F.col("n1") > 4000).cast("double").alias("y"))
    tr, te = holdout_split(m, "id")
    totals = target_totals(tr, ORDERED_CATS, ["y"])
    shown = [F.round(f"{c}__y", R9).alias(f"{c}__y") for c in ORDERED_CATS]
    train = ordered_statistics(tr, "id", ORDERED_CATS, ["y"]).select("id", F.lit(False).alias("is_test"), *shown)
    return train.unionByName(totals.apply(te).select("id", F.lit(True).alias("is_test"), *shown))
