"""Registered queries for readers and writers: each writes data derived from
the driver tables into the shared scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lexicon import lexicon_flags
from ..operators.audit import category_audit
from ..operators.common import literal_table
from ..operators.lookup import lookup_default
from ..operators.review import coerce_numbers
from ..operators.sparse import fit_sparse
from ..session import scratch_path, table
from ..sources import readers, writers
from .knn_plans import index_ctes
from .registry import register
from .standins import BRAND_COLORS, EXTRA_GROUPS, REVIEWS_SQL, SOURCE_COLORS, color_map_sql, reviews

PART_LEX = {g: EXTRA_GROUPS[g] for g in ("warm", "cool", "size")}


def _reviews_csv(spark, sf_dir):
    """Reviews as CSV, and again with one, two and three fields too many."""
    path = scratch_path(spark, "reviews-csv")
    good, empty, extra = reviews(spark, sf_dir), F.lit(None).cast("string"), F.lit("extra")
    writers.write_table_csv(good, path)
    for tail in ([extra], [empty, extra], [empty, empty, empty]):
        bad = good.select("*", *[c.alias(f"more{i}") for i, c in enumerate(tail)])
        writers.write_table_csv(bad, path, mode="append")
    return path


@register(
    "src_csv_skip_bad",
    f"SELECT id, winery, variety, description, CAST(points AS INTEGER) AS points, price FROM ({REVIEWS_SQL})",
)
def q_csv(spark, sf_dir):
    """Review table written as CSV (quoted texts with newlines and quotes),
    read back with the skip-bad reader and number coercion; the rows with
    too many fields beside them are skipped."""
    path = _reviews_csv(spark, sf_dir)
    cols = ["id", "winery", "variety", "description", "points", "price"]
    back = readers.read_csv_skip_bad(spark, path, cols, multi_line=True)
    return coerce_numbers(back).withColumn("id", F.col("id").cast("bigint"))


@register(
    "snk_table_csv",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
)
def q_table_csv(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "part-csv")
    writers.write_table_csv(part, path)
    back = spark.read.csv(path, header=True, schema=part.schema)
    return back


def _part_dense(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    flags = lexicon_flags(part, "p_name", PART_LEX, "word", keep=["p_partkey"])
    path = scratch_path(spark, "part-dense")
    writers.write_dense(flags, list(PART_LEX), path, order_by="p_partkey")
    return path


DENSE_SQL = (
    "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row_id, "
    + ", ".join(f"f{i}" for i in range(len(PART_LEX)))
    + " FROM (SELECT p_partkey, "
    + ", ".join(
        f"CAST(regexp_matches(lower(p_name), '(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(t)})($|[^\\p{{L}}\\p{{N}}_])') AS DOUBLE) AS f{i}"
        for i, t in enumerate(PART_LEX.values())
    )
    + " FROM part)"
)


@register("src_dense", DENSE_SQL)
def q_dense(spark, sf_dir):
    """Lexicon flags of part names written as a 0/1 matrix, read back by position."""
    return readers.read_dense(spark, _part_dense(spark, sf_dir))


@register("snk_dense", DENSE_SQL)
def q_snk_dense(spark, sf_dir):
    return readers.read_features(spark, _part_dense(spark, sf_dir), fmt="dense")


@register("src_features_only", DENSE_SQL)
def q_features_only(spark, sf_dir):
    """Features without labels, format sniffed."""
    return readers.read_features(spark, _part_dense(spark, sf_dir))


SPARSE_LINE_SQL = (
    "concat(CAST(p_size % 10 AS VARCHAR), ':', CAST(p_partkey % 7 AS VARCHAR), ' ', "
    "CAST((p_size + 3) % 10 AS VARCHAR), ':1.5 bad:1 ', CAST(p_size % 10 AS VARCHAR), ':2 7:x 1:2:3')"
)


def _sparse_lines(part):
    return F.concat(
        (F.col("p_size") % 10).cast("string"), F.lit(":"), (F.col("p_partkey") % 7).cast("string"), F.lit(" "),
        ((F.col("p_size") + 3) % 10).cast("string"), F.lit(":1.5 bad:1 "), (F.col("p_size") % 10).cast("string"),
        F.lit(":2 7:x 1:2:3"),
    )


SPARSE_SQL = (
    "WITH l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_id, " + SPARSE_LINE_SQL + " AS line FROM part), "
    "t AS (SELECT row_id, unnest(string_split(line, ' ')) AS tok FROM l), "
    "p AS (SELECT row_id, string_split(tok, ':') AS p FROM t WHERE contains(tok, ':')), "
    "g AS (SELECT row_id, TRY_CAST(p[1] AS INTEGER) AS idx, TRY_CAST(p[2] AS DOUBLE) AS val FROM p "
    "WHERE len(p) = 2 AND regexp_full_match(p[1], '[+-]?[0-9]+')) "
    "SELECT CAST(row_id AS BIGINT) AS row_id, idx, sum(val) AS val FROM g WHERE idx >= 0 AND val IS NOT NULL GROUP BY row_id, idx"
)


@register("src_sparse", SPARSE_SQL)
def q_sparse(spark, sf_dir):
    """``idx:val`` lines with bad tokens and repeated cells, in long form."""
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "part-sparse")
    part.orderBy("p_partkey").select(_sparse_lines(part).alias("value")).write.mode("overwrite").text(path)
    return readers.sparse_entries(spark, path)


TEXT_LINES_SQL = (
    "WITH s AS (SELECT conv_id, turn, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM conversations), "
    "l AS (SELECT conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS ln FROM s), "
    "c AS (SELECT conv_id, turn, ln, regexp_replace(line, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS description FROM l) "
    "SELECT CAST(row_number() OVER (ORDER BY conv_id, turn, ln) - 1 AS BIGINT) AS row_id, description FROM c WHERE description <> ''"
)


def _text_file(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "conv-text")
    conv.orderBy("conv_id", "turn").select(F.col("text").alias("value")).write.mode("overwrite").text(path)
    return path


@register("src_text_lines", TEXT_LINES_SQL)
def q_text_lines(spark, sf_dir):
    """Conversation texts written as lines; every non-blank line is one description."""
    return readers.read_text_lines(spark, _text_file(spark, sf_dir))


@register(
    "src_sniff",
    "SELECT * FROM (VALUES ('dense', 'dense'), ('sparse', 'sparse'), ('text', 'text')) AS t(written, format)",
)
def q_sniff(spark, sf_dir):
    """The format chosen for each of three files written from the tables."""
    part = table(spark, sf_dir, "part")
    sparse = scratch_path(spark, "sniff-sparse")
    part.select(_sparse_lines(part).alias("value")).write.mode("overwrite").text(sparse)
    files = {"dense": _part_dense(spark, sf_dir), "sparse": sparse, "text": _text_file(spark, sf_dir)}
    out = None
    for kind, path in files.items():
        one = readers.sniff_format_df(readers.indexed_lines(spark, path)).select(F.lit(kind).alias("written"), "format")
        out = one if out is None else out.unionByName(one)
    return out


LABELS_SQL = (
    "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id, CAST(quality AS VARCHAR) AS target FROM labels"
)


def _labels_file(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    path = scratch_path(spark, "labels")
    lab.orderBy("doc_id").select(F.col("quality").cast("string"), F.col("toxic").cast("string")).write.mode("overwrite").csv(path)
    return path


@register("src_labels", LABELS_SQL)
def q_labels(spark, sf_dir):
    """Two-column label file; the first column is the target."""
    return readers.read_labels(spark, _labels_file(spark, sf_dir))


@register(
    "snk_labels",
    "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row_id, p_type AS target FROM part",
)
def q_snk_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "part-labels")
    writers.write_labels(part, "p_type", path, order_by="p_partkey")
    return readers.read_labels(spark, path)


@register(
    "src_align",
    f"WITH x AS ({DENSE_SQL}), y AS ({LABELS_SQL}) SELECT x.*, y.target FROM x JOIN y USING (row_id)",
)
def q_align(spark, sf_dir):
    """Features of every part with the labels file: cut to the shorter side."""
    x = readers.read_dense(spark, _part_dense(spark, sf_dir))
    y = readers.read_labels(spark, _labels_file(spark, sf_dir))
    return readers.align(x, y)


@register(
    "src_json_map",
    f"SELECT d.doc_id AS id, d.source AS variety, coalesce(c.color, 'unknown') AS color FROM documents d "
    f"LEFT JOIN ({color_map_sql(SOURCE_COLORS)}) c ON c.variety = d.source",
)
def q_json_map(spark, sf_dir):
    """Colour map written as one JSON object, read back and applied to all documents."""
    path = scratch_path(spark, "colors-json")
    lit_map = literal_table(spark, SOURCE_COLORS.items(), "k string, v string")
    obj = lit_map.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    obj.write.mode("overwrite").text(path)
    colors = readers.read_json_map(spark, path, "variety", "color")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("variety"))
    return lookup_default(docs, colors, "variety", "color")


@register(
    "src_artifact",
    f"WITH {index_ctes()} SELECT term, cf, df FROM vocab",
)
def q_artifact(spark, sf_dir):
    """Fitted vocabulary saved as Parquet and loaded back."""
    from ..operators.recommend import fit_recommender

    rec = fit_recommender(reviews(spark, sf_dir))
    path = scratch_path(spark, "vocab")
    writers.write_table(rec.tfidf.vocab, path)
    return readers.read_table(spark, path).select("term", "cf", "df")


@register(
    "snk_artifact",
    f"WITH {index_ctes()} SELECT id, term, round(weight, 9) AS weight FROM idx",
)
def q_snk_artifact(spark, sf_dir):
    """Neighbour index saved as Parquet (partitioned by nothing, many files) and loaded back."""
    from ..operators.recommend import fit_recommender

    rec = fit_recommender(reviews(spark, sf_dir))
    path = scratch_path(spark, "index")
    writers.write_table(rec.tfidf.index, path)
    return readers.read_table(spark, path).select("id", "term", F.round("weight", 9).alias("weight"))


AUDIT_PART_SQL = (
    f"WITH c AS (SELECT p_brand, count(*) AS frequency FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand), "
    f"m AS ({color_map_sql(BRAND_COLORS, 'p_brand')}) "
    "SELECT c.frequency, c.p_brand AS category, coalesce(m.color, 'NON DÉFINI') AS current_color, "
    "CASE WHEN m.color IS NULL THEN 'A FAIRE' ELSE 'OK' END AS status FROM c LEFT JOIN m USING (p_brand)"
)


@register("snk_audit_csv", AUDIT_PART_SQL)
def q_audit_csv(spark, sf_dir):
    """Category audit written as ';' CSV with a byte-order mark, read back."""
    part = table(spark, sf_dir, "part")
    colors = literal_table(spark, BRAND_COLORS.items(), "p_brand string, color string")
    audit = category_audit(part, "p_brand", colors)
    path = scratch_path(spark, "audit-csv")
    writers.write_audit_csv(audit, path)
    back = spark.read.csv(path, header=True, sep=";", schema="frequency bigint, category string, current_color string, status string")
    return back


WIDE = 1_000_000
WIDE_VALUE = "CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN CAST('nan' AS DOUBLE) WHEN l_linenumber % 3 = 0 THEN -l_quantity ELSE l_quantity END"
# One row an order: a cell a line, a column that all orders have (missing in every fifth), a constant column.
WIDE_SQL = (
    "WITH o AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS row_id FROM (SELECT DISTINCT l_orderkey FROM lineitem)), "
    f"raw AS (SELECT l_orderkey, CAST((l_partkey * 7919) % {WIDE} AS INTEGER) AS idx, {WIDE_VALUE} AS val FROM lineitem "
    f"UNION ALL SELECT l_orderkey, {WIDE}, CASE WHEN l_orderkey % 5 = 0 THEN CAST('nan' AS DOUBLE) ELSE 1 + l_orderkey % 4 END FROM o "
    f"UNION ALL SELECT l_orderkey, {WIDE + 1}, 3 FROM o), "
    "c AS MATERIALIZED (SELECT row_id, idx, CASE WHEN isfinite(sum(val)) THEN sum(val) END AS v FROM raw JOIN o USING (l_orderkey) GROUP BY row_id, idx), "
    "n AS (SELECT count(*) AS rows FROM o), "
    "k AS MATERIALIZED (SELECT idx, count(*) - count(v) AS missing, rows - count(*) AS zeros, min(v) AS lo, max(v) AS hi FROM c, n GROUP BY idx, rows), "
    "f AS (SELECT idx, median(v) AS fill FROM (SELECT idx, v FROM c WHERE v IS NOT NULL UNION ALL SELECT idx, 0.0 FROM k, range(zeros) WHERE missing > 0) GROUP BY idx), "
    "e AS (SELECT k.idx, CASE WHEN missing > 0 THEN fill END AS fill, least(lo, CASE WHEN zeros > 0 THEN 0.0 END, CASE WHEN missing > 0 THEN fill END) AS lo, "
    "greatest(hi, CASE WHEN zeros > 0 THEN 0.0 END, CASE WHEN missing > 0 THEN fill END) AS hi FROM k LEFT JOIN f USING (idx)) "
    "SELECT CAST(row_id AS BIGINT) AS row_id, idx, round(coalesce(v, fill) / greatest(abs(lo), abs(hi)), 9) AS val FROM c JOIN e USING (idx) WHERE lo < hi AND coalesce(v, fill) <> 0"
)


def _wide_file(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    val = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 == 0, F.lit("nan"))
    val = val.when(F.col("l_linenumber") % 3 == 0, (-F.col("l_quantity")).cast("string")).otherwise(F.col("l_quantity").cast("string"))
    cell = F.concat(((F.col("l_partkey") * 7919) % WIDE).cast("string"), F.lit(":"), val)
    common = F.when(F.col("l_orderkey") % 5 == 0, F.lit("nan")).otherwise((1 + F.col("l_orderkey") % 4).cast("string"))
    rows = li.groupBy("l_orderkey").agg(F.concat_ws(" ", F.collect_list(cell)).alias("cells"))
    line = F.concat(F.col("cells"), F.lit(f" {WIDE}:"), common, F.lit(f" {WIDE + 1}:3"))
    path = scratch_path(spark, "orders-wide")
    rows.orderBy("l_orderkey").select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def _wide_cells(spark, path):
    """Cells of the file as a written table: fitting and cleaning pass over them
    several times, the text is read once."""
    cells = readers.sparse_entries(spark, path)
    out = scratch_path(spark, "orders-cells")
    cells.write.parquet(out)
    return spark.read.schema(cells.schema).parquet(out)


@register("cln_sparse_wide", WIDE_SQL)
def q_sparse_wide(spark, sf_dir):
    """A sparse file of a million columns, filled, reduced and scaled in long form."""
    path = _wide_file(spark, sf_dir)
    cells = _wide_cells(spark, path)
    cleaner = fit_sparse(cells, readers.indexed_lines(spark, path).count())
    return cleaner.clean(cells).select("row_id", "idx", F.round("val", 9).alias("val"))


@register("mdl_sparse_logistic")
def q_sparse_logistic(spark, sf_dir):
    """The same file to a logistic model: which orders lack the common column."""
    from pyspark.ml.classification import LogisticRegression

    path = _wide_file(spark, sf_dir)
    cells = _wide_cells(spark, path)
    rows = readers.indexed_lines(spark, path).select("row_id", F.col("line").contains(f"{WIDE}:nan").cast("double").alias("label"))
    vectors = fit_sparse(cells, rows.count()).vectors(cells, rows)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(vectors)
    return model.transform(vectors).select("row_id", "label", "prediction")
