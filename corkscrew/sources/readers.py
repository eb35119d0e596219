"""Readers: review CSV, dense / sparse / text feature files, labels, JSON maps.

Line-oriented feature files are positional (row i of the features goes
with line i of the labels). Row numbers are computed JVM-side: position
inside each scan partition plus the running count of the partitions
before it (a table with one row per partition, broadcast). That keeps
file order without collecting anything. Large inputs should carry an id
column instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from ..functions import fixed

OVERFLOW = "_overflow"
CORRUPT = "_corrupt"
INT_TOKEN = r"^[+-]?[0-9]+$"
PAIR_TOKEN = r"^[+-]?[0-9]+:[^:]+$"
END_MARK = "\u0001end"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the first line (a one-row look, bounded)."""
    first = spark.read.csv(path, header=False, sep=sep, quote='"', escape='"').limit(1).collect()
    return [str(c) for c in first[0]] if first else []


def read_csv_skip_bad(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    sep: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header; over-long rows skipped, short rows padded with null.

    The schema is the header plus one ``_overflow`` column and a corrupt-
    record column. Spark flags every row whose field count differs from
    that schema, so a row of exactly header + 1 fields is the only one
    left unflagged: rows are dropped when unflagged or when the overflow
    field is filled. A row with an empty overflow field can still be longer:
    if its record holds that many separators, it is parsed again with an end
    mark behind it, which a row of too many fields pushes out of the schema.
    Short rows are kept (``DROPMALFORMED`` would lose them). Empty fields
    become null. ``multi_line`` is only needed when
    quoted fields hold newlines; it stops splitting single files, so many
    part files keep the read parallel.
    """
    columns = columns or csv_header(spark, path, sep)
    fields = [T.StructField(c, T.StringType()) for c in columns + [OVERFLOW, CORRUPT]]
    raw = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .option("enforceSchema", True)
        .csv(path)
    )
    record = F.regexp_replace(F.col(CORRUPT), r"[\r\n]+$", "")
    n_seps = F.length(record) - F.length(F.replace(record, F.lit(sep), F.lit("")))
    reread = F.from_csv(
        F.concat(record, F.lit(sep + END_MARK)), ", ".join(f"c{i} string" for i in range(len(columns) + 1)),
        {"sep": sep, "quote": '"', "escape": '"'},
    )
    fits = F.array_contains(F.array(*[F.coalesce(reread[f"c{i}"], F.lit("")) for i in range(len(columns) + 1)]), END_MARK)
    short = F.when(n_seps > len(columns) * len(sep), fits).otherwise(True)
    kept = raw.where(F.col(CORRUPT).isNotNull() & F.col(OVERFLOW).isNull()).where(short)
    return kept.select(*[F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) for c in columns])


STRIP_RE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def indexed_lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """(row_id, line) for the non-blank lines of text files, in file order.

    Files are taken in path order and lines in offset order, whatever
    order the scan packs the file splits in.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    stripped = F.regexp_replace(F.col("value"), STRIP_RE, "")
    val = stripped if strip else F.col("value")
    nonblank = lines.select(val.alias("line"), "_file", "_block").where(stripped != "")
    return with_row_index(nonblank, split_cols=["_file", "_block"]).select("row_id", "line")


def with_row_index(df: DataFrame, name: str = "row_id", split_cols: list[str] | None = None) -> DataFrame:
    """Consecutive 0-based index in scan order, computed without moving the rows.

    Each scan split gets its row count and first row tag in one small
    aggregate (one row per split, broadcast back); a row's index is the
    count of all earlier splits plus its position inside its split. Splits
    are ordered by ``split_cols`` (file path, block start) when given, else
    by scan partition. Only sound directly over a file scan (+ narrow
    steps), where split contents and order repeat on every evaluation.
    """
    keys = split_cols or ["_pid"]
    tagged = df.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    splits = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    order = Window.orderBy(*keys)
    offsets = splits.select(*keys, "_first", (F.sum("_n").over(order) - F.col("_n")).alias("_off"))
    out = tagged.join(F.broadcast(offsets), keys)
    drop = {"_pid", "_mid", "_first", "_off", *keys}
    keep = [c for c in df.columns if c not in drop]
    return out.select(*keep, (F.col("_off") + F.col("_mid") - F.col("_first")).alias(name))


def _tokens(line: str = "line"):
    return F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda t: t != "")


def read_dense(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """Whitespace-separated numbers: (row_id, f0 .. f{w-1}) as doubles.

    One column stays one column (a one-column file is not turned into a
    single row). Width is the longest row; short rows are padded with null.
    """
    lines = lines if lines is not None else indexed_lines(spark, path)
    arr = lines.select("row_id", F.transform(_tokens(), lambda t: t.try_cast("double")).alias("v"))
    width = arr.agg(F.max(F.size("v"))).first()[0] or 0
    return arr.select("row_id", *[F.col("v")[i].alias(f"f{i}") for i in range(width)])


def sparse_entries(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """``idx:val`` tokens in long form (row_id, idx, val).

    Bad tokens are skipped; repeated cells of a row add up (as a CSR
    matrix built from coordinates does).
    """
    lines = lines if lines is not None else indexed_lines(spark, path)
    # a token is split and read once, inside the row; the outer form plus a null
    # test keeps the optimizer from doing it again for a size filter
    parts = F.filter(F.transform(_tokens(), lambda t: F.split(t, ":")), lambda p: F.size(p) == 2)
    read = F.transform(parts, lambda p: F.struct(F.when(p[0].rlike(INT_TOKEN), p[0].try_cast("int")).alias("idx"), p[1].try_cast("double").alias("val")))
    typed = lines.select("row_id", F.explode_outer(read).alias("_x")).where(F.col("_x").isNotNull()).select("row_id", "_x.idx", "_x.val")
    good = typed.where(F.col("idx").isNotNull() & (F.col("idx") >= 0) & F.col("val").isNotNull())
    return good.groupBy("row_id", "idx").agg(F.sum("val").alias("val"))


def read_sparse(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """Sparse file as a dense table (row_id, f0 .. f{w-1}); w = largest index + 1.

    Every non-blank line is a row, so lines without a good token give a
    row of zeros. Prefer ``sparse_entries`` for wide data.
    """
    lines = lines if lines is not None else indexed_lines(spark, path)
    ent = sparse_entries(spark, path, lines)
    top = ent.agg(F.max("idx")).first()[0]
    width = 0 if top is None else top + 1
    per_row = ent.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "val"))).alias("m"))
    rows = lines.select("row_id").join(per_row, "row_id", "left")
    return rows.select(
        "row_id",
        *[F.coalesce(F.element_at("m", F.lit(i)), F.lit(0.0)).alias(f"f{i}") for i in range(width)],
    )


def read_text_lines(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """Fallback format: each non-blank line is one ``description``."""
    lines = lines if lines is not None else indexed_lines(spark, path)
    return lines.select("row_id", F.col("line").alias("description"))


def sniff_format(spark: SparkSession, path: str, lines: DataFrame | None = None) -> str:
    """``sparse``, ``dense``, ``text`` or ``empty``, decided on all lines."""
    lines = lines if lines is not None else indexed_lines(spark, path)
    return sniff_format_df(lines).first()[0]


def sniff_format_df(lines: DataFrame) -> DataFrame:
    """The chosen format as a one-row DataFrame (one aggregate over the lines).

    ``sparse`` when every line has an ``index:number`` token, or every token of
    every line a ':'; ``dense`` when every token of every line is a number;
    else ``text``.
    """
    numeric = F.forall(_tokens(), lambda t: t.try_cast("double").isNotNull())
    pair = F.exists(_tokens(), lambda t: t.rlike(PAIR_TOKEN) & F.substring_index(t, ":", -1).try_cast("double").isNotNull())
    colon = F.forall(_tokens(), lambda t: t.contains(":"))
    stats = lines.agg(
        F.min(pair.cast("int")).alias("all_pairs"),
        F.min(colon.cast("int")).alias("all_colons"),
        F.min(numeric.cast("int")).alias("all_numeric"),
        F.count(F.lit(1)).alias("n"),
    )
    fmt = (
        F.when(F.col("n") == 0, F.lit("empty"))
        .when((F.col("all_pairs") == 1) | (F.col("all_colons") == 1), F.lit("sparse"))
        .when(F.col("all_numeric") == 1, F.lit("dense"))
        .otherwise(F.lit("text"))
    )
    return stats.select(fmt.alias("format"))


def read_features(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Feature file in any of the three formats (``auto`` sniffs it)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    lines = indexed_lines(spark, path)
    fmt = sniff_format(spark, path, lines=lines) if fmt == "auto" else fmt
    if fmt == "sparse":
        return read_sparse(spark, path, lines)
    if fmt == "dense":
        return read_dense(spark, path, lines)
    if fmt == "empty":
        return spark.createDataFrame([], "row_id bigint")
    return read_text_lines(spark, path, lines)


def read_labels(spark: SparkSession, path: str, filler: str = fixed.LABEL_FILLER) -> DataFrame:
    """First column of a header-less label file as ``target`` string; null -> filler."""
    lines = indexed_lines(spark, path, strip=False)
    first = F.from_csv(F.col("line"), "target string", {"quote": '"', "escape": '"'})["target"]
    value = F.when(F.trim(first) == "", None).otherwise(first)
    return lines.select("row_id", F.coalesce(value, F.lit(filler)).alias("target"))


def align(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and labels by position; the longer side is cut to the shorter."""
    return features.join(labels, "row_id", "inner")


def read_json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A flat JSON object as a two-column table; a missing file gives an empty table."""
    schema = f"{key} string, {value} string"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    m = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))
    return m


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Saved artefact (lexicon, vocabulary, index, metadata) written as Parquet."""
    return spark.read.parquet(path)
