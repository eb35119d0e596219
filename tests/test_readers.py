"""Reader and writer fixtures (FIXTURES.md §1, §3, §4)."""

import os

import pytest
from pyspark.sql import functions as F

from corkscrew.operators.review import clean_reviews, default_columns, with_title
from corkscrew.sources import readers, writers
from conftest import write

CSV = (
    "id,winery,variety,description,points,price\n"
    '1,Dom A,Merlot,"Rich, round ""big"" wine",87.9,12.5\n'
    "2,,Syrah,Peppery,abc,\n"
    "3,Dom C,,No variety,90,20\n"
    "4,Dom D,Pinot,,88,15\n"
    "5,Dom E,Gamay,Too many,85,10,extra\n"
    "6,Dom F,Riesling,Short row\n"
    "7,Dom G,Malbec,Trailing empty extra,80,9,\n"
    '8,Dom H,Malbec,"Empty, then a filled extra",80,9,,x\n'
    "9,Dom I,Malbec,Three empty extras,80,9,,,\n"
    '10,Dom J,Tannat,"Many, many, many, many, ""quoted"", commas",81,9\n'
)


def test_csv_skip_bad(spark, tmp):
    p = write(f"{tmp}/reviews.csv", CSV)
    df = readers.read_csv_skip_bad(spark, p)
    rows = {int(r["id"]): r for r in df.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 6, 10]  # over-long rows 5, 7, 8 and 9 skipped
    assert rows[10]["description"] == 'Many, many, many, many, "quoted", commas'
    assert rows[1]["description"] == 'Rich, round "big" wine'
    assert rows[2]["winery"] is None and rows[2]["price"] is None
    assert rows[6]["points"] is None and rows[6]["price"] is None  # short row padded
    clean = clean_reviews(df).orderBy(F.col("id").cast("int"))
    got = [(int(r["id"]), r["title"], r["points"], r["price"]) for r in clean.collect()]
    # no title column: winery filler, variety '' in the title; rows without description / variety dropped
    assert got == [(1, "Dom A Merlot", 87, 12.5), (2, "Inconnu Syrah", 0, 0.0), (6, "Dom F Riesling", 0, 0.0), (10, "Dom J Tannat", 81, 9.0)]


def test_title_kept_when_present(spark):
    df = spark.createDataFrame([("t", "w", "v")], "title string, winery string, variety string")
    assert with_title(df).first()["title"] == "t"


def test_default_columns(spark):
    df = spark.createDataFrame([(1, "t", "v", "d")], "id int, title string, variety string, description string")
    out = default_columns(df)
    assert out.columns == ["id", "title", "variety", "description", "points", "price"]
    assert out.first()["points"] == 0 and out.first()["price"] == 0


def test_dense_one_column_and_blank_lines(spark, tmp):
    p = write(f"{tmp}/one.data", "1\n\n2\n3\n")
    df = readers.read_features(spark, p)
    assert df.columns == ["row_id", "f0"]
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_dense_one_line(spark, tmp):
    p = write(f"{tmp}/line.data", "1 0 1 1\n")
    df = readers.read_features(spark, p)
    assert [tuple(r) for r in df.collect()] == [(0, 1.0, 0.0, 1.0, 1.0)]


def test_sparse(spark, tmp):
    p = write(f"{tmp}/s.data", "0:1.5 3:2 bad:1 3:1\n\n1:x 2:4 1:2:3\n5:1\n")
    assert readers.sniff_format(spark, p) == "sparse"
    ent = {(r["row_id"], r["idx"]): r["val"] for r in readers.sparse_entries(spark, p).collect()}
    assert ent == {(0, 0): 1.5, (0, 3): 3.0, (1, 2): 4.0, (2, 5): 1.0}
    dense = readers.read_sparse(spark, p)
    assert len(dense.columns) == 1 + 6
    assert dense.count() == 3


def test_text_fallback(spark, tmp):
    p = write(f"{tmp}/t.data", "Crème brûlée, toasty\n\n  spaced  \n")
    assert readers.sniff_format(spark, p) == "text"
    got = [r["description"] for r in readers.read_features(spark, p).orderBy("row_id").collect()]
    assert got == ["Crème brûlée, toasty", "spaced"]


def test_prose_with_colons_is_text(spark, tmp):
    p = write(f"{tmp}/c.data", "Nose: plum, at 12:30 sharp\n" + "Plain prose without any\n" * 3)
    assert readers.sniff_format(spark, p) == "text"


def test_late_line_decides_the_format(spark, tmp):
    p = write(f"{tmp}/l.data", "1 2 3\n" * 30 + "1 two 3\n")
    assert readers.sniff_format(spark, p) == "text"


def test_labels_and_align(spark, tmp):
    feats = write(f"{tmp}/x.data", "1 0\n0 1\n1 1\n")
    lab = write(f"{tmp}/x.solution", 'red,1\n""\nwhite\nrose\n')
    y = readers.read_labels(spark, lab)
    assert [r["target"] for r in y.orderBy("row_id").collect()] == ["red", "Inconnu", "white", "rose"]
    both = readers.align(readers.read_features(spark, feats), y)
    assert both.count() == 3  # cut to the shorter side


def test_features_missing_file(spark, tmp):
    with pytest.raises(FileNotFoundError):
        readers.read_features(spark, f"{tmp}/nope.data")


def test_json_map(spark, tmp):
    p = write(f"{tmp}/colors.json", '{"Merlot": "red", "Grüner Veltliner": "white", "Rosé": "rose"}')
    m = {r["variety"]: r["color"] for r in readers.read_json_map(spark, p, "variety", "color").collect()}
    assert m == {"Merlot": "red", "Grüner Veltliner": "white", "Rosé": "rose"}
    empty = readers.read_json_map(spark, f"{tmp}/missing.json", "variety", "color")
    assert empty.count() == 0 and empty.columns == ["variety", "color"]


def test_audit_csv_has_bom(spark, tmp):
    df = spark.createDataFrame([(3, "Merlot", "red", "OK"), (1, "Cépage X", "NON DÉFINI", "A FAIRE")],
                               "frequency bigint, category string, current_color string, status string")
    out = writers.write_audit_csv(df, f"{tmp}/audit")
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-") and f.endswith(".csv"))
    with open(os.path.join(out, parts[0]), "rb") as f:
        head = f.read(3)
    assert head == b"\xef\xbb\xbf"
    back = spark.read.csv(out, header=True, sep=";", encoding="UTF-8")
    assert back.count() == 2


def test_dense_writer_round_trip(spark, tmp):
    df = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(50)], "id int, a int, b int").repartition(5)
    path = writers.write_dense(df, ["a", "b"], f"{tmp}/m", order_by="id")
    back = readers.read_dense(spark, path).orderBy("row_id").collect()
    assert [(r["f0"], r["f1"]) for r in back] == [(float(i % 2), float((i + 1) % 2)) for i in range(50)]


def test_sparse_file_whose_largest_index_is_zero(spark, tmp):
    from corkscrew.sources.readers import read_sparse

    with open(f"{tmp}/x.data", "w") as f:
        f.write("0:1.5\n0:2\n")
    assert [tuple(r) for r in read_sparse(spark, f"{tmp}/x.data").orderBy("row_id").collect()] == [(0, 1.5), (1, 2.0)]
