"""Request stream: available-now output equals the batch answer; a restart adds nothing."""

from pyspark.sql import functions as F

from corkscrew.operators.recommend import fit_recommender, recommend
from corkscrew.plans.knn_plans import _colors
from corkscrew.plans.standins import requests, reviews
from corkscrew.streaming.requests import read_answers, stream_recommend
from conftest import SF_SMALL


def test_stream_equals_batch_and_restart_is_idempotent(spark, tmp):
    rec = fit_recommender(reviews(spark, SF_SMALL)).persist()
    reqs = requests(spark, SF_SMALL)
    src, sink, ckpt = f"{tmp}/in", f"{tmp}/out", f"{tmp}/ckpt"
    reqs.repartition(3, "request_id").write.parquet(src)
    stream_recommend(spark, rec, _colors(spark), src, sink, ckpt, max_files_per_trigger=1)
    got = read_answers(spark, sink).drop("batch_id")
    want = recommend(rec, reqs, _colors(spark))
    cols = sorted(want.columns)
    a = sorted(tuple(r) for r in got.select(cols).collect())
    b = sorted(tuple(r) for r in want.select(cols).collect())
    assert a == b
    # restart on the same checkpoint: no new files, no new rows
    stream_recommend(spark, rec, _colors(spark), src, sink, ckpt, max_files_per_trigger=1)
    assert read_answers(spark, sink).count() == len(a)
