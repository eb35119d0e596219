"""Registered queries of this subpackage (thin; the work is in the operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corkscrew.session import table

from . import alignment, chat, jaccard, ngram_lm, packing, quality, sentencepiece_fst, simhash, substring, topk, toxicity, urls, vector_codes
from .spark import relax, settle, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOXIC_CATEGORIES = ("low_quality", "toxic")


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        try:
            return fn(spark, sf_dir)
        finally:
            relax(spark)

    QUERIES[fn.__name__] = run
    return fn


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


@query
def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentencepiece_fst.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    back = sentencepiece_fst.decode(ids, model)
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


@query
def op2_exact_topk(spark, sf_dir):
    rows = topk.quantize(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("id") % 50 == 0), k=5)


URL_RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]


@query
def op3_url_filter(spark, sf_dir):
    out = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "blocked_score")


@query
def op4_quality_rules(spark, sf_dir):
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())


@query
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


@query
def op8_substring_dedup(spark, sf_dir):
    out = substring.remove_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op9_lm_score(spark, sf_dir):
    return ngram_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, toxicity_labels(spark, sf_dir), TOXIC_CATEGORIES)
    scored = toxicity.predict(docs, chain)
    return scored.select("doc_id", "low_quality_p", "toxic_p", (F.col("toxic_p") >= 0.5).alias("toxic"))


@query
def op11_alignment(spark, sf_dir):
    import public_tokenizers

    a, b = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The learning rounds of op12 in plain SQL, every part against every entry."""
    step = "len(v) // {n}".format(n=parts)
    sql = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT r, p, list_slice(v, p * ({step}) + 1, (p + 1) * ({step})) AS x FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        sql.append(f"d{k} AS (SELECT r, a.p, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts a JOIN book{k} b ON a.p = b.p)")
        sql.append(f"near{k} AS MATERIALIZED (SELECT r, p, first(x) AS x, min(d) AS d, arg_min(e, struct_pack(d := d, e := e)) AS e FROM d{k} GROUP BY r, p)")
        if k < rounds:
            sql.append(f"flat{k} AS (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k})")
            sql.append(f"mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(CAST(y AS HUGEINT)) / count(*)) AS m FROM flat{k} GROUP BY p, e, i) GROUP BY p, e)")
            sql.append(f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)")
    sql.append(f"coded AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)")
    sql.append(f"sha AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), 'string_agg', ','), ',' ORDER BY p, e)) AS s FROM book{rounds})")
    return (
        "WITH " + ", ".join(sql) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        "sha.s AS codebooks_sha256 FROM coded JOIN kept USING (r), sha"
    )


ORACLE["op12_vector_codes"] = codes_sql()


@query
def op12_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = settle(coded, "codes")
    # written first, so that Spark knows its size: broadcast if small, else shuffled
    per_label = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"), "codes-labels")
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("same")))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    sha = F.lit(books.sha256() if books else None).cast("string")
    return out.select("vec_id", code.alias("code"), "error", "label_error", sha.alias("codebooks_sha256"))


@query
def op13_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
