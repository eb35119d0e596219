"""SentencePiece, top-k, URL rules, chat, packing, toxicity, pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corkscrew.llm import chat, packing, sentencepiece_fst, topk, toxicity, urls
from corkscrew.llm.queries import QUERIES, TOXIC_CATEGORIES, URL_RULES, toxicity_labels

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  world\n\n\tx", " lead and trail ", "你好 é\u0301 \U0001f600", "a" * 3000, "naïve ½ don't I'LL", "x\x1cy \x1f", "tokens<|endoftext|> in text", "Σας ΟΔΟΣ İ"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")


def table(spark, sf, name="documents"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- SentencePiece


def test_sentencepiece_equals_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in TEXTS if t is not None] + [r["text"] for r in table(spark, sf).collect()]
    rows = sentencepiece_fst.decode(sentencepiece_fst.encode(documents(spark, texts), PIECES), PIECES).orderBy("doc_id").collect()
    assert [r["ids"] for r in rows] == library.encode(texts)
    assert [r["decoded"] for r in rows] == texts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thein gsaT\n.é▁<0xé", max_size=24))
def test_sentencepiece_paths(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = sentencepiece_fst.piece_model(PIECES)
    ids = np.frombuffer(model.encode(text), "<i4").tolist()
    assert ids == library.encode(text)
    assert model.decode(ids) == text.replace("▁", " ")


def test_sentencepiece_unigram_path():
    raw = bytearray(open(PIECES, "rb").read())
    # the same pieces read as a unigram model: model_type 2 -> 1 in the trainer's fields
    at = raw.index(b"tok_v0") + len(b"tok_v0")
    assert raw[at : at + 2] == b"\x18\x02"
    raw[at + 1] = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))
    model = sentencepiece_fst.PieceModel(bytes(raw))
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice("thein gsaT.é") for _ in range(rng.randrange(20)))
        assert np.frombuffer(model.encode(text), "<i4").tolist() == library.encode(text)


def test_sentencepiece_nulls_and_empty(spark):
    out = sentencepiece_fst.decode(sentencepiece_fst.encode(documents(spark, [None, ""]), PIECES), PIECES).orderBy("doc_id").collect()
    assert [(r["ids"], r["decoded"]) for r in out] == [(None, None), ([], "")]
    assert sentencepiece_fst.encode(documents(spark, TEXTS).where("false"), PIECES).collect() == []


# -- top-k


def topk_truth(rows, k):
    out = set()
    for q, a in rows.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows.items() if i != q and len(b) == len(a))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def run_topk(df, **args):
    rows = topk.quantize(df)
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(rows, rows.where("id % 50 = 0"), **args).collect()}


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_topk_random_with_ties(spark, slices):
    rng = random.Random(slices)
    rows = {i: [rng.randrange(-2, 3) / 256 for _ in range(6)] for i in range(300)}
    for i in range(100, 180):
        rows[i] = rows[50]  # copies of a query
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    truth = topk_truth({i: [round(256 * x) for x in v] for i, v in rows.items()}, 5)
    assert run_topk(df, k=5, slices=slices, block=64, query_block=4) == truth


def test_topk_rows_moved_grow_with_queries(spark, monkeypatch):
    """tables of rows per query and vector filled the disk at 6 GB."""
    rng = random.Random(1)
    rows = {i: [rng.randrange(-128, 128) / 256 for _ in range(16)] for i in range(2000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found, settle = {}, topk.settle

    def kept(table, name):
        found[name] = settle(table, name)
        return found[name]

    monkeypatch.setattr(topk, "settle", kept)
    assert run_topk(df, k=2, block=64, query_block=16) == topk_truth({i: [round(256 * x) for x in v] for i, v in rows.items()}, 2)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found["topk-found"].count() <= 40 * 3 * groups


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.5, -0.5]), (None, [9.0, 9.0]), (5, [0.5, -0.5]), (50, []), (7, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert run_topk(df, k=5) == {(0, 1, 5, 256 * 128 - 512 * 128)}
    assert run_topk(df.where("false"), k=5) == set()


def test_topk_query(spark, sf):
    rows = {r["vec_id"]: [int(np.floor(256 * float(x))) for x in r["embedding"]] for r in table(spark, sf, "embeddings").collect()}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["op2_exact_topk"](spark, sf).collect()}
    assert got == topk_truth(rows, 5)


# -- URLs


def url_truth(url):
    import re

    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in URL_RULES:
        own, slash, more = r.pattern.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + more) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return host, path, best and best.pattern, best and best.verdict


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com", "http://example.com/en", "http://a.example.com/en/", "http://xnet/es/", "http://a.net/es/1", "http://a.net?x=/fr/", "http://a.com#/", "http://É.com/ÄB", "x://y://z.com/", "http://a\nb.com/\nc"]


def check_urls(rows):
    for r in rows:
        host, path, rule, verdict = url_truth(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert r["verdict"] == (verdict or ("block" if r["blocked_score"] > 0 else "allow"))


def test_url_edges(spark):
    df = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, blocked_score double")
    rows = urls.judge(df, URL_RULES).collect()
    assert len(rows) == len(URLS)
    check_urls(rows)
    assert urls.judge(df.where("false"), URL_RULES).collect() == []


def test_url_query_and_model(spark, sf):
    pages = {r["page_id"]: r["url"] for r in table(spark, sf, "pages").select("page_id", "url").collect()}
    rows = QUERIES["op3_url_filter"](spark, sf).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    check_urls([{**r.asDict(), "url": pages[r["page_id"]]} for r in rows])


def test_url_model_on_held_out_hosts(spark):
    labelled = spark.createDataFrame(urls.labelled_table(), "host string, path string, blocked boolean")
    test = F.pmod(F.xxhash64("host"), F.lit(5)) == 0
    model = urls.fit(labelled.where(~test))
    out = urls.predict(labelled.where(test), model).collect()
    right = sum((r["blocked_score"] > 0) == r["blocked"] for r in out) / len(out)
    assert len(out) > 100 and right > 0.9
    probe = spark.createDataFrame([("casino-win.example.net", "/en/5"), ("m.spam-farm.example.org", "/x"), ("blog.thather.example.org", "/fr/9"), ("thon.example.net", "/de/1")], "host string, path string")
    assert [r["blocked_score"] > 0 for r in urls.predict(probe, model).collect()] == [True, True, False, False]


def test_url_model_does_not_go_by_shape(spark):
    model = urls.fit(spark.createDataFrame(urls.labelled_table(), "host string, path string, blocked boolean"))
    blocked = ["casino.example.net", "m.casino.example.net", "blog.viagra.example.net", "porn.example.org", "pokerbonus.example.com", "slots.casino.example.org", "www.viagra.test.de"]
    clean = ["city-library.example.org", "garden-recipes.example.net", "m.music-school.example.com", "history-museum.test.de", "weather.example.org", "blog.travel.example.net"]
    probe = spark.createDataFrame([(i, h, "/en/5") for i, h in enumerate(blocked + clean)], "i int, host string, path string")
    got = {r["host"]: r["blocked_score"] > 0 for r in urls.predict(probe, model).collect()}
    assert got == {h: h in blocked for h in blocked + clean}


def test_url_model_without_two_classes(spark):
    empty = spark.createDataFrame([], "host string, path string, blocked boolean")
    one = spark.createDataFrame([("a", "/", True)], "host string, path string, blocked boolean")
    assert urls.fit(empty).intercept < 0 < urls.fit(one).intercept


# -- chat


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def chat_truth(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), digest(said)


def check_chat(rows, by_conv):
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows} == {k: chat_truth(v) for k, v in by_conv.items()}


def test_chat_edges(spark):
    nasty = ["\\", "\\\\### User:", "### Assistant:", "</turn>", "</tur", "</turn></turn>\\", "### Role: x</role>", "", None, " ", "\n", "\\### Assistant: </turn> ok"]
    rows = [(c, i, role, t) for c, role in enumerate(["user", "assistant", "tool </role>", None, ""]) for i, t in enumerate(nasty)]
    truth = defaultdict(list)
    for c, _, role, t in rows:
        truth[c].append((role or "", t or ""))
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    check_chat(chat.read_back(chat.format_conversations(df)).collect(), truth)
    assert chat.read_back(chat.format_conversations(df.where("false"))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.text(alphabet="\\#</turn>Role: Asi", max_size=30)), max_size=6))
def test_chat_round_trip(turns):
    f = chat.Formatter(chat.Template())
    assert f.read("".join(part for r, t in turns for part, _ in f.segments(r, t))) == turns


def test_chat_machine(spark):
    convs = [["user", "assistant"], ["system", "user", "assistant", "user", "assistant"], ["assistant", "user"], ["user"], ["user", "user", "assistant"], ["user", "tool", "assistant"]]
    df = spark.createDataFrame([(c, i, r, "t") for c, roles in enumerate(convs) for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    assert [r["valid"] for r in chat.format_conversations(df).orderBy("conv_id").collect()] == [True, True, False, False, False, False]


def test_chat_query(spark, sf):
    by_conv = defaultdict(list)
    for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: r["turn"]):
        by_conv[r["conv_id"]].append((r["role"], r["text"] or ""))
    tricky = "\\### Assistant: </turn> ok"
    by_conv[-7] = [("user", tricky), ("assistant", tricky)]
    check_chat(QUERIES["op7_chat_format"](spark, sf).collect(), by_conv)


# -- packing


def test_word_ids_equal_the_tokenizer(spark, sf):
    tokenizer, mine = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    assert mine.plain
    for t in [t for t in TEXTS if t] + [r["text"] for r in table(spark, sf).collect()]:
        assert np.frombuffer(mine.text(t), "<i4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check_pack(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_edges(spark):
    texts = [(i % 9 if i % 9 else None, t) for i, t in enumerate(TEXTS + TEXTS + ["word " * 5000])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_pack(packing.pack_documents(df, WORDS, capacity=64).collect(), texts, 64)
    assert packing.pack_documents(df.where("false"), WORDS).collect() == []


def test_pack_query_is_near_the_bound(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf).collect()]
    rows = QUERIES["op5_best_fit_packing"](spark, sf).collect()
    used = check_pack(rows, texts, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(df, WORDS, capacity=50, with_ids=True), capacity=50)
    flat = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert flat[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=7), st.integers(1, 60))
def test_fullest_combination(available, room):
    items = [x for x, n in available.items() for _ in range(n)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    found = packing.fullest(available, room)
    assert sum(x * n for x, n in found) == max(sums)
    assert all(n <= available[x] for x, n in found)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_seats_every_piece(counts):
    plan = packing.minimum_slack_plan(counts, 50)
    bins = defaultdict(list)
    for length, n in counts.items():
        b, o = plan.seat(np.full(n, length), np.arange(n))
        for x, y in zip(b.tolist(), o.tolist()):
            bins[x].append((y, length))
    assert len(bins) == plan.bins
    for b in bins.values():
        ends = np.cumsum([x for _, x in sorted(b)])
        assert [y for y, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 50


# -- toxicity


def toxic_corpus(n=600, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["Grobian,", "lump!", "SCHUFT"])
        low = rng.random() < 0.2
        rows.append((i, " ".join(w + "%%%" if low else w for w in words), int(low), int(toxic)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    chain = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 400").select("doc_id", "low_quality", "toxic"), TOXIC_CATEGORIES)
    out = toxicity.predict(df.where("doc_id >= 400"), chain).collect()
    assert sum((r["toxic_p"] >= 0.5) == r["toxic"] for r in out) / len(out) > 0.97
    assert sum((r["low_quality_p"] >= 0.5) == r["low_quality"] for r in out) / len(out) > 0.97
    assert len(chain.categories[1].weights) == len(chain.categories[0].weights) + 1


def test_toxicity_keeps_every_significant_word(spark):
    # 700 words of low quality, one set in each such text, and a toxic word weaker than all of them
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        low, toxic = i % 2, i % 5 == 0
        words = [f"l{j}" for j in range(700)] if low else [f"g{j}" for j in range(5)]
        rows.append((i, " ".join(words + (["grob"] if toxic and rng.random() < 0.6 else [])), low, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    chain = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "low_quality", "toxic"), TOXIC_CATEGORIES)
    assert len(chain.vocabulary) == 706
    probe = spark.createDataFrame([(1, "g0 g1 g2 g3 g4 grob"), (2, "g0 g1 g2 g3 g4")], "doc_id long, text string")
    assert [r["toxic_p"] > 0.5 for r in toxicity.predict(probe, chain).orderBy("doc_id").collect()] == [True, False]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "a b", "c"), (3, "a b", "c"), (None, "x", "c")], "doc_id long, text string, toxic_p string")
    labels = spark.createDataFrame([(1, 0.0, None), (2, 0.0, 0.0), (3, 0.0, 1.0), (3, 0.0, 0.0), (None, 1.0, 1.0)], "doc_id long, low_quality double, toxic double")
    for known in (labels, labels.where("false"), labels.where("doc_id = 2")):
        out = toxicity.predict(docs, toxicity.fit(docs, known, TOXIC_CATEGORIES)).collect()
        assert len(out) == 5 and all(0 <= r["toxic_p"] <= 1 and r["low_quality_p"] < 0.5 for r in out)
    assert toxicity.predict(docs.where("false"), toxicity.fit(docs, labels, TOXIC_CATEGORIES)).collect() == []


# -- pipeline


def test_pipeline_stages_against_brute_force(spark, sf):
    from .test_text_operators import component_truth, fingerprint_truth, quality_truth, substring_truth

    docs = table(spark, sf)
    docs = docs.unionByName(docs.limit(3))  # repeated rows
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {n: [r["doc_id"] for r in d.collect()] for n, d in inputs.items()}
    texts = {n: {r["doc_id"]: r["text"] for r in d.collect()} for n, d in inputs.items()}

    labels = {r["doc_id"]: r["toxic"] for r in toxicity_labels(spark, sf).collect()}
    gone = set(ids["toxicity"]) - set(ids["quality_rules"])
    known = [i for i in texts["toxicity"] if i in labels]
    assert sum((i in gone) == bool(labels[i]) for i in known) / len(known) > 0.9
    kept = set(ids["simhash_near_dedup"])
    assert kept <= {i for i in ids["quality_rules"] if not quality_truth(texts["quality_rules"][i])[5]}
    roots = component_truth({i: fingerprint_truth(t) for i, t in texts["simhash_near_dedup"].items()})
    assert sorted(ids["substring_dedup"]) == sorted(set(roots.values()))
    for i, (_, cut, left) in substring_truth(texts["substring_dedup"]).items():
        assert texts["best_fit_packing"][i] == (left if cut else texts["substring_dedup"][i])
    check_pack(docs.collect(), list(texts["best_fit_packing"].items()), 2048)


def test_pipeline_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        table(spark, sf, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
