"""Quality, SimHash, substring dedup, LM scores: against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corkscrew.llm import components, ngram_lm, quality, simhash, substring
from corkscrew.llm import text as X
from corkscrew.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n\t ", "one", "one two", "a b c a b c a b c", "é\u00a0x\ny z\n\ny z", "same text here " * 30, "same text here " * 30, "w" * 50_000, "\n".join(["line one", "line one", " line one", ""] * 5)]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "n", i) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, kept int")


def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- words and hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\u00a0\x0b", max_size=12) | st.none(), max_size=6))
def test_words_as_the_pattern_splits(texts):
    data, off = X.utf8(pa.array(texts, pa.string()))
    start, end, bounds = X.words(data, off)
    for d, t in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(start[bounds[d] : bounds[d + 1]], end[bounds[d] : bounds[d + 1]])]
        assert got == WORD.findall(t or "")


def test_window_hash_does_not_depend_on_place():
    h = X.mix(np.arange(50, dtype=np.uint64))
    twice = np.concatenate([h[10:20], h])
    w = X.window_hashes(twice, 5)
    assert w[0] == w[20] and len(set(w.tolist())) == len(w) - 6


# -- quality rules


def quality_truth(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = [False] * len(words)
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit[i : i + 3] = [True] * 3
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * sum(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(hit), failed


def check_quality(rows, texts):
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == quality_truth(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_edges(spark):
    docs = documents(spark, EDGE)  # columns n_words and kept clash
    check_quality(quality.judge(docs).collect(), dict(enumerate(EDGE)))
    assert quality.judge(docs.where("false")).collect() == []


def test_quality_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf).collect()}
    rows = QUERIES["op4_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    check_quality(rows, texts)


def test_quality_rejects_repetition_and_keeps_prose(spark):
    rng = random.Random(1)
    prose = " ".join(f"w{rng.randrange(3000)}" for _ in range(400))
    passage = " ".join(f"p{i}" for i in range(12))
    looped = " ".join(f"{passage} x{i}" if i % 2 else f"y{i} z{i} u{i} v{i} t{i} s{i} r{i} q{i} o{i} m{i} l{i} k{i} j{i}" for i in range(60))
    kept = [r["kept"] for r in quality.judge(documents(spark, [prose, looped])).orderBy("doc_id").collect()]
    assert kept == [True, False]


def test_quality_rejects_passages_pasted_twice(spark):
    def pasted(share):  # ``share`` of 400 words in two copies of each of two passages, the first included
        size = int(400 * share) // 4
        one, two = (" ".join(f"{c}{i:03}" for i in range(size)) for c in "pq")
        rest = [f"r{i:03}" for i in range(400 - 4 * size)]
        a, b = len(rest) // 3, 2 * len(rest) // 3
        return " ".join([one, *rest[:a], two, *rest[a:b], one, two, *rest[b:]])

    rows = quality.judge(documents(spark, [pasted(s) for s in (0.0, 0.1, 0.22, 0.3, 0.4)])).orderBy("doc_id").collect()
    assert [r["base_failed"] for r in rows] == [False] * 5
    assert [r["kept"] for r in rows] == [True, True, False, False, False]


# -- SimHash


def fingerprint_truth(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component_truth(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check_simhash(rows, texts):
    fps = {i: fingerprint_truth(t) for i, t in texts.items()}
    roots = component_truth(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", roots[i]) for i in texts}


def test_simhash_edges(spark):
    check_simhash(simhash.near_duplicates(documents(spark, EDGE)).collect(), dict(enumerate(EDGE)))
    none = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(none).collect()) == [(-1, -1), (4, 4), (4, 4)]
    assert simhash.near_duplicates(none.where("false")).collect() == []


def test_simhash_query(spark, sf):
    check_simhash(QUERIES["op6_simhash"](spark, sf).collect(), {r["doc_id"]: r["text"] for r in table(spark, sf).collect()})


@pytest.mark.parametrize("max_shard", [3, 2048])
def test_links_keep_components_in_dense_clusters(spark, max_shard):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_shard=max_shard)
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    truth = component_truth({x: x & (1 << 64) - 1 for x in signed})
    assert {x: got.get(x, x) for x in signed} == truth


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(0)
    v = np.unique(np.concatenate([rng.integers(0, 2**63, 200).astype(np.uint64), np.uint64(7) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))]))
    pairs = {(int(a), int(b)) for x, y in simhash.BKTree(v).within(v, 2) for a, b in zip(x, y)}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 2
    assert pairs == set(zip(*(i.tolist() for i in np.nonzero(near))))


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (200, 201)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100, 201: 200}


# -- substring dedup


def substring_truth(texts, window=20):
    seen, out = set(), {}
    for i in sorted(texts):
        words = WORD.findall(texts[i] or "")
        cut = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                cut[k : k + window] = [True] * window
            seen.add(w)
        out[i] = (len(words), sum(cut), " ".join(w for w, c in zip(words, cut) if not c))
    return out


def check_substring(df, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}
    assert got == substring_truth(texts)


def test_substring_edges(spark):
    texts = [*EDGE, " ".join(map(str, range(20))), "x " + " ".join(map(str, range(20))) + " y", " ".join(map(str, range(1, 20))), " ".join(map(str, list(range(25)) * 3))]
    check_substring(substring.remove_duplicates(documents(spark, texts)), dict(enumerate(texts)))
    assert substring.remove_duplicates(documents(spark, texts).where("false")).collect() == []


def test_substring_rows_without_or_with_equal_ids(spark):
    text = " ".join(map(str, range(40)))
    rows = spark.createDataFrame([(None, text), (3, text), (3, text), (9, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_duplicates(rows).collect()) == [(0, 0), (3, 0), (3, 0), (9, 40)]


@pytest.mark.parametrize("seed", range(4))
def test_substring_random_passages(spark, seed):
    rng = random.Random(seed)
    pool = [[f"{'ab'[rng.randrange(2)]}{rng.randrange(4)}" for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    texts = {}
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randrange(60)] + [f"u{rng.randrange(50)}" for _ in range(rng.randrange(6))]
        texts[i] = " ".join(parts)
    check_substring(substring.remove_duplicates(documents(spark, [texts[i] for i in range(40)])), texts)


def test_substring_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf).collect()}
    truth = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in substring_truth(texts).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op8_substring_dedup"](spark, sf).collect()} == truth


def test_factors_join_spans_of_one_source(spark):
    text = " ".join(map(str, range(90)))
    docs = documents(spark, [text, "head " + text])
    got = substring.factors(substring.duplicate_spans(docs)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 90, 0, 0)]


# -- LM scores


def lm_truth(docs, corpus, alpha=0.4, least=1):
    c = {n: Counter() for n in (1, 2, 3)}
    for t in corpus:
        w = WORD.findall(t or "")
        for n in c:
            c[n].update(zip(*[w[i:] for i in range(n)]))
    total = sum(c[1].values()) or 1
    out = []
    for t in docs:
        w = WORD.findall(t or "")
        score = 0.0
        for i in range(len(w)):
            for n in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log(max(c[1][g], 0.5) / total)
                elif c[n][g] >= least:
                    score += math.log(c[n][g] / c[n - 1][g[:-1]])
                    break
                else:
                    score += math.log(alpha)
        out.append((len(w), score))
    return out


def check_lm(df, truth):
    for r in df.collect():
        n, score = truth[r["doc_id"]]
        assert r["n_tokens"] == n and r["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert (r["mean_log_score"] is None) == (n == 0)


def test_lm_edges(spark):
    texts = [*EDGE, "a b c d", "a b x", "c a b"]
    check_lm(ngram_lm.score(documents(spark, texts)), lm_truth(texts, texts))
    assert ngram_lm.score(documents(spark, texts).where("false")).collect() == []


def test_lm_other_corpus(spark):
    texts, corpus = ["the cat sat", "a dog sat on the mat", "zzz", None], ["the cat sat on the mat", "the cat sat down", "a dog"]
    check_lm(ngram_lm.score(documents(spark, texts), documents(spark, corpus)), lm_truth(texts, corpus))


def test_lm_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf).collect()}
    ids = sorted(texts)
    truth = dict(zip(ids, lm_truth([texts[i] for i in ids], texts.values())))
    df = QUERIES["op9_lm_score"](spark, sf)
    assert df.select(F.sum("n_tokens")).first()[0] == sum(n for n, _ in truth.values())
    check_lm(df, truth)


def test_lm_uses_ngrams_found_once(spark, sf):
    texts = ["a b c d", "a b x", "c a b", "p q r"]
    check_lm(ngram_lm.score(documents(spark, texts)), lm_truth(texts, texts, least=1))
    check_lm(ngram_lm.score(documents(spark, ["a b c", "p q x"]), documents(spark, texts)), lm_truth(["a b c", "p q x"], texts, least=1))
    rows = {r["doc_id"]: r["text"] for r in table(spark, sf).collect()}
    ids = sorted(rows)
    check_lm(QUERIES["op9_lm_score"](spark, sf), dict(zip(ids, lm_truth([rows[i] for i in ids], rows.values(), least=1))))


def test_lm_counts_beyond_32_bits(spark):
    import numpy as np

    gram, bounds = np.array([77], np.uint64), np.array([0, 1], "<i8").tobytes()
    asked = [(0, block, True, True, ngram_lm._steps(gram), ngram_lm._planes(np.array([3_000_000_000]))) for block in (1, 2)]
    df = spark.createDataFrame(asked, "bucket int, block long, counts boolean, asks boolean, grams binary, times binary")
    answers = [r.asDict() for r in ngram_lm._answered(df, 1).where("block = 1").collect()]
    b = ngram_lm._Block({"bounds": bounds, "vocab": ngram_lm._steps(gram), "words": ngram_lm._planes(np.array([0]))}, 1)
    b.learn(1, answers)
    assert b.count[1].tolist() == [6_000_000_000]
