"""Alignment, vector codes, n-gram Jaccard join: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corkscrew.llm import alignment, jaccard, vector_codes
from corkscrew.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_FILE, B_FILE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, component_id int")


def all_texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


# -- alignment

LETTERS = alignment.byte_letters()


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def whole_tokens(tokenizers, text):
    """Ids and byte strings of a whole text, straight from the libraries."""
    a, b = tokenizers
    x = a.encode(" " + text, add_special_tokens=False)
    y = b.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in t) for t in x.tokens]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    return x.ids, a_bytes, y, b_bytes


def align_truth(tokenizers, texts):
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        a, ab, b, bb = whole_tokens(tokenizers, text)
        raw = (" " + text).encode()
        if b"".join(ab) != raw or b"".join(bb) != raw:
            docs.append(None)
            continue
        ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ae[i] - len(ab[i]), be[j] - len(bb[j])) < min(ae[i], be[j])] if len(a) < 400 else fast_links(ae, be)
        cuts = sorted(set(ae) & set(be))
        groups, i, j = [], 0, 0
        for c in cuts:
            p, q = ae.index(c, i) + 1, be.index(c, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        docs.append((a, b, links, groups))
    held = Counter(p for d in docs if d for p in {(d[0][i], d[1][j]) for i, j in d[2]})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, groups = d
        counts = [held[a[i], b[j]] for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n == top[a[i]] for n, (i, _) in zip(counts, links))
        out.append((len(a), len(b), len(groups), len(links), best, sum(counts), hashlib.sha256(text.encode()).hexdigest()))
    return out


def fast_links(ae, be):
    out, j = [], 0
    for i, end in enumerate(ae):
        while True:
            out.append((i, j))
            if be[j] >= end:
                j += be[j] == end
                break
            j += 1
    return out


ALIGN_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD_TEXTS = [
    None, "", " ", "  ", "a", "word", " lead", "trail ", "two  spaces", "tab\there\n\n new  \n line", "▁under▁", "<s> </s> <unk> <|endoftext|> <0x41>",
    "naïve éè 中文 \U0001f600 x y  z　w  q", "it's we'll 'tis don't 12345 1 2 $%^ ...", "a\x00b \x1c\x1d c\x7f \x85d", "same text", "same text",
    "x" * 3000, "ab " * 2000, "\n" * 50, " . " * 20, "caf́e ́ ​ zero",
]


def test_align_edges(spark, tokenizers):
    got = {r["doc_id"]: tuple(r[c] for c in ALIGN_COLUMNS) for r in alignment.align(documents(spark, ODD_TEXTS), A_FILE, B_FILE).collect()}
    for i, t in enumerate(align_truth(tokenizers, ODD_TEXTS)):
        assert got[i] == t, ODD_TEXTS[i]


def test_align_query(spark, sf, tokenizers):
    rows = all_texts(spark, sf)
    got = {r["doc_id"]: tuple(r[c] for c in ALIGN_COLUMNS) for r in QUERIES["op11_alignment"](spark, sf).collect()}
    assert len(got) == len(rows)
    for (i, _), t in zip(rows, align_truth(tokenizers, [t for _, t in rows])):
        assert got[i] == t


def test_align_returns_ids_and_takes_empty_tables(spark, tokenizers):
    texts = ["some words here", None]
    rows = alignment.align(documents(spark, texts), A_FILE, B_FILE, with_ids=True).orderBy("doc_id").collect()
    a, _, b, _ = whole_tokens(tokenizers, texts[0])
    assert rows[0]["a_ids"] == a and rows[0]["b_ids"] == b and rows[1]["a_ids"] == []
    assert alignment.align(documents(spark, ["x"]).where("doc_id < 0"), A_FILE, B_FILE).collect() == []


def test_align_null_ids_and_repeated_rows(spark, tokenizers):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id long, text string")
    rows = alignment.align(df, A_FILE, B_FILE).collect()
    truth = align_truth(tokenizers, ["one two"] * 3)[0]
    assert len(rows) == 3 and all(tuple(r[c] for c in ALIGN_COLUMNS) == truth for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t  ▁é中1.\x0b\x85", max_size=25) | st.none(), max_size=5))
def test_stretches_tokenize_as_whole_texts(texts):
    pair = alignment.tokenizer_pair(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    a, b = alignment.tokenize(pa.array(texts, pa.string()), pair)
    for d, text in enumerate(texts):
        if not text:
            assert a.bounds[d] == a.bounds[d + 1]
            continue
        x, y = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        raw = (" " + text).encode()
        same = b"".join(pair.a_bytes[i] for i in x) == raw == b"".join(pair.b_bytes[i] for i in y)
        assert a.ids[a.bounds[d] : a.bounds[d + 1]].tolist() == (x if same else [])
        assert b.ids[b.bounds[d] : b.bounds[d + 1]].tolist() == (y if same else [])


def test_align_blocks_do_not_change_results(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40)
    whole = sorted(map(tuple, alignment.align(docs, A_FILE, B_FILE).collect()))
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 500)
    monkeypatch.setattr(alignment, "STEP_BYTES", 3000)
    monkeypatch.setattr(alignment, "STRAND", 7)
    assert sorted(map(tuple, alignment.align(docs, A_FILE, B_FILE).collect())) == whole


def test_align_files_hold_few_blocks(spark, monkeypatch):
    """a reader or writer gathers the rows of a file, and a block is a large row."""
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 20)
    monkeypatch.setattr(alignment, "STEP_BYTES", 100)
    written, settle = {}, alignment.settle

    def kept(table, name, *more):
        written[name] = settle(table, name, *more)
        return written[name]

    monkeypatch.setattr(alignment, "settle", kept)
    texts = [f"some words of text number {i}" for i in range(200)]
    assert alignment.align(documents(spark, texts).coalesce(1), A_FILE, B_FILE).count() == 200
    per_file = Counter(r[0] for r in written["align-blocks"].selectExpr("input_file_name()").collect())
    assert per_file.total() > 16 and max(per_file.values()) <= 8


def test_align_remembers_stretches_of_many_tokens(tokenizers):
    """The same stretch from the library and from what the worker remembers."""
    pair = alignment.TokenizerPair(open(A_FILE, "rb").read(), open(B_FILE, "rb").read())
    stretches = [" " + "\U0001f9ff" * 63, " word", " \u2581", " " + "\u4e2d" * 63]
    first = pair.tokens(stretches)
    assert max(len(a) // 4 for a, _, _ in first) > 128 and not first[2][2]
    assert len(pair.known) == 4 and pair.tokens(stretches) == first
    assert all(isinstance(x, bytes) for x in pair.known.values())  # one object a stretch


# -- vector codes


def codes_truth(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = np.array([v for _, v, _ in kept], object)
    size = m.shape[1] // parts
    cut = [m[:, p * size : (p + 1) * size] for p in range(parts)]
    started = [i for i, r in enumerate(kept) if r[0] is not None][:entries]
    books = [c[started].copy() for c in cut]

    def assign():
        out = []
        for c, b in zip(cut, books):
            d = ((c.astype(np.int64)[:, None] - b.astype(np.int64)[None]) ** 2).sum(2)
            out.append((d.argmin(1), d.min(1)))
        return out

    for _ in range(rounds):
        for (code, _), c, b in zip(assign(), cut, books):
            for e in range(len(b)):
                own = c[code == e]
                if len(own):
                    b[e] = [sum(col) // len(own) for col in own.T]
    found = assign()
    error = sum(e for _, e in found)
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, error.tolist()):
        by_label[lab] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted((i if i is not None else -99, "".join(f"{c[k]:02x}" for c, _ in found), int(error[k]), by_label[lab], sha) for k, (i, _, lab) in enumerate(kept))


def run_codes(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_vector_codes"](spark, str(tmp_path)).collect()
    return sorted((-99 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)


def test_codes_edges(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8) * 0.3)], int(i) % 3 if i % 4 else None) for i in rng.permutation(400)]
    rows += [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 2), (504, [0.5] * 8, None), (504, [0.5] * 8, None), (None, [0.1] * 8, 7)]
    assert run_codes(spark, tmp_path, rows) == codes_truth(rows)


def test_codes_few_rows_and_none(spark, tmp_path):
    rows = [(5, [0.25, -0.5, 1.0, 0.0], 1), (7, [0.25, -0.5, 1.0, 0.5], 1)]
    assert run_codes(spark, tmp_path / "few", rows) == codes_truth(rows)
    assert run_codes(spark, tmp_path / "none", [(1, None, 1)]) == []
    odd, _ = vector_codes.compress(spark.createDataFrame([(1, [0.5, 1.0, 2.0]), (2, [0.5, 1.0, 2.0]), (3, [1.0])], "vec_id long, embedding array<double>"))
    assert sorted((r["vec_id"], r["codes"], r["error"]) for r in odd.collect()) == [(1, [0, 0, 0, 0], 0), (2, [0, 0, 0, 0], 0)]


def test_codes_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in QUERIES["op12_vector_codes"](spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == codes_truth(rows)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 60), st.integers(0, 2**31))
def test_cells_give_the_nearest_entry(width, spread, seed):
    rng = np.random.default_rng(seed)
    entries, part = rng.integers(-spread, spread, (20, 3)), rng.integers(-spread, spread, (200, 3))
    d = ((part[:, None] - entries[None]) ** 2).sum(2)
    search = vector_codes.CellSearch(entries, width)
    for _ in range(2):
        code, error = search.nearest(part)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    assert search.known >= search.met // 2


# -- n-gram Jaccard join


def shingle_set(text, k=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_truth(docs, k=4, percent=85):
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            held[g].append(n)
    for n, (i, s) in enumerate(sets):
        for m in {m for g in s for m in held[g] if m < n}:
            j, t = sets[m]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def run_jaccard(df, **args):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(df, **args).collect())


def family(rng, size, members, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(members):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(size)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("least", [2, 4, 1000])
def test_jaccard_random(spark, least):
    rng = random.Random(least)
    texts = [None, "", " \n", "one", "One", "one two three", "ONE two\tthree", "a b c d", "a b c d", "A B c d", "a b c e"]
    for size in (5, 6, 7, 8, 12, 30, 60, 120, 130, 400):
        texts += family(rng, size, 12, max(1, size // 25))
    common = [f"w{rng.randrange(40)} x y z" for _ in range(10)]
    texts += [" ".join(rng.choice(common) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    texts += ["boiler plate text of some length " * 3 + f"end {i % 7}" for i in range(40)]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 3))
    assert run_jaccard(documents(spark, texts, 3), least=least) == jaccard_truth(docs)


def test_jaccard_few_words(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(13))) for _ in range(60)]
    assert run_jaccard(documents(spark, texts), least=2, shingle=3, percent=75) == jaccard_truth(list(enumerate(texts)), 3, 75)


def test_jaccard_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "A b c d e"), (9, "z y x w v")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(df).collect())
    assert rows == [(-1, None, None), (4, 2, 4), (4, 2, 4), (9, 2, 4), (9, 2, 4)]
    assert jaccard.jaccard_groups(df.where("doc_id < 0")).collect() == []
    long = documents(spark, ["w " * 400_000, "w " * 399_999, "word" * 100_000])
    assert run_jaccard(long) == [(0, 1, 0), (1, 1, 0), (2, 1, 2)]


def test_jaccard_unlinked_relatives(spark, monkeypatch):
    """A large group of texts that share most of their words but do not link is not verified pair by pair."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), 12):
            words[at] = f"v{i}x{at}"
        texts.append(" ".join(words))
    texts += texts[:1] + [texts[1] + " end"]
    seen = []
    check = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *args: seen.append(pairs.count()) or check(pairs, *args))
    assert run_jaccard(documents(spark, texts), least=4) == jaccard_truth(list(enumerate(texts)))
    assert sum(seen) < 5 * len(texts)


def test_jaccard_sketch_loses_no_link():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 60, 300, 900):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        gone = rng.integers(0, len(a), max(1, n // 20))
        b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(-(2**63), 2**63 - 1, n // 30)]))
        words = jaccard.sketches(np.array([0, len(a), len(a), len(a) + len(b)]), np.concatenate([a, b]))
        assert not words[1].any()
        bits = int(np.unpackbits((words[0] ^ words[2]).view(np.uint8)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


@pytest.mark.parametrize("percent", [75, 85])
def test_jaccard_pairs_of_frequent_tokens_stay_few(percent):
    """A set of frequent tokens alone is indexed under a few pairs for each token of its prefix, and its prefix is filled."""
    rng = np.random.default_rng(percent)
    for n in (2, 3, 4, 5, 8, 31, 64, 500, 1023, 4096):
        token = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        p = jaccard.Prefixes(np.array([0, len(token)]), token, token, percent)
        sig, own = p.signatures()
        levels = len(p._levels()[0])
        assert len(own) <= 3 * levels * max(1, int(p.need[0])) and len(np.unique(sig)) == len(sig)
        assert len(own) >= levels


def test_jaccard_query(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["op13_ngram_jaccard"](spark, sf).select("doc_id", "n_shingles", "component_id").collect())
    assert got == jaccard_truth(all_texts(spark, sf))
