"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles; two documents link when
``100 * |x & y| >= percent * |x | y|``. Equal texts are one class, which one
set represents, so a group of copies is never joined with itself.

1. *Sets*: 64-bit shingle hashes in ascending order, the lowest eighth of the
   hash range apart (``head``) from the rest (``tail``).
2. *Token classes*: prefixes in hash order are counted; tokens in many
   prefixes are frequent. Frequent tokens go to the end of the order, so that
   prefixes reach other tokens, which are counted in turn, ``passes`` times.
   Any set of frequent tokens gives right results; it sets the cost alone. A
   frequent token fills ``least`` prefixes, and at least one in
   ``FREQUENT_ROWS`` of all prefix entries, so at most ``passes *
   FREQUENT_ROWS`` tokens are frequent: the size bound of their broadcast.
3. *Signatures*: a set that may differ from a partner in ``need - 1`` tokens
   is indexed under its first ``need`` rare tokens, one by one. Where it has
   fewer, the prefix is extended with frequent tokens, and these count as
   pairs: they are dealt into buckets by hash, a bucket of m tokens is
   indexed under its pairs and stands for m - 1 rare tokens. Of two linked
   sets the one whose prefix ends first shares a rare token or a pair with
   the other. Buckets are small (two tokens or so), as a bucket's pairs grow
   with the square of m, and never too many for the prefix to be filled. Their
   number follows the size level (powers of two),
   which is part of the signature; a set close above a level's lower end is
   indexed for the level below too.
4. *Verification*: in each signature's group all members meet one of them
   first (stars), which joins groups of near copies with few comparisons.
   What still lies in different components meets as every pair in groups of
   at most ``PAIR_GROUP`` members, further stars in larger ones, and in the
   end every remaining pair from different components. Pairs must agree in
   size and in the sketch, 256 parities of the set's tokens by hash (each
   token that only one set has turns one over, so more of them than linked sets
   have differences means no link), inside the join, then in ``sample``, the head
   in 32 bits (by the same count), then in the whole sets. So no link is lost but those
   inside a component that other links already join.

Defined results: null, empty or wordless texts have no shingles and their own
id as component; texts with fewer words than a shingle have one, the whole
sequence; rows without an id take no part and get nulls; rows that share an id
are one document in linking, each with its own number of shingles; repeated
rows stay repeated; an empty table gives an empty result; a very long text is
one slice of a step, so a worker's memory grows with the longest text.
Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .components import components
from .spark import STEP_BYTES, discard, settle, ship

#: Most frequent tokens a counting pass may find.
FREQUENT_ROWS = 500_000
#: Signatures (one long each) that are broadcast; more are joined by a shuffle.
BROADCAST_SIGNATURES = 2_000_000
#: End of the lowest eighth of the (signed) hash range.
HEAD_END = -(1 << 63) + (1 << 61)
#: Members of a signature's group that meet as pairs after the first star.
PAIR_GROUP = 64
#: Parity words (64 bits each) of a set.
SKETCH = ("k0", "k1", "k2", "k3")


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def sequence_hashes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each text's whole word sequence (texts without words: 0)."""
    count = np.diff(bounds)
    out = np.zeros(len(count), np.uint64)
    has = count > 0
    if has.any():
        place = np.arange(len(h)) - np.repeat(bounds[:-1], count)
        each = h * X.powers(X.WORD_BASE, int(count.max()))[place]
        out[has] = X.mix(np.add.reduceat(each, bounds[:-1][has]) + count[has].astype(np.uint64) * np.uint64(X.BYTE_BASE))
    return out


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each text's distinct shingle hashes, ascending as signed numbers."""
    data, off = X.utf8(column)
    upper = (data >= 0x41) & (data <= 0x5A)
    data = data + upper.astype(np.uint8) * np.uint8(0x20)
    start, end, bounds = X.words(data, off)
    h = X.span_hashes(data, start, end)
    owner = X.owners(bounds)
    if len(h) >= shingle:
        whole = X.inside_text(owner, shingle)
        value, doc = X.window_hashes(h, shingle)[whole], owner[: len(whole)][whole]
    else:
        value, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < shingle))
    value = np.concatenate([value, sequence_hashes(h, bounds)[short]]).view(np.int64)
    doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        first = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
        value, doc = value[first], doc[first]
    return np.searchsorted(doc, np.arange(len(off))), value


def _shorten(head: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct leading 32 bits of each text's ascending ``head``, offsets)."""
    value = (head >> 29).astype(np.int32)  # the three highest bits are the same in all of them
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
    return value[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def sketches(off: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Parity words of each set, one column a word: bit i is the parity of its tokens with hash i."""
    bits = 64 * len(SKETCH)
    at = (X.mix(value.view(np.uint64)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(X.owners(off) * bits + at, minlength=(len(off) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(sid, h1, h2, n, k0..., sample, head, tail) of rows (sid, h1, h2, text)."""
    words = SKETCH  # a value for the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in X.row_slices(batch.column(3), STEP_BYTES):
                off, value = shingle_sets(batch.column(3).slice(lo, hi - lo), shingle)
                low = value < HEAD_END
                seen = np.concatenate([[0], np.cumsum(low)])[off]
                sample, sample_off = _shorten(value[low], seen)
                marks = [pa.array(k) for k in np.ascontiguousarray(sketches(off, value).T)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns[:3], pa.array(np.diff(off).astype(np.int32)), *marks, _lists(sample_off, sample), _lists(seen, value[low]), _lists(off - seen, value[~low])],
                    names=["sid", "h1", "h2", "n", *words, "sample", "head", "tail"],
                )

    return rows.mapInArrow(run, f"sid long, h1 long, h2 long, n int, {', '.join(f'{k} long' for k in SKETCH)}, sample array<int>, head array<long>, tail array<long>")


def _ceil_share(n, percent: int):
    return (percent * n + 99) // 100


class Prefixes:
    """Prefixes of a batch of sets under a class assignment of the tokens."""

    def __init__(self, off: np.ndarray, token: np.ndarray, frequent: np.ndarray, percent: int):
        self.off, self.percent, self.n = off, percent, np.diff(off)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        often = np.zeros(len(token), bool)
        if len(frequent) and len(token):
            at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
            often = (frequent[at] == token) & (self.n > 1)[owner]  # a single token has no pair
        order = np.argsort(owner * 2 + often, kind="stable")
        self.token, self.owner = token[order], owner
        self.place = np.arange(len(token)) - off[:-1][owner]
        self.rare = np.bincount(owner[~often], minlength=len(self.n))
        self.need = self.n - _ceil_share(self.n, percent) + 1

    def first(self) -> np.ndarray:
        """Tokens of the plain prefixes."""
        return self.token[self.place < self.need[self.owner]]

    def _levels(self) -> tuple[np.ndarray, np.ndarray]:
        has = np.flatnonzero(self.n > 0)
        level = np.floor(np.log2(self.n[has])).astype(np.int64)
        below = (self.percent * self.n[has] < 100 << level) & (level > 0)
        return np.concatenate([has, has[below]]), np.concatenate([level, level[below] - 1])

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """(signature, number of the set) for every single token and pair."""
        who, level = self._levels()
        salt = X.mix((level + 1).astype(np.uint64) * np.uint64(X.BYTE_BASE))
        single = np.minimum(self.rare, self.need)[who]
        of = np.repeat(np.arange(len(who)), single)
        at = self.off[:-1][who][of] + np.arange(len(of)) - np.repeat(np.cumsum(single) - single, single)
        sig, own = [X.mix(self.token[at].view(np.uint64) ^ salt[of])], [who[of]]

        rest = self.need[who] - single
        part = np.flatnonzero(rest > 0)
        many = (self.n - self.rare)[who[part]]
        of = part[np.repeat(np.arange(len(part)), many)]
        at = (self.off[:-1] + self.rare)[who[of]] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        mixed = X.mix(self.token[at].view(np.uint64) + salt[of])
        # n - need tokens may go without a pair: at most that many buckets
        buckets = np.maximum(1, np.minimum((2 << level) // 3, _ceil_share(1 << level, self.percent) - 1))
        bucket = (mixed >> np.uint64(16)).astype(np.int64) % buckets[of]
        order = np.lexsort((np.arange(len(of)), bucket, of))
        rank = np.empty(len(of), np.int64)
        rank[order] = _ranks(of[order], bucket[order])
        counts = (rank > 0).astype(np.int64)
        total = np.cumsum(counts)
        before = total - counts - np.repeat((total - counts)[np.cumsum(many) - many] if len(of) else total, many)
        keep = before < rest[of]
        order = order[keep[order]]
        rank, mixed, of = rank[order], mixed[order], of[order]
        right = np.repeat(np.arange(len(order)), rank)
        left = right - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(rank) - rank, rank))
        sig.append(X.mix(mixed[left] * np.uint64(X.WORD_BASE) + mixed[right]))
        own.append(who[of[right]])
        return np.concatenate(sig).view(np.int64), np.concatenate(own)


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of each entry in its run of equal (a, b)."""
    if not len(a):
        return np.zeros(0, np.int64)
    start = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    at = np.arange(len(a))
    return at - np.maximum.accumulate(np.where(start, at, 0))


def _prefixes(batch: pa.RecordBatch, frequent: np.ndarray, percent: int) -> Prefixes:
    lists = batch.column(batch.num_columns - 1)
    return Prefixes(lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy(), frequent, percent)


def _tokens() -> F.Column:
    return F.concat("head", "tail").alias("tokens")


def frequent_tokens(sets: DataFrame, *, percent: int, least: int, passes: int) -> np.ndarray:
    """Sorted tokens of the frequent class (bounded, see the module's text)."""
    spark = sets.sparkSession
    need = F.col("n") - F.floor((percent * F.col("n") + 99) / 100).cast("int") + 1
    rows = sets.where("n > 0").agg(F.sum(need)).first()[0] or 0
    least = max(least, -(-rows // FREQUENT_ROWS))
    first = sets.select(F.explode(F.slice(_tokens(), F.lit(1), need)).alias("token"))
    found = np.zeros(0, np.int64)
    for _ in range(passes):
        new = first.groupBy("token").count().where(F.col("count") >= least).select("token").toArrow().column(0).to_numpy()
        fresh = np.setdiff1d(new, found)
        if not len(fresh):
            break
        found = np.union1d(found, fresh)
        shared = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_prefixes(batch, shared.value, percent).first())], names=["token"])

        first = sets.select(_tokens()).mapInArrow(run, "token long")
    return found


def postings(sets: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(sig, sid, h1, n) of every set."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, own = _prefixes(batch, shared.value, percent).signatures()
            yield pa.RecordBatch.from_arrays([pa.array(sig), *[batch.column(i).take(pa.array(own)) for i in range(3)]], names=["sig", "sid", "h1", "n"])

    return sets.select("sid", "h1", "n", _tokens()).mapInArrow(run, "sig long, sid long, h1 long, n int")


def _sizes_fit(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(F.col(a), F.col(b)).cast("long") >= percent * F.greatest(F.col(a), F.col(b)).cast("long")


def _shared(a: str, b: str) -> F.Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def _where_sets(pairs: DataFrame, sets: DataFrame, columns: list[str], condition: F.Column, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets' ``columns`` meet ``condition``; only sets in some pair are moved."""
    ends = settle(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "jaccard-ends")
    some = settle(sets.select("sid", "n", *columns).join(ends, "sid", "left_semi"), "jaccard-some")
    rows = pairs
    for side in "ab":
        rows = rows.join(some.select(F.col("sid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *columns)]), side)
    out = settle(rows.where(condition).select("a", "b").distinct(), name)
    discard(ends, some)
    return out


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct (a, b) that link."""
    total = (F.col("n_a") + F.col("n_b")).cast("long")
    # |x ^ y| <= (100 - p) / (100 + p) * (|x| + |y|) for a link; shortened hashes can only hide differences
    apart = F.size("sample_a") + F.size("sample_b") - 2 * _shared("sample_a", "sample_b")
    near = _where_sets(pairs, sets, ["sample"], (100 + percent) * apart <= (100 - percent) * total, "jaccard-near")
    same = _shared("head_a", "head_b") + _shared("tail_a", "tail_b")
    out = _where_sets(near, sets, ["head", "tail"], (100 + percent) * same >= percent * total, "jaccard-links")
    discard(near)
    return out


def _sketches_fit(percent: int) -> F.Column:
    apart = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"{k}_hub"))) for k in SKETCH), F.lit(0))
    return (100 + percent) * apart.cast("long") <= (100 - percent) * (F.col("n") + F.col("m")).cast("long")


def _members(post: DataFrame, marks: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(sig, sid, h1, n, k0..., root, size) of the groups whose members lie in different components."""
    root = F.col("sid").alias("root")
    if roots is not None:
        marks, root = marks.join(roots.withColumnRenamed("node", "sid"), "sid", "left"), F.coalesce("root", "sid").alias("root")
    rows = post.join(marks, ["sid", "h1"]).select("sig", "sid", "h1", "n", *SKETCH, root)
    if roots is None:
        return rows.withColumn("size", F.lit(None).cast("long"))
    open_ = rows.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y").select("sig", "size")
    return rows.join(open_, "sig")


def _meetings(rows: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(sid, hub) of members that meet a hub of their group and may link with it."""
    other = hubs.select("sig", F.col("sid").alias("hub"), F.col("n").alias("m"), F.col("root").alias("to"), *[F.col(k).alias(f"{k}_hub") for k in SKETCH])
    return rows.join(other, "sig").where((F.col("root") != F.col("to")) & _sizes_fit("n", "m", percent) & _sketches_fit(percent))


def links(sets: DataFrame, *, percent: int = 85, least: int = 32, passes: int = 3, stars: int = 4) -> DataFrame:
    """Links (a, b) between set ids that keep every component."""
    frequent = frequent_tokens(sets, percent=percent, least=least, passes=passes)
    every = settle(postings(sets, frequent, percent), "jaccard-postings")
    shared = settle(every.groupBy("sig").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x < y").select("sig"), "jaccard-shared")
    few = shared.count() <= BROADCAST_SIGNATURES
    post = settle(every.join(F.broadcast(shared) if few else shared, "sig", "left_semi"), "jaccard-groups")
    discard(every, shared)
    # rows that share an id may hold different texts, and repeated rows are repeated sets
    marks = sets.groupBy("sid", "h1").agg(*[F.min(k).alias(k) for k in SKETCH])
    found = None
    roots = None
    for turn in range(stars + 1):
        rows = settle(_members(post, marks, roots), "jaccard-open")
        discard(post)
        if not rows.take(1):
            discard(rows)
            break
        met, post = [], None
        if turn == stars:
            met.append(_meetings(rows, rows, percent).where("sid < hub"))
        else:
            large = rows.where(F.col("size").isNull() | (F.col("size") > PAIR_GROUP))
            one = large.groupBy("sig").agg(F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("k"), "sid", "n", "root", *SKETCH)).alias("hub"))
            met.append(_meetings(large, one.select("sig", "hub.*"), percent))
            if turn:
                small = rows.where(F.col("size") <= PAIR_GROUP)
                met.append(_meetings(small, small, percent).where("sid < hub"))
            post = settle(large.select("sig", "sid", "h1", "n"), "jaccard-groups")
        pairs = None
        for m in met:
            ends = m.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b"))
            pairs = ends if pairs is None else pairs.unionByName(ends)
        pairs = settle(pairs.distinct(), "jaccard-pairs")
        discard(rows)
        new = verify(pairs, sets, percent)
        discard(pairs)
        found = new if found is None else found.unionByName(new)
        if post is not None:
            roots = settle(components(found), "jaccard-roots")
    return found if found is not None else sets.sparkSession.createDataFrame([], "a long, b long")


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85, least: int = 32) -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``."""
    ship()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("h1"), F.xxhash64(body, F.lit(1)).alias("h2"), body.alias("text"))
    narrow = settle(rows.drop("text"), "jaccard-rows")
    known = narrow.where("id IS NOT NULL")
    copies = settle(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "jaccard-copies")
    one = rows.where("id IS NOT NULL").join(copies, ["h1", "h2"], "left").where("rep IS NULL OR rep = id")
    sets = settle(_sets(one.select("id", "h1", "h2", "text"), shingle), "jaccard-sets")
    roots = components(links(sets.where("n > 0"), percent=percent, least=least))
    # repeated rows of one document are repeated sets
    named = sets.groupBy("h1", "h2").agg(F.min("sid").alias("node"), F.max("n").cast("long").alias("n_shingles")).join(roots, "node", "left")
    out = narrow.join(named, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.coalesce("root", "node"))
    seen = F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.when(seen, F.col("n_shingles")).alias("n_shingles"), F.when(seen, own).alias("component_id"))
