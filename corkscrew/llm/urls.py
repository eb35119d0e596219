"""URL filters: host and path rules, and a logistic regression on hashed
character n-grams of host and path for urls that no rule decides.

The regression is trained from a small labelled URL table (url, blocked) of at
most ``sample_rows`` distinct host-path pairs, the ones with the smallest hash.

Defined results: a null url, or one without ``://``, has an empty host and
path; rules are tried longest first, equal lengths in string order; without
labelled rows, or with one class only, that class (else allow) is the verdict;
repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .spark import STEP_BYTES, ship


# Words of hosts that the small labelled table blocks or allows.
BLOCKED_WORDS = (
    "adult ads bet bets betting bonus casino cheap click clickbait dating escort farm free gamble "
    "hack jackpot loan lottery lucky malware meds nude pharma pills poker porn prize replica "
    "sex slots spam toplist track tracker viagra warez webcam win winner xxx x"
).split()
ALLOWED_WORDS = (
    "academy archive art atlas blog book books calendar city college community cooking docs edu "
    "forum garden gazette guide health history home journal lab library local m magazine maps "
    "museum music nature news open paper park press radio recipes research review school "
    "science shop society sport stories travel university weather wiki work www"
).split()


# Made-up names, allowed as well: a name that the table does not know is no reason to block.
NEUTRAL_WORDS = [
    ("b br d f g k l m n p r s st t th v".split())[i % 16] + "aeiou"[i % 5] + ("ld n r nder ther m ven".split())[i % 7] for i in range(40)
]
# Shapes and endings of the hosts in that table, the same for both classes.
SHAPES = ("{a}", "{a}{b}", "{a}-{b}", "{b}.{a}", "www.{a}", "m.{a}", "blog.{a}", "m.{a}-{b}", "blog.{a}{b}")
ENDINGS = ("example.com", "example.net", "example.org", "com", "net", "org", "info", "sample.io")


def labelled_table() -> list[tuple[str, str, bool]]:
    """The small labelled URL table: (host, path, blocked) rows made of the
    words above, alone, joined, hyphenated and behind the same first labels,
    over the same endings and paths for both classes."""
    paths = ["/", "/en/1", "/fr/27", "/de/358/", "/es/4.html", ""]
    rows = []
    for words, blocked in ((BLOCKED_WORDS, True), (ALLOWED_WORDS, False), (NEUTRAL_WORDS, False)):
        for i, a in enumerate(words):
            b = words[(7 * i + 3) % len(words)]
            for j, shape in enumerate(SHAPES):
                for k in range(3):
                    end = ENDINGS[(i + j + 3 * k) % len(ENDINGS)]
                    rows.append((f"{shape.format(a=a, b=b)}.{end}", paths[(i + 2 * j + k) % len(paths)], blocked))
    return rows


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # host/path

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, rest = self.pattern.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path)."""
    upper = "".join(map(chr, range(65, 91)))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("`__url`")))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path`` (clashing columns are replaced)."""
    pages = pages.drop(*[c for c in ("host", "path") if c in pages.columns]).withColumn("__url", F.col(url))
    host, path = split_url(F.col("__url"))
    return pages.withColumns({"host": host, "path": path}).drop("__url")


def by_rules(split: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` (null where no rule fits)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):  # the last to be wrapped, the longest, is tried first
        fits = r.fits(F.col("host"), F.col("path"))
        name = F.when(fits, F.lit(r.pattern)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return split.withColumns({"rule": name, "rule_verdict": verdict})


@dataclass
class UrlModel:
    weights: np.ndarray  # one per bucket
    intercept: float
    lengths: tuple[int, ...]


def _grams(data: np.ndarray, off: np.ndarray, lengths: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of every text."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    byte = X.mix(data.astype(np.uint64) + np.uint64(1))
    rows, cols = [], []
    for n in lengths:
        if len(byte) >= n:
            keep = np.flatnonzero(X.inside_text(owner, n))
            rows.append(owner[keep])
            cols.append(((X.window_hashes(byte, n)[keep] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _scores(row: np.ndarray, col: np.ndarray, n: int, model_w: np.ndarray) -> np.ndarray:
    """Weights of a row's n-grams, scaled by the root of their number."""
    size = np.maximum(np.bincount(row, minlength=n), 1)
    return np.bincount(row, weights=model_w[col], minlength=n) / np.sqrt(size)


def fit(labelled: DataFrame, *, sample_rows: int = 4000, lengths: Sequence[int] = (3, 4, 5), buckets: int = 1 << 16, l2: float = 1e-4, steps: int = 120) -> UrlModel:
    """Train on (host, path, blocked) rows; conflicting labels of a pair count as blocked."""
    table = (
        labelled.groupBy("host", "path").agg(F.max(F.col("blocked").cast("int")).alias("blocked")).dropna()
        .orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample_rows).collect()  # at most sample_rows rows
    )
    w = np.zeros(buckets)
    y = np.array([r["blocked"] for r in table], float)
    if len(set(y.tolist())) < 2:
        return UrlModel(w, 1.0 if len(y) and y[0] else -1.0, tuple(lengths))
    row, col = _grams(*X.utf8(pa.array([join(r["host"], r["path"]) for r in table])), lengths, buckets)
    n = len(y)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    value = scale[row]
    v = np.ones(buckets + 1) / np.sqrt(buckets)
    forward = lambda u: np.bincount(row, weights=u[col] * value, minlength=n) + u[-1]
    back = lambda r: np.append(np.bincount(col, weights=r[row] * value, minlength=buckets), r.sum())
    for _ in range(15):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(forward(v)) ** 2 * 1.05 / n + l2)
    now = ahead = np.zeros(buckets + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(ahead), -35, 35)))
        grad = back(p - y) / n
        grad[:-1] += l2 * ahead[:-1]
        new = ahead - rate * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, now, t = new + (t - 1) / t_new * (new - now), new, t_new
    return UrlModel(now[:-1], float(now[-1]), tuple(lengths))


def join(host: str, path: str) -> str:
    return f"\x01{host}\x02{path}\x03"


def predict(split: DataFrame, model: UrlModel) -> DataFrame:
    """Add ``blocked_score`` (above 0: block) to rows with ``host`` and ``path``."""
    ship()
    split = split.drop(*[c for c in ("blocked_score",) if c in split.columns])
    joined = split.withColumn("__t", F.concat(F.lit("\x01"), "host", F.lit("\x02"), "path", F.lit("\x03")))
    schema = T.StructType([*split.schema.fields, T.StructField("blocked_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for lo, hi in X.row_slices(text, STEP_BYTES // 4):
                row, col = _grams(*X.utf8(text.slice(lo, hi - lo)), model.lengths, len(model.weights))
                score = _scores(row, col, hi - lo, model.weights) + model.intercept
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "blocked_score"])

    return joined.mapInArrow(run, schema)


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, *, url: str = "url", **fit_args) -> DataFrame:
    """``pages`` with host, path, rule, ``blocked_score`` and ``verdict``.

    ``labelled`` has the columns host, path, blocked; ``labelled_table`` is
    taken unless it is given.
    """
    ruled = by_rules(parts(pages, url), rules)
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(labelled_table(), "host string, path string, blocked boolean")
    out = predict(ruled, fit(labelled, **fit_args))
    own = F.when(F.col("blocked_score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict")
