"""Vector code compression: product codes found through memoised grid cells.

Vectors become integers, ``floor(scale * x)``, and are cut into equal
consecutive parts. Each part position has a codebook; a part's code is its
nearest entry (squared Euclidean distance, ties to the lower index).

The search for the nearest entry goes by coarse cells. A part's cell is its
components divided by the cell width. For every entry the distance to the
cell's box lies between a minimum and a maximum; an entry whose minimum
exceeds another's maximum is nearest nowhere in the box and is left out. The
remaining entries are cached under the cell's key (its exact coordinates),
so that parts in a known cell are compared with these entries alone, exactly
and in integers. The cache lives in a worker for one codebook and is bounded
by ``CACHE_CELLS``; cells beyond it are worked out each time.

Learning is the usual rounds: assign, then replace each entry by the floor of
its parts' mean. Sums are made per task and added up by Spark; the driver sees
one row per entry and component.

Defined results: vectors that are null or hold null, NaN or infinite
components take no part; so do vectors whose number of components differs
from that of the smallest id's vector. Lengths not divisible by the number of
parts are cut as evenly as possible. Rows without an id are coded but never
start a codebook entry; of rows that share an id each counts, the smaller
vector first. Fewer rows than entries give fewer entries; an empty table gives
an empty result. Components are stored as 32-bit integers; larger ones, after
scaling, raise an error. Other columns are kept; those named like a new column
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark import settle, ship

#: Cells a worker remembers per codebook.
CACHE_CELLS = 1 << 16
#: Numbers in one step of the distance arrays.
STEP = 1 << 20
LARGEST = (1 << 31) - 1


@dataclass
class Codebooks:
    """``entries[p]``: (entries, components) integers of part position ``p``."""

    entries: list[np.ndarray]

    @property
    def edges(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([e.shape[1] for e in self.entries])]).astype(int)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def part_edges(size: int, parts: int) -> np.ndarray:
    return np.array([size * p // parts for p in range(parts + 1)])


class CellSearch:
    """Nearest entry of one codebook for many parts, cell by cell."""

    def __init__(self, entries: np.ndarray, width: int):
        self.entries, self.width = entries.astype(np.int64), width
        self.cells: dict[bytes, np.ndarray] = {}
        self.met = self.known = self.compared = 0

    def _candidates(self, cell: np.ndarray) -> list[np.ndarray]:
        """Entries that no other entry dominates over each cell's box."""
        sides = []
        for i in range(cell.shape[1]):  # a component has few distinct cell numbers
            value, at = np.unique(cell[:, i], return_inverse=True)
            low = value[:, None] * self.width
            below, above = low - self.entries[:, i], self.entries[:, i] - (low + self.width - 1)
            sides.append((at.reshape(-1), np.maximum(np.maximum(below, above), 0) ** 2, np.maximum(np.abs(below), np.abs(above)) ** 2))
        out = []
        step = max(1, STEP // len(self.entries))
        for lo in range(0, len(cell), step):
            least = np.zeros((len(cell[lo : lo + step]), len(self.entries)), np.int64)
            most = least.copy()
            for at, gap, reach in sides:
                least += gap[at[lo : lo + step]]
                most += reach[at[lo : lo + step]]
            row, entry = np.nonzero(least <= most.min(1, keepdims=True))
            out += np.split(entry, np.searchsorted(row, np.arange(1, len(least))))
        return out

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row."""
        if not part.size:
            return np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        cell, of = np.unique(part // self.width, axis=0, return_inverse=True)
        of = of.reshape(-1)
        keys = [row.tobytes() for row in np.ascontiguousarray(cell)]
        found = [self.cells.get(k) for k in keys]
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            for i, some in zip(new, self._candidates(cell[new])):
                found[i] = some
                if len(self.cells) < CACHE_CELLS:
                    self.cells[keys[i]] = some
        self.met += len(cell)
        self.known += len(cell) - len(new)
        many = np.array([len(f) for f in found])
        first = np.cumsum(many) - many
        flat = np.concatenate(found)
        code, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        step = max(1, STEP // max(1, int(many.max()) * part.shape[1]))
        for lo in range(0, len(part), step):
            c = of[lo : lo + step]
            n = many[c]
            start = np.cumsum(n) - n
            row = np.repeat(np.arange(len(c)), n)
            entry = flat[first[c][row] + np.arange(len(row)) - start[row]]
            gap = part[lo : lo + step][row] - self.entries[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            best = np.minimum.reduceat(d, start)
            hit = np.flatnonzero(d == best[row])
            code[lo : lo + step] = entry[hit[np.searchsorted(hit, start)]]  # candidates ascend
            error[lo : lo + step] = best
            self.compared += len(row)
        return code, error


def integers(vectors: DataFrame, *, vector: str = "embedding", scale: int = 1024, out: str = "ints") -> DataFrame:
    """Rows with whole finite vectors, as integers ``floor(scale * x)`` in ``out``."""
    good = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))
    value = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(F.col(vector).isNotNull() & good).withColumn(out, value)


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy().astype(np.int64)
    if len(flat) and (flat.max() > LARGEST or flat.min() < -LARGEST):
        raise ValueError("a scaled component does not fit 32 bits")
    return flat.reshape(len(lists), -1)


def _partial_sums(ints: DataFrame, books: Codebooks, width: int, column: str) -> DataFrame:
    """(part, entry, place, total): per task, counts (place -1) and component sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = books.edges
        search = [CellSearch(e, width) for e in books.entries]
        total = [np.zeros((len(e), e.shape[1] + 1), np.int64) for e in books.entries]
        for batch in batches:
            rows = _matrix(batch.column(0))
            for p, s in enumerate(search):
                part = rows[:, edges[p] : edges[p + 1]]
                code, _ = s.nearest(part)
                np.add.at(total[p], code, np.concatenate([np.ones((len(part), 1), np.int64), part], axis=1))
        for p, t in enumerate(total):
            used = np.flatnonzero(t[:, 0])
            size = t.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) * size, p, np.int32)), pa.array(np.repeat(used, size).astype(np.int32)), pa.array(np.tile(np.arange(-1, size - 1), len(used)).astype(np.int32)), pa.array(t[used].ravel())],
                names=["part", "entry", "place", "total"],
            )

    return ints.select(column).mapInArrow(run, "part int, entry int, place int, total long")


def learn(ints: DataFrame, *, id_col: str = "vec_id", column: str = "ints", parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 32) -> Codebooks | None:
    """Codebooks of ``ints`` (None without a row), started from the smallest ids."""
    ship()
    first = ints.where(F.col(id_col).isNotNull()).orderBy(id_col, column).select(column).limit(entries)
    start = [r[0] for r in first.collect()]  # at most ``entries`` rows
    if not start:
        return None
    size = len(start[0])
    start = np.array([r for r in start if len(r) == size], np.int64).reshape(-1, size)
    edges = part_edges(size, parts)
    books = Codebooks([start[:, a:b].copy() for a, b in zip(edges[:-1], edges[1:])])
    alike = ints.where(F.size(column) == size)
    for _ in range(rounds):
        new = [e.copy() for e in books.entries]
        sums = _partial_sums(alike, books, width, column).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
        rows = sums.toArrow().to_pandas().pivot(index=["part", "entry"], columns="place", values="total")
        for (p, e), row in rows.iterrows():
            new[p][e] = [int(row[i]) // int(row[-1]) for i in range(new[p].shape[1])]
        books = Codebooks(new)
    return books


def encode(ints: DataFrame, books: Codebooks, *, column: str = "ints", width: int = 32, code: str = "codes", error: str = "error") -> DataFrame:
    """``ints`` with each part's code (array) and the vector's squared error."""
    ship()
    ints = ints.drop(*[c for c in (code, error) if c in ints.columns])
    size = int(books.edges[-1])
    at = ints.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = books.edges
        search = [CellSearch(e, width) for e in books.entries]
        for batch in batches:
            rows = _matrix(batch.column(at))
            found = [s.nearest(rows[:, edges[p] : edges[p + 1]]) for p, s in enumerate(search)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), codes.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(sum(e for _, e in found))], names=[*batch.schema.names, code, error])

    schema = T.StructType([*ints.schema.fields, T.StructField(code, T.ArrayType(T.IntegerType())), T.StructField(error, T.LongType())])
    return ints.where(F.size(column) == size).mapInArrow(run, schema)


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 32) -> tuple[DataFrame, Codebooks | None]:
    """(``vectors`` without the vector, with ``codes`` and ``error``; the codebooks)."""
    ship()
    names = [c for c in vectors.columns if c not in (vector, "ints", "codes", "error")]
    kept = settle(integers(vectors, vector=vector, scale=scale).select(*names, "ints"), "codes-ints")
    books = learn(kept, id_col=id_col, parts=parts, entries=entries, rounds=rounds, width=width)
    if books is None:
        return kept.limit(0).select(*names, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), None
    return encode(kept, books, width=width).drop("ints"), books
