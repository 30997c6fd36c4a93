"""Vector code compression: product codes from codebooks that Spark refines, with a kd-tree per codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_join, written

#: Integer components beyond this count as it, and errors beyond the largest long as that.
MOST = 1 << 52
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Options:
    """parts: equal parts of a vector.  entries: of a codebook.  rounds: of refinement.  scale: steps of 1.  leaf: entries of a tree's leaf."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    leaf: int = 8


class Tree:
    """A kd-tree over the entries of a codebook, searched for many queries at a time.

    Nodes split at the median of their widest axis; each has the box of its entries, whose squared distance to a query
    bounds all of them from below.
    """

    def __init__(self, entries: np.ndarray, leaf: int):
        self.entries, self.leaf = entries, leaf
        self.nodes: list[tuple] = []  # low and high corner, entries (of a leaf), axis, split, left, right
        self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        at, points = len(self.nodes), self.entries[own]
        low, high = points.min(axis=0), points.max(axis=0)
        self.nodes.append((low, high, own, None, None, None, None))
        if len(own) > self.leaf and (high > low).any():
            axis = int(np.argmax(high - low))
            order = own[np.argsort(points[:, axis], kind="stable")]
            half = len(own) // 2
            split = self.entries[order[half], axis]
            left = self._grow(np.sort(order[:half]))
            right = self._grow(np.sort(order[half:]))
            self.nodes[at] = (low, high, None, axis, split, left, right)
        return at

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query, the lower of equally near ones, and its squared distance.

        Every query looks into the leaf that it falls into first; then a node is passed over only by queries whose best
        distance is below the node's bound.  A node whose bound equals it may hold a lower index, and is visited.
        """
        best = np.full(len(queries), -1, queries.dtype)  # -1: nothing seen yet
        index = np.full(len(queries), len(self.entries), np.int64)
        if queries.shape[1] == 0:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), queries.dtype)
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            _, _, own, axis, split, left, right = self.nodes[node]
            if own is not None:
                self._look(own, queries, rows, best, index)
            else:
                lower = (queries[rows, axis] < split).astype(bool)
                waiting += [(left, rows[lower]), (right, rows[~lower])]
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            node, rows = waiting.pop()
            low, high, own, _, _, left, right = self.nodes[node]
            here = queries[rows]
            gap = np.maximum(np.maximum(low - here, here - high), 0)
            rows = rows[((gap * gap).sum(axis=1) <= best[rows]).astype(bool)]
            if not len(rows):
                continue
            if own is not None:
                self._look(own, queries, rows, best, index)
            else:
                waiting += [(left, rows), (right, rows)]
        return index, best

    def _look(self, own: np.ndarray, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        away = queries[rows][:, None, :] - self.entries[own][None, :, :]
        distance = (away * away).sum(axis=2)
        at = distance.argmin(axis=1)  # the first of equal ones, and ``own`` ascends
        found, distance = own[at], distance[np.arange(len(rows)), at]
        better = ((best[rows] < 0) | (distance < best[rows]) | ((distance == best[rows]) & (found < index[rows]))).astype(bool)
        best[rows[better]], index[rows[better]] = distance[better], found[better]


def part_bounds(width: int, parts: int) -> list[int]:
    """Where parts begin and end: equal ones, or the first ones a component longer where the width does not divide."""
    return [i * (width // parts) + min(i, width % parts) for i in range(parts + 1)]


def _integers(batch: pa.RecordBatch, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), as int64."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int64)


class Coder:
    """Codebooks of all parts as trees.  Arithmetic is of 64 bits where no sum of squares can leave them, else of Python's integers."""

    def __init__(self, codebooks: list[np.ndarray], width: int, options: Options):
        self.books, self.width, self.options = codebooks, width, options
        self.bounds = part_bounds(width, options.parts)
        self.largest = max((int(np.abs(b).max()) for b in codebooks if b.size), default=0)
        self.trees: dict[bool, list[Tree]] = {}

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of entry indexes and of squared distances."""
        reach = self.largest + (int(np.abs(vectors).max()) if vectors.size else 0)
        wide = self.width * reach * reach >= 1 << 62
        kind = object if wide else np.int64
        if wide not in self.trees:
            self.trees[wide] = [Tree(b.astype(kind), self.options.leaf) for b in self.books]
        found = [tree.nearest(vectors[:, a:b].astype(kind)) for tree, a, b in zip(self.trees[wide], self.bounds, self.bounds[1:], strict=False)]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", options: Options = Options()) -> DataFrame:
    """Product code of each vector: id, code, error, label_error, codebooks_sha256.

    Vectors that are null or empty, or hold null or non-finite components, are dropped, and so are those of another
    length than the vector of the smallest id.  Codebooks start from the vectors of the smallest ids (a null id comes
    last, equal ids are ordered by their vectors; fewer vectors make fewer entries).  A round assigns each part to the
    nearest entry, the lower index of equal ones, and puts floor(sum / count) in its place; an entry without parts stays.
    Repeated rows count and are returned each; a null label is a label; an empty table gives an empty table; other
    columns are not read.

    The codebooks (parts x entries x their width, whatever the input) travel with a broadcast; tasks add up integers per
    entry, which Spark sums exactly; no vector is shuffled.  The sums of labels meet the rows in a join whose hot labels are broadcast.
    """
    spark = vectors.sparkSession
    sound = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & sound)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(options.entries)
    first = [r["vector"] for r in first.orderBy(F.col("id").asc_nulls_last(), "vector").collect()]  # no more than ``entries`` vectors
    width = len(first[0]) if first else 0
    if first and any(len(v) != width for v in first):
        rows = rows.where(F.size("vector") == width)
        first = [r["vector"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(options.entries).collect()]
    else:
        rows = rows.where(F.size("vector") == width)
    start = np.clip(np.floor(np.array(first, np.float64).reshape(len(first), width) * options.scale), -MOST, MOST).astype(np.int64)
    bounds = part_bounds(width, options.parts)
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    for _ in range(options.rounds if first else 0):
        coder = spark.sparkContext.broadcast(Coder(books, width, options))

        def add(batches: Iterator[pa.RecordBatch], coder=coder) -> Iterator[pa.RecordBatch]:
            own, sums, counts = coder.value, {}, {}
            for batch in batches:
                v = _integers(batch, width, options.scale)
                index, _ = own.assign(v)
                for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    entries, at = np.unique(index[:, p], return_inverse=True)
                    total = np.zeros((len(entries), b - a), object if len(v) and np.abs(v).max() > 1 << 40 else np.int64)
                    np.add.at(total, at, v[:, a:b].astype(total.dtype))
                    for e, t, n in zip(entries.tolist(), total.tolist(), np.bincount(at).tolist(), strict=True):
                        known = sums.get((p, e))
                        sums[p, e] = t if known is None else [x + y for x, y in zip(known, t, strict=True)]
                        counts[p, e] = counts.get((p, e), 0) + n
            made = [(p, e, i, Decimal(x), counts[p, e]) for (p, e), t in sums.items() for i, x in enumerate(t)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], ["part", "entry", "place", "total", "n"])

        partial = rows.select("vector").mapInArrow(add, "part int, entry int, place int, total decimal(38,0), n long")
        books = [b.copy() for b in books]
        # one row per integer of the codebooks
        for r in partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]

    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    coder = spark.sparkContext.broadcast(Coder(books, width, options))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, distance = coder.value.assign(_integers(batch, width, options.scale))
            code = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            error = [min(sum(row), LONGEST) for row in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scratch = Scratch()
    coded = scratch(rows.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    keyed = coded.select("*", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of_label"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    labels = scratch(keyed.groupBy("no_label", "of_label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")))
    met = split_join(keyed, labels, ["no_label", "of_label"], "n")
    result = written(met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")))
    scratch.clear()
    return result


