"""Ranked lexical search: integer BM25 impacts, searched score-at-a-time over shards of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, small_batches, written

#: Bytes to terms: everything of ASCII but letters and digits is a space, A-Z are small; what is beyond ASCII stays.
_TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Options:
    """most: documents of an item.  item_bytes: text of the items of one pass.  shard_docs, shard_postings: of a shard."""

    most: int = 10
    item_bytes: int = 16 << 20
    shard_docs: int = 8_192
    shard_postings: int = 2_000_000


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """The items of one pass: (item number, item id, {term number: times}), and the numbers of their terms."""

    def __init__(self, rows: list[tuple]):
        self.numbers: dict[bytes, int] = {}
        self.items = []
        for number, id_, text in rows:
            times = Counter(self.numbers.setdefault(t, len(self.numbers)) for t in terms_of(text))
            if times:
                self.items.append((number, id_, times))


class Shard:
    """Impact-ordered postings of some documents.  ``read`` counts those that searches added up."""

    def __init__(self, ids: list, lengths: list[int], terms: list[np.ndarray], tfs: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.read = ids, 0
        sizes = np.array([len(t) for t in terms], np.int64)
        # Python's integers: the product of a very long document and a very large corpus leaves 64 bits
        m = np.array([25 + (75 * n * n_docs) // n_terms for n in lengths], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, tf, doc = np.concatenate(terms), np.concatenate(tfs).astype(np.int64), np.repeat(np.arange(len(ids)), sizes)
        self.impacts = weights[self.terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-self.impacts, self.terms))
        self.by_impact, self.doc = self.impacts[order], doc[order]
        self.first = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))

    def search(self, times: dict[int, int], most: int, known: list[tuple]) -> list[tuple]:
        """The best ``most`` of ``known`` and this shard's documents, as (score, id, ...) sorted by score and id.

        Postings of all the item's terms are added up in falling order of their impacts, whole groups of equal impact at a
        time.  What a document can still gain is the sum of the terms' next impacts.  Reading stops when no more than
        ``most`` documents can reach the best ``most`` so far, or none can; these documents' scores are then completed.
        """
        spans = [(self.first[t], self.first[t + 1], q, t) for t, q in times.items() if self.first[t + 1] > self.first[t]]
        if not spans:
            return known
        fall = -np.concatenate([self.by_impact[a:b] * q for a, b, q, _ in spans])
        docs = np.concatenate([self.doc[a:b] for a, b, _, _ in spans])
        order = np.argsort(fall, kind="stable")
        sums, at, step = np.zeros(len(self.ids), np.int64), 0, 1024
        fall_in_order, docs_in_order = fall[order], docs[order]
        ends = np.cumsum([b - a for a, b, _, _ in spans])
        starts = ends - [b - a for a, b, _, _ in spans]
        floor = known[most - 1][0] if len(known) >= most else 0
        while True:
            end = min(at + step, len(order))
            if end < len(order):  # whole groups only: without the one that is cut, or if it is the only one with all of it
                group = int(np.searchsorted(fall_in_order, fall_in_order[end], side="left"))
                end = group if group > at else int(np.searchsorted(fall_in_order, fall_in_order[end], side="right"))
            self.read += end - at
            np.add.at(sums, docs_in_order[at:end], -fall_in_order[at:end])
            at, step = end, step * 2
            if at == len(order):
                rest = 0
            else:
                read = [s + np.searchsorted(fall[s:e], fall_in_order[at - 1], side="right") for s, e in zip(starts, ends, strict=True)]
                rest = sum(-int(fall[r]) for r, e in zip(read, ends, strict=True) if r < e)
            need = max(floor, int(np.partition(sums, -most)[-most]) if len(sums) >= most else 0, 1)
            if rest < need or not rest:
                reach = np.flatnonzero(sums + rest >= need)
                if len(reach) <= most or not rest:
                    break
        if not len(reach):
            return known
        found = list(known)
        for d in reach.tolist():
            own = slice(self.starts[d], self.starts[d + 1])
            score = sum(int(i) * times.get(t, 0) for t, i in zip(self.terms[own].tolist(), self.impacts[own].tolist(), strict=True))
            if score > 0:
                found.append((score, self.ids[d]))
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:most]


def _passes(items: DataFrame, id_col: str, text_col: str, item_bytes: int, scratch: Scratch) -> Iterator[Items]:
    """Items in passes of bounded size, one after the other on the driver."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = scratch(rows.withColumn("number", F.monotonically_increasing_id()))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / item_bytes))
    for p in range(passes):
        yield Items([(r["number"], r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == p).collect()])


def ranked_search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", options: Options = Options()) -> DataFrame:
    """The best documents of each item: item_id, rank, id, score; equal scores by ascending id, null ids last.

    Terms are runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased, of whole texts however
    long.  Null texts have none; documents without terms do not count in the statistics.  Every row of ``items`` is an item,
    so repeated ids are ranked each; an item without terms, or whose terms no document holds, has no rows; repeated documents take
    a rank each; an empty table of either gives no rows; other columns are not read.

    Documents are read once for each pass over the items (16 MB of items each), for a written index: a document's length,
    and numbers and frequencies of the terms that some item has.  Their statistics are aggregates of that table, over all
    documents.  Then each task builds impact-ordered shards of its documents, bounded in size, searches them for every
    item and keeps its own best; the bests of tasks meet in two steps, so no group holds more than a few thousand rows.
    """
    spark = small_batches(docs.sparkSession)
    kind, item_type = items.schema[item_col].dataType.simpleString(), to_arrow_type(items.schema[item_col].dataType)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    scratch, result = Scratch(), None
    for own in _passes(items, item_col, item_text_col, options.item_bytes, scratch):
        shipped = spark.sparkContext.broadcast(own)

        def index(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            numbers = shipped.value.numbers
            for batch in batches:
                made = []
                for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                    found = terms_of(text.as_py())
                    if found:
                        count = Counter(t for t in map(numbers.get, found) if t is not None)
                        made.append((id_, len(found), list(count), list(count.values())))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], ["id", "n", "terms", "tfs"])

        table = scratch(rows.mapInArrow(index, "id long, n long, terms array<int>, tfs array<long>"))
        n_docs, n_terms = table.agg(F.count(F.lit(1)), F.sum("n")).first()
        weights = np.zeros(len(own.numbers), np.int64)
        # one row per term of this pass's items
        for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
            weights[r["term"]] = term_weight(n_docs, r["df"])
        weighed = spark.sparkContext.broadcast(weights)

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped, weighed=weighed, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            items_ = shipped.value.items

            def close(held: list[tuple]) -> None:
                shard = Shard(*map(list, zip(*held, strict=True)), weighed.value, n_docs, n_terms)
                for number, _, times in items_:
                    best[number] = shard.search(times, options.most, best.get(number, []))

            held, postings = [], 0
            for batch in batches:
                for id_, n, terms, tfs in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("terms"), batch.column("tfs"), strict=True):
                    held.append((id_, n, terms.values.to_numpy(), tfs.values.to_numpy()))
                    postings += len(terms)
                    if len(held) >= options.shard_docs or postings >= options.shard_postings:
                        close(held)
                        held, postings = [], 0
            if held:
                close(held)
            out = [(number, id_, doc, score) for number, id_, _ in items_ for score, doc in best.get(number, [])]
            task = TaskContext.get().partitionId()
            arrays = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], item_type), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64()), pa.array([task] * len(out), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["number", "item", "id", "score", "task"])

        part = table.where(F.size("terms") > 0).mapInArrow(search, f"number long, item {kind}, id long, score long, task int")
        result = part if result is None else result.unionByName(part)
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    near = Window.partitionBy("number", "group").orderBy(*order)
    met = result.withColumn("group", F.expr("task DIV 256")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= options.most)
    met = met.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).where(F.col("rank") <= options.most)
    done = written(met.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    scratch.clear()
    return done
