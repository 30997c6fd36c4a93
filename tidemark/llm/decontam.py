"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Weights are divided by the score that an item gives itself, so scores run from 0 to 1 and one threshold serves items
of any length.  A passage of twice the longest item's length starts at every item length, so every occurrence of an
item lies in one passage whole.

Before a passage enters WAND, a bound on the weights of its rarer terms settles most of them: an item's commonest terms
cannot bring it to the threshold by themselves, so without enough of its rarer ones it is not retrieved.  The
bound is exact; WAND finds the same items with it and without.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASH_CACHE_WORDS, give_back, small_batches, written
from .toxicity import PUNCTUATION

#: Words that are searched at a time.
CHUNK_WORDS = 1 << 18


@dataclass(frozen=True)
class Options:
    """k1, b: of BM25.  threshold: normalised score from which items are retrieved.  rest: share of an item's own
    score that its commonest terms may add up to before a passage must show rarer ones.  block: items of a posting
    block.  shingle, overlap: of an item's word shingles a passage must hold this share, and of the words of its
    question and of its answer each the share ``part``.  index_bytes: text of items that one pass over the corpus
    ships; more items take more passes."""

    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6
    rest: float = 0.25
    block: int = 8
    shingle: int = 5
    overlap: float = 0.8
    part: float = 0.5
    index_bytes: int = 16 << 20


def terms_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without punctuation at their ends."""
    return [w for w in (x.strip(PUNCTUATION) for x in text.encode("utf-8", "surrogatepass").lower().split()) if w] if text else []


def question_words(text: str) -> int:
    """Words of the question: up to the first question mark, or else the first line end, or else half of the words."""
    n = len(terms_of(text))
    for mark in ("?", "\n"):
        at = text.find(mark)
        if at >= 0 and 0 < (k := len(terms_of(text[: at + 1]))) < n:
            return k
    return (n + 1) // 2


class Index:
    """Inverted index of items with the block maxima that WAND skips by."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], total: int, mean_length: float, options: Options, longest: int = 0):
        """``longest``: words of the longest item of all, if others are in other indexes; passages are of its length."""
        self.options = options
        order = sorted(((len(terms_of(text)), item, text) for item, text in items), key=lambda x: (x[0], x[1], x[2]))
        self.items = [item for n, item, _ in order if n]
        texts = [text for n, _, text in order if n]
        self.words = [terms_of(text) for text in texts]
        self.questions = [question_words(text) for text in texts]
        self.terms = {t: i for i, t in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.longest = max(longest, max(map(len, self.words), default=1))
        weights: list[dict[int, float]] = []
        for words in self.words:
            norm = options.k1 * (1 - options.b + options.b * len(words) / mean_length)
            tf: dict[bytes, int] = defaultdict(int)
            for w in words:
                tf[w] += 1
            raw = {self.terms[w]: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (options.k1 + 1) / (n + norm) for w, n in tf.items()}
            own = sum(raw.values())
            weights.append({t: x / own for t, x in raw.items()})
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.terms]
        for i, own in enumerate(weights):
            for t, x in own.items():
                self.postings[t][0].append(i)
                self.postings[t][1].append(x)
        self.most = [max(w) for _, w in self.postings]
        self.block_most: list[dict[int, float]] = []
        for ids, ws in self.postings:
            best: dict[int, float] = {}
            for i, w in zip(ids, ws, strict=True):
                best[i // options.block] = max(best.get(i // options.block, 0.0), w)
            self.block_most.append(best)
        # the commonest terms of each item, up to a share of its score, cannot bring it to the threshold by themselves
        rare: set[tuple[int, int]] = set()
        self.needed = np.zeros(len(weights))
        for i, own in enumerate(weights):
            common = 0.0
            for t, x in sorted(own.items(), key=lambda p: (-len(self.postings[p[0]][0]), p[0])):
                if common + x <= options.rest:
                    common += x
                else:
                    rare.add((t, i))
            self.needed[i] = options.threshold - common - 1e-9
        by_term: dict[int, list[int]] = defaultdict(list)
        for t, i in sorted(rare):
            by_term[t].append(i)
        counts = np.array([len(by_term.get(t, ())) for t in range(len(self.terms))], np.int64)
        self.rare_start = np.concatenate([[0], np.cumsum(counts)])
        self.rare_count = counts
        self.rare_item = np.array([i for t in sorted(by_term) for i in by_term[t]], np.int64)
        self.rare_weight = np.array([weights[i][t] for t in sorted(by_term) for i in by_term[t]])
        self.shingles: list[dict[tuple[int, ...], list[int]]] = []
        for words in self.words:
            ids = [self.terms[w] for w in words]
            k = min(options.shingle, len(ids))
            at: dict[tuple[int, ...], list[int]] = defaultdict(list)
            for p in range(len(ids) - k + 1):
                at[tuple(ids[p : p + k])].append(p)
            self.shingles.append(dict(at))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of all items that the terms score at the threshold or above, by block-max WAND."""
        theta, block = self.options.threshold - 1e-9, self.options.block
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            in_block = sum(self.block_most[t].get(item // block, 0.0) for _, _, t in cursors[: pivot + 1])
            if in_block < theta:  # no item up to the end of the block, or to the next list's item, can get there
                after = (item // block + 1) * block
                if pivot + 1 < len(cursors):
                    after = min(after, cursors[pivot + 1][0])
                target, moving = max(after, item + 1), cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(self.postings[t][1][p] for i, p, t in cursors[: pivot + 1])
                if score >= theta:
                    found.append((item, score))
                target, moving = item + 1, cursors[: pivot + 1]
            else:
                target, moving = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moving:
                ids = self.postings[c[2]][0]
                c[1] = bisect_left(ids, target, c[1])
                c[0] = ids[c[1]] if c[1] < len(ids) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def overlap(self, item: int, passage: list[int]) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's words and of its answer's words that the passage holds."""
        known, n = self.shingles[item], len(self.words[item])
        k = min(self.options.shingle, n)
        held = [False] * (n - k + 1)
        for j in range(len(passage) - k + 1):
            for p in known.get(tuple(passage[j : j + k]), ()):
                held[p] = True
        words = [False] * n
        for p, h in enumerate(held):
            if h:
                words[p : p + k] = [True] * k
        q = self.questions[item]
        return sum(held) / len(held), sum(words[:q]) / q, sum(words[q:]) / (n - q) if n > q else 1.0


class Searcher:
    """Finds the items that documents hold; remembers the numbers of words it has met."""

    def __init__(self, index: Index):
        self.index = index
        terms = index.terms

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= HASH_CACHE_WORDS:
                    self.clear()
                bare = word.strip(PUNCTUATION)
                value = self[word] = terms.get(bare, -1) if bare else -2
                return value

        self.numbers = Numbers()

    def number(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return ids[ids != -2]

    def find(self, docs: list[np.ndarray]) -> list[dict[int, tuple[int, float, float, float, float]]]:
        """For each document: item -> (passage start, score, overlap, question, answer) of its best passage."""
        index, step = self.index, self.index.longest
        out: list[dict[int, tuple[int, float, float, float, float]]] = [{} for _ in docs]
        if not index.items or not docs:
            return out
        sizes = np.array([len(d) for d in docs], np.int64)
        passages = -(-sizes // step)
        first = np.concatenate([[0], np.cumsum(passages)])
        words = np.concatenate(docs)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero((words >= 0) & (index.rare_count[words] > 0))
        local = place[at] // step
        base = np.repeat(first[:-1], sizes)[at]
        terms = len(index.terms)
        back = local > 0
        keys = np.unique(np.concatenate([(base + local) * terms + words[at], (base + local - 1)[back] * terms + words[at][back]]))
        passage, term = keys // terms, keys % terms
        count = index.rare_count[term]
        ends = np.cumsum(count)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(index.rare_start[term] - (ends - count), count)
        n = len(index.items)
        pair, inverse = np.unique(np.repeat(passage, count) * n + index.rare_item[entry], return_inverse=True)
        sums = np.bincount(inverse, index.rare_weight[entry], len(pair))
        live = np.unique(pair[sums >= index.needed[pair % n]] // n)
        owner = np.searchsorted(first, live, side="right") - 1
        for p, d in zip(live.tolist(), owner.tolist(), strict=True):
            start = (p - int(first[d])) * step
            ids = docs[d][start : start + 2 * step].tolist()
            for item, score in index.search(sorted({t for t in ids if t >= 0})):
                all_, q, a = index.overlap(item, ids)
                if all_ >= self.index.options.overlap and q >= self.index.options.part and a >= self.index.options.part:
                    best = out[d].get(item)
                    if best is None or (all_, score) > (best[2], best[1]):
                        out[d][item] = (start, score, all_, q, a)
        return out

    def batch(self, texts) -> Iterator[dict[int, tuple[int, float, float, float, float]]]:
        held, words = [], 0
        for text in texts:
            held.append(self.number(text))
            words += len(held[-1])
            if words >= CHUNK_WORDS:
                yield from self.find(held)
                held, words = [], 0
                give_back()
        yield from self.find(held)


def build_indexes(items: DataFrame, options: Options = Options(), *, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of all items, one after the other, each small enough to ship; the driver holds one at a time.

    Term statistics and the passages' length are of all items together, so the results do not depend on how many
    indexes there are.
    """
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("item IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / options.index_bytes))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [t for text in batch["text"] for t in set(terms_of(text))]
            yield pd.DataFrame({"term": found}).astype(object)

    lengths = rows.mapInPandas(lambda bs: (pd.DataFrame({"n": [len(terms_of(t)) for t in b["text"]]}) for b in bs), "n long").where("n > 0")
    total, mean_length, longest = lengths.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    df = rows.mapInPandas(spell, "term binary").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if shards > 1:
        df = written(df)
    for shard in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
        own = [(r["item"], r["text"]) for r in part.collect()]
        known = df if shards == 1 else df.join(part.mapInPandas(spell, "term binary").distinct(), "term")
        counts = {bytes(r["term"]): r["df"] for r in known.collect()}
        yield Index(own, counts, total, mean_length or 1.0, options, longest or 0)


_searchers: dict[str, Searcher] = {}


def _searcher(name: str, index: Index) -> Searcher:
    if name not in _searchers:
        _searchers.clear()
        _searchers[name] = Searcher(index)
    return _searchers[name]


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """(id, item_id, passage_start, score, overlap, question, answer): a row for each item that a document holds.

    Every passage of every whole text searches the index; retrieved items are verified by the overlap of their
    shingles and of the words of question and answer.  Null texts hold nothing; repeated rows give repeated matches;
    a null id stays null; a very long text is searched whole, passage by passage; items without words are never found;
    repeated items are found each; empty tables give no rows; other columns are not read.  No shuffle of documents.
    """
    spark = small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    result = None
    for index in build_indexes(items, options):
        shipped = spark.sparkContext.broadcast(index)
        name = f"{spark.sparkContext.applicationId}-{shipped._jbroadcast.id()}"

        def match(batches: Iterator[pd.DataFrame], shipped=shipped, name=name) -> Iterator[pd.DataFrame]:
            searcher = _searcher(name, shipped.value)
            for batch in batches:
                found = [
                    (None if pd.isna(id_) else int(id_), searcher.index.items[item], *best)
                    for id_, matches in zip(batch["id"], searcher.batch(batch["text"]), strict=True)
                    for item, best in sorted(matches.items())
                ]
                frame = pd.DataFrame(found, columns=["id", "item_id", "passage_start", "score", "overlap", "question", "answer"])
                yield frame.astype({"id": "Int64", "item_id": "int64", "passage_start": "int64", "score": float, "overlap": float, "question": float, "answer": float})

        part = rows.mapInPandas(match, "id long, item_id long, passage_start long, score double, overlap double, question double, answer double")
        result = part if result is None else result.unionByName(part)
    return result.withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", options: Options = Options()) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, as they are, with all their columns whatever these are named.

    Null, empty and wordless texts stay; very long ones are searched whole; repeated rows stay or go together; without items
    all rows stay; an empty table gives an empty table.
    """
    spark = small_batches(docs.sparkSession)
    kept = docs
    for index in build_indexes(items, options):
        shipped = spark.sparkContext.broadcast(index)
        name = f"{spark.sparkContext.applicationId}-{shipped._jbroadcast.id()}"

        def clean(batches, shipped=shipped, name=name):
            searcher = _searcher(name, shipped.value)
            for batch in batches:
                held = [bool(m) for m in searcher.batch(batch.column(text_col).to_pylist())]
                yield batch.filter(pa.array([not h for h in held], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept

