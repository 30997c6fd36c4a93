"""Toxicity: class-conditional Kneser-Ney models over words, compared by length-normalised log-likelihood.

Each class, toxic and ordinary, has an interpolated model.  A pair's discounted count in the class backs off to the
class's continuation counts of the word (in how many different contexts it stands), and these to the continuation
counts that both classes share.  A word that is rare or was never seen is left to the shared counts alone, so every
word of a text has a probability under both models.  As continuation counts do for words, the counts of pairs are of
documents, so that what one document repeats is no evidence of its class.

Pairs that do not tell the classes apart are pruned; the mass that goes with them is the context's backoff weight.

A document's score is a logistic curve of three features: the mean log-likelihood ratio of all its words, and of those
ratios that a log-likelihood-ratio test bears out the largest mean over a few words on end and the sum over the root
of the length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HASH_CACHE_WORDS, discard, fits_broadcast, give_back, mix64, released, small_batches, split_join, written

#: Stripped from the ends of words before they are counted.
PUNCTUATION = b""".,;:!?"'()*#$%&|-_[]{}<>/\\"""
#: The context of a row that counts a single word; the word before the first one of a text; the word of a row about a context.
SINGLE, START, ANY = 0, 1, 0
#: Bits of a word's id: of 100 million different words, one in 10,000 shares its id with another.
BITS = 40
#: Words of texts whose counts a task adds up before it emits them.
CHUNK_WORDS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    """discount: of Kneser-Ney.  rare: words of fewer labelled documents are left to the shared counts.  least_docs:
    documents an expression needs to be tested.  least_g2: the log-likelihood ratio against the classes' sizes that bears it out, or
    2 ln(expressions tested) where that is more.  window: words over which the largest mean is taken.  calibration_rows:
    labelled rows, about so many and no more than calibration_share of them, of smallest id hash, that the logistic curve is fitted to; the
    counts cover every other labelled row.  broadcast_bytes: size of a model up to which it is shipped; a larger one is joined."""

    discount: float = 0.75
    rare: int = 2
    least_docs: int = 4
    least_g2: float = 15.0
    window: int = 8
    calibration_rows: int = 20_000
    calibration_share: float = 0.25
    broadcast_bytes: int = 64 << 20


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_CACHE_WORDS:
            self.clear()
        bare = word.strip(PUNCTUATION)
        value = self[word] = max(2, xxhash.xxh64_intdigest(bare) >> (64 - BITS)) if bare else 0
        return value


_ids = _Ids()


def word_ids(text: str | None) -> np.ndarray:
    """Ids of a text's words, lower-cased (A-Z) and without punctuation at their ends."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    ids = np.fromiter(map(_ids.__getitem__, words), np.int64, len(words))
    return ids[ids != 0]


def contexts(ids: np.ndarray) -> np.ndarray:
    """The word before each."""
    return np.concatenate([np.array([START], np.int64), ids[:-1]])[: len(ids)]


def held_out(id_: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, toxic) of the labelled documents that may be learnt from, each text once.

    Of equal texts the smallest id stays, toxic if most of their labels are.  Labels are broadcast only up to a
    counted size; beyond it the join shuffles.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    narrow = docs.select(F.col("id"), F.xxhash64("text").alias("h"))
    small = lambda t, n: F.broadcast(t) if fits_broadcast(n, 40) else t
    labelled = narrow.join(small(marks, labels.count()), F.col("id") == F.col("doc_id"))
    once = written(labelled.groupBy("h").agg(F.min("id").alias("keep"), (2 * F.sum("toxic") > F.count(F.lit(1))).cast("int").alias("toxic")).select("keep", "toxic"))
    return docs.join(small(once, once.count()), F.col("id") == F.col("keep")).select("id", "text", "toxic")


def count_expressions(training: DataFrame) -> DataFrame:
    """(w, v, c0, c1): documents of each class that hold a word (v = SINGLE) or a pair (v, w), from (text, toxic).

    A row travels as 64 and 16 bits: the word's id with the first bits of the context's, and the context's last ones.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def emit() -> pd.DataFrame:
            parts = []
            for k, rows in enumerate(held):
                pairs = np.concatenate(rows) if rows else np.zeros((0, 2), np.int64)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                new = np.ones(len(pairs), bool)
                new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(pairs)))
                parts.append(pd.DataFrame({"high": pairs[at, 0], "low": pairs[at, 1].astype(np.int16), f"c{k}": n, f"c{1 - k}": np.zeros(len(n), np.int64)}))
            return pd.concat(parts)[["high", "low", "c0", "c1"]]

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                ids = word_ids(text)
                if len(ids):
                    both = np.concatenate([np.column_stack([ids, np.full(len(ids), SINGLE)]), np.column_stack([ids, contexts(ids)])])
                    packed = np.column_stack([(both[:, 0] << 24) | (both[:, 1] >> 16), both[:, 1] & 0xFFFF])
                    order = np.lexsort((packed[:, 1], packed[:, 0]))
                    packed = packed[order]
                    new = np.ones(len(packed), bool)
                    new[1:] = (packed[1:] != packed[:-1]).any(axis=1)
                    held[int(toxic > 0)].append(packed[new])
                    size += len(ids)
                if size >= CHUNK_WORDS:
                    yield emit()
                    held, size = [[], []], 0
                    give_back()
        yield emit()

    rows = training.select("text", "toxic").mapInPandas(count, "high long, low short, c0 long, c1 long")
    rows = rows.groupBy("high", "low").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return rows.select("high", "low", F.col("c0").cast("int").alias("c0"), F.col("c1").cast("int").alias("c1"))


def _unpacked(counts: DataFrame) -> DataFrame:
    v = F.shiftleft(F.col("high").bitwiseAND((1 << 24) - 1), 16).bitwiseOR(F.col("low").cast("long").bitwiseAND(0xFFFF))
    return counts.select(F.shiftrightunsigned("high", 24).alias("w"), v.alias("v"), "c0", "c1")


def _g2(a: Column, b: Column, share: float) -> Column:
    n = a + b
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (term(a, n * F.lit(share)) + term(b, n * F.lit(1 - share)))


@dataclass(frozen=True)
class Model:
    """rows (v, w, ratio, strong): log-likelihood ratios, toxic to ordinary, of words (v = SINGLE), of the pairs that were kept, and
    of the backoff weights of these pairs' contexts (w = ANY).  unknown: the ratio of any other word."""

    rows: DataFrame
    unknown: float


def models(counts: DataFrame, docs0: int, docs1: int, options: Options = Options()) -> Model:
    """The two models of ``counts``, a written table of count_expressions, as ratios; docs0 and docs1 are the classes' documents."""
    d, spark = options.discount, counts.sparkSession
    rows = _unpacked(counts)
    singles = rows.where(F.col("v") == SINGLE).select("w", "c0", "c1")
    pairs = rows.where(F.col("v") != SINGLE)
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long"))
    cont = pairs.groupBy("w").agg(kinds("c0").alias("n0"), kinds("c1").alias("n1"))
    words = written(singles.join(cont, "w").withColumn("seen", F.col("c0") + F.col("c1") >= options.rare))
    kept_sum = lambda c: F.sum(F.when(F.col("seen"), F.greatest(F.col(c) - d, F.lit(0.0))).otherwise(0.0))
    total = words.agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), kept_sum("n0").alias("k0"), kept_sum("n1").alias("k1"), F.count(F.lit(1)).alias("v"),
        F.count_if(F.col("c0") + F.col("c1") >= options.least_docs).alias("tested"),
    ).first()
    left = [1 - total[f"k{c}"] / total[f"n{c}"] for c in (0, 1)]
    least = max(options.least_g2, 2 * math.log(max(total["tested"], 1)))
    everything = total["n0"] + total["n1"] + 0.5 * (total["v"] + 1)

    def word_p(c: int) -> Column:
        shared = (F.col("n0") + F.col("n1") + 0.5) / F.lit(everything)
        return F.greatest(F.col(f"n{c}") - d, F.lit(0.0)) / F.lit(float(total[f"n{c}"])) + F.lit(left[c]) * shared

    share = docs1 / (docs0 + docs1)
    tells = (F.col("c0") + F.col("c1") >= options.least_docs) & (_g2(F.col("c1"), F.col("c0"), share) >= least)
    in_contexts = _g2(F.col("n1"), F.col("n0"), total["n1"] / (total["n0"] + total["n1"])) >= least
    seen = words.where("seen").withColumn("strong", tells & in_contexts).withColumn("p0", word_p(0)).withColumn("p1", word_p(1))
    # of the pairs those are kept that tell the classes apart, and of words that do not, only by twice the bar
    kept = pairs.where(tells).withColumn("clear", _g2(F.col("c1"), F.col("c0"), share) >= 2 * least)
    kept = kept_rows = written(kept.join(seen.select("w", "p0", "p1", "strong"), "w").where("strong OR clear").select("v", "w", "c0", "c1", "p0", "p1"))
    few = kept.select("v").distinct()
    few = F.broadcast(few) if fits_broadcast(few.count(), 16) else few
    of = pairs.join(few, "v").groupBy("v").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    more = lambda c: F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"c{c}") - d, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0)
    kept = kept.join(of, "v").withColumn("m0", more(0)).withColumn("m1", more(1))
    weights = kept.groupBy("v").agg((1 - F.sum("m0")).alias("g0"), (1 - F.sum("m1")).alias("g1"))
    two = kept.join(weights, "v")
    pair_p = lambda c: F.col(f"m{c}") + F.col(f"g{c}") * F.col(f"p{c}")
    row = lambda df, v, w, ratio, strong: df.select(v.cast("long").alias("v"), w.cast("long").alias("w"), ratio.alias("ratio"), strong.alias("strong"))
    out = row(seen, F.lit(SINGLE), F.col("w"), F.log(F.col("p1") / F.col("p0")), F.col("strong"))
    out = out.unionByName(row(two, F.col("v"), F.col("w"), F.log(pair_p(1) / pair_p(0)), F.lit(True)))
    out = out.unionByName(row(weights, F.col("v"), F.lit(ANY), F.log(F.col("g1") / F.col("g0")), F.lit(False)))
    out = written(out)
    discard(words, kept_rows)
    return Model(out, math.log(left[1] / left[0]))


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v.astype(np.uint64) * _BASE + w.astype(np.uint64))


class Ratios:
    """A model's rows in sorted arrays, to look up the words of a text: words with their ratios, which of them are strong, pairs, contexts."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], strong: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], in_context: tuple[np.ndarray, np.ndarray], unknown: float):
        self.words, self.strong, self.pairs, self.contexts, self.unknown = words, strong, pairs, in_context, unknown

    @classmethod
    def of_rows(cls, v: np.ndarray, w: np.ndarray, ratio: np.ndarray, strong: np.ndarray, unknown: float) -> Ratios:
        single, context = v == SINGLE, (v != SINGLE) & (w == ANY)
        pair = ~single & ~context
        pick = lambda keys, values: (keys[o := np.argsort(keys)], values[o].astype(np.float32))
        return cls(pick(w[single], ratio[single]), np.sort(w[single & strong]), pick(_pair_key(v[pair], w[pair]), ratio[pair]), pick(v[context], ratio[context]), unknown)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return table[at] == keys, at

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each word after the one before it, and the same where it is borne out, else 0."""
        before = contexts(ids)
        known, at = self._find(self.words[0], ids)
        ratio = np.where(known, self.words[1][at], self.unknown) if len(self.words[0]) else np.full(len(ids), self.unknown)
        proof = np.where(self._find(self.strong, ids)[0], ratio, 0.0)
        there, at = self._find(self.contexts[0], before)
        ratio[there] += self.contexts[1][at[there]]
        kept, at = self._find(self.pairs[0], _pair_key(before, ids))
        ratio[kept] = proof[kept] = self.pairs[1][at[kept]]
        return ratio, proof

    def features(self, text: str | None, window: int) -> tuple[float, float, float]:
        """Mean ratio of all words; largest mean of ``window`` proofs on end (of all, if fewer); their sum over the root of length."""
        ids = word_ids(text)
        n = len(ids)
        if n == 0:
            return 0.0, 0.0, 0.0
        ratio, proof = self.of(ids)
        sums = np.concatenate([[0.0], np.cumsum(proof)])
        k = min(window, n)
        return float(ratio.mean()), float((sums[k:] - sums[:-k]).max() / k), float(sums[-1] / math.sqrt(n))


FEATURES = ("mean", "peak", "spread")


def features(docs: DataFrame, model: Model, options: Options = Options(), *, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (text, more) with FEATURES in place of the text, or beside it.

    The model is broadcast while its counted size stays under options.broadcast_bytes.  A larger one is joined to the
    distinct words and pairs of each document, whose part of the model then meets its text.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if keep_text or c != text]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in rest}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), *(f"{c} double" for c in FEATURES)])
    window, unknown = options.window, model.unknown
    own = ("v", "w", "ratio", "strong")
    kinds_of = {"v": np.int64, "w": np.int64, "ratio": float, "strong": bool}
    whole = fits_broadcast(model.rows.count(), 12, options.broadcast_bytes)
    if whole:
        table = model.rows.toArrow()
        shipped = spark.sparkContext.broadcast(Ratios.of_rows(*(table.column(c).to_numpy() for c in own), unknown))
        del table

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            parts = [None] * batch.num_rows if whole else batch.column("model").to_pylist()
            for one, part in zip(batch.column(text).to_pylist(), parts, strict=True):
                of = shipped.value if whole else Ratios.of_rows(*(np.array([r[k] for r in part or ()], t) for k, t in kinds_of.items()), unknown)
                found.append(of.features(one, window))
            scored = [pa.array([f[k] for f in found], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *scored], [*rest, *FEATURES])

    if whole:
        return docs.mapInArrow(score, schema)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for place, one in zip(batch["place"], batch["text"], strict=True):
                ids = word_ids(one)
                before = contexts(ids)
                asked = np.concatenate([np.column_stack([np.full(len(ids), SINGLE), ids]), np.column_stack([before, ids]), np.column_stack([before, np.full(len(ids), ANY)])])
                asked = np.unique(asked, axis=0)
                yield pd.DataFrame({"place": place, "v": asked[:, 0], "w": asked[:, 1]})

    placed = written(docs.withColumn("place", F.monotonically_increasing_id()))  # ids of a plan that runs twice may differ
    asked = written(placed.select("place", F.col(text).alias("text")).mapInPandas(spell, "place long, v long, w long"))
    weighed = asked.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")).join(model.rows, ["v", "w"])
    hits = split_join(asked, written(weighed), ["v", "w"], "n")
    parts = hits.groupBy("place").agg(F.collect_list(F.struct(*own)).alias("model"))
    return placed.join(parts, "place", "left").drop("place").mapInArrow(score, schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve, intercept first, by Newton's method on features of unit variance."""
    middle, width = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - middle) / width])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * middle / width).sum()], w[1:] / width])


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """Toxicity of every whole text: id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    ``labels`` has (doc_id, toxic).  Learning is from rows that are not held out; ids only join labels to texts.
    Null or empty texts hold no evidence and get the score of a text without any; a very long text is read whole, by itself;
    repeated rows score alike; a null id is scored too (held out).  Without labels of both classes the score is the share of
    toxic labels (0 if none).  An empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.select("id", held_out(F.col("id")).alias("held_out"), "text")
    scored = _scores(rows, out, labels, options)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _learnt(rows: DataFrame, labels: DataFrame, options: Options) -> tuple[Model | None, np.ndarray]:
    """The model of the labelled texts among ``rows`` (id, text) and the weights of the logistic curve; without both classes no model
    and the score of every text."""
    training = training_rows(rows, labels.select("doc_id", "toxic"))
    sizes = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None, np.array([1.0 if sizes.get(1) else 0.0])
    part = min(options.calibration_share, options.calibration_rows / sum(sizes.values()))
    apart = F.shiftrightunsigned(F.xxhash64("id"), 32) < F.lit(int(part * (1 << 32)))
    counted = {r["toxic"]: r["n"] for r in training.where(~apart).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = len(counted) == 2 and all(sizes[k] > counted[k] for k in (0, 1))
    fitted, counted_rows = (training.where(apart), training.where(~apart)) if both else (training, training)
    counted = counted if both else sizes
    counts = released(written(count_expressions(counted_rows)))
    if counts.agg(F.sum("c0") * F.sum("c1")).first()[0] in (None, 0):  # a class whose texts have no words
        return None, np.array([sizes[1] / (sizes[0] + sizes[1])])
    model = models(counts, counted[0], counted[1], options)
    discard(counts)
    seen = features(fitted.select("text", "toxic"), model, options).toPandas()
    return model, fit_logistic(seen[list(FEATURES)].to_numpy(), seen["toxic"].to_numpy(float))


def _scores(rows: DataFrame, out: DataFrame, labels: DataFrame, options: Options, **how) -> DataFrame:
    """``out`` (text, more) with a score, by models of the labelled texts among ``rows`` (id, text)."""
    small_batches(rows.sparkSession)
    model, w = _learnt(rows, labels, options)
    if model is None:
        return out.withColumn("score", F.lit(float(w[0])))
    z = F.lit(float(w[0]))
    for weight, name in zip(w[1:], FEATURES, strict=True):
        z = z + F.lit(float(weight)) * F.col(name)
    return features(out, model, options, **how).withColumn("score", 1 / (1 + F.exp(-z)))


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """The rows of ``docs`` that ``score`` does not predict to be toxic, as they are, with all their columns whatever these are named.

    Null and empty texts stay unless texts without evidence are predicted toxic; very long texts are read whole; repeated rows stay
    or go together; without labels of both classes all stay if the labels are not toxic; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = _scores(rows, whole, labels, options, text=names[text_col], keep_text=True).where("score < 0.5")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
