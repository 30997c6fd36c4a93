"""Document fingerprints: threshold-scaled sketches of word shingles, and the sequence of edited documents."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix64, shuffle_partitions, small_batches, split_words

_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Scale:
    """shingle: words.  shift: the fixed fraction is 2**-shift of all shingle hashes, for texts of every size.  whole: sets of
    at most so many shingles are kept whole, as the fraction would leave little or nothing of them."""

    shingle: int = 5
    shift: int = 3
    whole: int = 256


@dataclass(frozen=True)
class Sketch:
    """Retained hashes, sorted: all shingle hashes below 2**(64 - scale.shift), or all of a small set.

    What a small set keeps beyond the fraction only makes small sets exact: it is left out whenever a sketch meets one
    that has the fraction alone, so all sketches are comparable and merge to the sketch of the texts together.
    """

    hashes: np.ndarray
    is_whole: bool
    scale: Scale = Scale()

    def text(self) -> str:
        return f"{0 if self.is_whole else self.scale.shift}:{base64.b64encode(self.hashes.astype('<u8').tobytes()).decode()}"

    @staticmethod
    def parse(text: str, scale: Scale = Scale()) -> Sketch:
        shift, _, data = text.partition(":")
        return Sketch(np.frombuffer(base64.b64decode(data), "<u8").astype(np.uint64), shift == "0", scale)

    @staticmethod
    def of(hashes: np.ndarray, scale: Scale = Scale()) -> Sketch:
        """The sketch of a set of sorted distinct hashes."""
        whole = Sketch(hashes, True, scale)
        return whole if len(hashes) <= scale.whole else Sketch(whole.below(), False, scale)

    def below(self) -> np.ndarray:
        """The hashes below the fixed fraction."""
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(1 << (64 - self.scale.shift)))] if self.is_whole and self.scale.shift else self.hashes

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts' shingles together."""
        if self.is_whole and other.is_whole:
            return Sketch.of(np.union1d(self.hashes, other.hashes), self.scale)
        return Sketch(np.union1d(self.below(), other.below()), False, self.scale)

    def _both(self, other: Sketch) -> tuple[int, int, int]:
        a, b = (self.hashes, other.hashes) if self.is_whole and other.is_whole else (self.below(), other.below())
        return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)

    def likeness(self, other: Sketch) -> float:
        """Jaccard similarity of the shingle sets, exact for two whole ones, else estimated; two empty ones are alike."""
        both, a, b = self._both(other)
        return both / (a + b - both) if a + b else float(self.is_whole and other.is_whole)

    def containment(self, other: Sketch) -> float | None:
        """Share of this text's shingles that the other has too, however long the other is; None where nothing of this
        text lies below the fraction (or it has no words), so nothing is known."""
        both, a, _ = self._both(other)
        return both / a if a else None


def sketch(text: str | None, scale: Scale = Scale()) -> Sketch:
    """Sketch of a whole text.  With fewer words than a shingle has, all of them are one; a text without words has none."""
    words = hash_words(split_words(text))
    n = len(words)
    if n == 0:
        return Sketch(np.zeros(0, np.uint64), True, scale)
    k = min(scale.shingle, n)
    z = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        z = z * _BASE + words[i : i + n - k + 1]
    return Sketch.of(np.unique(mix64(z)), scale)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scale: Scale = Scale()) -> DataFrame:
    """Fingerprint of each whole text: id, n_chars, fingerprint.  Null text: as the empty one.

    A very long text is read whole, by itself; repeated rows are fingerprinted each; an empty table gives an empty table;
    other columns are not read.  No shuffle.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "n_chars": [len(t or "") for t in batch["text"]], "fingerprint": [sketch(t, scale).text() for t in batch["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInPandas(build, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scale: Scale = Scale()) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by the start of the next document.

    The next document has the next smaller id; after the last comes the first.  Equal ids follow each other in the
    order of their texts, a null id comes last, a null text counts as empty, and a single document is its own next.
    An empty table gives an empty table; other columns are not read.  A very long text is held with the one before it.

    Quantiles of the ids (the ids alone are read for them) deal documents to ranges, a few per task.  Besides its own
    documents a range gets one more row, the first document of the range below it, so a single shuffle of the texts
    brings every document and its next together, and a task streams through them one at a time.
    """
    spark = small_batches(docs.sparkSession)
    tasks = shuffle_partitions(spark)
    ranges = 4 * tasks
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id")
    cuts = sorted(set(ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ids.head(1) else []
    rows = rows.withColumn("ord", F.coalesce(F.col("id"), F.lit(-(1 << 63))))
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(ord_: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ord_.to_numpy(), side="right").astype(np.int32))

    # one row per range, so no more than 4 * tasks + 1
    tops = {r["range"]: r["top"] for r in rows.groupBy(range_of("ord").alias("range")).agg(F.max("ord").alias("top")).collect()}
    filled = sorted(tops)
    top_of = np.full(len(bounds) + 1, -(1 << 63), np.int64)
    above = np.full(len(bounds) + 1, -1, np.int64)
    for i, r in enumerate(filled):
        top_of[r], above[r] = tops[r], filled[(i + 1) % len(filled)]

    @F.pandas_udf("range int, above int")
    def place(ord_: pd.Series) -> pd.DataFrame:
        """A row's range, and the range that it also goes to as the first of its own, else -1."""
        at = np.searchsorted(bounds, ord_.to_numpy(), side="right")
        return pd.DataFrame({"range": at.astype(np.int32), "above": np.where(top_of[at] == ord_.to_numpy(), above[at], -1).astype(np.int32)})

    placed = rows.select("ord", "text", place("ord").alias("p"))
    copies = F.array_compact(F.array(F.struct(F.col("p.range"), F.lit(0).alias("extra")), F.when(F.col("p.above") >= 0, F.struct(F.col("p.above").alias("range"), F.lit(1).alias("extra")))))
    dealt = placed.select("ord", "text", F.explode(copies).alias("c")).select("ord", "text", "c.range", "c.extra")
    dealt = dealt.repartition(tasks, "range").sortWithinPartitions("range", "extra", F.desc("ord"), "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            out = []
            for id_, text, range_, extra in zip(batch["ord"], batch["text"], batch["range"], batch["extra"], strict=True):
                if waiting is not None and waiting[2] == range_:
                    own = sketch(text, scale)
                    out.append(one(waiting, text, own))
                    waiting = None if extra else (id_, text, range_, own)
                elif not extra:
                    waiting = (id_, text, range_, sketch(text, scale))
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"id": "Int64"})

    def one(row, following: str, of_next: Sketch) -> tuple:
        id_, text, _, own = row
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        of_edited = sketch(edited, scale) if edited != text else own
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return None if id_ == -(1 << 63) else int(id_), len(text), sha, own.text(), of_edited.text(), own.likeness(of_edited), own.likeness(of_next)

    done = dealt.mapInPandas(compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumnRenamed("id", id_col)
