"""The corpus pipeline: five stages from raw documents to a mix of sources, each written and read again as Parquet.

What holds for every stage: it reads doc_id, text, lang, source and n_chars, by these names whatever other columns there are, and all but
the last return these five.  Nulls in lang, source and n_chars are carried as they are.  Texts are read whole, however long.  Rows that
repeat an id or a text are rows of their own.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontam, mixing, neardup, substrings, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models do not predict to be toxic.

    Null and empty texts hold no evidence, so they stay where most labelled documents are ordinary.  A null id is scored, but learns
    nothing.  Equal texts stay or go together.
    """
    return toxicity.without_toxic(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that five-word shingles link at a similarity of 0.8 or more.

    Null, empty and wordless texts are linked with nothing and stay, and so do rows without id.  Rows that repeat a kept id all stay.
    """
    return neardup.without_near_duplicates(docs.select(*COLUMNS), options=neardup.Options(shingle=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 50 words that a document of a smaller id has; a text of which nothing is left goes.

    Cut texts keep their remaining stretches as they were, joined by a line end, and get their n_chars anew.  Null, empty and short texts
    and rows without id stay as they are.
    """
    cut = substrings.remove_repeats(docs, carry=("lang", "source", "n_chars"), with_text=True)
    rows = cut.where("n_removed = 0 OR n_removed < n_words")
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", chars.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that holds an item of ``benchmark``.

    Null and empty texts stay; a null id makes no difference.  With an empty benchmark all documents stay.
    """
    return decontam.without_contaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes: doc_id, source, size, source_size, target, taken.

    A null text has size 0; a null source is a source of its own; rows without id share a key and are taken one after the other.
    """
    return mixing.mix(docs, common.word_count(F.col("text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("source_mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one's is complete."""
    docs = _table(spark, sf_dir, "documents")
    before = None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.released(common.written(docs))
            if before is not None:
                common.discard(before)
            before = docs
    return docs
