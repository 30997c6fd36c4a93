"""Progress of a running analysis as a stream of messages (generation, index, kind)."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.barrier import Scope


def analysed(messages: DataFrame) -> DataFrame:
    """(generation, analysed, finished): files done and whether the run ended, by generation."""
    done = F.count_distinct(F.when(F.col("kind") == "Progress", F.col("index")))
    return messages.groupBy("generation").agg(done.alias("analysed"), F.count_if(F.col("kind") == "Finished").alias("finished"))


def current(messages: DataFrame, generation: int) -> DataFrame:
    """Messages of a generation; those of earlier or later ones are stale."""
    return messages.where(F.col("generation") == generation)


def drained(messages: DataFrame, generation: int) -> DataFrame:
    """One row: the state after all messages: files done, and the last Finished message, which marks everything done."""
    rows = current(messages, generation)
    last = F.max(F.when(F.col("kind") == "Finished", F.col("index")))
    return rows.agg(F.count_distinct(F.when(F.col("kind") == "Progress", F.col("index"))).alias("analysed"), last.alias("last_finished"), last.isNotNull().alias("done"))


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str | None) -> Iterator[None]:
    """Jobs started inside carry a tag, those after it do not."""
    if tag:
        spark.addTag(tag)
    try:
        yield
    finally:
        if tag:
            spark.removeTag(tag)


def tell(batch: DataFrame, messages: str, number: int, generation: int) -> None:
    """Write a Progress message for each file of a batch."""
    told = batch.select(F.lit(generation).cast("long").alias("generation"), F.col("file_idx").cast("long").alias("index"), F.lit("Progress").alias("kind"))
    told.write.mode("overwrite").parquet(f"{messages}/part={number}")


def run_stream(changes: DataFrame, analyse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, generation: int = 0, *, messages: str | None = None, tag: str | None = None) -> StreamingQuery:
    """Start a query over a stream of change records: each micro-batch is analysed and adds its rows to the target.

    Each batch overwrites its own part, so a batch that runs again after a failure leaves the same rows.  ``messages`` is a
    folder that gets a Progress message (generation, index, kind) for each file, by its file_idx, when its batch is done.  Jobs
    carry ``tag``, so cancel() can stop them within a batch.  See finish() for the end.
    """

    def step(batch: DataFrame, number: int) -> None:
        with tagged(batch.sparkSession, tag), Scope(batch.sparkSession):
            rows = analyse(batch).withColumn("generation", F.lit(generation))
            rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
            if messages:
                tell(batch, messages, number, generation)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(query: StreamingQuery, spark: SparkSession, messages: str | None = None, generation: int = 0, *, at_end: Callable[[], None] | None = None) -> bool:
    """Wait for a query; whether it ended by itself.  Only then the Finished message is written, whose index is the number of
    files, and ``at_end`` is called, which may save a cache.  A failed or cancelled run leaves neither."""
    try:
        query.awaitTermination()
    except PySparkException:
        return False
    if query.exception() is not None:
        return False
    if messages:
        done = spark.read.parquet(messages).where(F.col("generation") == generation).select(F.count_distinct("index").alias("index"))
        done.select(F.lit(generation).cast("long").alias("generation"), "index", F.lit("Finished").alias("kind")).write.mode("overwrite").parquet(f"{messages}/part=end")
    if at_end:
        at_end()
    return True


def cancel(query: StreamingQuery, spark: SparkSession, tag: str) -> None:
    """Stop a query and the jobs of the batch that it is in."""
    spark.interruptTag(tag)
    query.stop()
