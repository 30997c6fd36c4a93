"""A review that grows: change records arrive in micro-batches, and what has come so far is reviewed as one.

Symbols and their changes belong to single files, so a batch computes them for its own files and appends them to a state
folder.  Moves, items, coverage and blast radius look across files: they are computed again for the change sets that a batch touches,
from all of their accumulated rows.  The review after any number of batches is therefore the review of all their files at once.

The state folder has the tables files, symbols and changes (what batches add) and linked, items and stats (what they
renew), each in a folder per batch.  A batch overwrites its own folders and is marked at last, and only marked batches are
read, so a batch that runs again after a failure leaves the same rows and readers never see half of one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import group, moves, symbols
from ..plans.barrier import Scope, settled
from ..plans.review import finished, parsable, symbols_of, with_file_changes, with_lines
from .progress import tagged, tell

ADDED, RENEWED = ("files", "symbols", "changes"), ("linked", "items", "stats")


@dataclass(frozen=True)
class State:
    """The state folder of a growing review."""

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def batches(self) -> list[int]:
        """Numbers of the complete batches."""
        fs, at = self._fs(f"{self.folder}/done")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def mark(self, number: int) -> None:
        fs, at = self._fs(f"{self.folder}/done/{number}")
        fs.mkdirs(at.getParent())
        fs.create(at, True).close()

    def put(self, name: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def all(self, name: str, *, beside: int | None = None) -> DataFrame | None:
        """Rows of a table with their ``batch``, of all complete batches and of one that is being made; None without batches."""
        numbers = sorted({*self.batches(), *([] if beside is None else [beside])})
        if not numbers:
            return None
        paths = [f"{self.folder}/{name}/batch={n}" for n in numbers]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def latest(self, name: str) -> DataFrame | None:
        """Rows of a renewed table: of each change set those of the last batch that touched it."""
        rows, touched = self.all(name), self.all("touched")
        if rows is None:
            return None
        last = touched.groupBy("changeset_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["changeset_id", "batch"], "left_semi").drop("batch")

    def once(self, name: str) -> DataFrame | None:
        """Rows of an added table: of a file that came more than once those of its last batch."""
        rows = self.all(name)
        return None if rows is None else _last_of_files(rows, self.all("files")).drop("batch")


def _last_of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    key = "path" if "path" in rows.columns else "file"
    last = files.groupBy("changeset_id", F.col("path").alias(key)).agg(F.max("batch").alias("batch"))
    return rows.join(last, ["changeset_id", key, "batch"], "left_semi")


def add_batch(state: State, changes: DataFrame, number: int, *, review_each: bool = True, renames: bool = True, cache_path: str | None = None, **how) -> None:
    """Add change records with hunks to the state and, with ``review_each``, review the change sets that they belong to anew.

    ``how`` goes to the later stages: similar, tests, sources, definitions, local_judge.  A file that comes again replaces its earlier version.
    """
    with Scope(state.spark):
        files = settled(with_lines(changes))
        rows = settled(symbols_of(parsable(files), cache_path))
        found = with_file_changes(symbols.diff_symbols(rows, renames=renames), rows, parsable(files))
        for name, table in (("files", files), ("symbols", rows), ("changes", found)):
            state.put(name, number, table)
        touched = files.select("changeset_id").distinct()
        if review_each:
            renew(state, touched, number, **how)
        else:
            for name in RENEWED:
                state.put(name, number, _nothing(state, name))
            touched = touched.where("false")
        state.put("touched", number, touched)
    state.mark(number)


def _nothing(state: State, name: str) -> DataFrame:
    kinds = {"linked": symbols.CHANGE, "items": group.ITEM_SCHEMA, "stats": group.STATS_SCHEMA}
    return state.spark.createDataFrame([], kinds[name])


def renew(state: State, touched: DataFrame, number: int, *, similar: bool = True, **how) -> None:
    """Review change sets from all their accumulated rows, as batch ``number``."""
    files = state.all("files", beside=number)
    of = lambda name: settled(_last_of_files(state.all(name, beside=number), files).join(touched, "changeset_id", "left_semi").drop("batch"))
    own, rows, compared = (of(name) for name in ADDED)
    linked = settled(moves.link_moves(compared, rows, similar=similar))
    made = finished(own, linked, **how)
    for name, table in (("linked", linked), ("items", made.items.drop("pos")), ("stats", made.stats)):
        state.put(name, number, table)


def finish(state: State, **how) -> None:
    """Review every change set from all accumulated rows, as a batch of its own (an odd number, so the stream may go on); for
    streams that only collect."""
    numbers = state.batches()
    if not numbers:
        return
    number = numbers[-1] | 1
    with Scope(state.spark):
        touched = settled(state.all("files").select("changeset_id").distinct())
        for name in ADDED:
            state.put(name, number, state.all(name).where("false").drop("batch"))
        renew(state, touched, number, **how)
        state.put("touched", number, touched)
    state.mark(number)


def run_review(changes: DataFrame, folder: str, checkpoint: str, generation: int = 0, *, messages: str | None = None, tag: str | None = None, **how) -> StreamingQuery:
    """Start a query that reviews a stream of change records (with hunks, as a git source gives them) as it grows.

    The state is in ``folder``.  ``messages`` is a folder that gets a Progress message for each file, by its file_idx, when its batch is
    complete; jobs carry ``tag``, so that progress.cancel() can stop them within a batch.  ``how`` as in add_batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        with tagged(batch.sparkSession, tag):
            add_batch(State(batch.sparkSession, folder), batch, 2 * number, **how)
            if messages:
                tell(batch, messages, number, generation)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
