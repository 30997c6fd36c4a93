"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Words whose hashes a Python worker remembers; the memory stays bounded, the hashes do not depend on it.
HASH_CACHE_WORDS = 100_000


class _Hashes(dict):
    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value


_hashes: dict[int, _Hashes] = {}


def split_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text (``bytes.split`` splits on exactly the white space of WORD_PATTERN)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    if seed not in _hashes:
        _hashes.clear()
        _hashes[seed] = _Hashes(seed)
    return np.fromiter(map(_hashes[seed].__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder in the folder that driver and executors share (``spark.checkpoint.dir``).

    A path without a scheme lies on the session's default file system, as for Spark itself.  Only where the session
    runs on one machine and has no such setting, as in tests, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the context cleaner drop shuffle files of finished steps, which the driver's GC would do late."""
    for _ in range(2):  # what the first one finds, the cleaner's thread lets go of meanwhile
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


#: Rows and bytes of a batch that goes to a Python worker, whose memory is the executor's scarcest.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 250, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of texts no larger than BATCH."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)
    return spark


def give_back() -> None:
    """Return what this Python worker has freed to the system, where the C library can."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits_broadcast(rows: int, row_bytes: int, limit_bytes: int = 32 << 20) -> bool:
    """Whether a counted table of known row width may be broadcast."""
    return rows * row_bytes <= limit_bytes


def _salt(df: DataFrame, parts: int) -> Column:
    """A number below ``parts`` that a row has by its plain columns, so a task that runs again deals alike."""
    plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
    return F.pmod(F.xxhash64(*plain), F.lit(parts))


def split_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", *, most: int = 1_000, limit_bytes: int = 32 << 20) -> DataFrame:
    """``left`` joined with the written table ``right``, which has one row per key and in ``weight`` the key's rows in ``left``.

    Keys with more than ``most`` rows, and with more than a 100,000th of all, are hot: by that share there can be no more than
    100,000 of them, whatever the input.  Where their rows of ``right``, measured, fit ``limit_bytes``, these are broadcast and
    the rows of ``left`` stay where they are; otherwise only the keys are, hot rows of ``left`` are dealt to many tasks by a salt and
    each row of ``right`` goes to all of these.  The rows of all other keys meet in a shuffle.  The result has the columns of both but ``weight``.
    """
    total, largest = right.agg(F.sum(weight), F.max(weight)).first()
    line = max(most, (total or 0) // 100_000)
    if (largest or 0) <= line:
        return left.join(right.drop(weight), on, how)
    hot = right.where(F.col(weight) > line).drop(weight)
    rest = right.where(F.col(weight) <= line).drop(weight)
    n_bytes = hot.agg(F.sum(F.octet_length(F.to_json(F.struct(*hot.columns))).cast("long"))).first()[0]
    keys = F.broadcast(hot.select(*on))
    cold = left.join(keys, on, "left_anti").join(rest, on, how)
    if n_bytes <= limit_bytes:
        return left.join(F.broadcast(hot), on).unionByName(cold)
    parts = shuffle_partitions(left.sparkSession)
    dealt = left.join(keys, on, "left_semi")
    dealt = dealt.withColumn("__salt", _salt(dealt, parts).cast("int"))
    copies = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [*on, "__salt"]).drop("__salt").unionByName(cold)


def word_count(text: Column) -> Column:
    """Number of WORD_PATTERN words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def released(df: DataFrame) -> DataFrame:
    """A written table, after the shuffle files of the steps that made it were let go."""
    release(df.sparkSession)
    return df


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch(list):
    """Written tables of one computation, to be deleted together when what was made of them is written itself."""

    def __call__(self, df: DataFrame) -> DataFrame:
        self.append(written(df))
        return self[-1]

    def clear(self) -> None:
        discard(*self)
        super().clear()
