"""Helpers shared by the training-data operators: tables, shared storage, bitmaps, word streams."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A bitmap filter has this many bits, whatever the input: 1 MiB.
FILTER_BITS = 1 << 23
#: Bits in one row of a bitmap table; the size that bitmap_construct_agg builds.
ROW_BITS = 1 << 15

#: Python sides take documents in slices of about this many bytes of text.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python, which both sides hold; a batch is at least one row.
ARROW_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_fold(text: Column) -> Column:
    """Null as empty; only A-Z become lower case."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. A local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = getattr(spark, "_wirelake_dir", None)
    if known is None:
        known = spark._wirelake_dir = tempfile.mkdtemp(prefix="wirelake-")
    return known


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting key has this value inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors. Arrow batches have ARROW_BYTES."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wirelake/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES)):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wirelake_path = path
    return out


def stage_alone(df: DataFrame, name: str) -> DataFrame:
    """stage(), whose shuffle files go when it is written; else they stay until the driver collects its garbage."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return stage(df, name)


def drop_stage(df: DataFrame) -> None:
    """Removes a staged table that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._wirelake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_mark(text: Column) -> Column:
    """A 64-bit hash of the folded text: with the id, what decisions on rows are joined by."""
    return F.xxhash64(ascii_fold(text))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that found keeps, with all their columns.

    found has one row for each row of docs: (id, mark, grp, kept), mark = text_mark of the text. Rows are met by id (nulls are equal) and
    mark, so another text under a dropped id stays. Of several kept rows of one group (repeated or null ids) one stays, that of the smallest id,
    then mark; of rows that agree in both any one. A null grp is no group: such rows all go by kept.
    """
    marked = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), text_mark(F.col(text_col)).alias("mark"))
    kept = found.where("kept and grp is not null").groupBy("grp", "id", "mark").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct("id", "mark"))
    many = kept.groupBy("grp").agg(least.alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    again = stage(kept.join(many, "grp").select("id", "mark", F.struct("id", "mark").eqNullSafe(F.col("first")).alias("stays")), "kept-again")
    gone = stage(found.where("not kept").select("id", "mark").unionByName(again.where("not stays").select("id", "mark")), "gone")

    def met(other: DataFrame) -> Column:
        return marked["id"].eqNullSafe(other["id"]) & (marked["mark"] == other["mark"])

    out = marked.join(gone, met(gone), "left_anti")
    if not again.isEmpty():
        one = again.where("stays").select("id", "mark")
        single = out.join(one, met(one), "left_anti")
        out = single.unionByName(out.join(one, met(one), "left_semi").dropDuplicates(["id", "mark"]))
    return out.select("doc.*")


def filter_bits(entries: int) -> int:
    """Bits of a filter that lets few others through: 16 for each entry, 1 MiB at least and 64 MiB at most."""
    return min(1 << 29, max(FILTER_BITS, 1 << (16 * entries - 1).bit_length()))


def bitmap_rows(df: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the hashes in df: rows (bucket, bitmap), at most bits / ROW_BITS of them."""
    spot = F.pmod(hashed, F.lit(bits))
    return (
        df.select(F.floor(spot / ROW_BITS).cast("int").alias("bucket"), F.pmod(spot, F.lit(ROW_BITS)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )


def collect_bitmap(df: DataFrame, hashed: Column, bits: int = FILTER_BITS) -> bytes:
    """The same bitmap on the driver: bits / 8 bytes, whatever df holds."""
    out = bytearray(bits // 8)
    for row in bitmap_rows(df, hashed, bits).collect():
        at = row["bucket"] * ROW_BITS // 8
        out[at : at + ROW_BITS // 8] = row["bitmap"]
    return bytes(out)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (int64, as Spark has them) have their bit set."""
    spot = np.mod(hashes, np.int64(len(bitmap) * 8))
    return (bitmap[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def give_back() -> None:
    """Freed memory goes back to the system: workers live on, and what one operator has freed would count beside the next one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batch of about limit bytes, each with its texts as UTF-8 (null as empty); one part is unpacked at a time."""
    if not batch.num_rows:
        return
    column = batch.column(text).cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    part = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, end - start), [t or b"" for t in column.slice(start, end - start).to_pylist()]
    give_back()


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return text.lower().split()


class WordHashes(dict):
    """64-bit hashes of words, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def word_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in turn, and where each text's words begin (one more at the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    parts = []
    for i, t in enumerate(texts):
        words = words_of(t)
        starts[i + 1] = starts[i] + len(words)
        parts.append(np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mix(out + hashes[j : j + n] + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & (2**64 - 1)))
    return out
