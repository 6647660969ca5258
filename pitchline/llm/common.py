"""Helpers shared by the corpus operators: lineage cuts, chunking, hashing of words and shingles.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, so the same rule works on UTF-8 bytes as on
code points. All hashing is vectorised over a chunk of texts; only per-document set work loops in Python.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words as a Java character class and as a regular expression for words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; longer documents form a chunk of their own.
CHUNK_BYTES = 1 << 20

#: One salt for each place in a run of words.
_SALT = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts that driver and executors share: the cluster's, or on one machine, as in tests, our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="pitchline-")
        shared_dir.own = place
    return place.rstrip("/")


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside; afterwards they are as before."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: recovery restarts from these files.

    Files get the advisory size, so a small table is a few files and not one for each core.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def as_declared(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the schema of `like`: a file forgets which columns are never null."""
    return df if df.schema == like.schema else df.mapInArrow(lambda batches: batches, like.schema)


def kept(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks: for slim results of one pass over texts, of which a lost part is made again from its own texts."""
    return df.persist(StorageLevel.DISK_ONLY)


def release(*frames: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in frames:
        path = getattr(df, "cut_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """Arrow batches of at most so many rows and about so many bytes for the jobs run inside, so long texts take little memory at a time."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_view(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as string and the named further columns; whatever else docs has stays out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free fingerprint of them, by one aggregation."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of edges (a, b): one row (a, b) per node that isn't its component's smallest id, b that id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until nothing changes. Each step
    is a partially aggregated minimum and a join that AQE may split, so a hub's links needn't share a task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), name)
    before = checksum(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        after = cut(small, name)
        release(now)
        now, was, before = after, before, checksum(after)
        if was == before:
            break
    return now


# --- vectorised text work, used inside Arrow tasks ---------------------------------------------------------


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def as_strings(column: pa.Array) -> pa.Array:
    """The column as strings with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts one after another and the offsets of each text in them."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a chunk of texts: byte range [lo, hi) of each, first[r]:first[r+1] the words of row r, 64-bit hashes."""

    def __init__(self, texts: pa.Array, fold: bool = True, hashes: bool = True, spaces: np.ndarray = _SPACES):
        self.buf, off = raw_bytes(texts)
        buf, n = self.buf, len(self.buf)
        word = ~spaces[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        start = word.copy()
        if n:
            before[0] = False
            before[1:] = word[:-1]
            start &= ~before | edge[:-1]
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = word[1:]
            stop = word & (~after | edge[1:])
            self.lo, self.hi = np.flatnonzero(start), np.flatnonzero(stop) + 1
        else:
            self.lo = self.hi = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.lo, off).astype(np.int64)
        self.off = off
        if hashes:
            self.hash = self._hash(fold)

    def _hash(self, fold: bool) -> np.ndarray:
        n = len(self.buf)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[self.buf] * up[:n], out=total[1:])
        return mix((total[self.hi] - total[self.lo]) * down[self.lo])


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, row by row, and the offsets of each row; fewer words than k count as one run."""
    n, h = np.diff(w.first), w.hash
    total = np.zeros(len(h), np.uint64)
    for j in range(k):
        total[: len(h) - j] += mix(h[j:] + _SALT[j])
    total += np.uint64(k)
    keep = np.ones(len(h), bool)
    last = w.first[1:][n >= k]
    for j in range(1, k):
        keep[last - j] = False
    for r in np.flatnonzero((n > 0) & (n < k)):
        a, b = w.first[r], w.first[r + 1]
        total[a] = mix(h[a:b] + _SALT[: b - a]).sum() + np.uint64(b - a)
        keep[a + 1 : b] = False
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    return mix(total)[keep] if len(h) else total, np.concatenate([[0], np.cumsum(counts)])
