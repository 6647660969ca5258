"""Exact duplicates through a cuckoo-filter index of live digests.

A digest is the SHA-256 of the text after lower-casing A-Z. The index holds 16-bit fingerprints in buckets of
four; the full digests lie bucketed beside them. A probe whose fingerprint is found is verified against the
stored digest, so answers are exact; an insertion that finds no room after a bounded number of evictions
doubles the table and reinserts the stored keys. Digests can be deleted again.

Plan: digests are computed on the JVM and written once, slim. Each input partition folds its own copies through
an index (so thousands of copies leave a partition as one row), partial entries are shuffled by digest, and
each partition of digests folds them through an index again. A join by digest, which AQE may split, brings
survivor and size back to every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, base_view, cut, release

#: Digests that one shuffle partition should hold.
KEYS_PER_PARTITION = 200_000
#: An input partition hands its partial entries on when it holds so many digests.
FLUSH_KEYS = 500_000


class CuckooIndex:
    """Map from digests (bytes, evenly spread) to payloads, behind a cuckoo filter."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.stored: list[tuple[bytes, list] | None] = [None] * (buckets * self.SLOTS)
        self.live = self.resizes = self.false_hits = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        """Slot of the digest, or -1: fingerprints first, then the stored digest decides."""
        mark, *buckets = self._places(digest)
        prints = self.prints
        for bucket in buckets:
            at = bucket * 4
            for slot in (at, at + 1, at + 2, at + 3):
                if prints[slot] == mark:
                    if self.stored[slot][0] == digest:
                        return slot
                    self.false_hits += 1
        return -1

    def get(self, digest: bytes) -> list | None:
        slot = self._slot(digest)
        return self.stored[slot][1] if slot >= 0 else None

    def insert(self, digest: bytes, payload: list) -> None:
        """Add a digest that isn't in the index."""
        self.live += 1
        self._place(digest, payload)

    def _place(self, digest: bytes, payload: list) -> None:
        entry, (mark, first, second) = (digest, payload), self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * 4, bucket * 4 + 4):
                if not self.prints[slot]:
                    self.prints[slot], self.stored[slot] = mark, entry
                    return
        bucket = second
        for kick in range(self.KICKS):
            slot = bucket * 4 + kick % 4
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.stored[slot] = self.stored[slot], entry
            bucket = self._other(bucket, mark)
            for slot in range(bucket * 4, bucket * 4 + 4):
                if not self.prints[slot]:
                    self.prints[slot], self.stored[slot] = mark, entry
                    return
        self._resize(entry)

    def _resize(self, homeless: tuple[bytes, list]) -> None:
        kept = [e for e in self.stored if e] + [homeless]
        buckets = 2 * (self.mask + 1)
        self.mask = buckets - 1
        self.prints, self.stored = [0] * (buckets * 4), [None] * (buckets * 4)
        self.resizes += 1
        for digest, payload in kept:
            self._place(digest, payload)

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest; false if it isn't there."""
        slot = self._slot(digest)
        if slot < 0:
            return False
        self.prints[slot], self.stored[slot] = 0, None
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, list]]:
        return (e for e in self.stored if e)


ENTRY = "digest binary, keep_id long, keep_row long, group_size long"


def _batch(rows: list[tuple[bytes, list]]) -> pa.RecordBatch:
    columns = [d for d, _ in rows], [p[0][1] if p[0][0] else None for _, p in rows], [p[0][2] for _, p in rows], [p[1] for _, p in rows]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["digest", "keep_id", "keep_row", "group_size"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(digest, order of the row, size, kind) of each entry; a null id is lower than any other."""
    for batch in batches:
        for digest, doc, row, size, *kind in zip(*(column.to_pylist() for column in batch.columns)):
            yield digest, (doc is not None, doc or 0, row), size, kind


def _fold(most: int | None):
    """Fold entries of equal digests: sizes add up, the largest (id, row) stays. Past `most` digests, those so far are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for digest, order, size, _ in _entries(batches):
            held = index.get(digest)
            if held is None:
                index.insert(digest, [order, size])
                if most and index.live >= most:
                    yield _batch(list(index.items()))
                    index = CuckooIndex()
            else:
                held[0], held[1] = max(held[0], order), held[1] + size
        yield _batch(list(index.items()))

    return run


def digests(docs: DataFrame) -> DataFrame:
    """Slim table of (doc_id, row, digest), one row per document."""
    text = F.coalesce("text", F.lit(""))
    return base_view(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256)).alias("digest"))


def build_index(entries: DataFrame) -> DataFrame:
    """Entries (digest, keep_id, keep_row, group_size) folded to one for each digest."""
    spark = entries.sparkSession
    partial = cut(entries.mapInArrow(_fold(FLUSH_KEYS), ENTRY), "partial")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), partial.count() // KEYS_PER_PARTITION + 1)
    return partial.repartition(parts, "digest").mapInArrow(_fold(None), ENTRY)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Needs columns doc_id and text; others are ignored. A null text counts as empty, and all empty texts are
    equal. The row with the largest doc_id stays; among rows that share it exactly one stays; a null doc_id
    is smaller than any other. An empty table gives an empty result.
    """
    slim = cut(digests(docs), "digests")
    index = build_index(slim.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size")))
    return slim.join(index, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def members(docs: DataFrame) -> DataFrame:
    """Live documents of an index that is maintained: (digest, doc_id, n), n rows of that id and text."""
    return digests(docs).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def _as_entries(live: DataFrame) -> DataFrame:
    """Members as entries; an id occurs once for each digest, so the order of rows never decides."""
    return live.select("digest", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("keep_row"), F.col("n").alias("group_size"))


def index_of(live: DataFrame) -> DataFrame:
    """The index (columns of ENTRY) of a table of members."""
    return build_index(_as_entries(live))


def _renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored entries (kind 0) less the digests that changed (1), and with what those hold now (2)."""
    live = CuckooIndex()
    for digest, order, size, (kind,) in _entries(batches):
        held = live.get(digest)
        if kind == 1:
            live.delete(digest)
        elif held is None:
            live.insert(digest, [order, size])
        else:
            held[0], held[1] = max(held[0], order), held[1] + size
    yield _batch(list(live.items()))


def maintain(index: DataFrame, live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index and its members (see `members`) after documents came and then others went.

    Documents of `deleted` go by doc_id and text; a row of it takes one row away, and one that isn't there does
    nothing. Each partition of digests loads its stored entries into a cuckoo index, deletes those of digests that
    changed, and inserts these again with the survivor and size of the members that stay, so a survivor that goes is
    followed by the next largest id, and a digest without members is gone. Members of other digests aren't read into
    it. Null texts count as empty; a null doc_id is an id of its own, smaller than any other. Empty tables on any side
    change nothing. Both results are written tables.
    """
    count = lambda df, came, went: df.select("digest", "doc_id", *[(F.col("n") if x else F.lit(0).cast("long")).alias(c) for c, x in (("more", came), ("less", went))])
    change = cut(count(members(inserted), True, False).unionByName(count(members(deleted), False, True)), "changes")
    changed = change.select("digest").distinct()
    sums = count(live, True, False).unionByName(change).groupBy("digest", "doc_id").agg((F.sum("more") - F.sum("less")).alias("n"))
    stay = cut(sums.where("n > 0"), "members")
    # Copies fold in their partition before they are shuffled by digest.
    now = _as_entries(stay.join(changed, "digest", "left_semi")).mapInArrow(_fold(FLUSH_KEYS), ENTRY)
    gone = changed.select("digest", *[F.lit(None).cast("long").alias(c) for c in ("keep_id", "keep_row", "group_size")])
    stored = index.select("digest", "keep_id", "keep_row", "group_size")
    every = reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(k)) for k, df in enumerate((stored, gone, now))])
    every = cut(every, "entries")
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), every.count() // KEYS_PER_PARTITION + 1)
    renewed = cut(every.repartition(parts, "digest").sortWithinPartitions("digest", "kind").mapInArrow(_renewed, ENTRY), "index")
    release(change, every)
    return renewed, stay


def keep_largest(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one of each group of equal texts is kept; columns as in docs."""
    found = exact_duplicates(docs)
    repeats = base_view(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if repeats.isEmpty():
        gone = found.where("not kept").select(F.col("doc_id").alias("__gone"))
        return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti").select(*docs.columns)
    # Ids that repeat can't name a row: of rows with one id and one text, any one stands for the kept row.
    sha = F.sha2(ascii_lower(F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("binary"), 256)
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), sha.alias("sha")).dropDuplicates(["id", "sha"])
    stay = found.where("kept").select(F.col("doc_id").alias("keep"), "text_sha256")
    return marked.join(stay, marked["id"].eqNullSafe(stay["keep"]) & (marked["sha"] == stay["text_sha256"]), "left_semi").select("row.*")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW w AS (PARTITION BY t)
"""
