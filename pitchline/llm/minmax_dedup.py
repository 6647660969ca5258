"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a
signature of 2p values costs p hash evaluations a shingle and estimates the Jaccard similarity without bias.
Values are banded; documents that share a band are candidates and every link is confirmed on full sets.

Plan
1. One pass over the texts writes a slim table: id, set size, 128-bit set key, band keys.
2. Documents with equal sets fold into the smallest id (partially aggregated, so thousands of copies are cheap).
3. In each band bucket all members are compared with the bucket's leader only, its most connected member; the
   confirmed links give components.
4. Documents of buckets that still hold several components are joined exactly across components by prefix and
   position filters: shingles are ordered from rare to common, a link's first common shingle must come early in
   both sets, and a document with many shingles of its own can't link at all. So every link that the bands
   propose is confirmed, refuted by its bound, or lies within a component, without listing a group's pairs.
5. Components of the confirmed links, joined back by set key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_declared, as_strings, base_view, components, cut, kept, mix, shingles, small_batches, text_chunks

#: 20 bands of two permutations (four values): a pair at similarity 0.85 shares no band with probability 4e-7.
BANDS = 20
PERMS_PER_BAND = 2
#: Bits of the map of documents whose sets are needed: 8 MB.
BITMAP_BITS = 1 << 26


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)


def min_max_signature(flat: np.ndarray, off: np.ndarray, perms: int) -> np.ndarray:
    """(rows, 2 * perms): minimum and maximum of each permutation over every row of hashes; rows must not be empty."""
    mul, add = _permutations(perms)
    out = np.empty((len(off) - 1, 2 * perms), np.uint64)
    step = np.empty_like(flat)
    for p in range(perms):
        np.multiply(flat, mul[p], out=step)
        step += add[p]
        step ^= step >> np.uint64(32)
        out[:, 2 * p] = np.minimum.reduceat(step, off[:-1])
        out[:, 2 * p + 1] = np.maximum.reduceat(step, off[:-1])
    return out


def _node(own: np.ndarray) -> np.uint64:
    """64-bit key of a set of hashes; equal sets are one node of the link graph."""
    return mix(mix(own).sum(keepdims=True) + mix(own.sum(keepdims=True)))[0]


def _signatures(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = as_strings(batch["text"]), batch["doc_id"]
            for a, b in text_chunks(texts):
                flat, off = shingles(Words(texts.slice(a, b - a)), k)
                size = np.zeros(b - a, np.int64)
                node = np.zeros(b - a, np.uint64)
                for r in np.flatnonzero(np.diff(off)):
                    own = np.unique(flat[off[r] : off[r + 1]])
                    size[r], node[r] = len(own), _node(own)
                full = np.flatnonzero(size)
                values = np.zeros((b - a, bands), np.uint64)
                if len(full):
                    sig = min_max_signature(flat, off[np.concatenate([full, [b - a]])], bands * PERMS_PER_BAND)
                    sig = sig.reshape(len(full), bands, 2 * PERMS_PER_BAND)
                    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands)).copy()
                    for j in range(2 * PERMS_PER_BAND):
                        total = mix(total + sig[:, :, j])
                    values[full] = total
                yield pa.record_batch(
                    [
                        ids.slice(a, b - a),
                        pa.array(size),
                        pa.array(node.view(np.int64), mask=size == 0),
                        pa.ListArray.from_arrays(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32), pa.array(values.view(np.int64).ravel())),
                    ],
                    ["doc_id", "n_shingles", "node", "bands"],
                )

    return run


def _sets(k: int, bitmap: Broadcast | None):
    """(node, hashes) of texts whose bit is set in the bitmap, all without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap is not None:
                bit = batch["bit"].to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array((bitmap.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))
            texts = as_strings(batch["text"])
            for a, b in text_chunks(texts):
                flat, off = shingles(Words(texts.slice(a, b - a)), k)
                rows = [np.unique(flat[off[r] : off[r + 1]]) for r in np.flatnonzero(np.diff(off))]
                if not rows:
                    continue
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                yield pa.record_batch([pa.array(np.array([_node(x) for x in rows]).view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows).view(np.int64)))], ["node", "hashes"])

    return run


def _hashed(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, hashes) of the wanted (node, doc_id).

    Texts needn't be shuffled for it: a bitmap of hashed ids, of fixed size whatever the data, tells each task
    which texts to shingle; what it lets through by chance goes in the join with the wanted nodes. Past the
    number of ids that it can tell apart, texts are shuffled to the ids instead.
    """
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    if wanted.count() <= BITMAP_BITS // 4:
        packed = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toPandas()
        bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
        bitmap[packed["word"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64).view(np.uint64)
        found = docs.where("doc_id is not null").select("text", bit.alias("bit")).mapInArrow(_sets(k, spark.sparkContext.broadcast(bitmap)), "node long, hashes array<long>")
    else:
        found = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(k, None), "node long, hashes array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _confirmed(percent: int):
    """Pairs whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["hashes_a"], batch["hashes_b"]
            x, y = left.values.to_numpy(), right.values.to_numpy()
            xo, yo = left.offsets.to_numpy(), right.offsets.to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                both = np.concatenate([x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(both) - common)
            keep = pa.array(ok)
            yield pa.record_batch([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    return run


def _verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the full shingle sets of both."""
    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    rows = rows.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a")
    return rows.select("a", "b", "hashes_a", "hashes_b").mapInArrow(_confirmed(percent), "a long, b long")


def _across(sets: DataFrame, rooted: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (node, root) with different roots that may link: exact, by prefixes and positions."""
    tokens = sets.join(rooted, "node", "left_semi").select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed = tokens.join(common, "token").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    alone = F.col("size") - F.size("shared")
    prefix = F.floor(F.col("size") * F.lit(100 - percent) / F.lit(100)).cast("int") + 1
    early = listed.withColumn("alone", alone).select("node", "size", "alone", F.posexplode(F.slice("shared", F.lit(1), F.greatest(prefix - F.col("alone"), F.lit(0)))).alias("at", "e")).join(rooted, "node")
    early = cut(early.select("node", "root", "size", (F.col("alone") + F.col("at")).alias("at"), F.col("e.token").alias("token")), "prefixes")
    x, y = early.alias("x"), early.alias("y")
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    may = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & (F.lit(100 + percent) * rest >= F.lit(percent) * (F.col("x.size") + F.col("y.size")))
    return x.join(y, may).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, n_shingles, component_id, kept; one row per input row.

    Needs columns doc_id and text; others are ignored. Sets are distinct runs of k words after lower-casing
    A-Z; a text with fewer words is one run. Texts without words (or null) have size 0 and are linked with
    nothing. Links hold between texts: repeated rows and equal texts share a class, and rows that share a
    doc_id each get the class of their own text. A row whose doc_id is null belongs to no class: its
    component_id is null and it is kept. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _classes(base_view(docs), k, percent, bands)


def _classes(docs: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    slim = kept(docs.mapInArrow(_signatures(k, bands), "doc_id long, n_shingles long, node long, bands array<long>"))
    full = slim.where("node is not null and doc_id is not null")
    sets = full.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"))
    members = full.select("node", F.explode("bands").alias("band")).distinct()
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(members.join(buckets, "band"), "buckets")
    weights = cut(shared.groupBy("node").agg(F.sum("n").alias("weight")).join(sets, "node"), "weights")
    # Small tables that rows of hot buckets and nodes are joined with are written: such joins stay splittable.
    leaders = cut(shared.join(weights, "node").groupBy("band").agg(F.max_by("node", F.struct("weight", "rep")).alias("leader")), "leaders")
    hashed = cut(_hashed(docs, weights.select("node", F.col("rep").alias("doc_id")), k), "sets")

    to_leader = shared.join(leaders, "band").where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    roots = components(_verify(hashed, to_leader, percent))

    rooted = shared.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    mixed = cut(mixed, "mixed")
    open_ = cut(rooted.join(mixed, "band", "left_semi").select("node", "root").distinct(), "open")
    if not open_.isEmpty():
        more = cut(_verify(hashed, _across(hashed, open_, percent), percent), "more")
        if not more.isEmpty():
            roots = components(roots.union(more))

    of_root = roots.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b").distinct())
    smallest = of_root.join(sets, "node").groupBy("root").agg(F.min("rep").alias("component"))
    classes = of_root.join(smallest, "root").select("node", "component")
    classes = sets.join(classes, "node", "left").where("component is not null or most != rep").select("node", F.coalesce("component", "rep").alias("component"))
    classes = cut(classes, "classes")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = slim.join(classes, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each near-duplicate class is kept; columns as in docs.

    Where ids repeat or are null they don't name a row: then the rows are numbered and written first, and of each class
    one row stays, whatever its id. Rows without words are in no class, so all of them stay.
    """
    odd = base_view(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if not odd.isEmpty():
        rows = cut(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("text"), F.monotonically_increasing_id().alias("doc_id")), "rows")
        gone = near_duplicates(rows, k, percent).where("not kept").select(F.col("doc_id").alias("__gone"))
        stay = rows.join(gone, rows["doc_id"] == gone["__gone"], "left_anti").select("__row.*")
        return as_declared(stay, docs)
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti").select(*docs.columns)


#: For three words and a similarity of 85 percent, as the query has it: exact sets, all pairs that share a shingle, closure.
NEAR_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS own FROM d),
classes AS (SELECT list_sort(own) AS own, min(doc_id) AS rep, len(own) AS n FROM s WHERE len(own) > 0 GROUP BY list_sort(own), len(own)),
t AS (SELECT rep, n, unnest(own) AS shingle FROM classes),
pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS common
          FROM t a JOIN t b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (m + n - common)),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT s.doc_id, len(s.own)::BIGINT AS n_shingles, coalesce(root, s.doc_id) AS component_id, coalesce(root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN classes ON list_sort(s.own) = classes.own LEFT JOIN roots ON roots.a = classes.rep
"""
