"""Source divergence audit: how far the word use of each source lies from its language and from its other sources.

Terms are encoded by sorted arrays of kept terms: each task counts the terms of its texts by (lang, source), a row for
each term of a lang; the counts, ranges of terms by lang and UTF-8 order, meet in tasks that settle which terms are kept
and cut them into chunks of one lang. Within a chunk a term's id is its place in the chunk's sorted array (searchsorted
finds it from the place of its rows), and ids in bincount give one dense vector a group. Ids keep UTF-8 order, so the first of equal values is the first by term, and what chunks find can
be merged without looking at the strings of other chunks. All arithmetic is in integers.

No task holds the whole dictionary: state is one chunk, a number for each pair of a lang's sources, and the best terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, small_batches

#: Runs of letters: ASCII letters and all that is not ASCII, as bytes of lower-cased UTF-8.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
#: A chunk ends at so many terms or counts; a task's counts go on at so many. Both change the work only.
CHUNK_TERMS, CHUNK_COUNTS, HELD = 4096, 1 << 19, 800_000
UNIT = 1_000_000_000


def _counted(held: int):
    def rows(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for lang, by_source in counts.items():
            start, sources = lang.encode() + b"\0", pa.array(list(by_source), pa.string())
            found = pa.array([t for n in by_source.values() for t in n], pa.binary()).dictionary_encode()
            of = np.repeat(np.arange(len(by_source), dtype=np.int32), [len(n) for n in by_source.values()])
            count = np.fromiter((x for n in by_source.values() for x in n.values()), np.int64, len(found))
            code, terms = found.indices.to_numpy(), found.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(terms)))])
            for a in range(0, len(terms), 1 << 15):
                part, at = terms[a : a + (1 << 15)], ends[a : a + (1 << 15) + 1]
                own = order[at[0] : at[-1]]
                offsets = pa.array((at - at[0]).astype(np.int32))
                yield pa.record_batch(
                    [
                        pa.array([start + t for t in part], pa.binary()).cast(pa.string()),
                        pa.ListArray.from_arrays(offsets, sources.take(pa.array(of[own]))),
                        pa.ListArray.from_arrays(offsets, pa.array(count[own])),
                        pa.array([docs[lang][t] for t in part], pa.int64()),
                    ],
                    _COUNTS,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, size = {}, {}, 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                n = counts.setdefault(lang, {}).setdefault(source, Counter())
                terms = _TERM.findall(text.lower())
                size -= len(n)
                n.update(terms)
                docs.setdefault(lang, Counter()).update(set(terms))
                size += len(n)
                if size > held:
                    yield from rows(counts, docs)
                    counts, docs, size = {}, {}, 0
        yield from rows(counts, docs)

    return run


_COUNTS = ["key", "sources", "n", "docs"]


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(key, sources, n, docs): occurrences in each source and documents, summed within tasks; nulls count as empty.

    A key is lang, a zero character and term. Terms have no zero, so equal keys have the same lang and term, and the keys
    of a lang come in the order of its terms. (As one column they sort faster: lang alone fills the sort's prefix.)
    """
    view = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return view.mapInArrow(_counted(held), "key string, sources array<string>, n array<long>, docs long")


_CHUNK = "lang string, terms array<string>, sources array<string>, at array<int>, of array<int>, n array<long>, sums array<long>"


def _flat(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Entries of lists one after another, and the number of entries of each list."""
    return column.flatten(), np.diff(column.offsets.to_numpy())


def _chunk(lang: str, table: pa.Table, starts: np.ndarray, kept: list[str]) -> pa.RecordBatch:
    """One chunk as a row: sorted kept terms, the first row of each in starts, its sources, and counts by (term id, source number)."""
    names, size = _flat(table["sources"].combine_chunks())
    source, n = names.dictionary_encode(), _flat(table["n"].combine_chunks())[0].to_numpy()
    ids = np.repeat(np.searchsorted(starts, np.arange(len(table)), "right") - 1, size)
    of, width = source.indices.to_numpy(), len(source.dictionary)
    cells = np.bincount(ids * width + of, n, len(kept) * width).astype(np.int64)
    used = np.flatnonzero(cells)
    row = ([lang], [kept], [source.dictionary.to_pylist()], [(used // width).astype(np.int32)], [(used % width).astype(np.int32)], [cells[used]], [np.bincount(of, n, width).astype(np.int64)])
    types = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(v, t) for v, t in zip(row, types)], [c.split()[0] for c in _CHUNK.split(", ")])


def _summed(table: pa.Table) -> pa.Table:
    """Rows of one term as one row with counts summed by source, so a term that many tasks know stays small."""
    names, n = (_flat(table[c].combine_chunks())[0] for c in ("sources", "n"))
    out = pa.table({"source": names, "n": n}).group_by("source", use_threads=False).aggregate([("n", "sum")])
    row = [[table["key"][0].as_py()], [out["source"].to_pylist()], [out["n_sum"].to_pylist()], [pc.sum(table["docs"]).as_py()]]
    return pa.table([pa.array(v, f.type) for v, f in zip(row, table.schema)], schema=table.schema)


def _chunked(least: int, chunk_terms: int, chunk_counts: int):
    def chunks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole terms, sorted by key; table isn't empty."""
        table = table.combine_chunks()
        key = table["key"].combine_chunks()
        new = np.ones(len(key), bool)
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        keep = np.add.reduceat(table["docs"].to_numpy(), starts) >= least
        rows = np.diff(np.append(starts, len(key)))
        table = table.filter(pa.array(np.repeat(keep, rows)))
        kept = [k.rsplit("\0", 1) for k in key.take(pa.array(starts[keep])).to_pylist()]
        # Rows and counts up to each kept term.
        first = np.concatenate([[0], np.cumsum(rows[keep])])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(table["n"]).to_numpy())])[first]
        a = 0
        while a < len(kept):
            most = np.searchsorted(ends, ends[a] + chunk_counts, "right") - 1
            b = min(max(int(most), a + 1), a + chunk_terms, len(kept))
            b = next((k for k in range(a, b) if kept[k][0] != kept[a][0]), b)
            low, high = int(first[a]), int(first[b])
            yield _chunk(kept[a][0], table.slice(low, high - low), first[a:b] - low, [t for _, t in kept[a:b]])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += len(batch["n"].flatten())
            if size < chunk_counts:
                continue
            table = pa.concat_tables(held).combine_chunks()
            # The last term may go on in the next batch.
            last = pc.equal(table["key"], table["key"][-1])
            whole, rest = table.filter(pc.invert(last)), _summed(table.filter(last))
            if whole.num_rows:
                yield from chunks(whole)
            held, size = [rest], len(rest["n"].combine_chunks().flatten())
        if held:
            yield from chunks(pa.concat_tables(held))

    return run


def kept_chunks(counts: DataFrame, least_docs: int = 3, chunk_terms: int = CHUNK_TERMS, chunk_counts: int = CHUNK_COUNTS) -> DataFrame:
    """Chunks of the terms that at least least_docs documents of a lang have; each range of terms is one task's."""
    ranged = counts.repartitionByRange("key").sortWithinPartitions("key")
    return ranged.mapInArrow(_chunked(least_docs, chunk_terms, chunk_counts), _CHUNK)


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) by long division in base 1000: exact for totals below 9e15."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compared(top: int):
    """Chunks joined with their lang's groups: sums for pairs of sources, and the terms that may rank among the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "value"]
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        best: dict[tuple[str, str], list[tuple[int, str]]] = {}
        for batch in batches:
            for row in pa.Table.from_batches([batch]).to_pylist():
                lang, groups, terms = row["lang"], row["groups"], row["terms"]
                number = {g: i for i, g in enumerate(groups)}
                of = np.array([number[s] for s in row["sources"]])[np.array(row["of"], np.int64)]
                at, n = np.array(row["at"], np.int64), np.array(row["n"], np.int64)
                length, v = len(terms), row["v"]
                count = np.bincount(of * length + at, n, len(groups) * length).astype(np.int64).reshape(len(groups), length)
                totals = np.array(row["totals"], np.int64)
                p = share(count, (totals + v)[:, None])
                q = share(count.sum(0), int(totals.sum()) + v)
                _, sums = pairs.setdefault(lang, (groups, np.zeros((len(groups), len(groups)), np.int64)))
                for g in range(len(groups)):
                    sums[g] += _gap(p[g], p).sum(1)
                    own = np.flatnonzero((count[g] > 0) & (p[g] > q))
                    value = _gap(p[g][own], q[own])
                    # Ids are in UTF-8 order, and the sort is stable: ties stay in the order of terms.
                    first = np.argsort(-value, kind="stable")[:top]
                    if len(first):
                        held = best.setdefault((lang, groups[g]), [])
                        held += [(-int(value[i]), terms[own[i]]) for i in first]
                        held.sort()
                        del held[top:]
        for lang, (groups, sums) in pairs.items():
            for g, source in enumerate(groups):
                k = len(groups)
                yield pa.record_batch([pa.array([lang] * k), pa.array([source] * k), pa.array(["pair"] * k), pa.array(groups), pa.array(sums[g])], names)
        for (lang, source), held in best.items():
            k = len(held)
            yield pa.record_batch([pa.array([lang] * k), pa.array([source] * k), pa.array(["term"] * k), pa.array([t for _, t in held]), pa.array([-x for x, _ in held], pa.int64())], names)

    return run


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the groups of documents by (lang, source) apart.

    Terms are runs of letters, A-Z lower-cased; a lang keeps those in at least least_docs of its rows. p of a term is
    1 + floor(10 ** 9 * (count + 1) / (all counts + number of kept terms)); p against q gives floor((p - q) ** 2 / q).
    Part `pair`: for every other source of the lang that sum over all kept terms (0 without any), q being the other's.
    Part `term`: terms of the group with p over its lang's q, the first `top`. Ranks go by value, then item in UTF-8 order.

    Needs text, lang and source; nulls count as '', other columns are ignored, repeated rows count as often as they
    stand. An empty table gives an empty result, a lang with one source no pairs.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        counts = cut(term_counts(docs), "terms")
        chunks = cut(kept_chunks(counts, least_docs), "chunks")
        release(counts)
        groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", "s.sources").agg(F.sum("s.sums").alias("total")).withColumnRenamed("sources", "source")
        groups = cut(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]), "groups")
        kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
        by_lang = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g")).join(kept, "lang").select("lang", F.col("g.source").alias("groups"), F.col("g.total").alias("totals"), "v")
    with small_batches(spark, 8):
        found = cut(chunks.join(by_lang, "lang").mapInArrow(_compared(top), "lang string, source string, part string, item string, value long"), "found")
    release(chunks)
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source != item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(terms)


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang)
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n,
             1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p FROM grid WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= 200
"""
