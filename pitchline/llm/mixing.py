"""Mixing sources to target weights by entropy balancing.

Among all document rates w in (0, 2] whose tokens meet each source's target, entropy balancing takes those
closest to 1 in relative entropy. The dual has one multiplier for each source: w = min(2, exp(m * size / mean
size)). It is convex and solved by Newton steps, safeguarded by a bracket; each step is one aggregation over
the profile (source, size, count), which is all that the dual needs.

Rates become copies by a threshold: the whole part of the rate, and one more where hash - fraction falls below
a cut-off of the source. Histograms narrow the cut-off until few documents are in question; of those, the ones
taken bring the source's tokens closest to its target.

What is known of each source (target, multiplier, cut-off, documents chosen singly) is a row of a DataFrame, so
there may be as many sources as hosts; the driver sees only counts and the unit of the targets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_declared, cut, release

#: A document is repeated at most so often.
MOST = 2.0
#: Documents of a source among which the last tokens are chosen one by one.
LAST_DOCUMENTS = 400
#: Bits of a document's random number, of its place (number less fraction), and of the bins of one histogram.
CHANCE_BITS, PLACE_BITS, BIN_BITS = 53, 54, 8
#: Rows of sources that are broadcast count as so many bytes and eight for each document chosen singly; past the limit Spark chooses the join.
SOURCE_BYTES, BROADCAST_BYTES = 200, 8 << 20
#: Copies of one row that a task lists at a time.
RANKS = 4096


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a hash of id and text of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"))


def _chance(h: Column, rank: Column) -> Column:
    """A whole number below 2 ** CHANCE_BITS from the row's hash and its rank among equal rows, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(h, rank.cast("long")), 64 - CHANCE_BITS)


def _rate(size: Column) -> Column:
    return F.least(F.lit(MOST), F.exp(F.least(F.lit(40.0), F.col("multiplier") * size / F.col("mean"))))


def _place(u: Column, rate: Column) -> Column:
    """The place that the cut-off is compared with: below 2 ** PLACE_BITS, and lower for a larger fraction of the rate."""
    return u - F.floor((rate - F.floor(rate)) * F.lit(2.0**CHANCE_BITS)).cast("long") + F.lit(1 << CHANCE_BITS)


def _ranked_sources(sized: DataFrame) -> DataFrame:
    """(sid, name, source_size, n): sources numbered by code point, null last, by a distributed sort."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(sums.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "sources")
    part, at = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    # One row for each partition of the sort.
    before = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"))
    before = before.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    return rows.join(F.broadcast(before), part == F.col("part")).select((at + F.col("before")).alias("sid"), F.col("source").alias("name"), "source_size", "n")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = MOST) -> DataFrame:
    """sources (sid, source_size) with target: they weigh `weights` in turn; what exceeds `most` times a size is reshared.

    The unit, tokens for a weight of 1, can only grow from round to round, so it alone says who has reached the bound.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int"))
    sources = sources.withColumn("weight", weight)
    bound, unit, known = F.lit(most) * F.col("source_size"), 0.0, -1
    while True:
        over = F.lit(unit) * F.col("weight") > bound
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, bound).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()
        if row["n"] == known or not row["free"]:
            break
        known, unit = row["n"], (share * row["all"] - row["capped"]) / row["free"]
    return sources.withColumn("target", F.when(F.lit(unit) * F.col("weight") > bound, bound).otherwise(F.lit(unit) * F.col("weight"))).drop("weight")


def _small(sources: DataFrame, rows: int, chosen: int = 0) -> DataFrame:
    return F.broadcast(sources) if SOURCE_BYTES * rows + 8 * chosen <= BROADCAST_BYTES else sources


def _balanced(profile: DataFrame, sources: DataFrame, rows: int, tolerance: float = 1e-7, steps: int = 60) -> DataFrame:
    """sources with multiplier, by Newton steps on the dual, all at once; a step that leaves its bracket is halved into it."""
    size, inf = F.col("source_size"), float("inf")
    loose = (F.col("target") > 0) & (F.col("target") < F.lit(MOST * (1 - 1e-12)) * size)
    start = {"open": loose, "multiplier": F.when(loose | (size == 0), 0.0).otherwise(1e12), "low": F.lit(-inf), "high": F.lit(inf)}
    now = cut(sources.withColumns(start), "multipliers")
    m, gap = F.col("multiplier"), F.col("target") - F.col("tokens")
    low, high = F.when(gap > 0, m).otherwise(F.col("low")), F.when(gap > 0, F.col("high")).otherwise(m)
    finite = (F.col("low") > -inf) & (F.col("high") < inf)
    newton = F.when(F.col("slope") > 0, m + gap / F.col("slope")).otherwise(F.lit(inf))
    inside = (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - m) <= 2 + F.abs(m))
    step = F.when(inside, newton).when(finite, (F.col("low") + F.col("high")) / 2).otherwise(m + F.signum(gap) * (1 + F.abs(m)))
    for _ in range(steps):
        if now.where("open").isEmpty():
            break
        rated = profile.join(_small(now.where("open").select("sid", "multiplier", "mean"), rows), "sid").withColumn("rate", _rate(F.col("size")))
        tokens = F.col("n") * F.col("size") * F.col("rate")
        sums = rated.groupBy("sid").agg(F.sum(tokens).alias("tokens"), F.sum(F.when(F.col("rate") < MOST, tokens * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        next_ = now.join(sums, "sid", "left").withColumn("open", F.col("open") & (F.abs(gap) > F.lit(tolerance) * F.col("target")))
        next_ = next_.withColumns({"low": F.when(F.col("open"), low).otherwise(F.col("low")), "high": F.when(F.col("open"), high).otherwise(F.col("high"))})
        was, now = now, cut(next_.withColumn("multiplier", F.when(F.col("open"), step).otherwise(m)).select(*now.columns), "multipliers")
        release(was)
    return now.drop("open", "low", "high")


def _rounded(points: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """sources with cut-offs: places below `low` are taken, of those from low to `high` the numbers `chosen`.

    points: (sid, size, n, h) of rows, n the number of equal ones, each of which has a number of its own.
    """
    rank = points.where("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RANKS}"))))
    rank = rank.withColumn("rank", F.explode(F.sequence(F.col("block") * RANKS, F.least(F.col("n"), (F.col("block") + 1) * RANKS) - 1)))
    rated = rank.join(_small(sources.select("sid", "multiplier", "mean"), rows), "sid").withColumn("rate", _rate(F.col("size"))).withColumn("u", _chance(F.col("h"), F.col("rank")))
    rated = cut(rated.select("sid", "size", "u", F.floor("rate").alias("whole"), (F.col("rate") > F.floor("rate")).alias("loose"), _place(F.col("u"), F.col("rate")).alias("v")), "rated")
    sure = rated.groupBy("sid").agg(F.sum(F.col("whole") * F.col("size")).alias("below"))
    now = sources.join(sure, "sid", "left").select("sid", "target", F.coalesce("below", F.lit(0)).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    now = cut(now, "cut-offs")
    shift = PLACE_BITS
    while shift > 0 and not now.where("open").isEmpty():
        was, before, shift = now, shift, max(shift - BIN_BITS, 0)
        asked = _small(now.where("open").select("sid", "prefix", "target", "below"), rows)
        bins = rated.where("loose").join(asked, "sid").where(F.shiftright("v", before) == F.col("prefix"))
        bins = bins.groupBy("sid", "prefix", "target", "below", F.shiftright("v", shift).alias("bin")).agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
        # At most 2 ** BIN_BITS rows a source from here on.
        own = Window.partitionBy("sid")
        bins = bins.withColumn("upto", F.sum("tokens").over(own.orderBy("bin")))
        crossing = F.when(F.col("below") + F.col("upto") > F.col("target"), F.col("bin"))
        bins = bins.withColumn("at", F.coalesce(F.min(crossing).over(own), F.max("bin").over(own)))
        # Neighbours on both sides come along while few documents are in them, so that the last choice has some variety.
        bins = bins.withColumn("near", F.sum("n").over(own.orderBy(F.abs(F.col("bin") - F.col("at"))).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        few = (F.col("near") <= LAST_DOCUMENTS) | (F.lit(shift) == 0) & (F.col("bin") == F.col("at"))
        bins = bins.withColumn("first", F.coalesce(F.min(F.when(few, F.col("bin"))).over(own), F.col("at")))
        found = bins.groupBy("sid").agg(
            F.first("at").alias("at"), F.first("first").alias("first"), F.max(F.when(few, F.col("bin"))).alias("last"),
            F.coalesce(F.sum(F.when(F.col("bin") < F.col("first"), F.col("tokens"))), F.lit(0)).alias("less"),
        )
        now = now.join(found, "sid", "left")
        settled = F.col("last").isNotNull() | F.col("at").isNull()
        # Beyond `less` tokens the next histogram is that of the bin in which the target lies.
        now = now.select(
            "sid", "target", (F.col("below") + F.when(F.col("open"), F.coalesce("less", F.lit(0))).otherwise(0)).alias("below"),
            F.when(F.col("open"), F.coalesce("at", "prefix")).otherwise(F.col("prefix")).alias("prefix"), (F.col("open") & ~settled).alias("open"),
            *[F.when(F.col("last").isNotNull(), value).otherwise(F.col(name)).alias(name) for name, value in (("low", F.shiftleft("first", shift)), ("high", F.shiftleft(F.col("last") + 1, shift)))],
        )
        now = cut(now, "cut-offs")
        release(was)
    last = rated.where("loose").join(_small(now.select("sid", "low", "high", "target", "below"), rows), "sid").where("v >= low and v < high")
    # At most LAST_DOCUMENTS a source.
    last = last.groupBy("sid", (F.col("target") - F.col("below")).alias("left")).agg(F.sort_array(F.collect_list(F.struct("v", "u", "size"))).alias("documents"))
    chosen = last.mapInArrow(_chosen, "sid long, chosen array<long>")
    out = sources.join(now.select("sid", "low", "high"), "sid").join(chosen, "sid", "left")
    out = cut(out.select(*sources.columns, "low", "high", F.coalesce("chosen", F.array().cast("array<long>")).alias("chosen")), "mix")
    release(rated, now)
    return out


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, left = batch["documents"], batch["left"].to_pylist()
        documents = list(zip(*(lists.values.field(k).to_pylist() for k in ("v", "u", "size"))))
        ends = lists.offsets.to_pylist()
        yield pa.record_batch([batch["sid"], pa.array([_closest(documents[a:b], tokens) for a, b, tokens in zip(ends, ends[1:], left)], pa.list_(pa.int64()))], ["sid", "chosen"])


def _closest(documents: list[tuple[int, int, int]], tokens: float) -> list[int]:
    """Of documents (v, u, size), in order, the u of those whose sizes come near to `tokens`: a run first, then single exchanges."""
    taken, left, total = [], [], 0
    for d in documents:
        if total + d[2] <= tokens:
            taken.append(d)
            total += d[2]
        else:
            left.append(d)
    for _ in range(50):
        gap = tokens - total
        sizes = sorted((d[2], j) for j, d in enumerate(left))
        keys = [s for s, _ in sizes]
        best = (abs(gap), None, None)
        for i, out in [(None, 0), *((i, d[2]) for i, d in enumerate(taken))]:
            at = bisect_left(keys, gap + out)
            for k in (at - 1, at):
                if 0 <= k < len(keys) and abs(gap + out - keys[k]) < best[0]:
                    best = (abs(gap + out - keys[k]), i, sizes[k][1])
        if best[2] is None:
            break
        come = left.pop(best[2])
        if best[1] is not None:
            left.append(taken.pop(best[1]))
        taken.append(come)
        total = sum(d[2] for d in taken)
    return [d[1] for d in taken]


def _plan(sized: DataFrame, weights: tuple[int, ...], share: float) -> tuple[DataFrame, DataFrame]:
    """(sources, repeats): each source's row, and the (h, source) of rows that agree in id and text, both written."""
    sources = cut(with_targets(_ranked_sources(sized), weights, share).withColumn("mean", F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0))).drop("n"), "targets")
    rows = sources.count()
    names = _small(sources.select("sid", "name"), rows)
    points = sized.join(names, sized["source"].eqNullSafe(names["name"])).groupBy("sid", "name", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    points = cut(points, "points")
    profile = cut(points.groupBy("sid", "size").agg(F.sum("n").alias("n")), "profile")
    out = _rounded(points.drop("name"), _balanced(profile, sources, rows), rows)
    repeats = cut(points.where("n > 1").select("h", F.col("name").alias("source")), "repeats")
    release(profile, points)
    return out, repeats


def _ranked(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """rows (with source and h) with rank: 0, 1, ... among rows that agree in id, text and source.

    Rows that have no equal are left where they are. Equal ones are numbered within the partition they come from, and
    the partitions' counts add up, so a hot group of copies is spread over tasks.
    """
    none = F.lit(0).cast("long")
    if repeats.isEmpty():
        return rows.withColumn("rank", none)
    same = (rows["h"] == repeats["h"]) & rows["source"].eqNullSafe(repeats["source"])
    equal = cut(rows.join(repeats, same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "equal").withColumn("part", F.shiftright("row", 33))
    counts = equal.groupBy("h", "source", "part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select(F.col("h").alias("h_"), F.col("source").alias("source_"), F.col("part").alias("part_"), (F.sum("k").over(Window.partitionBy("h", "source").orderBy("part")) - F.col("k")).alias("before"))
    at = F.row_number().over(Window.partitionBy("h", "source", "part").orderBy("row")) - 1
    found = equal.join(before, (F.col("h") == F.col("h_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("part") == F.col("part_"))).withColumn("rank", at + F.col("before"))
    return rows.join(repeats, same, "left_anti").withColumn("rank", none).unionByName(found.select(*rows.columns, "rank"))


def _with_copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (with source, size, h, rank) with source_size, target, rate and copies."""
    total = sources.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("chosen")).alias("chosen")).first()
    out = rows.join(_small(sources, total["n"], total["chosen"] or 0), rows["source"].eqNullSafe(sources["name"])).withColumn("rate", _rate(F.col("size"))).withColumn("u", _chance(F.col("h"), F.col("rank")))
    out = out.withColumn("v", _place(F.col("u"), F.col("rate")))
    loose = (F.col("rate") > F.floor("rate")) & (F.col("size") > 0)
    more = loose & ((F.col("v") < F.col("low")) | ((F.col("v") < F.col("high")) & F.array_contains("chosen", F.col("u"))))
    return out.withColumn("copies", (F.floor("rate") + F.when(more, 1).otherwise(0)).cast("long"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, rate, copies.

    Needs columns doc_id, text and source; others are ignored. A null text has size 0, a null source is a
    source of its own, after all others. Rows that agree in id, text and source are documents of their own, each with
    a random number of its own, so any share of them may be taken; which of them is which makes no difference.
    Documents of size 0 are taken once and add nothing. An empty table gives an empty result.
    """
    sized = cut(_sized(docs), "sized")
    sources, repeats = _plan(sized, weights, share)
    out = _with_copies(_ranked(sized, repeats), sources)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, with the columns of docs.

    The sources' rows are joined to the texts, by broadcast while they are small. Only texts of rows that agree in id,
    text and source are shuffled. Nulls, repeats and an empty table as in `mix_report`.
    """
    sized = cut(_sized(docs), "sized")
    sources, repeats = _plan(sized, weights, share)
    release(sized)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    text = F.coalesce(F.col("__row.text").cast("string"), F.lit(""))
    rows = own.select("__row", F.col("__row.source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col("__row.doc_id").cast("long"), text).alias("h"))
    copies = _with_copies(_ranked(rows, repeats), sources).where("copies > 0")
    taken = copies.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")
    return as_declared(taken, docs)
