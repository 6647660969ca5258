"""Exact order statistics of many columns at once, by counting.

A pass counts how many values of each column fall into each of a fixed number of equal slices of its range, with the
least and greatest value of each slice. The slice that holds the wanted rank is the next pass's range, until it holds one
value only. State is columns times slices, whatever the number of rows and of distinct values; a sort or a map of all
values would be neither.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices of a range: each pass narrows it by as much, or to single values.
SLICES = 2048


@dataclass
class _Wanted:
    """A rank (from 0) among the values of a column from low to high."""

    column: str
    rank: int
    low: float
    high: float

    @property
    def done(self) -> bool:
        return self.low == self.high


def _known(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _slice(value: Column, low: float, high: float, slices: int) -> Column:
    """The slice of value: it grows with the value, whatever rounding does. Ranges wider than a double are halved."""
    part = 1.0 if math.isfinite(high - low) else 0.5
    at = (value * part - F.lit(low * part)) / F.lit(high * part - low * part) * slices
    return F.least(F.floor(at), F.lit(slices - 1)).cast("int")


def order_statistics(df: DataFrame, wanted: dict[str, list[float]], slices: int = SLICES) -> dict[str, list[float | None]]:
    """For each column its quantiles at the given shares, exactly: between two values in proportion, None without values.

    Nulls and NaN are missing; infinite values aren't allowed. Two to six passes over df, which should be a written table.
    """
    names = list(wanted)
    if not names:
        return {}
    row = df.agg(*[f(_known(c)).alias(f"{k}_{n}") for n, c in enumerate(names) for k, f in (("count", F.count), ("low", F.min), ("high", F.max))]).first()
    places = {c: [share * (row[f"count_{n}"] - 1) for share in wanted[c]] for n, c in enumerate(names) if row[f"count_{n}"]}
    targets = {(c, r): _Wanted(c, r, row[f"low_{n}"], row[f"high_{n}"]) for n, c in enumerate(names) for p in places.get(c, []) for r in {int(p), min(int(p) + 1, row[f"count_{n}"] - 1)}}
    if any(t.low == float("-inf") or t.high == float("inf") for t in targets.values()):
        raise ValueError("infinite values have no order statistics here")
    while open_ := [t for t in targets.values() if not t.done]:
        # Ranks of one column that are in the same range share its counts.
        ranges = list(dict.fromkeys((t.column, t.low, t.high) for t in open_))
        parts = [F.when(_known(c).between(low, high), F.struct(F.lit(i).alias("range"), _slice(_known(c), low, high, slices).alias("slice"), _known(c).alias("value"))) for i, (c, low, high) in enumerate(ranges)]
        counted = df.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).groupBy("p.range", "p.slice").agg(F.count(F.lit(1)).alias("n"), F.min("p.value").alias("low"), F.max("p.value").alias("high"))
        found: dict[int, list] = {}
        for r in counted.collect():
            found.setdefault(r["range"], []).append((r["slice"], r["n"], r["low"], r["high"]))
        for t in open_:
            for _, n, low, high in sorted(found[ranges.index((t.column, t.low, t.high))]):
                if t.rank < n:
                    t.low, t.high = low, high
                    break
                t.rank -= n
    out: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in names}
    for c, at in places.items():
        for k, p in enumerate(at):
            a = targets[c, int(p)].low
            out[c][k] = a if p == int(p) else a + (p - int(p)) * (targets[c, int(p) + 1].low - a)
    return out
