"""Typed requests for predictions: JSON texts become fixtures or refusals, and a counter of what was predicted."""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: The fields of a request; all are text, match_date an ISO date.
FIELDS = ("home", "away", "league", "match_date")


def typed_requests(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts with league, date, home, away and reason: null for a valid request, else the first rule that it breaks.

    A request is a JSON object with exactly the four fields, each a text that isn't empty, match_date a day as
    yyyy-MM-dd. Rules, in order: it is an object; no field is missing; none is unknown; all are text; none is empty; the
    day exists. Columns of a refused request are null; a null text is no object. Nothing is read twice or collected.
    """
    value = F.try_parse_json(F.col(column).cast("string"))
    keys = F.json_object_keys(F.col(column).cast("string"))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False)) & keys.isNotNull()
    allowed = F.array(*[F.lit(f) for f in FIELDS])
    field = lambda f: F.try_variant_get(value, f"$.{f}", "string")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant"))
    where = lambda test: F.filter(F.array(*[F.when(test(f), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    day = F.when(field("match_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(field("match_date"), "yyyy-MM-dd"))
    rules = (
        ("missing", F.array_except(allowed, keys)),
        ("unknown", F.array_sort(F.array_except(keys, allowed))),
        ("not text", where(lambda f: ~F.coalesce(kind(f) == "STRING", F.lit(False)))),
        ("empty", where(lambda f: field(f) == "")),
        ("no day", F.when(day.isNull(), F.array(F.lit("match_date"))).otherwise(F.array().cast("array<string>"))),
    )
    reason = F.when(~is_object, F.lit("not a JSON object"))
    for name, odd in rules:
        reason = reason.when(F.size(odd) > 0, F.concat(F.lit(f"{name}: "), F.array_join(odd, ", ")))
    out = texts.withColumn("reason", reason)
    valid = lambda c: F.when(F.col("reason").isNull(), c)
    return out.withColumns({"league": valid(field("league")), "date": valid(day), "home": valid(field("home")), "away": valid(field("away"))})


class Counter:
    """How many rows were predicted by jobs that ended well."""

    def __init__(self) -> None:
        self.total = 0
        self._lock = Lock()

    def counted(self, predictions: DataFrame, sink: Callable[[DataFrame], object]) -> object:
        """Run sink(predictions), a single job that uses them, and count its rows; a job that fails counts nothing.

        Rows are counted by the job itself as it makes them, not by another pass.
        """
        seen = Observation()
        out = sink(predictions.observe(seen, F.count(F.lit(1)).alias("n")))
        with self._lock:
            self.total += seen.get["n"]
        return out
