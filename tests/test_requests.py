"""Typed requests, rule by rule, and the counter of predictions."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitchline.operators.requests import Counter, typed_requests

GOOD = {"home": "Ay", "away": "Bee", "league": "L", "match_date": "2024-02-29"}


def said(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v is not ...})


CASES = [
    (said(), None),
    (said(home=" "), None),
    (said(home="Ünï \u2028 \"x\""), None),
    (said(home=""), "empty: home"),
    (said(home="", league=""), "empty: home, league"),
    (said(away=...), "missing: away"),
    (said(away=..., league=...), "missing: away, league"),
    (said(extra=1, also=None), "unknown: also, extra"),
    (said(home=3), "not text: home"),
    (said(home=None), "not text: home"),
    (said(home=["Ay"]), "not text: home"),
    (said(league={"name": "L"}), "not text: league"),
    (said(match_date=20240229), "not text: match_date"),
    (said(match_date="2023-02-29"), "no day: match_date"),
    (said(match_date="29/02/2024"), "no day: match_date"),
    (said(match_date="2024-2-9"), "no day: match_date"),
    (said(match_date="2024-02-29T10:00:00"), "no day: match_date"),
    ("{", "not a JSON object"),
    ("", "not a JSON object"),
    ("[]", "not a JSON object"),
    ('"text"', "not a JSON object"),
    ("null", "not a JSON object"),
    (None, "not a JSON object"),
    ("{}", "missing: home, away, league, match_date"),
]


def test_every_rule(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "id int, value string")
    rows = {r["id"]: r for r in typed_requests(df).collect()}
    assert [(CASES[i][0], rows[i]["reason"]) for i in range(len(CASES))] == CASES
    for i, (text, reason) in enumerate(CASES):
        own = tuple(rows[i][c] for c in ("home", "away", "league", "date"))
        want = json.loads(text) if reason is None else None
        assert own == ((want["home"], want["away"], want["league"], dt.date(2024, 2, 29)) if want else (None,) * 4)
    assert typed_requests(df.limit(0)).collect() == []


def test_counter_counts_what_ended_well(spark, tmp_path):
    counter, df = Counter(), spark.range(37).repartition(3)
    counter.counted(df, lambda d: d.write.parquet(f"file://{tmp_path}/a"))
    assert counter.total == 37
    broken = df.withColumn("x", F.when(F.col("id") == 30, F.raise_error(F.lit("no"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="no"):
        counter.counted(broken, lambda d: d.write.parquet(f"file://{tmp_path}/b"))
    assert counter.total == 37
    assert len(counter.counted(df.limit(5), lambda d: d.collect())) == 5 and counter.total == 42
