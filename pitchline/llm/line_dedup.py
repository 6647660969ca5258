"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

A line that stands on many sites is boilerplate. HyperLogLog sketches of the sites, one for each line hash, merge
by aggregation, so a line on a third of all rows leaves each task as one small sketch. Lines whose estimate lies
near the threshold, within the sketch's error, get an exact distinct count; all others are settled by the sketch.
The lines that go are then taken out of every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut
from .quality_rules import let

#: A line on so many distinct sites is boilerplate.
LEAST_SITES = 8
#: Sketches of 2 ** 10 registers: a relative standard error of about 3 percent; four of them are checked exactly.
SKETCH_BITS = 10
NEAR = 0.13


def line_key(line: Column) -> Column:
    """What makes lines equal: the line without white space at its ends and with single spaces."""
    return F.trim(F.regexp_replace(line, SPACE, " "))


def _lines(docs: DataFrame) -> DataFrame:
    """(of, site, key) of every line with a word; `of` is its text's hash."""
    split = docs.select("of", "site", F.explode(F.split("text", "\n")).alias("line"))
    return split.select("of", "site", line_key(F.col("line")).alias("line")).where("line != ''").select("of", "site", F.xxhash64("line", F.lit(1)).alias("key"))


def boilerplate(lines: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """Keys of lines that stand on at least least_sites distinct sites, exactly."""
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"))
    judged = cut(spread.where(F.col("sites") >= least_sites * (1 - NEAR)), "spread")
    sure = judged.where(F.col("sites") > least_sites * (1 + NEAR)).select("key")
    close = judged.where(F.col("sites") <= least_sites * (1 + NEAR)).select("key")
    exact = lines.join(close, "key", "left_semi").groupBy("key", "site").agg(F.count(F.lit(1)).alias("n"))
    exact = exact.groupBy("key").agg(F.count("site").alias("sites")).where(F.col("sites") >= least_sites).select("key")
    return sure.unionByName(exact)


def _marked(docs: DataFrame, site: str, least_sites: int) -> DataFrame:
    """(doc_id, text, keys): the keys of each document's boilerplate lines, null without any.

    Rows are known by their texts' hashes, not by their ids: equal texts lose the same lines. If two texts had one hash,
    each would look for the other's lines too, which are boilerplate all the same.
    """
    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    view = view.withColumn("of", F.xxhash64("text"))
    lines = cut(_lines(view), "lines")
    hits = lines.join(boilerplate(lines, least_sites), "key", "left_semi")
    gone = hits.groupBy("of").agg(F.collect_set("key").alias("keys"))
    return view.join(gone, "of", "left").drop("of")


def _cleaned(text: Column, keys: Column) -> tuple[Column, Column]:
    """The text without the lines in keys, and the number of lines taken out."""
    key = lambda line: F.xxhash64(line_key(line), F.lit(1))
    parts = F.split(text, "\n")
    stay = F.filter(parts, lambda line: (line_key(line) == "") | ~F.array_contains(keys, key(line)))
    return F.when(keys.isNull(), text).otherwise(F.array_join(stay, "\n")), F.when(keys.isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(stay))


def clean_lines(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """Documents without boilerplate: doc_id, text, lines_removed; one row per input row.

    Needs columns doc_id, text and `site`; others are ignored. Lines are equal after trimming and with white
    space as single spaces; lines without a word never go. A null text counts as empty, a null site as no
    site: it adds nothing to a line's spread, but its documents are cleaned too. Every row is cleaned by its own
    text, so null ids, repeated ids and repeated rows make no difference. An empty table gives an empty result.
    """
    text, removed = _cleaned(F.col("text"), F.col("keys"))
    return _marked(docs, site, least_sites).select("doc_id", text.alias("text"), removed.cast("long").alias("lines_removed"))


def line_report(docs: DataFrame, site: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """clean_lines in figures: doc_id, lines_removed, n_chars (of the cleaned text), text_md5."""
    return clean_lines(docs, site, least_sites).select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


LINE_SQL = r"""
WITH l AS (SELECT doc_id, source, i, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS key
           FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
gone AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 8),
c AS (SELECT doc_id, count(*) FILTER (WHERE gone.key IS NOT NULL) AS lines_removed,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.key IS NULL), '') AS text
      FROM l LEFT JOIN gone USING (key) GROUP BY doc_id)
SELECT doc_id, lines_removed, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM c
"""
