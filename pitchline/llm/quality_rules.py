"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean expression over the text. A bounded sample gives each rule's cost (seconds a row) and
selectivity (share of rows that it rejects); rules then run in the order of rejections per cost, inside one
CASE expression, so a row that an early rule rejects never pays for the later ones. The order changes the
work only: a row is kept if no rule rejects it.

Rows whose text is null count as empty. Nothing but the text decides, so repeated rows get equal verdicts,
and an empty table gives an empty result. Further columns, whatever their names, are left alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, base_view, cut, release

#: Rows of the sample that cost and selectivity are estimated on.
SAMPLE_ROWS = 2000
#: Timed runs of each rule over the sample, and the least time that a rule counts with.
RUNS, LEAST_SECONDS = 2, 1e-3
#: Words in the windows whose repetition counts.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though use may name it often or inside a lambda."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0), lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long")


def _paired(hashes: Column, gap: int) -> Column:
    """Hash of each element with the one `gap` further on."""
    return let(hashes, lambda v: F.zip_with(v, F.slice(v, F.lit(gap + 1), F.size(v)), lambda x, y: F.xxhash64(x, y)))


def _covered(windows: Column) -> Column:
    """Words that lie in a window (given by hash, in order) which occurs twice or more."""

    def marked(ordered: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def total(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, marked), total)


def n_repeat_words(word_list: Column) -> Column:
    """Words in windows of 8 words found twice or more in the text; hashes double from 1 to 2, 4 and 8 words."""
    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    eights = _paired(_paired(_paired(hashes, 1), 2), 4)
    full = let(eights, lambda v: F.slice(v, F.lit(1), F.greatest(F.size(v) - (WINDOW - 1), F.lit(0))))
    return let(full, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(_covered(v))).cast("long")


def n_word_runs(word_list: Column) -> Column:
    """Words equal to the word before."""
    return let(word_list, lambda v: F.size(F.filter(F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda x, y: x == y), lambda same: F.coalesce(same, F.lit(False))))).cast("long")


@dataclass(frozen=True)
class Rule:
    """A named test; rejects(text) is true for texts that must go."""

    name: str
    rejects: Callable[[Column], Column]


BASE_RULES = (
    Rule("short", lambda t: F.regexp_count(t, F.lit(WORD)) < 20),
    Rule("repeats", lambda t: let(words(t), lambda w: F.lit(100) * n_repeat_words(w) > F.lit(30) * F.size(w))),
)
#: What the cascade adds to the base: each looks at another kind of damage.
MORE_RULES = (
    Rule("symbols", lambda t: F.lit(20) * n_symbols(t) > word_chars(t)),
    Rule("shouting", lambda t: F.lit(10) * F.regexp_count(t, F.lit("!")) > F.lit(3) * F.regexp_count(t, F.lit(WORD))),
    Rule("capitals", lambda t: F.lit(10) * F.regexp_count(t, F.lit(r"\p{Lu}")) > F.lit(3) * F.length(t)),
    Rule("word_runs", lambda t: let(words(t), lambda w: F.lit(10) * n_word_runs(w) > F.lit(3) * F.size(w))),
    Rule("long_words", lambda t: word_chars(t) > F.lit(20) * F.regexp_count(t, F.lit(WORD))),
)
ALL_RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejection: float


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Estimate]:
    """Cost and rejection rate of each rule on a sample of at most sample_rows rows.

    A cost is the shortest of some runs, less that of a rule that does nothing, which stands for the job around it.
    """
    texts = base_view(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    # The count comes from the files' footers; the fraction keeps what meets in the limit's one task at twice the sample.
    share = min(1.0, 2 * sample_rows / max(docs.count(), 1))
    sample = cut((texts.sample(share, seed) if share < 1 else texts).limit(sample_rows), "sample")
    rows = max(sample.count(), 1)

    def measured(rejects: Column) -> tuple[float, int]:
        probe = sample.agg(F.count_if(rejects).alias("n"))
        rejected = probe.first()["n"]
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            probe.first()
            took.append(time.perf_counter() - began)
        return min(took), rejected

    idle, _ = measured(F.col("text").isNull())
    found = [(rule, *measured(rule.rejects(F.col("text")))) for rule in rules]
    release(sample)
    return [Estimate(rule, max(took - idle, LEAST_SECONDS) / rows, rejected / rows) for rule, took, rejected in found]


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejection per cost, best first; rules that rejected nothing come last, cheapest first."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.rejection / e.cost, e.cost))]


def cascade(rules: list[Rule], text: Column) -> Column:
    """Name of the first rule that rejects the text, else null; later rules aren't evaluated."""
    return reduce(lambda chain, r: chain.when(r.rejects(text), F.lit(r.name)), rules[1:], F.when(rules[0].rejects(text), F.lit(rules[0].name))) if rules else F.lit(None).cast("string")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with a column rejected_by (null: kept); an own column of that name is replaced."""
    return docs.withColumn("rejected_by", cascade(ordered(estimate(docs, rules, sample_rows)), F.coalesce(F.col("text").cast("string"), F.lit(""))))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    chain = cascade(ordered(estimate(docs, rules)), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.where(chain.isNull())


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Base measures of every document and the cascade's verdict over what passes the base."""
    chain = ordered(estimate(docs, rules))
    text = F.col("text")
    out = base_view(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words(text))
    out = out.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(F.col("words")).alias("n_repeat_words"))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words")))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(chain, text).isNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i + 7]) AS n
         FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
covered AS (SELECT rid, count(DISTINCT i + j) AS n
            FROM runs, (SELECT unnest(range(0, 8)) AS j) WHERE n > 1 GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n
          FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
same AS (SELECT rid, count(*) AS n FROM (SELECT rid, w, unnest(range(2, len(w) + 1)) AS i FROM d)
         WHERE w[i] = w[i - 1] GROUP BY rid),
m AS (SELECT d.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             coalesce(same.n, 0) AS n_runs
      FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN same USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 20 * n_symbols > word_chars
            OR 10 * len(regexp_extract_all(text, '!')) > 3 * n_words
            OR 10 * len(regexp_extract_all(text, '\p{Lu}')) > 3 * length(text)
            OR 10 * n_runs > 3 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
