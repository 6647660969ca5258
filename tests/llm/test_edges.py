"""Every operator on awkward rows, on an empty table, and with columns of clashing names."""

from __future__ import annotations

import pytest
from cases import clashing, edge_rows, frame

from pitchline.llm import compact_windows, exact_dedup, licenses, line_dedup, logbilinear, minmax_dedup, mixing, nbsvm, packing, quality_rules, toxicity, word_runs

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((1, 1, 0), (7, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (4, 0, 1))):
    return spark.createDataFrame(list(rows), LABELS)


ONE_ROW_EACH = {
    "quality_rules": lambda s, d: quality_rules.quality_report(d),
    "exact_dedup": lambda s, d: exact_dedup.exact_duplicates(d),
    "mixing": lambda s, d: mixing.mix_report(d),
    "line_dedup": lambda s, d: line_dedup.line_report(d),
    "licenses": lambda s, d: licenses.license_report(d),
    "toxicity": lambda s, d: toxicity.toxicity_scores(d, labels(s)),
    "minmax_dedup": lambda s, d: minmax_dedup.near_duplicates(d),
    "nbsvm": lambda s, d: nbsvm.quality_scores(d, labels(s)),
    "word_runs": lambda s, d: word_runs.run_report(d),
    "logbilinear": lambda s, d: logbilinear.language_scores(d),
    "without_repeats": lambda s, d: compact_windows.without_repeats(d),
}
OTHERS = {
    "substrings": lambda s, d: compact_windows.repeated_passages(d),
    "packing": lambda s, d: packing.packed(d),
    "judged": lambda s, d: quality_rules.judged(d),
    "passing": lambda s, d: quality_rules.passing(d),
    "keep_largest": lambda s, d: exact_dedup.keep_largest(d),
    "keep_one_of_each": lambda s, d: minmax_dedup.keep_one_of_each(d),
    "mixed": lambda s, d: mixing.mixed(d),
    "scan": lambda s, d: licenses.scan_licenses(d),
}


def plain(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", list(ONE_ROW_EACH))
def test_one_row_for_each_document_whatever_its_columns(spark, name):
    docs = frame(spark, edge_rows())
    found = ONE_ROW_EACH[name](spark, docs)
    rows = found.collect()
    assert len(rows) == len(edge_rows())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((d is None, d or 0) for d, *_ in edge_rows())
    assert plain(ONE_ROW_EACH[name](spark, clashing(docs))) == sorted(map(str, rows))


@pytest.mark.parametrize("name", list(OTHERS))
def test_clashing_columns(spark, name):
    docs = frame(spark, edge_rows())
    rows, more = OTHERS[name](spark, docs), OTHERS[name](spark, clashing(docs))
    assert rows.count() > 0 or name == "scan"
    assert rows.count() == more.count()


@pytest.mark.parametrize("name", [*ONE_ROW_EACH, *OTHERS])
def test_empty(spark, name):
    assert (ONE_ROW_EACH | OTHERS)[name](spark, frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["passing", "keep_largest", "keep_one_of_each", "mixed"])
def test_filters_keep_the_columns(spark, name):
    docs = clashing(frame(spark, edge_rows())).drop("rejected_by")
    assert OTHERS[name](spark, docs).schema == docs.schema


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, nbsvm.quality_scores])
@pytest.mark.parametrize("rows", [[], [(1, 1, 1)], [(1, None, None)], [(404, 1, 1)]])
def test_few_labels(spark, score, rows):
    out = score(frame(spark, edge_rows()), labels(spark, rows)).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)


def test_batches_are_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    compact_windows.repeated_passages(frame(spark, edge_rows()))
    assert spark.conf.get(key) == before
