"""The audit of sources against plain integers, whatever the chunks and batches."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from cases import clashing, edge_rows, frame, prose
from parity import compare, duck

from pitchline.llm import divergence, entries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(of):
            total = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (of[t] + 1) // total for t in kept}

        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-gap(p[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            order = lambda v: (v[0], v[1].encode())
            for part, found in (("pair", sorted(pairs, key=order)), ("term", sorted(terms, key=order)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, a, s, None) for i, (t, a, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def many():
    rows = [(prose(i % 40, 30 + i), ("en", "fr", None, "")[i % 4], ("a", "b", "c", None, "")[i % 5]) for i in range(120)]
    rows += [(f"straße Ünï naïve \U0001f600 Zz {'zz' * (i % 3)}", "de", f"s{i % 3}") for i in range(9)]
    return rows + [(None, "xx", "a"), ("", "xx", "b"), ("once only", "xx", None), ("only ONCE", "yy", "a")] + [rows[0]] * 5


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("top", [200, 3])
def test_against_plain_integers(spark, top):
    assert found(divergence.source_divergence(table(spark, many()), top=top)) == expected(many(), top=top)


def test_chunks_and_batches_do_not_show(spark, monkeypatch):
    docs = table(spark, many()).repartition(7)
    counts = divergence.term_counts(docs, held=50)
    for terms, entries_ in ((1, 5), (3, 1), (4096, 40)):
        chunks = divergence.kept_chunks(counts, 3, terms, entries_).collect()
        assert all(r["terms"] == sorted(r["terms"], key=str.encode) and len(r["terms"]) <= terms for r in chunks)
        kept = Counter((r["lang"], t) for r in chunks for t in r["terms"])
        assert set(kept.values()) == {1}
    monkeypatch.setattr(divergence.kept_chunks, "__defaults__", (3, 2, 3))
    assert found(divergence.source_divergence(docs)) == expected(many())


def test_awkward_rows_empty_tables_and_clashing_columns(spark):
    docs = frame(spark, edge_rows())
    want = expected([(t, "en", s) for _, t, s in edge_rows()])
    assert found(divergence.source_divergence(docs)) == want
    assert found(divergence.source_divergence(clashing(docs).withColumn("term", docs.text).withColumn("n", docs.doc_id))) == want
    assert divergence.source_divergence(frame(spark, [])).collect() == []


def test_shares_are_exact_for_huge_counts():
    import numpy as np

    count = np.array([0, 1, 10**12, 3 * 10**15], np.int64)
    total = 9 * 10**15 - 1
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]


def test_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(entries.op13_source_divergence(spark, folder), duck(folder), entries.oracle_sql()["op13_source_divergence"]) == ""


def test_a_task_sends_one_row_for_each_term(spark):
    """However many sources a lang has, and each row tells all of them apart."""
    docs = spark.createDataFrame([(f"one two {'two' if i % 2 else 'three'}", "en", f"s{i % 7}") for i in range(70)], "text string, lang string, source string").coalesce(1)
    got = {r["key"]: r for r in divergence.term_counts(docs).collect()}
    assert divergence.term_counts(docs).count() == len(got) == 3
    assert got["en\0two"]["docs"] == 70 and sorted(zip(got["en\0two"]["sources"], got["en\0two"]["n"])) == [(f"s{k}", 15) for k in range(7)]
