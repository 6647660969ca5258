"""Quality rules, classifiers, licences and lines."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import edge_rows, frame, lower, prose, words
from parity import compare, duck
from pyspark.sql import functions as F

from pitchline.llm import entries, quality_rules as q
from pitchline.llm.labelled import platt, training_sample
from pitchline.llm.license_texts import _BSD, _BSD_NAMES, _gnu_header
from pitchline.llm.licenses import TEMPLATES, Scanner, license_report, normalised, scan_licenses
from pitchline.llm.line_dedup import boilerplate, clean_lines
from pitchline.llm.nbsvm import dual_coordinate_descent, fit, indicators, log_count_ratios, quality_scores, trained
from pitchline.llm.toxicity import BlockMaxIndex, likelihood_ratio, toxicity_scores

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert compare(entries.queries()[name](spark, FOLDER), duck(FOLDER), entries.oracle_sql()[name]) == ""


def measures(text):
    w = words(text)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_measures(spark):
    rows = edge_rows() + [(50, "a b c d e f g h " * 9, "s"), (51, "x\nx\n\nx\n y\ny", "s"), (52, "# $ " + prose(4, 30) + " |", "s"), (53, "w " * 40, "s")]
    got = {r["doc_id"]: r for r in q.quality_report(frame(spark, [r for r in rows if r[0]])).collect()}
    for d, t, _ in rows:
        if d:
            r = got[d]
            n, chars, symbols, dup, repeat = measures(t)
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), d
            assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])


def test_cascade_order_and_short_circuit(spark):
    rules = [q.Estimate(q.Rule(n, lambda t: F.lit(True)), c, r) for n, c, r in (("dear", 10.0, 0.5), ("cheap", 1.0, 0.2), ("idle", 0.1, 0.0))]
    assert [r.name for r in q.ordered(rules)] == ["cheap", "dear", "idle"]
    never = q.Rule("never", lambda t: F.raise_error(F.lit("a later rule was evaluated")).cast("boolean"))
    first = q.Rule("first", lambda t: F.length(t) >= 0)
    assert frame(spark, edge_rows()).select(q.cascade([first, never], F.coalesce("text", F.lit(""))).alias("r")).distinct().collect()[0]["r"] == "first"


def test_estimates_see_cost_and_rejections(spark):
    found = {e.rule.name: e for e in q.estimate(frame(spark, edge_rows() * 5), q.ALL_RULES)}
    assert all(e.cost > 0 for e in found.values()) and found["short"].rejection > 0


# --- classifiers ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,label", [("op7_toxicity", "toxic"), ("op10_quality_classifier", "quality")])
def test_held_out_accuracy(spark, name, label):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    rows = entries.queries()[name](spark, folder).where("held_out").join(known, "doc_id").where(f"{label} is not null").collect()
    good, bad = [r["score"] for r in rows if r[label] == 1], [r["score"] for r in rows if r[label] == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc > 0.94, auc


def test_held_out_labels_are_never_learned(spark):
    docs = frame(spark, [(i, prose(i, 60) + (" vile" * 5 if i % 2 else ""), "s") for i in range(200)])
    one = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    from pitchline.llm.labelled import fold

    for score, folds, held in ((toxicity_scores, 5, 0), (quality_scores, 4, 2)):
        flipped = one.withColumns({c: F.when(fold(F.col("doc_id"), folds) == held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
        a, b = ({r["doc_id"]: r["score"] for r in score(docs, x).collect()} for x in (one, flipped))
        assert a == b


def test_training_sample_is_bounded_and_repeats(spark):
    docs = frame(spark, [(i, f"t{i}", "s") for i in range(100)])
    known = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(5, 0)], "doc_id long, toxic int")
    a, b = (sorted(map(tuple, training_sample(docs, known, "toxic", 5, 0, 30).collect())) for _ in range(2))
    assert a == b and len(a) == 30


def test_a_text_that_does_not_fit_is_left_out_alone(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    known = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    first = training_sample(frame(spark, [(i, "x", "s") for i in ids]), known, "toxic", 5, 0, 1).first()["doc_id"]
    docs = frame(spark, [(i, "long " * 500 if i == first else f"text {i}", "s") for i in ids])
    rows = training_sample(docs, known, "toxic", 5, 0, 100, most_bytes=1000).collect()
    assert {r["doc_id"] for r in rows} == set(ids) - {first}
    assert training_sample(docs, known, "toxic", 5, 0, 1, most_bytes=1000).collect() == []


@pytest.mark.parametrize("common", [1 / 16, 2.0, 0.0])
def test_nearest_examples_are_exact(common):
    rng = np.random.default_rng(3)
    n, width = 500, 40
    dense = np.zeros((n, width))
    for i in range(n):
        t = rng.choice(width, rng.integers(1, 9), replace=False)
        dense[i, t] = rng.integers(1, 4, len(t))
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    entry, term = np.nonzero(dense)
    index = BlockMaxIndex.build(entry, term, dense[entry, term], np.arange(n), np.ones(n, int), np.zeros(n, int), width, common)
    for i in range(60):
        t = np.flatnonzero(dense[i])
        frequent = index.frequent_parts(np.zeros(len(t), int), t, dense[i, t], 0, 1)[0]
        near, cosine = index.nearest(t, dense[i, t], frequent, 7, without=i)
        all_ = np.round(dense @ dense[i], 6)
        all_[i] = 0
        want = np.lexsort((np.arange(n), -all_))[:7]
        assert near.tolist() == want[all_[want] > 0].tolist() and np.allclose(cosine, all_[near], atol=2e-6)


def dense_toxicity(texts, labels, train, k=15):
    """Scores by dense vectors: the votes of the k nearest distinct examples, calibrated leaving each example out."""
    token = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    counts = [Counter(token.findall(lower(t))) for t in texts]
    vocabulary = sorted({w for i in train for w in counts[i]})
    tf = np.array([[c[w] for w in vocabulary] for c in counts], float)
    has, y = tf[train] > 0, np.array([labels[i] for i in train])
    scale = (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1) * likelihood_ratio(np.stack([has[y == 0].sum(0), has[y == 1].sum(0)], 1), ((y == 0).sum(), (y == 1).sum()))
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * scale
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    share_of = lambda y: (y.sum() + 0.5) / (len(y) + 1)
    empty = ~v[train].any(1)
    share = share_of(y[empty]) if empty.any() else share_of(y)

    def vote(i, own):
        if not v[i].any():
            return share
        groups = defaultdict(list)
        for j, t in enumerate(train):
            if t != own and v[t].any():
                groups[tuple(tf[t])].append(j)
        near = sorted(((round(float(v[i] @ v[train[g[0]]]), 6), g) for g in groups.values()), key=lambda e: -e[0])
        near = [(1 / (1.05 - min(c, 1)), np.mean(y[g])) for c, g in near[:k] if c > 0]
        return (sum(w * p for w, p in near) + share) / (sum(w for w, _ in near) + 1)

    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    slope, intercept = platt(logit(np.array([vote(t, t) for t in train])), y)
    return [1 / (1 + np.exp(-(max(slope, 0) * logit(np.array(vote(i, None))) + intercept))) for i in range(len(texts))]


def test_toxicity_is_that_of_dense_vectors(spark):
    texts = [prose(i % 70, 20 + i % 9) + (" Vile mob" * (i % 3) if i % 4 == 1 else "") + (" calm" if i % 5 == 2 else "") for i in range(120)]
    texts[7], texts[8], texts[20:30] = "", "--", ["the same vile text"] * 10
    labels = [int("ile" in t) if i % 17 else 1 for i, t in enumerate(texts)]
    docs = frame(spark, [(i, t or None, "s") for i, t in enumerate(texts)])
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, known).collect()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    assert np.allclose([got[i]["score"] for i in range(len(texts))], dense_toxicity(texts, labels, train), atol=1e-4)
    assert all(got[i]["held_out"] == (i not in train) for i in got)


def test_a_text_of_unknown_words_gets_the_share(spark):
    docs = frame(spark, [(i, prose(i, 9) + " vile" * (i % 2), "s") for i in range(40)] + [(99, "zzz yyy", "s"), (98, "", "s")])
    known = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, known).collect()}
    assert got[98]["score"] == got[99]["score"] and list(got[99]["evidence"]) == []


def test_training_texts_are_bounded_in_bytes(spark):
    docs = frame(spark, [(i, "x" * 100, "s") for i in range(50)] + [(3, "a", "s")])
    known = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    rows = training_sample(docs, known, "toxic", 5, 0, 50, most_bytes=1050).collect()
    assert len(rows) in (10, 11) and sum(len(r["text"]) for r in rows) <= 1050


def test_dual_coordinate_descent_separates_and_meets_its_conditions():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 5
    values, labels = [np.ones(2)] * 20, np.array([1, 1, 0, 0] * 5)
    w, bias = dual_coordinate_descent(rows, values, labels, 4, cost=1.0, epochs=300)
    margins = np.array([w[r].sum() + bias for r in rows])
    assert ((margins > 0) == (labels > 0)).all() and abs(margins).min() > 0.95


def test_log_count_ratios():
    ratio = log_count_ratios([np.array([0, 1])] * 4 + [np.array([1])] * 4, np.array([1] * 4 + [0] * 4), 2)
    assert math.isclose(ratio[0], math.log((5 / 6) / (1 / 6))) and ratio[1] == 0 and ratio[2] == 0


def test_indicators_are_a_set_of_the_text_alone():
    both = indicators(pa.array(["A b c a B c", "", "A b c a B c"], pa.large_string()))
    assert (both[0] == both[2]).all() and len(both[1]) == 0 and len(set(both[0])) == len(both[0])


def labelled_rows(seed=7, n=160):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    out = [f"{prose(int(i), int(rng.integers(1, 40)))} {'good word' if a else 'bad sign'} {prose(int(i) + 999, 3)}" if i % 7 else prose(int(i), 5) for i, a in enumerate(y)]
    return out, y


def test_scores_are_the_fitted_models_by_dense_brute_force(spark):
    """Every n-gram of the sample in a dense matrix: ratios, norms, weights and scores by plain loops, rare n-grams too."""
    texts, y = labelled_rows()
    rows = indicators(pa.array(texts, pa.large_string()))
    model = fit(rows, y)
    grams = sorted(set().union(*map(set, map(np.ndarray.tolist, rows))))
    dense = np.array([[g in own for g in grams] for own in map(set, map(np.ndarray.tolist, rows))], float)
    one, none = ((dense[y == c].sum(0) + 1) / ((y == c).sum() + 2) for c in (1, 0))
    ratio = np.log(one / none)
    norm = np.sqrt(np.maximum((dense * (ratio != 0)).sum(1), 1))
    values = dense * ratio / norm[:, None]
    weights, bias = dual_coordinate_descent([np.flatnonzero(v) for v in values], [v[v != 0] for v in values], y, len(grams))
    margin = values @ weights + bias
    assert np.allclose(model.margins(rows), margin, atol=1e-9)
    assert (dense.sum(0) == 1).sum() > 100 and model.known.tolist() == [g for g, r in zip(grams, ratio) if r]
    want = 1 / (1 + np.exp(-(model.slope * margin + model.intercept)))
    # The query fits on rows outside the held-out fold; here all of them are.
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    docs = frame(spark, [(d, t, "s") for d, t in zip(ids, texts)])
    got = {r["doc_id"]: r["score"] for r in quality_scores(docs, spark.createDataFrame([(d, int(a)) for d, a in zip(ids, y)], "doc_id long, quality int")).collect()}
    assert np.allclose([got[d] for d in ids], want, atol=1e-6)


def test_margins_of_the_fit_are_those_of_the_scores():
    """The hinge loss's conditions hold for the scorer's margins: rows beyond their side of the margin have no part in it."""
    texts, y = labelled_rows(3, 90)
    rows = indicators(pa.array(texts, pa.large_string()))
    model = trained(rows, y)
    assert np.allclose(model.margins(rows[::-1])[::-1], model.margins(rows))
    assert model.margins([np.zeros(0, np.int64)]).tolist() == [model.bias] and model.margins([]).tolist() == []


def test_platt():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(int)
    a, b = platt(x, y)
    assert abs(a - 1.5) < 0.15 and abs(b + 0.5) < 0.15


# --- licences and lines ---------------------------------------------------------------------------------------------


def licence_words(text):
    return re.findall(r"[0-9a-z\x80-\u1fff]+", re.sub("[\u0080-\u00bf\u2000-\u206f]", " ", lower(text)))


def dice(a, b):
    a, b = (Counter(zip(x, x[1:])) for x in (a, b))
    return 2 * (a & b).total() / (a.total() + b.total())


def by_every_window(text, templates, least=0.8):
    """(licence, coefficient, first word, last word): the best end of every start, of these the best that don't overlap."""
    w, found = licence_words(text), []
    for name, template in templates:
        t = licence_words(template)
        for i in range(len(w) - 1):
            d, j = max((round(dice(w[i : j + 1], t), 12), -j) for j in range(i + 1, len(w)))
            if d >= least:
                found.append((-d, -len(set(t) & set(w[i : 1 - j])), i, name, -j))
    out = []
    for d, _, i, name, j in sorted(found):
        if all(j < a or i > b for _, _, a, b in out):
            out.append((name, -d, i, j))
    return sorted(out, key=lambda f: f[2])


def test_licences_by_every_window(spark):
    """Brute force over all windows of words and all templates, without pruning."""
    rng = np.random.default_rng(1)
    short = [t for t in TEMPLATES if len(t[1]) < 160]
    rows = []
    for i in range(40):
        w = " ".join(short[k][1] for k in rng.choice(len(short), 2)).split()
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = "changed"
        rows.append((i, f"{prose(i, 12)} {chr(10).join(w)} \u201cand\u201d {w[0]} {w[1]} {w[2]}", "s"))
    got = defaultdict(list)
    for r in scan_licenses(frame(spark, rows), short).collect():
        got[r["doc_id"]].append((r["license"], r["dice"], r["first_word"], r["last_word"]))
        text = rows[r["doc_id"]][1][r["first_char"] : r["last_char"] + 1]
        assert licence_words(text) == licence_words(rows[r["doc_id"]][1])[r["first_word"] : r["last_word"] + 1]
    for d, text, _ in rows:
        want = by_every_window(text, short)
        assert [(f[0], *f[2:]) for f in sorted(got[d], key=lambda f: f[2])] == [(f[0], *f[2:]) for f in want]
        assert np.allclose(sorted(f[1] for f in got[d]), sorted(f[1] for f in want))


@pytest.mark.parametrize("place", ["{}", "Before it stand words, {} and after it too.", "# {}\ncode()", "\u00abbegin\u00bb\n\n * {}"])
def test_every_template_is_named(spark, place):
    rows = [(i, place.format(text.replace('"', "\u201d")), "s") for i, (_, text) in enumerate(TEMPLATES)]
    got = {r["doc_id"]: r for r in license_report(frame(spark, rows)).collect()}
    assert [got[i]["license"] for i in range(len(rows))] == [name for name, _ in TEMPLATES]
    assert all(r["dice"] == 1.0 for r in got.values())


def test_licences_by_name(spark):
    lines = {
        "SPDX-License-Identifier: MIT": "mit",
        "// SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "SPDX-License-Identifier: Foo-1.1": "spdx-other",
        "Licensed under the Apache License 2.0": "apache-2.0",
        "Licensed under the GNU General Public License v3.0": "gpl-3.0",
        "Licensed under the GNU Lesser General Public License v2.1": "lgpl-2.1",
        "Licensed under the GNU General Public License": "gpl",
        _gnu_header("program", "Lesser General Public License", "3", True): "lgpl-3.0",
        _BSD + _BSD_NAMES: "bsd-3-clause",
        "The license of this identifier": None,
    }
    rows = [(i, f"some words before {line} and some after", "s") for i, line in enumerate(lines)]
    got = {r["doc_id"]: r["license"] for r in license_report(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == list(lines.values())


def test_many_notices_in_one_text():
    text = "Released under the MIT License. Other words stand here. " * 20_000
    scanner = Scanner(TEMPLATES, 0.8)
    w = normalised(pa.array([text], pa.large_string()))
    start = time.monotonic()
    found = scanner.scan(w, 0, *scanner.hits(w))
    assert len(found) == 20_000 and {f[0] for f in found} == {"mit"} and time.monotonic() - start < 20


def test_licences_stay_with_their_row(spark):
    mit, gpl = TEMPLATES[0][1], next(t for n, t in TEMPLATES if n == "gpl-3.0")
    rows = [(None, mit, "s"), (None, None, "s"), (2, gpl, "s"), (2, "nothing here at all", "s"), (2, gpl, "s"), (3, f"{mit}\n{prose(1, 30)}\n{gpl} {mit}", "s"), (4, "", "s")]
    got = sorted((r["doc_id"] or 0, r["license"] or "", r["n_licenses"]) for r in license_report(frame(spark, rows)).collect())
    assert got == [(0, "", 0), (0, "mit", 1), (2, "", 0), (2, "gpl-3.0", 1), (2, "gpl-3.0", 1), (3, "mit", 2), (4, "", 0)]
    assert scan_licenses(frame(spark, rows)).where("doc_id = 3").count() == 3


def test_boilerplate_lines(spark):
    rows = [(i, f"own line {i}\n Follow   us \nanother {i}", f"site{i % 9}") for i in range(30)]
    rows += [(100 + i, f"rare {i}\nOnly here", f"site{i % 3}") for i in range(30)] + [(200, "Follow us", None), (201, None, "site1")]
    out = {r["doc_id"]: r for r in clean_lines(frame(spark, rows)).collect()}
    assert all(out[i]["text"] == f"own line {i}\nanother {i}" and out[i]["lines_removed"] == 1 for i in range(30))
    assert all(out[100 + i]["lines_removed"] == 0 for i in range(30)) and out[200]["text"] == "" and out[201]["text"] == ""


def test_lines_go_from_rows_without_an_id_of_their_own(spark):
    rows = [(i, f"own {i}\nFollow us", f"site{i}") for i in range(9)] + [(None, "none\nFollow us", "site1"), (1, "again", "site1"), (None, None, None)]
    out = sorted((r["doc_id"] or 0, r["text"], r["lines_removed"]) for r in clean_lines(frame(spark, rows)).collect())
    assert out == sorted([(i, f"own {i}", 1) for i in range(9)] + [(0, "none", 1), (1, "again", 0), (0, "", 0)])


@pytest.mark.parametrize("sites,gone", [(7, False), (8, True), (9, True), (300, True)])
def test_spread_is_exact_near_the_threshold(spark, sites, gone):
    lines = spark.range(sites * 3).select(F.lit(1).cast("long").alias("key"), F.concat(F.lit("s"), (F.col("id") % sites).cast("string")).alias("site"))
    assert (boilerplate(lines, 8).count() == 1) == gone
