"""The language model: exact counts and unigram base, slopes, normalised shares, and what context is worth."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import edge_rows, frame, lower, prose, words

from pitchline.llm import logbilinear as lb
from pitchline.llm.common import cut


def held(d, folds=7, rest=2):
    return d is not None and zlib.crc32(str(d).encode()) % folds == rest


def expected(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score rounded) by plain counting."""
    count = Counter()
    for d, t, _ in rows:
        if not held(d):
            count.update([*words(lower(t)), None])
    total, types = sum(count.values()), len(count)
    out = []
    for d, t, _ in rows:
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((count[w] + 1) / (total + types + 1)) for w in tokens)
        out.append((d, held(d), len(tokens), sum(count[w] > 0 for w in tokens), total, round(base, 6)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 300, lb.CHUNK])
def test_counts_and_base_against_plain_counting(spark, monkeypatch, chunk):
    monkeypatch.setattr(lb.encoded, "__defaults__", (chunk,))
    rows = edge_rows() + [(100 + i, prose(i, 5 + 7 * i), "a") for i in range(20)] + [(i, "ß ñ Ü \U0001f600 x", None) for i in (201, 202, 203)]
    docs = frame(spark, [r for r in rows if r[1] is None or len(r[1]) < 50_000] if chunk == 1 else rows).repartition(3)
    kept = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    out = lb.language_scores(docs)
    assert found(out) == expected(kept)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out.collect())


def chain(seed, n, states=12):
    """Words that follow from the word before three times out of four."""
    rng = random.Random(seed)
    out, s = [], rng.randrange(states)
    for _ in range(n):
        s = (5 * s + 1) % states if rng.random() < 0.75 else rng.randrange(states)
        out.append(f"w{s}{'abc'[rng.randrange(3)]}{'xyz'[s % 3]}{s}")
    return " ".join(out)


def test_context_is_worth_more_than_counts_on_held_out_texts(spark):
    docs = frame(spark, [(i, chain(i, 400), "a") for i in range(300)]).repartition(3)
    rows = [r for r in lb.language_scores(docs, rounds=3).collect() if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert len(rows) > 20 and gain > 0.2
    again = lb.language_scores(docs, rounds=3).select("doc_id", "score").collect()
    assert {r["doc_id"]: round(r["score"], 4) for r in again if held(r["doc_id"])} == {r["doc_id"]: round(r["score"], 4) for r in rows}


def test_known_words_and_one_unknown_of_each_class_sum_to_one(spark):
    docs = frame(spark, [(i, prose(i, 60, 50), "a") for i in range(40)])
    chunks = cut(lb.encoded(docs, 7, 2))
    counts = cut(chunks.selectExpr("explode(arrays_zip(words, n)) w").where("w.n > 0").groupBy("w.words").agg({"w.n": "sum"}).toDF("word", "n"))
    vocab = lb.vocabulary(chunks, counts, 9, 20)
    p = lb.train(lb.classed(chunks, counts, vocab), vocab, 8, 3, 2, 64)
    x = np.random.default_rng(0).integers(0, 31, (50, 3))
    logs = lb.class_log_probabilities(p, x)
    assert logs.shape == (50, 30) and np.allclose(np.exp(logs).sum(1), 1, atol=1e-5)
    # Every known word's share in its class, by a text of that word alone; the smallest share is an unknown word's.
    known = [r["word"] for r in counts.collect()]
    probe = frame(spark, [(k, w, None) for k, w in enumerate(known)])
    rows = lb.classed(cut(lb.encoded(probe, 7, 2)), counts, vocab).collect()
    inner, k = Counter(), Counter()
    for r in rows:
        for share, c in zip(r["inner"], np.frombuffer(r["classes"], "<u2")):
            inner[int(c)] += math.exp(share)
    unknown = {c: 1 / (vocab.class_tokens[c] + vocab.class_types[c] + 1) if c > 9 else 0 for c in inner}
    assert len(inner) > 15 and all(abs(inner[c] + unknown[c] - 1) < 1e-9 for c in inner)


def test_steps_climb_the_contrastive_objective():
    """learn() moves along the slope of the objective that finite differences give."""
    rng = np.random.default_rng(3)
    shares = rng.dirichlet(np.ones(6))
    p = lb.start(shares, 4, 2)
    x, y = rng.integers(0, 7, (30, 2)), rng.integers(0, 6, 30)
    noise = lb.Trainer(p, shares, noise=5, seed=8).rng.choice(6, 5, p=shares)

    def objective(q):
        h = (q.context[x].astype(float) * q.place).sum(1)
        odds = np.log(shares * 5)
        true = (h * q.target[y]).sum(1) + q.bias[y] - odds[y]
        false = h @ q.target[noise].T.astype(float) + q.bias[noise] - odds[noise]
        return -np.logaddexp(0, -true).sum() - np.logaddexp(0, false).sum()

    moved = []
    trainer = lb.Trainer(p, shares, noise=5, seed=8)
    trainer._climb = lambda values, slopes, rows, by: moved.append((rows, by))
    trainer.learn(x, y)
    for name, (rows, by) in zip(("target", "bias", "context", "place"), moved):
        value = getattr(p, name)
        whole = np.zeros(value.size if name == "place" else value.shape)
        whole[rows] = by
        whole = whole.reshape(value.shape)
        for at in [np.unravel_index(i, value.shape) for i in rng.choice(value.size, 5, replace=False)]:
            up, down = (lb.Parameters(*[v.astype(float) for v in (p.context, p.target, p.bias, p.place, p.slopes)]) for _ in range(2))
            getattr(up, name)[at] += 1e-4
            getattr(down, name)[at] -= 1e-4
            assert abs((objective(up) - objective(down)) / 2e-4 - whole[at]) < 1e-3


def test_windows_by_hand():
    x, y = lb.windows(np.array([4, 5, 6]), np.array([2, 0, 1]), 2, 9)
    assert x.tolist() == [[9, 9], [4, 9], [5, 4], [9, 9], [9, 9], [6, 9]] and y.tolist() == [4, 5, 0, 0, 6, 0]


def test_only_held_out_texts(spark):
    ids = [d for d in range(200) if held(d)][:5]
    rows = lb.language_scores(frame(spark, [(d, "a b", "s") for d in ids])).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in rows] == [(0, 0, 0.0)] * 5
    assert all(math.isfinite(r["score"]) for r in rows)
