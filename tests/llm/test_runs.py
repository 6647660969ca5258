"""Periodic runs against every pair of places, and against regrown periods, on words, texts and tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from cases import edge_rows, frame, prose, words

from pitchline.llm import word_runs


def brute(w):
    """(start, stop, smallest period) of all maximal repetitions, by trying every period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b, p) for (a, b), p in found.items())


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randrange(rng.choice([4, 12, 40, 160])), rng.choice([1, 2, 3, 4, 9])
        w = [str(rng.randrange(letters)) for _ in range(n)]
        kind = rng.randrange(4)
        if kind == 1 and n:
            p = rng.randrange(1, n + 1)
            w = (w[:p] * (n // p + 1))[:n]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = str(rng.randrange(letters))
        if kind == 2:
            w, other = ["a"], ["b"]
            while len(w) < n:
                w, other = w + other, w
            w = w[:n]
        if kind == 3:
            w = w + w[: n // 2] + w
        yield w


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_are_those_of_every_period(seed):
    texts = list(sequences(seed, 400))
    ids, first = word_runs.encoded(texts)
    want = [(a + int(f), b + int(f), p) for w, f in zip(texts, first) for a, b, p in brute(w)]
    assert sorted(word_runs.all_runs(ids, first)) == want


def test_steps_do_not_show(monkeypatch):
    texts = list(sequences(9, 100))
    ids, first = word_runs.encoded(texts)
    want = sorted(word_runs.all_runs(ids, first))
    monkeypatch.setattr(word_runs, "STEP", 7)
    assert sorted(word_runs.all_runs(ids, first)) == want


def expected(doc_id, text):
    """The contract's row, by plain loops."""
    w = words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(((a, b - a, p) for a, b, p in brute(w) if b - a >= max(6, 4 * p)), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_report_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " \n".join(w), "s") for i, w in enumerate(sequences(21, 400))]
    rows += [(d, t, s) for d, t, s in edge_rows() if t is None or len(t) < 5000]
    rows += [(1000 + i, prose(i, rng.randrange(1, 300)), "s") for i in range(60)]
    found = sorted(map(str, word_runs.run_report(frame(spark, rows)).collect()))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = sorted("Row(" + ", ".join(f"{k}={v!r}" for k, v in zip(names, expected(d, t))) + ")" for d, t, _ in rows)
    assert found == want
    assert any("n_runs=2" in w for w in want)


def test_very_long_texts(spark):
    line = "the same notice again and again"
    long_ = prose(5, 200_000, 90)
    rows = [(7, " ".join([line] * 50_000), "a"), (8, long_ + " x" * 300_000, "a"), (9, long_, "b")]
    found = {r["doc_id"]: r for r in word_runs.repeated_runs(frame(spark, rows)).collect()}
    assert found[7]["runs"] == [[0, 300_000, 6]] and found[7]["text"] == line
    assert found[8]["runs"][-1] == [200_000, 300_000, 1]
    assert found[9]["runs"] == found[8]["runs"][:-1]


def test_only_whole_periods(spark):
    with pytest.raises(ValueError):
        word_runs.repeated_runs(frame(spark, []), least_periods=1)
