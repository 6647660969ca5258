"""Duplicates, near-duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import edge_rows, frame, lower, prose, words
from pyspark.sql import functions as F

from pitchline.llm import compact_windows as cw
from pitchline.llm.exact_dedup import CuckooIndex, exact_duplicates, index_of, keep_largest, maintain, members
from pitchline.llm.minmax_dedup import keep_one_of_each, min_max_signature, near_duplicates


def shingle_set(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def altered(text, seed, share):
    rng = random.Random(seed)
    return " ".join("zz" + str(rng.randrange(10**6)) if rng.random() < share else w for w in words(text))


@pytest.fixture(scope="module")
def copies():
    """Copies, near copies of several distances, chains, and strangers."""
    rows, n = [], 100
    for family in range(12):
        base = prose(family + 10, 60 + 17 * family)
        for k in range(8):
            rows.append((n, altered(base, n, (0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2)[k]), "s"))
            n += 1
        text = base
        for k in range(4):
            text = altered(text, n + 50, 0.01)
            rows.append((n, text, "s"))
            n += 1
    return rows + edge_rows()


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_brute_force(spark, copies, k, percent):
    rows = [(d, t, s) for d, t, s in copies if d is not None]
    sets = [shingle_set(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    classes = {}
    for i, (d, _, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(d)
    want = sorted((d, len(sets[i]), min(classes[find(i)])) for i, (d, _, _) in enumerate(rows))
    got = near_duplicates(frame(spark, copies), k, percent).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_of_each_stays(spark, copies):
    docs = frame(spark, copies)
    found = near_duplicates(docs)
    kept = {r["doc_id"] for r in keep_one_of_each(docs).collect()}
    assert kept == {r["doc_id"] for r in found.where("kept").collect()}


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    sig = min_max_signature(np.concatenate([a, b]), np.array([0, 1000, 2000]), 400)
    assert sig.shape == (2, 800) and abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.05


def test_exact_duplicates(spark):
    rows = edge_rows()
    text = {}
    for d, t, _ in rows:
        text.setdefault(lower(t), []).append(d)
    got = exact_duplicates(frame(spark, rows)).collect()
    for r in got:
        group = next(g for t, g in text.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["doc_id"] in group and r["group_size"] == len(group)
        assert r["keep_id"] == max((d for d in group if d is not None), default=None)
    assert sum(r["kept"] for r in got) == len(text)
    assert keep_largest(frame(spark, rows)).count() == len(text)
    unique = [r for r in rows if r[0] not in (3, None)]
    assert sorted(r["doc_id"] for r in keep_largest(frame(spark, unique)).collect()) == sorted(r["doc_id"] for r in exact_duplicates(frame(spark, unique)).where("kept").collect())


def test_cuckoo_index_against_a_dictionary():
    rng, index, live = random.Random(5), CuckooIndex(4), {}
    for step in range(6000):
        digest = hashlib.sha256(str(rng.randrange(2500)).encode()).digest()
        if rng.random() < 0.6:
            if index.get(digest) is None:
                index.insert(digest, [step])
                live[digest] = [step]
        else:
            assert index.delete(digest) == (live.pop(digest, None) is not None)
        assert index.get(digest) == live.get(digest)
    assert dict(index.items()) == live and index.live == len(live) and index.resizes > 3


def test_cuckoo_index_with_equal_fingerprints():
    index = CuckooIndex(2)
    keys = [b"\x07\x00" + bytes([0, 0, 0, 0, 0, 0]) + i.to_bytes(4, "big") for i in range(6)]
    for i, k in enumerate(keys):
        index.insert(k, [i])
    assert [index.get(k) for k in keys] == [[i] for i in range(6)] and index.false_hits > 0


def test_index_is_kept_up_to_date(spark):
    a, b, c = (frame(spark, [(d, t, "s") for d, t in x]) for x in ([(1, "x"), (2, "X"), (3, "y")], [(4, "z"), (5, "x")], [(3, "y"), (1, "x")]))
    after, _ = maintain(index_of(members(a)), members(a), b, c)
    assert sorted((r["keep_id"], r["group_size"]) for r in after.collect()) == [(4, 1), (5, 2)]


def test_the_next_largest_id_follows_a_survivor(spark):
    a, none = frame(spark, [(1, "x", "s"), (5, "X", "s"), (None, "x", "s")]), frame(spark, [])
    state = index_of(members(a)), members(a)
    for gone, want in (([(5, "x", "s")], [(1, 2)]), ([(5, "x", "s"), (7, "q", "s")], [(1, 2)]), ([(1, "x", "s")], [(None, 1)]), ([(None, "X", "s")], [])):
        state = maintain(*state, none, frame(spark, gone))
        assert [(r["keep_id"], r["group_size"]) for r in state[0].collect()] == want
    assert state[1].isEmpty() and maintain(*state, none, none)[0].isEmpty()


def test_insertions_and_deletions_against_a_dictionary(spark):
    rng, live = random.Random(11), Counter()
    state = index_of(members(frame(spark, []))), members(frame(spark, []))
    draw = lambda: (rng.choice([None, *range(12)]), rng.choice(["a", "A", "b b", "", None, "c" * 5000]))
    norm = lambda row: (row[0], (row[1] or "").lower())
    for _ in range(5):
        came = [draw() for _ in range(55)]
        went = [rng.choice(came + list(live)) if rng.random() < 0.8 else draw() for _ in range(45)]
        for row in came:
            live[norm(row)] += 1
        for row in went:
            live[norm(row)] = max(live[norm(row)] - 1, 0)
        state = maintain(*state, frame(spark, [(*r, "s") for r in came]), frame(spark, [(*r, "s") for r in went]))
        want = {}
        for (doc, text), n in live.items():
            if n:
                keep, size = want.get(text, (None, 0))
                want[text] = (max((d for d in (keep, doc) if d is not None), default=None), size + n)
        got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in state[0].collect()}
        assert got == {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}


def windows_by_brute_force(values, least):
    """(centre, left, right) by definition: of each run the first minimum, gathered."""
    spans = {}
    for i in range(len(values)):
        for j in range(i, len(values)):
            c = i + min(range(j - i + 1), key=lambda k: (values[i + k], k))
            a, b = spans.get(c, (i, j))
            spans[c] = min(a, i), max(b, j)
    return {(c, a, b) for c, (a, b) in spans.items() if b - a + 1 >= least}


@pytest.mark.parametrize("seed,most", [(1, 10**6), (2, 6), (3, 2)])
def test_compact_windows_are_those_of_the_definition(seed, most):
    rng, least = np.random.default_rng(seed), 5
    parts = [rng.integers(1, most, n).astype(np.uint64) for n in (30, 5, 17)]
    v = np.concatenate([x for p in parts for x in (np.zeros(1, np.uint64), p)] + [np.zeros(1, np.uint64)])
    at = cw.Sequences.centres(None, v, least)
    left, right = cw.compact_windows(v, at)
    got = {(c, a, b) for c, a, b in zip(at.tolist(), left.tolist(), right.tolist()) if v[c] and b - a + 1 >= least}
    want, start = set(), 1
    for p in parts:
        want |= {(c + start, a + start, b + start) for c, a, b in windows_by_brute_force(p.tolist(), least)}
        start += len(p) + 1
    assert got == want


@pytest.fixture(scope="module")
def passages():
    """Twelve documents share a passage of 70 words, four a nearly equal one of 200; others share 30 words only."""
    shared, near, short = prose(501, 70), prose(502, 200), prose(503, 30)
    rows = [(i, f"{prose(600 + i, 90)} {shared} {prose(700 + i, 50)}", "s") for i in range(1, 13)]
    rows += [(20 + i, f"{prose(800 + i, 60)} {' '.join('qq%d' % j if i and j in (60 + i, 140 + i) else w for j, w in enumerate(words(near)))}", "s") for i in range(4)]
    rows += [(40 + i, f"{prose(900 + i, 100)} {short} {prose(950 + i, 100)}", "s") for i in range(8)]
    return rows


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeated_passages(spark, passages, monkeypatch, hot):
    """hot: from how many windows on a centre's buckets are split; the documents found are the same."""
    monkeypatch.setattr(cw, "HOT", hot)
    got = cw.repeated_passages(frame(spark, passages)).collect()
    text = {d: words(lower(t)) for d, t, _ in passages}
    for r in got:
        a, b = text[r["doc_id"]][r["first_word"] : r["last_word"] + 1], text[r["match_id"]][r["match_first"] : r["match_last"] + 1]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert min(len(a), len(b)) >= 50 and r["similarity"] >= 0.8 and abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-12
    named = {r["doc_id"] for r in got} | {r["match_id"] for r in got}
    assert named == set(range(1, 13)) | set(range(20, 24))
    whole = [r for r in got if r["doc_id"] in range(1, 13)]
    assert len(whole) == 11 and all(r["last_word"] - r["first_word"] + 1 == 70 for r in whole)


def test_repeats_are_cut_from_all_but_one(spark, passages):
    out = {r["doc_id"]: r for r in cw.without_repeats(frame(spark, passages)).collect()}
    assert sorted(out[i]["words_removed"] for i in range(1, 13)) == [0] + [70] * 11
    assert all(out[40 + i]["words_removed"] == 0 and out[40 + i]["text"] == dict((d, t) for d, t, _ in passages)[40 + i] for i in range(8))


def test_copies_are_named_once(spark):
    text = prose(5, 80)
    got = cw.repeated_passages(frame(spark, [(3, text, "s"), (1, text.upper(), "s"), (2, text, "s"), (2, text, "s"), (None, text, "s")])).collect()
    assert sorted(((r["doc_id"] or 0), r["match_id"], r["last_word"]) for r in got) == [(0, 1, 79), (2, 1, 79), (2, 1, 79), (3, 1, 79)]


def test_verification_splits_at_foreign_stretches():
    same = np.arange(100, 160)
    x = np.concatenate([np.arange(0, 40), same, np.arange(1000, 1040), same + 500])
    y = np.concatenate([np.arange(2000, 2100), same, np.arange(3000, 3100)])
    assert cw.passages(x, y, 46, 80) == [(40, 100, 100, 160, 1.0)]
    assert cw.passages(np.arange(50), np.arange(100, 150), 46, 80) == []


def test_passages_at_the_threshold_are_hardly_missed():
    """Share of pairs at similarity 0.8 of which too few hash functions agree, counted by their own minima."""
    rng, missed = np.random.default_rng(4), 0
    for _ in range(1500):
        both, one, other = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
        least = [[(h * cw._MUL[f] + cw._ADD[f]) ^ ((h * cw._MUL[f] + cw._ADD[f]) >> np.uint64(32)) for h in (both, one, other)] for f in range(cw.HASHES)]
        missed += sum(b.min() < min(x.min(), y.min()) for b, x, y in least) < cw.AGREE
    assert missed <= 0.008 * 1500


@pytest.mark.parametrize("hot", [2000, 1])
def test_a_first_node_without_the_passage_hides_none(spark, monkeypatch, hot):
    """A and B share a passage about a phrase that many others hold; the others' nodes come before theirs and after."""
    monkeypatch.setattr(cw, "HOT", hot)
    rows, want = [], set()
    for case, (size, more) in enumerate([(20, 40), (35, 25), *[(49, 2)] * 24]):
        phrase, base = prose(3000 + case, size), 1000 * (case + 1)
        before, after = words(prose(3100 + case, 60)), words(prose(3200 + case, 60))
        rows += [(base + i, f"{prose(10**6 + base + i, 70)} {phrase} {prose(2 * 10**6 + base + i, 70)}", "s") for i in range(10)]
        for i in range(2):
            passage = " ".join([*before[-(more // 2) :], phrase, *after[: more // 2]])
            rows.append((base + 100 + i, f"{prose(3 * 10**6 + base + i, 60)} {passage} {prose(4 * 10**6 + base + i, 60)}", "s"))
        want.add((base + 100, base + 101))
    got = cw.repeated_passages(frame(spark, rows)).collect()
    assert {tuple(sorted((r["doc_id"], r["match_id"]))) for r in got} == want
    assert all(r["similarity"] == 1 for r in got)


def test_a_group_without_its_first_node_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Many share a passage about a phrase that even more hold alone, whose nodes come first in about half the cases."""
    rows, sizes, write = [], {}, cw.cut

    def counted(df, name="cut"):
        out = write(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(cw, "cut", counted)
    for case in range(6):
        phrase, base = prose(5000 + case, 20), 1000 * (case + 1)
        passage = f"{prose(5100 + case, 25)} {phrase} {prose(5200 + case, 25)}"
        rows += [(base + i, f"{prose(10**6 + base + i, 70)} {phrase} {prose(2 * 10**6 + base + i, 70)}", "s") for i in range(40)]
        rows += [(base + 100 + i, f"{prose(3 * 10**6 + base + i, 60)} {passage} {prose(4 * 10**6 + base + i, 60)}", "s") for i in range(40)]
    got = cw.repeated_passages(frame(spark, rows)).collect()
    # A document may have a row with the first node of each of two buckets.
    assert 6 * 39 <= len(got) <= 2 * 6 * 39 and {r["doc_id"] for r in got} | {r["match_id"] for r in got} == {1000 * c + 100 + i for c in range(1, 7) for i in range(40)}
    assert sizes.get("rest_pairs", 0) <= 2 * 6 * 39


def test_dense_stretches_are_those_of_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        size, least, shared = rng.integers(1, 40), int(rng.integers(2, 8)), rng.random(30) < 0.5
        h = rng.integers(0, 30, size)
        n = np.where(shared[h], 3, 1)
        first, want = [int(np.flatnonzero(h == x)[0]) for x in h], np.zeros(size, bool)
        for i in range(size):
            for j in range(i + least, size + 1):
                common = sum(n[k] > 1 for k in range(i, j))
                foreign = sum(n[k] == 1 and first[k] == k for k in range(i, j))
                if common >= 0.8 * (common + foreign):
                    want[i:j] = True
        assert (cw._inside(*cw.dense(h, n, least, 80), size) == want).all()


def test_outer_places_meet_every_passage():
    rng = np.random.default_rng(8)
    for _ in range(300):
        h = rng.permutation(10**6)[:200]
        n = np.where(rng.random(200) < rng.random(), rng.integers(2, 5000, 200), 1)
        own = set(cw.outer(h, n, 46, 80).tolist())
        for i in range(155):
            for j in (i + 45, i + 60, min(i + 91, 199)):
                if j < 200 and n[i] > 1 and n[j] > 1 and (n[i : j + 1] > 1).mean() >= 0.8:
                    assert own & set(range(i, j + 1))


def test_one_row_of_a_class_stays_whatever_the_ids(spark):
    """Ids that repeat or are null don't name rows."""
    same, other = prose(1, 60), prose(2, 60)
    rows = [(1, same, "s"), (2, same, "s"), (None, same, "s"), (2, other, "s"), (None, other + " more", "s"), (None, None, "s"), (3, "", "s"), (3, prose(3, 50), "s"), (3, prose(3, 50), "s")]
    got = sorted((r["text"] or "") for r in keep_one_of_each(frame(spark, rows)).collect())
    assert len(got) == 5 and got[:2] == ["", ""] and {t[:40] for t in got[2:]} == {same[:40], other[:40], prose(3, 50)[:40]}


@pytest.mark.parametrize("mates", [1, 200])
def test_small_and_large_buckets_find_the_same_documents(spark, monkeypatch, mates):
    """Two of eight that hold a phrase share more about it: found by meeting in the bucket and by the join of shingles alike."""
    monkeypatch.setattr(cw, "MATES", mates)
    rows, want = [], set()
    for case, (size, more) in enumerate([(20, 40), (35, 25)]):
        phrase, base = prose(7000 + case, size), 1000 * (case + 1)
        passage = f"{prose(7100 + case, more)} {phrase} {prose(7200 + case, more)}"
        rows += [(base + i, f"{prose(5 * 10**6 + base + i, 70)} {phrase} {prose(6 * 10**6 + base + i, 70)}", "s") for i in range(6)]
        rows += [(base + 100 + i, f"{prose(7 * 10**6 + base + i, 60)} {passage} {prose(8 * 10**6 + base + i, 60)}", "s") for i in range(2)]
        want.add((base + 100, base + 101, size + 2 * more))
    got = cw.repeated_passages(frame(spark, rows)).collect()
    assert {(*sorted((r["doc_id"], r["match_id"])), r["last_word"] - r["first_word"] + 1) for r in got} == want


def test_pairs_are_verified_together_as_one_by_one():
    """Many pairs in one step, with repeated shingles and ranges that split, against sets counted for each pair alone."""
    rng = np.random.default_rng(12)

    def alone(x, y, least, percent):
        out, todo = [], [(0, len(x), 0, len(y))]
        while todo:
            i, j, k, l = todo.pop()
            in_x, in_y = [v in set(y[k:l]) for v in x[i:j]], [v in set(x[i:j]) for v in y[k:l]]
            if min(j - i, l - k) < least or sum(in_x) * 100 < least * percent // 2:
                continue
            i, j, k, l = i + in_x.index(True), j - in_x[::-1].index(True), k + in_y.index(True), l - in_y[::-1].index(True)
            own, other = set(x[i:j]), set(y[k:l])
            if min(j - i, l - k) < least:
                continue
            if len(own & other) * 100 >= percent * len(own | other):
                out.append((i, j, k, l, len(own & other) / len(own | other)))
                continue
            gaps = []
            for row, start in (([v in other for v in x[i:j]], i), ([v in own for v in y[k:l]], k)):
                at = [n + start for n, same in enumerate(row) if same]
                gaps.append(max(((b - a - 1, -a - 1) for a, b in zip(at, at[1:])), default=(0, 0)))
            (gap_x, from_x), (gap_y, from_y) = gaps
            if gap_x >= gap_y and gap_x:
                todo += [(i, -from_x, k, l), (-from_x + gap_x, j, k, l)]
            elif gap_y:
                todo += [(i, j, k, -from_y), (i, j, -from_y + gap_y, l)]
        return sorted(out)

    found = 0
    for _ in range(30):
        pairs = []
        for _ in range(15):
            x = rng.integers(0, rng.integers(2, 300), rng.integers(0, 160))
            y = np.concatenate([rng.integers(0, 300, rng.integers(0, 40)), np.where(rng.random(len(x)) < rng.random() * 0.3, 999, x)])
            pairs.append((x, y))
        least, percent = int(rng.integers(5, 50)), int(rng.integers(50, 95))
        xo, yo = (np.cumsum([0, *[len(p[k]) for p in pairs]]) for k in (0, 1))
        got = cw.passages_of_pairs(np.concatenate([x for x, _ in pairs]), xo, np.concatenate([y for _, y in pairs]), yo, least, percent)
        want = [(n, *p) for n, (x, y) in enumerate(pairs) for p in alone(x.tolist(), y.tolist(), least, percent)]
        assert list(zip(*[v.tolist() for v in got])) == want
        found += len(want)
    assert found > 100


def test_first_nodes_are_found_in_one_pass(spark, monkeypatch):
    """Buckets of one node go, others get the first window of their first node; all by one frame over a bucket."""
    seen, real = [], cw.cut
    monkeypatch.setattr(cw, "cut", lambda df, *a: seen.append(df) or real(df, *a))
    rows = [(1, 5, 9), (1, 3, 8), (1, 3, 2), (1, 7, 1), (2, 4, 4), (2, 4, 5), (3, -6, 1), (3, 6, 0)]
    led, files = cw._led(spark.createDataFrame([(*r, None) for r in rows], "key long, node long, window long, hot long"))
    first = {1: (3, 2), 3: (-6, 1)}
    assert sorted((r["key"], r["node"], r["window"], r["lead"], r["lead_window"]) for r in led.collect()) == sorted((*r, *first[r[0]]) for r in rows if r[0] in first)
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    cw.release(*files)


def test_rows_led_higher_up_are_left_out(spark):
    """Against the definition, without a join of rows with rows."""
    rng = random.Random(6)
    rows = sorted({(*rng.sample(range(6), 2), a, a + rng.randrange(1, 9), b, b + rng.randrange(1, 9), 1.0) for a, b in ((rng.randrange(6), rng.randrange(6)) for _ in range(120))})
    above = lambda x: {y[1] for y in rows if y[0] == x[1] and y[1] < x[1] and y[2] <= x[4] and y[3] >= x[5]}
    want = [x for x in rows if not any(z[0] == x[0] and z[1] in above(x) and z[2] <= x[2] and z[3] >= x[3] for z in rows)]
    good = spark.createDataFrame(rows, "node long, lead long, first_word int, last_word int, lead_first int, lead_last int, similarity double")
    out = cw._led_once(good)
    assert sorted(map(tuple, out.collect())) == want and 0 < len(want) < len(rows)
    assert "<=" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def test_lists_of_leads_are_not_sent_with_each_row(spark):
    """All pairs of 150 nodes: what is shuffled stays near the size of the rows."""
    rng = random.Random(9)
    rows = [(n, m, a, a + 60, b, b + 60, rng.random()) for n in range(150) for m in range(n) for a, b in [(rng.randrange(10**6), rng.randrange(10**6))]]
    good = spark.createDataFrame(rows, "node long, lead long, first_word int, last_word int, lead_first int, lead_last int, similarity double")
    written = lambda: sum(x.totalShuffleWrite() for x in [store.apply(i) for i in range(store.size())])
    store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    before = written()
    with cw.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert cw._led_once(good).count() == len(rows)
    store = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    assert written() - before < 200 * len(rows)


def test_only_documents_that_may_hold_a_passage_are_cut_into_windows(spark, passages):
    """Those that share 30 words only have no stretch; stretches hold every word of the passages, and their shingles are those of the text."""
    docs = cw.base_view(frame(spark, passages))
    named = docs.mapInArrow(cw._named, "doc_id long, node long, n_words long")
    groups = named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words"))
    got = {r["rep"]: r for r in cw._passable(docs, groups, 46, 80).join(groups, "node").collect()}
    assert set(got) == set(range(1, 13)) | set(range(20, 24))
    for d, r in got.items():
        assert len(r["grams"]) == r["n_words"] - 4
        if d < 13:
            assert any(a <= 90 and b >= 90 + 66 for a, b in zip(r["starts"], r["stops"]))


def test_pairs_are_verified_in_parts_with_the_same_result(spark, passages, monkeypatch):
    rows = lambda: sorted(map(tuple, cw.repeated_passages(frame(spark, passages)).collect()))
    want, sizes, write = rows(), [], cw.cut
    monkeypatch.setattr(cw, "WHOLE", 0)
    monkeypatch.setattr(cw, "cut", lambda df, name="cut": (sizes.append(name), write(df, name))[1])
    assert rows() == want and sizes.count("part") > 1
