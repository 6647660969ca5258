"""Mixing, packing and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import edge_rows, frame, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from pitchline.llm.mixing import _ranked_sources, mix_report, mixed, with_targets
from pitchline.llm.packing import best_fit, cut_points, local_search, packed


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Brute force: reshare the excess one round after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in names if s in free and unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_reshared(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {name: int(rng.integers(0, 10 ** int(rng.integers(1, 7)))) for name in ["b", "é", "\U0001f642", "zz", "a", "\uffee", None, "", "B"]}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    frame_ = spark.createDataFrame([(i, s, sizes[s]) for i, s in enumerate(names)], "sid long, name string, source_size long")
    got = {r["name"]: r["target"] for r in with_targets(frame_).collect()}
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) <= 1e-9 * max(want[s], 1) for s in names)


def test_sources_are_ranked_by_code_point(spark):
    names = ["b", "é", "\U0001f642", "zz", "a", "\uffee", None, "", "B"]
    rows = spark.createDataFrame([(s, 1) for s in names for _ in range(2)], "source string, size long")
    got = [r["name"] for r in _ranked_sources(rows).orderBy("sid").collect()]
    assert got == sorted(names, key=lambda s: (s is None, s or ""))


def test_repeated_rows_are_taken_one_by_one(spark):
    text = prose(3, 10)
    rows = [(None, text, "a")] * 100 + [(i, prose(i, 30), "b") for i in range(1, 30)] + [(1, prose(1, 30), "b")] * 3
    out = mix_report(frame(spark, rows)).collect()
    taken, aim = sum(r["taken"] for r in out if r["doc_id"] is None), next(r["target"] for r in out if r["doc_id"] is None)
    assert abs(taken - aim) <= 5 and {r["taken"] for r in out if r["doc_id"] is None} <= {0, 10, 20}
    copies = Counter(r["doc_id"] for r in mixed(frame(spark, rows)).collect())
    assert copies == Counter({d: n for d in {r["doc_id"] for r in out} if (n := sum(r["copies"] for r in out if r["doc_id"] == d))})


def test_many_sources(spark):
    """Each source is a host of its own; nothing of them is collected."""
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.concat(F.lit("host"), F.col("id").cast("string")).alias("source"))
    row = mix_report(docs).agg(F.sum("taken").alias("t"), F.sum("target").alias("aim"), F.count_if(F.col("taken") > 2 * F.col("size")).alias("over"), F.count_if(F.abs(F.col("taken") - F.col("target")) > F.col("size") / 2 + 1e-6).alias("far")).first()
    assert abs(row["aim"] - 1.5 * sum(i % 7 + 1 for i in range(100_000))) < 1 and row["over"] == 0 and row["far"] == 0


@pytest.fixture(scope="module")
def library():
    return [(i, prose(i, 20 + i * 7 % 190), ("a", "b", "c", "d", None)[i % 5] if i % 3 else "a") for i in range(600)]


def test_mix_meets_its_targets(spark, library):
    rows = mix_report(frame(spark, library)).collect()
    size = {d: len(words(t)) for d, t, _ in library}
    own, taken, aim = Counter(), Counter(), {}
    for d, t, s in library:
        own[s] += size[d]
    want = targets(dict(own))
    for r in rows:
        s = library[r["doc_id"]][2]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[s] and r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        aim[s] = r["target"]
        taken[s] += r["taken"]
    for s in own:
        assert abs(aim[s] - want[s]) < 1e-6 and abs(taken[s] - aim[s]) <= max(3, 0.002 * aim[s]), s


def test_rates_are_tilted_exponentially(spark, library):
    """log rate is a line through the origin in the size, within each source, wherever the bound of 2 doesn't hold."""
    by = defaultdict(list)
    for r in mix_report(frame(spark, library)).collect():
        if 0 < r["rate"] < 2:
            by[library[r["doc_id"]][2]].append((r["size"], np.log(r["rate"])))
    for pairs in by.values():
        x, y = np.array(pairs).T
        assert np.allclose(y, x * (x @ y) / (x @ x), atol=1e-9)


def test_mix_repeats_and_rows_follow_the_report(spark, library):
    docs = frame(spark, library)
    one, two = (sorted(map(tuple, mix_report(docs.repartition(n)).select("doc_id", "copies").collect())) for n in (2, 5))
    assert one == two
    assert sorted(Counter(r["doc_id"] for r in mixed(docs).collect()).items()) == [x for x in one if x[1]]


# --- packing --------------------------------------------------------------------------------------------------------


def test_cut_points():
    assert cut_points(5, 10) == [0] and cut_points(10, 10) == [0] and cut_points(11, 10) == [0, 1] and cut_points(25, 10) == [0, 5, 15]


@pytest.mark.parametrize("seed", range(4))
def test_local_search_keeps_pieces_and_never_needs_more_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 100, 400) if seed % 2 else np.concatenate([rng.integers(30, 55, 300), rng.integers(1, 9, 60)])
    first = best_fit(lengths, 100)
    bins = local_search([b[:] for b in first], lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert max(lengths[b].sum() for b in bins) <= 100 and len(bins) <= len(first)


def test_local_search_empties_bins():
    """Best fit leaves 6+3, 5+4, 5 and 2+2+...; exchanges reach the least number of bins."""
    lengths = np.array([6, 5, 5, 4, 3, 3, 2, 2])
    bins = local_search([[0, 4], [1, 3], [2, 5], [6, 7]], lengths, 10)
    assert len(bins) == 3


def test_packed_round_trip(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [r for r in edge_rows() if r[0] not in (3, None)] + [(70, "a <|endoftext|> b", "s"), (71, "日本語 текст 🙂   x", "s"), (72, "  \n\n  tabs\t\there's 12345 _under_ naïve ﬁ", "s"), (73, " " * 5000 + "x", "s"), (74, "it's’s don't\r\n\r\n end ", "s")]
    ids = {d: enc.encode(t or "", add_special_tokens=False).ids + [2] for d, t, _ in rows}
    got = packed(frame(spark, rows)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"], r["doc_id"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(ids[d])
        assert all(n == 1024 for _, _, n in own[1:]) and (len(own) == 1) == (len(ids[d]) <= 1024)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(pieces) == set(ids)


def test_shards_together_waste_a_few_bins(spark):
    """Many small shards need about as many sequences as one large one: what they leave underfull is dealt again."""
    rows = [(i, prose(i, 40 + i * 37 % 150), "s") for i in range(900)]
    used = {}
    for most in (60, 100_000):
        out = packed(frame(spark, rows), shard_pieces=most).collect()
        fill = Counter()
        for r in out:
            fill[r["sequence_id"]] += r["length"]
        assert len(out) == 900 and max(fill.values()) <= 1024
        used[most] = len(fill), -(-sum(fill.values()) // 1024)
    assert used[60][0] <= used[100_000][0] + 4 and used[100_000][0] <= used[100_000][1] + 2


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]


def test_every_stage_keeps_columns_and_takes_effect(spark, library):
    text = prose(1, 90)
    rows = [(i + 1000, t, s) for i, t, s in library] + [(1, text, "a"), (2, text.replace("a", "A"), "a"), (3, text + " more", "a"), (4, "too short", "a"), (5, None, None)]
    docs = frame(spark, rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = out.persist()
        seen[name] = Counter(r["doc_id"] for r in docs.collect())
    assert not {4, 5} & set(seen["quality rules"]) and {1, 2, 3} <= set(seen["quality rules"])
    assert 1 not in seen["exact dedup"] and {2, 3} <= set(seen["exact dedup"])
    assert 2 in seen["near dedup"] and 3 not in seen["near dedup"]
    assert max(seen["mixing"].values()) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == seen["mixing"]


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert rows and max(fill.values()) <= 1024 and len(fill) <= 1.02 * (-(-sum(fill.values()) // 1024)) + 1
