"""Toxicity by the nearest labelled examples: exact cosine of TF-IDF vectors over a block-max inverted index.

Terms are runs of letters and digits after lower-casing A-Z. The index holds every term of a bounded sample of
labelled documents; document frequencies are counted over all documents. A term's TF-IDF weight is scaled by the
log-likelihood ratio of its presence with the label: no term is left out, but words that go with neither label
weigh little (plain TF-IDF weights find neighbours of the same language, not of the same label).

Examples with equal vectors are one entry with counts of their labels. Postings lie in blocks of similar examples,
with the largest weight of each term and block. A query sums a block's bounds, scores the blocks of the highest
bounds first and leaves out those that can't reach the k-th best cosine, so the neighbours are exact. Their votes,
weighted by closeness, are calibrated by leaving each example out in turn; the neighbours' ids are the evidence.

The index is a broadcast whose size the sample bounds; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_strings, base_view, cut, mix, release, small_batches, text_chunks
from .labelled import fold, platt, training_sample

#: Most labelled rows that terms and examples come from.
SAMPLE_ROWS = 8000
NEIGHBOURS = 15
BLOCK = 64
#: Terms of more than this share of the entries are kept as dense rows.
COMMON = 1 / 16
#: Cosines within this distance may count as equal.
SAME = 1e-6
#: Queries that are multiplied with the dense rows at a time.
TOGETHER = 64
#: Tasks that score the left-out examples.
CALIBRATION_TASKS = 16

_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _BREAKS[_low:_high] = False


def terms(texts: pa.Array) -> Words:
    """Runs of ASCII letters and digits and of all other characters past ASCII."""
    return Words(texts, spaces=_BREAKS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each sampled document with their counts."""
    for batch in batches:
        texts = as_strings(batch["text"])
        for a, b in text_chunks(texts):
            w = terms(texts.slice(a, b - a))
            rows = [np.unique(w.hash[i:j], return_counts=True) for i, j in zip(w.first[:-1], w.first[1:])]
            lists = [pa.array([t.view(np.int64) for t, _ in rows], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in rows], pa.list_(pa.int32()))]
            yield pa.record_batch([batch["doc_id"].slice(a, b - a), batch["label"].slice(a, b - a), *lists], ["doc_id", "label", "terms", "counts"])


def likelihood_ratio(with_: np.ndarray, of: tuple[int, int]) -> np.ndarray:
    """Dunning's G2 of presence against class; with_ holds document counts (terms, 2), `of` the sizes of the classes."""
    total = float(sum(of))
    seen = with_.sum(1)
    out = np.zeros(len(with_))
    for c in (0, 1):
        for count, margin in ((with_[:, c], seen), (of[c] - with_[:, c], total - seen)):
            expected = margin * of[c] / total
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(count > 0, count * np.log(count / expected), 0.0)
    return np.maximum(2 * out, 0.0)


class Finder:
    """Occurrences of wanted terms (sorted hashes): a bitmap of hash prefixes first, then a search among the hashes."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[(wanted >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, count) of each wanted term in each row, by row."""
        n = len(self.wanted)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        maybe = np.flatnonzero(self.bitmap[(w.hash >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.wanted, w.hash[maybe]), n - 1)
        hit = self.wanted[place] == w.hash[maybe]
        row = np.searchsorted(w.first, maybe[hit], "right") - 1
        key, count = np.unique(row * n + place[hit], return_counts=True)
        return key // n, key % n, count


def _present(wanted: np.ndarray):
    """Documents that hold each wanted term, by partition; term -1 counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts, rows = Finder(wanted), np.zeros(len(wanted), np.int64), 0
        for batch in batches:
            texts = as_strings(batch["text"])
            rows += len(texts)
            for a, b in text_chunks(texts):
                _, term, _ = find(terms(texts.slice(a, b - a)))
                counts += np.bincount(term, minlength=len(wanted))
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(counts[seen], rows))], ["term", "n"])

    return run


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places of the ranges [low, high), one range after another."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


@dataclass
class BlockMaxIndex:
    """Unit vectors of entries by term. Cells are the pairs of a term and a block of BLOCK entries that has it.

    Term t has cells [cells[t], cells[t + 1]); cell c lies in `block[c]`, has `bound[c]` as its largest weight and
    postings [first[c], first[c + 1]) of (entry, weight). Entry e stands for count[e] examples, positive[e] of label 1.
    Terms of many entries, whose bounds would be the same everywhere, are rows of `dense` instead; `dense_at` has
    their row, or -1.
    """

    cells: np.ndarray
    block: np.ndarray
    bound: np.ndarray
    first: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    dense_at: np.ndarray
    dense: np.ndarray
    ids: np.ndarray
    count: np.ndarray
    positive: np.ndarray

    @staticmethod
    def build(entry: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, count: np.ndarray, positive: np.ndarray, n_terms: int, common: float = COMMON) -> BlockMaxIndex:
        """From postings (entry, term, weight) in any order."""
        blocks = -(-len(ids) // BLOCK)
        frequent = np.bincount(term, minlength=n_terms) > max(common * len(ids), 1)
        dense_at = np.where(frequent, np.cumsum(frequent) - 1, -1)
        dense = np.zeros((int(frequent.sum()), blocks * BLOCK), np.float32)
        often = frequent[term]
        dense[dense_at[term[often]], entry[often]] = weight[often]
        entry, term, weight = entry[~often], term[~often], weight[~often]
        order = np.argsort(term.astype(np.int64) * len(ids) + entry)
        entry, term, weight = entry[order].astype(np.int32), term[order], weight[order].astype(np.float32)
        block = entry // BLOCK
        new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
        bound = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0, np.float32)
        cells, first = np.searchsorted(term[new], np.arange(n_terms + 1)), np.append(new, len(term))
        return BlockMaxIndex(cells.astype(np.int32), block[new], bound, first.astype(np.int32), entry, weight, dense_at.astype(np.int32), dense, ids, count, positive)

    def ready(self) -> BlockMaxIndex:
        """The index with dense rows in double precision, for many queries."""
        return replace(self, dense=self.dense.astype(np.float64))

    def frequent_parts(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, low: int, high: int) -> np.ndarray:
        """(high - low, entries): what the frequent terms add to the cosines of the queries low to high."""
        part = slice(*np.searchsorted(row, (low, high)))
        row, at, weight = row[part] - low, self.dense_at[term[part]], weight[part]
        queries = np.zeros((high - low, len(self.dense)))
        queries[row[at >= 0], at[at >= 0]] = weight[at >= 0]
        return queries @ self.dense

    def nearest(self, term: np.ndarray, weight: np.ndarray, frequent: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of largest cosine above 0 with the unit vector; `without` is left out.

        Cosines count as equal when they agree in six decimals, as weights are kept in single precision; of these the
        lower number comes first.
        """
        low, high = self.cells[term], self.cells[term + 1]
        cell = spans(low, high)
        of_cell = np.repeat(weight, high - low)
        block = self.block[cell]
        rest = np.bincount(block, of_cell * self.bound[cell], minlength=len(frequent) // BLOCK)
        bound = frequent.reshape(-1, BLOCK).max(1) + rest
        if without >= 0:
            frequent = frequent.copy()
            frequent[without] = -np.inf
        # Frequent terms alone already say how large the k-th best cosine is at least.
        least = np.partition(frequent, -k)[-k] if len(frequent) > k else 0.0
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > max(least - SAME, 0))]
        best, cosine, wave = np.zeros(0, np.int64), np.zeros(0), 4
        while len(order):
            wanted = np.zeros(len(bound), bool)
            wanted[order[:wave]] = True
            now = np.flatnonzero(wanted[block])
            a, b = self.first[cell[now]], self.first[cell[now] + 1]
            at = spans(a, b)
            score = frequent + np.bincount(self.entry[at], np.repeat(of_cell[now], b - a) * self.weight[at], minlength=len(frequent))
            own = np.flatnonzero((score > max(least - SAME, SAME / 2)) & np.repeat(wanted, BLOCK))
            best, cosine = np.concatenate([best, own]), np.concatenate([cosine, np.round(score[own], 6)])
            top = np.lexsort((best, -cosine))[:k]
            best, cosine = best[top], cosine[top]
            order = order[wave:]
            if len(best) == k:
                # A block that can only tie with the last neighbour is of use if it has a lower number.
                least = max(least, cosine[-1])
                order = order[(bound[order] > least + SAME / 2) | ((bound[order] > least - SAME) & (order <= best[-1] // BLOCK))]
            wave *= 4
        return best, cosine


@dataclass
class ToxicityModel:
    """Terms (sorted hashes) with their scales, the index, what a text without known terms gets, and the calibration."""

    wanted: np.ndarray
    scale: np.ndarray
    index: BlockMaxIndex
    share: float
    neighbours: int = NEIGHBOURS
    slope: float = 1.0
    intercept: float = 0.0

    def ready(self) -> ToxicityModel:
        return replace(self, index=self.index.ready())

    def vectors(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """Weights of the postings (row, term, count), of norm 1 by row; all 0 in rows without a term of any weight."""
        weight = (1 + np.log(count)) * self.scale[term]
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=rows))
        return weight / np.where(norm > 0, norm, 1)[row]

    def votes(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, without: np.ndarray | None = None, labels: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
        """Vote and neighbours of each row's vector; each row may leave out an example: its entry (or -1) and its label."""
        out = []
        for low in range(0, rows, TOGETHER):
            high = min(low + TOGETHER, rows)
            frequent = self.index.frequent_parts(row, term, weight, low, high)
            edges = np.searchsorted(row, np.arange(low, high + 1))
            for r, i, j in zip(range(low, high), edges[:-1], edges[1:]):
                out.append(self.vote(term[i:j], weight[i:j], frequent[r - low], *(() if without is None else (int(without[r]), int(labels[r])))))
        return out

    def vote(self, term: np.ndarray, weight: np.ndarray, frequent: np.ndarray, without: int = -1, label: int = 0) -> tuple[float, np.ndarray]:
        """(share of label 1 among the neighbours, weighted by closeness and drawn towards the share of all; their numbers).

        An example may be left out: `without` is its entry, from which one of its label goes.
        """
        if not weight.any():
            return self.share, np.zeros(0, np.int64)
        index, last = self.index, without >= 0 and self.index.count[without] == 1
        near, cosine = index.nearest(term, weight, frequent, self.neighbours, without if last else -1)
        positive, count = index.positive[near].astype(float), index.count[near].astype(float)
        if without >= 0 and not last:
            own = near == without
            positive, count = positive - own * label, count - own
        closeness = 1 / (1.05 - np.minimum(cosine, 1.0))
        return float(((closeness * positive / count).sum() + self.share) / (closeness.sum() + 1)), near

    def score(self, vote: float) -> float:
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.slope * np.log(vote / (1 - vote)) + self.intercept))))


@dataclass
class Examples:
    """Labelled rows, by id: `size` distinct terms each, as numbers in `wanted` (sorted hashes), with their counts."""

    ids: np.ndarray
    labels: np.ndarray
    size: np.ndarray
    term: np.ndarray
    count: np.ndarray
    wanted: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Examples:
        rows = rows.sort_by("doc_id")
        terms, counts = (rows[c].combine_chunks() for c in ("terms", "counts"))
        hashes = terms.flatten().to_numpy().view(np.uint64)
        wanted = np.unique(hashes)
        return Examples(rows["doc_id"].to_numpy(), rows["label"].to_numpy().astype(np.int64), np.diff(terms.offsets.to_numpy()), np.searchsorted(wanted, hashes).astype(np.int32), counts.flatten().to_numpy(), wanted)

    def parts(self, rows: int = 256) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows, postings, row of each posting within these) of so many rows at a time, which keeps work arrays small."""
        edge = np.concatenate([[0], np.cumsum(self.size)])
        for a in range(0, len(self.ids), rows):
            b = min(a + rows, len(self.ids))
            yield slice(a, b), slice(edge[a], edge[b]), np.repeat(np.arange(b - a), self.size[a:b])


def assemble(examples: Examples, documents: np.ndarray, total: int, neighbours: int = NEIGHBOURS) -> tuple[ToxicityModel, np.ndarray]:
    """The uncalibrated model, and each example's entry (-1: no vector).

    documents: how many of all `total` documents hold each term.
    """
    ids, labels, wanted, term = examples.ids, examples.labels, examples.wanted, examples.term
    of = int((labels == 0).sum()), int((labels == 1).sum())
    toxic = np.repeat(labels == 1, examples.size)
    with_ = np.stack([np.bincount(term[~toxic], minlength=len(wanted)), np.bincount(term[toxic], minlength=len(wanted))], 1)
    scale = np.log((1 + total) / (1 + documents)) + 1
    if min(of):
        scale = scale * likelihood_ratio(with_, of)
    share = float((labels.sum() + 0.5) / (len(labels) + 1))
    model = ToxicityModel(wanted, scale.astype(np.float32), None, share, neighbours)

    # Equal vectors are one entry, known by two hashes; entries that share their heaviest terms stand together.
    weight, full = np.zeros(len(term), np.float32), np.zeros(len(ids), bool)
    keys, heavy = np.zeros((2, len(ids)), np.uint64), np.full((2, len(ids)), -1)
    for rows, at, row in examples.parts():
        t, n = term[at], examples.count[at].astype(np.uint64)
        w = model.vectors(row, t, n, rows.stop - rows.start)
        weight[at] = w
        full[rows] = np.bincount(row, w, minlength=rows.stop - rows.start) > 0
        for k in (0, 1):
            np.add.at(keys[k, rows], row, mix(mix(wanted[t] + np.uint64(k + 1)) + n))
        order = np.lexsort((t, -w, row))
        first = np.searchsorted(row[order], np.arange(rows.stop - rows.start))
        for k in (0, 1):
            has = np.flatnonzero(examples.size[rows] > k)
            heavy[k, rows.start + has] = t[order[first[has] + k]]
    order = np.lexsort((ids, keys[1], keys[0], heavy[1], heavy[0], ~full))[: full.sum()]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(keys[0][order]) != 0) | (np.diff(keys[1][order]) != 0)
    of_row = np.full(len(ids), -1, np.int32)
    of_row[order] = np.cumsum(new) - 1
    leader = np.zeros(len(ids), bool)
    leader[order[new]] = True
    own = np.repeat(leader, examples.size) & (weight > 0)
    count, positive = np.bincount(of_row[order]), np.bincount(of_row[order], labels[order]).astype(np.int64)
    index = BlockMaxIndex.build(np.repeat(of_row, examples.size)[own], term[own], weight[own], ids[order[new]], count, positive, len(wanted))
    empty = ~full
    return replace(model, index=index, share=float((labels[empty].sum() + 0.5) / (empty.sum() + 1)) if empty.any() else share), of_row


def calibrated(model: ToxicityModel, votes: np.ndarray, labels: np.ndarray) -> ToxicityModel:
    """The model with Platt's calibration of votes that each leave their own example out."""
    if not len(labels):
        return replace(model, share=0.5)
    if not 0 < labels.sum() < len(labels):
        return model
    p = np.clip(votes, 1e-6, 1 - 1e-6)
    slope, intercept = platt(np.log(p / (1 - p)), labels)
    return replace(model, slope=max(slope, 0.0), intercept=intercept)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, neighbours: int = NEIGHBOURS) -> ToxicityModel:
    """Terms and examples from at most `rows` labelled documents outside the held-out fold, frequencies from all documents."""
    spark = docs.sparkSession
    texts = training_sample(docs, labels, label, folds, held, rows)
    sample = cut(texts.mapInArrow(_counted, "doc_id long, label int, terms array<long>, counts array<int>"), "examples")
    release(texts)
    examples = Examples.of(sample.toArrow())
    held_by = base_view(docs).select("text").mapInArrow(_present(examples.wanted), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = held_by["term"].to_numpy(), held_by["n"].to_numpy()
    documents = np.zeros(len(examples.wanted), np.int64)
    documents[term[term >= 0]] = n[term >= 0]
    model, entry = assemble(examples, documents, int(n[term < 0].sum()), neighbours)
    shared = spark.sparkContext.broadcast((model, examples.ids, entry))
    del examples

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids, of_row = shared.value
        m = m.ready()
        for batch in batches:
            of = of_row[np.searchsorted(ids, batch["doc_id"].to_numpy())]
            n = np.diff(batch["terms"].offsets.to_numpy())
            row, term = np.repeat(np.arange(len(n)), n), np.searchsorted(m.wanted, batch["terms"].flatten().to_numpy().view(np.uint64))
            weight = m.vectors(row, term, batch["counts"].flatten().to_numpy(), len(n))
            votes = [vote for vote, _ in m.votes(row, term, weight, len(n), of, batch["label"].to_numpy())]
            yield pa.record_batch([pa.array(votes, pa.float64()), batch["label"]], ["vote", "label"])

    votes = sample.repartition(CALIBRATION_TASKS).mapInArrow(left_out, "vote double, label int").toArrow()
    shared.destroy()
    release(sample)
    return calibrated(model, votes["vote"].to_numpy(), votes["label"].to_numpy())


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples, closest first) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.ready()
        find = Finder(m.wanted)
        for batch in batches:
            texts = as_strings(batch["text"])
            for a, b in text_chunks(texts):
                row, term, count = find(terms(texts.slice(a, b - a)))
                weight = m.vectors(row, term, count, b - a)
                found = m.votes(row, term, weight, b - a)
                score = pa.array([m.score(vote) for vote, _ in found], pa.float64())
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), score, pa.array([m.index.ids[near] for _, near in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return base_view(docs).mapInArrow(run, "doc_id long, score double, evidence array<long>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted, evidence.

    Needs doc_id and text of docs, doc_id and toxic of labels; other columns are never read. A null text counts
    as empty, a null id as not held out. Texts without a term of the examples, empty ones too, get the calibrated
    share of label 1 among examples without terms, or of all examples if each has one. Rows that repeat get equal
    scores, an empty table gives an empty result, and without labels every score is 0.5.
    """
    with small_batches(docs.sparkSession):
        scored = score_toxicity(docs, train_toxicity(docs, labels, folds=folds, held=held, rows=rows))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
