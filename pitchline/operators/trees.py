"""Multiclass boosted trees on histograms of gradients that Spark sums, one aggregation for a level of all classes' trees.

Spark ML has binary boosting only, so three one-against-rest ensembles and a job for each level of each tree; here the
trees of all classes grow together on the softmax loss, and a missing value takes the side of each split that gains more.
Rows are binned once, into a written table of blocks. A level is one pass over the blocks, which leaves one array of
(class, node, feature, bin) sums whatever the number of rows; arrays are added pairwise among tasks, and only the total,
whose size is fixed, reaches the driver, which picks the splits. Tasks know the trees so far and so every row's scores;
now and then these are kept, so that a pass applies few trees. Gradients are whole numbers of 2 ** -30: sums are exact,
and the forest is the same however rows are split among tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialised, released

#: Bins of a feature's histogram; the last one holds missing values.
BINS = 256
#: Rows of a block, and about as many of a task's share; rounds until scores are kept again; fineness of gradients.
BLOCK, REFRESH, FINE = 1 << 16, 10, float(1 << 30)


@dataclass(frozen=True)
class Forest:
    """Trees by round and class: splits of the inner nodes level by level (value, feature, side of nulls) and leaves."""

    classes: tuple[int, ...]
    feature: np.ndarray  # (rounds, classes, inner nodes)
    value: np.ndarray
    nulls_left: np.ndarray
    leaf: np.ndarray  # (rounds, classes, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): sums of the leaves that each row of x (features, nan for null) falls into."""
        rounds, classes, inner = self.feature.shape
        out = np.zeros((len(x), classes))
        rows, empty = np.arange(len(x)), np.isnan(x)
        depth = (inner + 1).bit_length() - 1
        for r in range(rounds):
            for k in range(classes):
                node = np.zeros(len(x), np.int64)
                for level in range(depth):
                    at = node + (1 << level) - 1
                    f = self.feature[r, k, at]
                    left = np.where(empty[rows, f], self.nulls_left[r, k, at], x[rows, f] <= self.value[r, k, at])
                    node = 2 * node + ~left
                out[:, k] += self.leaf[r, k, node]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, 3); a class that was never seen has 0."""
        out = np.zeros((len(x), 3))
        out[:, list(self.classes)] = softmax(self.raw(x))
        return out

    def as_dict(self) -> dict:
        return {"classes": list(self.classes)} | {k: getattr(self, k).tolist() for k in ("feature", "value", "nulls_left", "leaf")}

    @staticmethod
    def from_dict(d: dict) -> Forest:
        return Forest(tuple(d["classes"]), np.array(d["feature"], np.int64), np.array(d["value"], float), np.array(d["nulls_left"], bool), np.array(d["leaf"], float))


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Each value's bin: bin b of a feature holds values up to edges[b], the last known bin all others, BINS - 1 the missing ones."""
    out = np.full(x.shape, BINS - 1, np.uint8)
    for f, values in enumerate(edges):
        known = ~np.isnan(x[:, f])
        out[known, f] = np.minimum(np.searchsorted(values, x[known, f]), max(len(values) - 1, 0))
    return out


def quantiles(x: np.ndarray) -> list[np.ndarray]:
    """At most BINS - 1 edges of each feature's bins: all its values, or quantiles if there are more."""
    out = []
    for f in range(x.shape[1]):
        known = x[~np.isnan(x[:, f]), f]
        values = np.unique(known)
        out.append(values if len(values) < BINS else np.unique(np.quantile(known, np.linspace(0, 1, BINS)[1:], method="higher")))
    return out


#: A tree in bins: (feature, last bin on the left, nulls go left) of the inner nodes, level by level.
Splits = list[tuple[int, int, bool]]


def nodes_of(bins: np.ndarray, splits: Splits, node: np.ndarray | None = None, done: int = 0) -> np.ndarray:
    """The node of each row, a column of bins, on the level below the splits; node is known below the first `done` of them."""
    rows = np.arange(bins.shape[1])
    while done < len(splits):
        level = splits[done : 2 * done + 1]
        # For each node and bin whether rows go right.
        right = np.array([[not side if b == BINS - 1 and last < BINS else b > last for b in range(BINS)] for _, last, side in level])
        if done == 0:
            node = right[0][bins[level[0][0]]].astype(np.intp)
        else:
            own = bins[np.array([f for f, _, _ in level])[node], rows]
            node = 2 * node + right[node, own]
        done = 2 * done + 1
    return np.zeros(bins.shape[1], np.intp) if node is None else node


@dataclass
class Block:
    """Rows of a task: bins by feature, labels as places among the classes, and scores under the trees of all rounds before `seen`."""

    bins: np.ndarray
    label: np.ndarray
    raw: np.ndarray
    seen: int = 0

    def after(self, grown: list[tuple[list[Splits], np.ndarray]], first: int) -> Block:
        """The block with its scores under grown, whose first round is `first`, too."""
        raw = self.raw.copy()
        for splits, leaf in grown[self.seen - first :]:
            for k, tree in enumerate(splits):
                raw[:, k] += leaf[k, self.nodes(k, tree)]
        return Block(self.bins, self.label, raw, first + len(grown))

    def nodes(self, k: int, splits: Splits) -> np.ndarray:
        """The node of each row below the splits of class k; the last answer is kept, as trees grow level by level."""
        known = self.__dict__.setdefault("_nodes", {})
        before, node = known.get(k, ([], None))
        if before != splits[: len(before)]:
            before, node = [], None
        node = nodes_of(self.bins, splits, node, len(before))
        known[k] = splits, node
        return node

    def slopes(self) -> np.ndarray:
        """(class, 2, row): first and second derivatives as whole numbers."""
        if "_slopes" not in self.__dict__:
            p = softmax(self.raw).T
            first = p - (self.label == np.arange(len(p))[:, None])
            self._slopes = np.rint(np.stack([first, np.maximum(2 * p * (1 - p), 1e-16)], 1) * FINE)
        return self._slopes

    def sums(self, growing: list[Splits], wanted: list[list[int]]) -> np.ndarray:
        """(class, wanted node, feature, bin, 2): whole-number sums of first and second derivatives of nodes on the level to be split."""
        width, n = self.bins.shape
        out = np.empty((len(growing), len(wanted[0]), width, BINS, 2), np.int64)
        for k, slopes in enumerate(self.slopes()):
            node = self.nodes(k, growing[k])
            for at, i in enumerate(wanted[k]):
                rows = np.flatnonzero(node == i)
                # A feature at a time: its cells are few enough to stay near the processor.
                bins = self.wide() if len(rows) == n else np.take(self.bins, rows, 1).astype(np.intp)
                for d in range(2):
                    v = slopes[d] if len(rows) == n else slopes[d][rows]
                    for f in range(width):
                        # Doubles hold these sums exactly: a block has few rows.
                        out[k, at, f, :, d] = np.bincount(bins[f], v, BINS)
        return out

    def wide(self) -> np.ndarray:
        """The bins as bincount takes them."""
        if "_wide" not in self.__dict__:
            self._wide = self.bins.astype(np.intp)
        return self._wide


def _chosen(sums: np.ndarray, penalty: float, least: float) -> tuple[Splits, np.ndarray]:
    """The best split of each node by its (node, feature, bin, 2) sums, and the sums (2, node, side) on either side of it."""
    g, h = np.moveaxis(sums / FINE, -1, 0)
    nodes = len(g)
    total, empty = np.stack([v.sum(2)[:, :1, None] for v in (g, h)]), np.stack([v[..., BINS - 1 :] for v in (g, h)])
    left = np.cumsum(np.stack([g, h])[..., : BINS - 1], 3)
    best, choice = np.zeros(nodes), [(0, BINS, True)] * nodes
    sides = np.stack([total[:, :, 0, 0], np.zeros((2, nodes))], 2)
    for nulls_left in (False, True):
        gl, hl = left + empty if nulls_left else left
        gr, hr = total[0] - gl, total[1] - hl
        gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - total[0] ** 2 / (total[1] + penalty)
        gain = np.where((hl >= least) & (hr >= least), gain, -np.inf).reshape(nodes, -1)
        for i, at in enumerate(gain.argmax(1)):
            if gain[i, at] > best[i] + 1e-12:
                best[i], choice[i] = gain[i, at], (int(at) // (BINS - 1), int(at) % (BINS - 1), nulls_left)
                for d, (a, b) in enumerate(((gl, gr), (hl, hr))):
                    sides[d, i] = a.reshape(nodes, -1)[i, at], b.reshape(nodes, -1)[i, at]
    return choice, sides


def _both(parents: np.ndarray | None, sums: np.ndarray, wanted: list[list[int]]) -> np.ndarray:
    """(class, node, feature, bin, 2) of all nodes of a level by those of the level above and of one node of each split."""
    if parents is None:
        return sums
    out = np.empty((len(sums), 2 * parents.shape[1], *sums.shape[2:]), sums.dtype)
    for k, nodes in enumerate(wanted):
        at = np.array(nodes)
        out[k, at], out[k, at ^ 1] = sums[k], parents[k] - sums[k]
    return out


def boosted(level_sums: Callable[[list[tuple[list[Splits], np.ndarray]], list[Splits], list[list[int]]], np.ndarray], classes: tuple[int, ...], edges: list[np.ndarray], rounds: int, depth: int, rate: float, penalty: float, least: float) -> Forest:
    """Grow a forest; level_sums(trees so far, splits of the growing trees, nodes) gives the sums of Block over all rows."""
    inner = (1 << depth) - 1
    shape = (rounds, len(classes), inner)
    feature, value, nulls, leaf = np.zeros(shape, np.int64), np.full(shape, np.inf), np.ones(shape, bool), np.zeros((rounds, len(classes), inner + 1))
    grown: list[tuple[list[Splits], np.ndarray]] = []
    for r in range(rounds):
        growing: list[Splits] = [[] for _ in classes]
        sums = found = None
        for _ in range(depth):
            # Of two nodes that one split makes only one is summed up, the one with less of the second derivatives; sums are exact.
            wanted = [[2 * i + int(h[0] > h[1]) for i, h in enumerate(sides[1])] for _, sides in found] if found else [[0]] * len(classes)
            sums = _both(sums, level_sums(grown, growing, wanted), wanted)
            found = [_chosen(sums[k], penalty, least) for k in range(len(classes))]
            growing = [splits + new for splits, (new, _) in zip(growing, found)]
        for k, (_, sides) in enumerate(found):
            leaf[r, k] = (-rate * sides[0] / (sides[1] + penalty)).ravel()
            for i, (f, last, side) in enumerate(growing[k]):
                if last < BINS and len(edges[f]):
                    feature[r, k, i], value[r, k, i], nulls[r, k, i] = f, edges[f][min(last, len(edges[f]) - 1)], side
        grown.append((growing, leaf[r]))
    return Forest(classes, feature, value, nulls, leaf)


def _on_one(block: Block, *growth) -> Forest:
    """Grow on the rows of one block."""

    def level_sums(grown: list, growing: list[Splits], wanted: list[list[int]]) -> np.ndarray:
        nonlocal block
        if block.seen < len(grown):
            old, block = block, block.after(grown, 0)
            block._wide = old.wide()
        return block.sums(growing, wanted)

    return boosted(level_sums, *growth)


def fit_forest(x: np.ndarray, label: np.ndarray, rounds: int, depth: int, rate: float, penalty: float = 1.0, least: float = 1.0, edges: list[np.ndarray] | None = None) -> Forest:
    """Boost on rows x in memory (nan for null) with labels 0 to 2; penalty is on squared leaves, least a side's sum of second derivatives."""
    classes = tuple(int(c) for c in np.unique(label))
    edges = quantiles(x) if edges is None else edges
    block = Block(np.ascontiguousarray(binned(x, edges).T), np.searchsorted(classes, label), np.zeros((len(x), len(classes))))
    return _on_one(block, classes, edges, rounds, depth, rate, penalty, least)


def _matrix(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]).astype(float)


def feature_edges(data: DataFrame, features: tuple[str, ...]) -> list[np.ndarray]:
    """Edges of every feature's bins, from sketches of bounded size: all values of up to BINS - 1 equally frequent ones, or quantiles."""
    at = F.array(*[F.lit((k + 1) / (BINS - 1)) for k in range(BINS - 1)])
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    row = data.agg(*[F.percentile_approx(known(c), at, F.lit(100 * BINS)).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(v if v is not None else [], float)) for v in row]


def _blocks(features: tuple[str, ...], classes: tuple[int, ...], edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            x, label = (np.concatenate(v) for v in zip(*held))
            return pa.record_batch([pa.array([binned(x, edges).tobytes()], pa.binary()), pa.array([np.searchsorted(classes, label).astype(np.uint8).tobytes()], pa.binary())], ["bins", "label"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if held and size + part.num_rows > BLOCK:
                    yield block()
                    held, size = [], 0
                held.append((_matrix(part, features), part["__label"].to_numpy()))
                size += part.num_rows
        if held:
            yield block()

    return run


def train(rows: DataFrame, features: tuple[str, ...], rounds: int, depth: int, rate: float, penalty: float = 1.0, least: float = 1.0) -> Forest:
    """Fit on all rows (features and __label), however many; a task has about BLOCK of them, or more if there are very many.

    Lost blocks are made again from their written table and the trees so far. The rows of a table of one block are one
    task's share anyway: there the task grows the same trees itself, without a job for each level.
    """
    data = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col("__label").cast("int").alias("__label"))
    counts = {r["__label"]: r["count"] for r in data.groupBy("__label").count().collect()}
    if not counts:
        raise ValueError("no labelled rows to fit on")
    classes = tuple(sorted(counts))
    edges, width = feature_edges(data, features), len(features)
    parts = min(-(-sum(counts.values()) // BLOCK), 100_000)
    table = materialised(data.repartition(parts).mapInArrow(_blocks(features, classes, edges), "bins binary, label binary"), "bins")

    def block(row) -> Block:
        label = np.frombuffer(row["label"], np.uint8)
        return Block(np.ascontiguousarray(np.frombuffer(row["bins"], np.uint8).reshape(len(label), width).T), label, np.zeros((len(label), len(classes))))

    growth = (classes, edges, rounds, depth, rate, penalty, least)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.record_batch([pa.array([json.dumps(_on_one(block(row), *growth).as_dict())])], ["forest"])

    if parts == 1:
        forest = Forest.from_dict(json.loads(table.mapInArrow(here, "forest string").first()["forest"]))
        released(table)
        return forest
    base = table.rdd.map(block)
    kept, seen = base.persist(StorageLevel.MEMORY_AND_DISK), 0

    def level_sums(grown: list, growing: list[Splits], wanted: list[list[int]]) -> np.ndarray:
        nonlocal kept, seen
        if len(grown) >= seen + REFRESH:
            # Always from the first blocks: a lost part needs all trees once, not a chain of kept scores.
            so_far, seen = list(grown), len(grown)
            old, kept = kept, table.rdd.map(block).map(lambda b: b.after(so_far, 0)).persist(StorageLevel.MEMORY_AND_DISK)
            kept.count()
            old.unpersist()
        new, first = grown[seen:], seen
        found = kept.map(lambda b: b.after(new, first).sums(growing, wanted))
        return found.treeReduce(np.add, 2) if parts > 8 else found.reduce(np.add)

    forest = boosted(level_sums, *growth)
    kept.unpersist()
    released(table)
    return forest


def predicted(df: DataFrame, forest: Forest, features: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """df with the three probabilities under `names`."""

    @F.pandas_udf("array<double>")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(forest.probabilities(x.to_numpy(dtype=float, na_value=np.nan))))

    out = df.withColumn("__p", score(F.struct(*[F.col(c).cast("double").alias(c) for c in features])))
    return out.withColumns({name: F.get("__p", F.lit(k)) for k, name in enumerate(names)}).drop("__p")
