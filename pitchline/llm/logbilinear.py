"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, normalised when it scores.

A token's probability is that of its class, given the classes before it, times its share within its class. The most
frequent words and the end of a text are classes of their own; all other words, unknown ones too, share classes by their
endings, so the softmax has a fixed width while the vocabulary is that of the whole corpus. A class's score is the dot
product of its vector with the sum of the context's vectors, each weighted by its place (Mnih and Hinton 2007; Mnih and
Teh 2012). Training sees every training text once: in each of a few rounds tasks start from the same parameters, pass
over their share of the round's texts in numpy, against noise drawn from the classes' shares, and the parameters are
averaged by tokens in an aggregation. Scoring multiplies batches of contexts with all class vectors and normalises.

Words become numbers in chunks of texts, each with its own dictionary; counts over the whole corpus come back to the
chunks by joins on words. The driver holds the parameters, whose number is fixed, and the classes' totals.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import base_view, cut, release, settings, small_batches

#: Words that are classes of their own, classes of endings, size of vectors, words of context.
TOP, ENDINGS, SIZE, CONTEXT = 95, 160, 16, 5
#: Rounds of averaging, noise classes a batch, tokens a batch, step size. Each training text is in one round.
ROUNDS, NOISE, BATCH, STEP = 4, 64, 2048, 0.1
#: Bytes of text that share a dictionary; a longer text has its own.
CHUNK = 4 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PACKED = "zstd"
_TINY = 1e-6


# --- words as numbers ------------------------------------------------------------------------------------------------

_ENCODED = "docs array<long>, held array<boolean>, sizes array<int>, ids binary, words array<string>, n array<long>"
_CLASSED = "docs array<long>, held array<boolean>, sizes array<int>, classes binary, base array<double>, inner array<double>, known array<long>"


def _record(values: list, schema: str) -> pa.RecordBatch:
    types = {"array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
    names = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array([v], types[t]) for v, (_, t) in zip(values, names)], [n for n, _ in names])


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids byte by byte of their places, compressed: frequent words have small ids, so most high bytes are 0."""
    return pa.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), _PACKED, asbytes=True)


def unpacked_ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, _PACKED, asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def _encoded(folds: int, held: int, most: int):
    def chunk(rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        ids, out = [], [d is not None and zlib.crc32(str(d).encode()) % folds == held for d, _ in rows]
        for _, text in rows:
            ids.append(np.array([known.setdefault(w, len(known)) for w in _WORD.findall(text)], np.int32))
        n = np.bincount(np.concatenate([np.zeros(0, np.int32), *[v for v, h in zip(ids, out) if not h]]), minlength=len(known))
        words = pa.array(list(known), pa.binary()).cast(pa.string())
        return _record([[d for d, _ in rows], out, [len(v) for v in ids], packed_ids(np.concatenate(ids)), words, n], _ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for d, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                if rows and size + len(text) > most:
                    yield chunk(rows)
                    rows, size = [], 0
                rows.append((d, text.lower()))
                size += len(text)
        if rows:
            yield chunk(rows)

    return run


def encoded(docs: DataFrame, folds: int, held: int, most: int = CHUNK) -> DataFrame:
    """Chunks of texts with a dictionary of their own: ids of words, and each word's count in the training texts."""
    view = base_view(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return view.mapInArrow(_encoded(folds, held, most), _ENCODED).withColumn("chunk", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Vocabulary:
    """What is known of all training tokens: their number, that of texts, of types, and of both by class of endings."""

    tokens: int
    texts: int
    types: int
    top: tuple[str, ...]
    class_tokens: tuple[int, ...]
    class_types: tuple[int, ...]

    @property
    def base(self) -> int:
        """What a token's count + 1 is divided by in the unigram base."""
        return self.tokens + self.types + 1

    def shares(self) -> np.ndarray:
        """The classes' smoothed shares of the training tokens: the noise."""
        n = np.array(self.class_tokens, float) + 1
        return n / n.sum()


def _class_of(word: Column, own: Column, top: int, endings: int) -> Column:
    """0 is the end of a text, then come the words of their own, then the endings."""
    return F.coalesce(own, (F.lit(1 + top) + F.crc32(F.right(word, F.lit(2)).cast("binary")) % F.lit(endings)).cast("int"))


def _top_frame(df: DataFrame, top: tuple[str, ...]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(w, k + 1) for k, w in enumerate(top)], "word string, own int"))


def vocabulary(chunks: DataFrame, counts: DataFrame, top: int = TOP, endings: int = ENDINGS) -> Vocabulary:
    """Totals over counts (word, n) and the training texts of chunks; one row a class reaches the driver."""
    first = tuple(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(top).collect())
    top = len(first)
    texts = chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    classes = counts.join(_top_frame(counts, first), "word", "left").groupBy(_class_of(F.col("word"), F.col("own"), top, endings).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
    n, types = [texts] + [0] * (top + endings), [int(texts > 0)] + [0] * (top + endings)
    for row in classes.collect():
        n[row["k"]], types[row["k"]] = row["n"], row["types"]
    return Vocabulary(sum(n), texts, sum(types), first, tuple(n), tuple(types))


def classed(chunks: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Chunks with classes for words, and for each text its base score, log shares within classes, and known tokens.

    Each chunk's words meet the corpus's counts by a join on words, then their chunk again by its number. All but the end
    of the text is in these sums.
    """
    top = len(vocab.top)
    endings = len(vocab.class_tokens) - 1 - top
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("at", "word"))
    classes = len(vocab.class_tokens)
    slot = F.col("at").cast("long") * classes + _class_of(F.col("word"), F.col("own"), top, endings)
    told = asked.join(counts, "word", "left").join(_top_frame(chunks, vocab.top), "word", "left").select("of", slot.alias("slot"), F.coalesce("n", F.lit(0)).alias("n"))
    whole = np.array(vocab.class_tokens, float) + np.array(vocab.class_types, float) + 1
    whole[: 1 + top] = 0

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        n, k = np.zeros(words.num_rows, np.int64), np.zeros(words.num_rows, np.uint16)
        at, own = np.divmod(words["slot"].to_numpy(), classes)
        n[at], k[at] = words["n"].to_numpy(), own
        inner = np.where(whole[k] > 0, np.log((n + 1) / np.maximum(whole[k], 1)), 0.0)
        base = np.log10((n + 1) / vocab.base)
        row = texts.to_pylist()[0]
        ends = np.cumsum([0, *row["sizes"]])
        ids = unpacked_ids(row["ids"], int(ends[-1]))
        sums = [[v[ids[a:b]].sum() for a, b in zip(ends[:-1], ends[1:])] for v in (base, inner, (n > 0).astype(np.int64))]
        return pa.Table.from_batches([_record([row["docs"], row["held"], row["sizes"], k[ids].astype("<u2").tobytes(), *sums], _CLASSED)])

    return chunks.select("chunk", "docs", "held", "sizes", "ids").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(run, _CLASSED)


# --- the model -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parameters:
    """Vectors of context classes (the last one stands before a text), of target classes, biases, weights by place, and squared slopes so far."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray
    slopes: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in (self.context, self.target, self.bias, self.place, self.slopes)]).astype(float)

    def like(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for v in (self.context, self.target, self.bias, self.place, self.slopes):
            out.append(flat[at : at + v.size].reshape(v.shape).astype(np.float32))
            at += v.size
        return Parameters(*out)


def start(shares: np.ndarray, size: int = SIZE, context: int = CONTEXT, seed: int = 1) -> Parameters:
    """Small random vectors, and biases that make every context's distribution the classes' shares."""
    rng, k = np.random.default_rng(seed), len(shares)
    draw = lambda n: (0.1 * rng.normal(size=(n, size))).astype(np.float32)
    return Parameters(draw(k + 1), draw(k), np.log(shares).astype(np.float32), np.ones((context, size), np.float32), np.full(3 * k + 1 + context * size, _TINY, np.float32))


def windows(classes: np.ndarray, sizes: np.ndarray, context: int, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, targets) of all tokens of texts one after another; each text ends with target 0; nearest word first."""
    sizes = np.asarray(sizes, np.int64)
    begins = np.cumsum(sizes + context + 1) - sizes - 1
    seq = np.full(int((sizes + context + 1).sum()), outside, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    seq[begins[of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = classes
    seq[begins + sizes] = 0
    at = np.repeat(begins, sizes + 1) + np.arange(int((sizes + 1).sum())) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    return seq[at[:, None] - np.arange(1, context + 1)], seq[at]


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    # Classes fit in 16 bits, which numpy sorts by counting.
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive steps on batches of tokens: each tells its target from noise classes that the batch shares."""

    def __init__(self, p: Parameters, shares: np.ndarray, noise: int = NOISE, step: float = STEP, seed: int = 0):
        self.p = Parameters(*[v.copy() for v in (p.context, p.target, p.bias, p.place, p.slopes)])
        k = len(shares)
        self.slopes = np.split(self.p.slopes, [k + 1, 2 * k + 1, 3 * k + 1])
        self.shares, self.noise, self.step = shares, noise, step
        self.odds = np.log(shares * noise).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def _climb(self, values: np.ndarray, slopes: np.ndarray, rows, by: np.ndarray) -> None:
        slopes[rows] += (by * by).mean(1) if by.ndim == 2 else by * by
        scale = self.step / np.sqrt(slopes[rows])
        values[rows] += by * (scale[:, None] if by.ndim == 2 else scale)

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        p = self.p
        near = p.context[x]
        h = np.einsum("bmd,md->bd", near, p.place)
        z = self.rng.choice(len(self.shares), self.noise, p=self.shares)
        own, others = p.target[y], p.target[z]
        true = np.einsum("bd,bd->b", h, own) + p.bias[y] - self.odds[y]
        false = h @ others.T
        false += p.bias[z] - self.odds[z]
        with np.errstate(over="ignore"):
            up = 1 / (1 + np.exp(true))
            np.exp(np.negative(false, out=false), out=false)
        false += 1
        down = np.divide(-1, false, out=false)
        back = up[:, None] * own + down @ others
        rows, by = _by_row(np.concatenate([y, z]), np.concatenate([np.column_stack([up[:, None] * h, up]), np.column_stack([down.T @ h, down.sum(0)])]))
        place = np.einsum("bd,bmd->md", back, near)
        which, moved = _by_row(x.ravel(), (back[:, None, :] * p.place).reshape(-1, h.shape[1]))
        self._climb(p.target, self.slopes[1], rows, by[:, :-1])
        self._climb(p.bias, self.slopes[2], rows, by[:, -1])
        self._climb(p.context, self.slopes[0], which, moved)
        self._climb(p.place.reshape(-1), self.slopes[3], slice(None), place.ravel())
        self.tokens += len(y)

    def parameters(self) -> Parameters:
        return replace(self.p, slopes=np.concatenate(self.slopes))


def _row_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["classes"], "<u2").astype(np.int64), np.array(row["sizes"], np.int64), np.array(row["held"], bool)


def _trained(p: Parameters, shares: np.ndarray, turn: int, rounds: int, batch_size: int):
    """A task's pass over its share of one round; its parameters leave as (number, weighted value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(p, shares, seed=turn)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in batch.to_pylist():
                classes, sizes, out = _row_arrays(row)
                mine = ~out & (np.arange(len(sizes)) % rounds == turn)
                x, y = windows(classes[np.repeat(mine, sizes)], sizes[mine], len(p.place), len(shares))
                held.append((x, y))
                x, y = (np.concatenate(v) for v in zip(*held))
                whole = len(y) // batch_size * batch_size
                for a in range(0, whole, batch_size):
                    trainer.learn(x[a : a + batch_size], y[a : a + batch_size])
                held = [(x[whole:], y[whole:])]
        if held and len(held[0][1]):
            trainer.learn(*held[0])
        if trainer.tokens:
            flat = trainer.parameters().flat()
            n = float(trainer.tokens)
            yield pa.record_batch([pa.array(np.arange(-1, len(flat))), pa.array(np.concatenate([[n], flat * n]))], ["at", "value"])

    return run


def train(texts: DataFrame, vocab: Vocabulary, size: int = SIZE, context: int = CONTEXT, rounds: int = ROUNDS, batch_size: int = BATCH) -> Parameters:
    """Parameters after all training texts of `classed` rows were seen once, in rounds of averaged passes."""
    shares = vocab.shares()
    p = start(shares, size, context)
    for turn in range(rounds):
        found = texts.select("sizes", "held", "classes").mapInArrow(_trained(p, shares, turn, rounds, batch_size), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")
        if len(found):
            value = found["value"].to_numpy()
            p = p.like(value[1:] / value[0])
    return p


class Scorer:
    """Scores of all classes for batches of contexts, by one matrix product a batch."""

    def __init__(self, p: Parameters):
        # One more coordinate, 1 in the nearest word's vector, adds the bias.
        self.context = [np.column_stack([p.context * w, np.full(len(p.context), j == 0)]).astype(np.float32) for j, w in enumerate(p.place)]
        self.target = np.column_stack([p.target, p.bias]).T.astype(np.float32, order="C")

    def raw(self, x: np.ndarray) -> np.ndarray:
        h = self.context[0][x[:, 0]]
        for j in range(1, len(self.context)):
            h += self.context[j][x[:, j]]
        return h @ self.target

    def target_logs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of classes y: their scores less the log of the sum over all classes."""
        score = self.raw(x)
        if score.max(initial=0) > 60:
            score -= score.max(1, keepdims=True)
        own = score[np.arange(len(y)), y]
        return own - np.log(np.exp(score, out=score).sum(1))


def class_log_probabilities(p: Parameters, x: np.ndarray) -> np.ndarray:
    """Natural logs of every class's probability for each context: rows of exponentials sum to one."""
    score = Scorer(p).raw(x).astype(float)
    score -= score.max(1, keepdims=True)
    return score - np.log(np.exp(score).sum(1, keepdims=True))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(p: Parameters, vocab: Vocabulary, batch_size: int):
    end = np.log10((vocab.texts + 1) / vocab.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(p)
        for batch in batches:
            for row in batch.to_pylist():
                classes, sizes, held = _row_arrays(row)
                firsts = np.cumsum(sizes) - sizes
                logs = np.zeros(len(sizes))
                # Texts of about a million tokens at a time.
                a = 0
                while a < len(sizes):
                    b = max(int(np.searchsorted(firsts + sizes, firsts[a] + (1 << 20), "right")), a + 1)
                    x, y = windows(classes[firsts[a] : firsts[b - 1] + sizes[b - 1]], sizes[a:b], len(p.place), len(p.target))
                    of = np.repeat(np.arange(b - a), sizes[a:b] + 1)
                    own = [scorer.target_logs(x[i : i + batch_size], y[i : i + batch_size]) for i in range(0, len(y), batch_size)]
                    logs[a:b] = np.bincount(of, np.concatenate(own), b - a)
                    a = b
                known = np.array(row["known"], np.int64) + (vocab.texts > 0)
                values = [pa.array(row["docs"], pa.int64()), pa.array(held), pa.array(sizes + 1), pa.array(known), pa.array(np.full(len(sizes), vocab.tokens)), pa.array(np.array(row["base"]) + end), pa.array((logs + np.array(row["inner"])) / np.log(10))]
                yield pa.record_batch(values, [c.split()[0] for c in _SCORES.split(", ")])

    return run


def score(texts: DataFrame, p: Parameters, vocab: Vocabulary, batch_size: int = BATCH) -> DataFrame:
    """The scores of every text of `classed` rows."""
    return texts.mapInArrow(_scored(p, vocab, batch_size), _SCORES)


def language_scores(docs: DataFrame, folds: int = 7, held: int = 2, size: int = SIZE, context: int = CONTEXT, rounds: int = ROUNDS, top: int = TOP, endings: int = ENDINGS) -> DataFrame:
    """Log10 probabilities of every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A-Z lower-cased, and the end of the text. Training texts are those whose crc32(doc_id as text)
    modulo folds isn't `held`; base_score is their add-one unigram model's. In the model an unknown word has one smoothed
    share of the class of its ending, so for any context the known words and one unknown word of each class sum to one.

    Needs doc_id and text, other columns are ignored. A null text counts as empty: only its end is scored. A text with a
    null id is a training text. Repeated rows are scored and counted as often as they stand; an empty table gives an empty
    result; without training texts every class is as likely.
    """
    spark = docs.sparkSession
    written = {"spark.sql.parquet.compression.codec": "zstd"}
    with small_batches(spark), settings(spark, written):
        chunks = cut(encoded(docs, folds, held), "encoded")
    # Shuffle files go when the job of a written table ends: no job reads another's.
    with small_batches(spark, 1 << 16), settings(spark, written | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        counts = chunks.select(F.explode(F.arrays_zip("words", "n")).alias("w")).where("w.n > 0").groupBy(F.col("w.words").alias("word")).agg(F.sum("w.n").alias("n"))
        counts = cut(counts, "counts")
        vocab = vocabulary(chunks, counts, top, endings)
        texts = cut(classed(chunks, counts, vocab), "classed")
        release(chunks, counts)
    with small_batches(spark, 16):
        p = train(texts, vocab, size, context, rounds)
    return score(texts, p, vocab)
