"""Periodic runs of words: all maximal repetitions of every text by suffix arrays, LZ blocks and Main's extensions.

Texts of an Arrow batch are handled together, chunk by chunk, as one sequence in which words of different texts never
match. Prefix doubling gives the suffix array; its ranks, one array for each doubling, are kept, so that the common
extension of any two places, to either side, is a few vectorised comparisons. LCP values of neighbours in the suffix
array give the longest-previous-factor array (Crochemore and Ilie 2008), whose jumps are the LZ blocks. A run that
touches a block's edge is found there by extending to both sides from every possible period (Main 1989); a run strictly
inside a block is the copy of one that starts earlier, taken from buckets by start (Kolpakov and Kucherov 1999).

One task holds one text at a time, or several of about a megabyte together; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, as_strings, base_view, text_chunks

#: Pairs of places whose extensions are compared in one vectorised step.
STEP = 1 << 19
_WORD = re.compile(WORD)


def doubled_ranks(ids: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks): ranks[k][i] is the same for equal stretches of 2 ** k words; end[i] is where i's text ends.

    Ids of different texts differ. Only groups that are still open are sorted again; the last, all-different, ranks are left out.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    head = np.ones(n + 1, bool)
    head[1:n] = own[1:] != own[:-1]
    slots = np.arange(n)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head[:n], slots, 0))
    ranks, width = [], 1
    open_ = np.flatnonzero(~(head[:n] & head[1:]))
    while len(open_):
        ranks.append(rank)
        at = order[open_]
        other = at + width
        key = rank[at].astype(np.int64) * (n + 1) + np.where(other < end[at], rank[np.minimum(other, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[open_] = new
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        width *= 2
        open_ = open_[~(head[open_] & head[open_ + 1])]
    return order, ranks


def ahead(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree from places i and j (i < j) onward; a place may be one past the last."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        b = j + out
        inside = b < len(ranks[k])
        same = inside & (ranks[k][i + out] == ranks[k][np.where(inside, b, 0)])
        out[same] += 1 << k
    return out


def behind(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that agree before places i and j (i < j)."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a = i - out - (1 << k)
        same = (a >= 0) & (ranks[k][np.maximum(a, 0)] == ranks[k][np.maximum(j - out - (1 << k), 0)])
        out[same] += 1 << k
    return out


def previous_factors(order: np.ndarray, ranks: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """(lengths, sources): the longest stretch from each place that also starts earlier, and where (-1: none).

    Places are taken out of the suffix order from last to first; what is then beside a place starts before it.
    Words that stand once in their text have length 0 and need no step.
    """
    n = len(order)
    length, source = [0] * n, [-1] * n
    if not ranks:
        return length, source
    own = ranks[0][order]
    twice = np.zeros(n, bool)
    twice[1:] = own[1:] == own[:-1]
    twice[:-1] |= twice[1:]
    places = order[twice]
    common = np.zeros(len(places) + 1, np.int64)
    for a in range(1, len(places), STEP):
        x, y = places[a - 1 : min(a + STEP, len(places)) - 1], places[a : a + STEP]
        common[a : a + len(x)] = ahead(ranks, np.minimum(x, y), np.maximum(x, y))
    slot = np.argsort(places, kind="stable")[::-1].tolist()
    m = len(slot)
    lcp, where = common.tolist(), [*places.tolist(), -1]
    before, after = [m, *range(m)], [*range(1, m + 1), 0]
    for s in slot:
        a, b = before[s], after[s]
        x, y = lcp[s], lcp[b]
        if x >= y:
            if x:
                length[where[s]], source[where[s]] = x, where[a]
        else:
            length[where[s]], source[where[s]] = y, where[b]
            lcp[b] = x
        before[b], after[a] = a, b
    return length, source


def blocks(length: list[int], first: np.ndarray) -> list[int]:
    """Starts of the LZ blocks of all texts, and the end of the last one."""
    starts = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        i = a
        while i < b:
            starts.append(i)
            i += length[i] or 1
    return [*starts, int(first[-1])]


def _numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number from 1) of every item, for counts of items by row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def edge_runs(ids: np.ndarray, ranks: list[np.ndarray], starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(start, stop, period) of runs that touch an edge of a block, from every period that such a run can have.

    A run that reaches at least a period past the edge, and no further than the block behind it, has a period of at most
    that block; one that reaches at least a period back has less than both blocks together, or it would have made the
    block before the edge longer.
    """
    n = len(ids)
    size = np.diff(starts)
    edge = starts[:-1]
    opens = np.zeros(n + 1, bool)
    opens[first] = True
    text_start = first[np.searchsorted(first, edge, "right") - 1]
    back = np.where(opens[edge], 0, np.concatenate([[0], size[:-1]]) + size - 1)
    # Where a text ends, what reaches back lies inside its last block.
    closing = np.flatnonzero(opens[starts[1:]])
    edges = np.concatenate([edge, starts[1:][closing]])
    left = np.concatenate([np.minimum(back, edge - text_start), size[closing] // 2])
    found = []
    for counts, at, forward in ((size, edge, True), (left, edges, False)):
        total = np.cumsum(counts)
        a = 0
        while a < len(counts):
            b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP, "right")), a + 1)
            row, period = _numbered(counts[a:b])
            c = at[a:b][row]
            low, high = (c, c + period) if forward else (c - period, c)
            near = (high < n) & (ids[np.minimum(high, n - 1)] == ids[np.minimum(low, n - 1)])
            near |= (low > 0) & (ids[low - 1] == ids[high - 1])
            low, high, period = low[near], high[near], period[near]
            on, off = ahead(ranks, low, high), behind(ranks, low, high)
            run = on + off >= period
            low, high, period, on, off = (v[run] for v in (low, high, period, on, off))
            found.append(np.stack([low - off, high + on, period], 1))
            a = b
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:, :2] != out[:-1, :2]).any(1)
    return out[keep]


def copied_runs(edge: np.ndarray, starts: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """All runs: those at edges, and those strictly inside a block, copied from where the block's words stood before.

    Runs lie in buckets by start. A block's source may reach into the block; what is copied is then copied on.
    """
    buckets: dict[int, list[tuple[int, int]]] = {}
    for a, b, p in edge.tolist():
        buckets.setdefault(a, []).append((b, p))
    if buckets:
        for a, b in zip(starts[:-1], starts[1:]):
            s = source[a]
            if s < 0 or b - a < 4:
                continue
            shift, stop = a - s, s + b - a
            for x in range(s + 1, stop - 2):
                for y, p in buckets.get(x, ()):
                    if y < stop:
                        buckets.setdefault(x + shift, []).append((y + shift, p))
    return [(x, y, p) for x, runs in buckets.items() for y, p in runs]


def all_runs(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, smallest period) of every run of at least two periods; ids of different texts differ, first has the texts' offsets."""
    if not len(ids):
        return []
    end = np.repeat(first[1:], np.diff(first))
    order, ranks = doubled_ranks(ids, end)
    if not ranks:
        return []
    length, source = previous_factors(order, ranks)
    starts = blocks(length, first)
    return copied_runs(edge_runs(ids, ranks, np.array(starts), first), starts, source)


def probed(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a periodic tail for a tenth of the ids: the input that the report is defined on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def encoded(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of lists of words; equal words of one list, and no others, have equal ids."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids, used = np.empty(first[-1], np.int64), 0
    for t, a, b in zip(texts, first[:-1], first[1:]):
        known: dict[str, int] = {}
        ids[a:b] = [known.setdefault(w, len(known)) for w in t]
        ids[a:b] += used
        used += len(known)
    return ids, first


def long_runs(texts: list[list[str]], least_words: int, least_periods: int) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period) of at least so many words and periods, by start, then period."""
    ids, first = encoded(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = [r for r in all_runs(ids, first) if r[1] - r[0] >= max(least_words, least_periods * r[2])]
    of = np.searchsorted(first, [r[0] for r in runs], "right") - 1
    for t, (a, b, p) in zip(of, runs):
        out[t].append((a - int(first[t]), b - a, p))
    return [sorted(r, key=lambda v: (v[0], v[2])) for r in out]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, [a + p for a, _, p in runs], 1)
    np.add.at(gone, [a + n for a, n, _ in runs], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def _per_text(docs: DataFrame, rewrite, columns: list[tuple[str, pa.DataType]], row, least_words: int, least_periods: int) -> DataFrame:
    """doc_id and what row(words, runs) returns, for every row of docs."""
    names = ["doc_id", *[name for name, _ in columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch["text"])
            for a, b in text_chunks(texts):
                ids = batch["doc_id"].slice(a, b - a)
                words = [rewrite(_WORD.findall(t), d) for t, d in zip(texts.slice(a, b - a).to_pylist(), ids.to_pylist())]
                rows = [row(w, r) for w, r in zip(words, long_runs(words, least_words, least_periods))]
                yield pa.record_batch([ids, *[pa.array(list(v), t) for v, (_, t) in zip(zip(*rows), columns)]], names)

    types = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.list_(pa.int64())): "array<array<bigint>>"}
    return base_view(docs).mapInArrow(run, ", ".join(["doc_id long", *[f"{name} {types[t]}" for name, t in columns]]))


def repeated_runs(docs: DataFrame, least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """doc_id, runs (arrays of start, length and period in words) and the text without repeats; one row per input row.

    A run is a stretch of consecutive words with smallest period q, of at least least_words words and least_periods (two
    or more) times q, that no neighbouring word extends. Of each run the first q words stay; kept words are joined by
    single spaces, a text without runs too. A null text counts as empty and has no runs; null and repeated ids and
    repeated rows make no difference, since a row is judged by its own text. An empty table gives an empty result;
    columns other than doc_id and text are ignored.
    """
    if least_periods < 2:
        raise ValueError("a run has at least two periods")
    columns = [("runs", pa.list_(pa.list_(pa.int64()))), ("text", pa.string())]
    return _per_text(docs, lambda words, _: words, columns, lambda w, r: ([list(v) for v in r], " ".join(collapsed(w, r))), least_words, least_periods)


def _digest(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    return len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()


def run_report(docs: DataFrame, least_words: int = 6, least_periods: int = 4) -> DataFrame:
    """The runs of every document in figures, on its words with the probe's periodic tails; one row per input row.

    Columns: doc_id, n_runs, the longest run (ties: smallest start, then period) as start, length, period and
    exponent_milli, null without one, runs_sha256 and collapsed_sha256. A null id gets no periodic tail. Otherwise as repeated_runs.
    """
    columns = [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")]
    return _per_text(docs, probed, columns, _digest, least_words, least_periods)
