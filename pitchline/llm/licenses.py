"""Licence notices by the Dice coefficient over word bigrams.

Texts are normalised (A-Z in lower case; words are letters and digits, punctuation separates) and compared with
templates: licence texts, standard headers, short notices. A passage can only reach the coefficient t with a template
if the smaller number of bigrams is at least t / (2 - t) of the larger: these size bounds prune templates and windows
before any comparison. Passages are all windows of words that begin and end with a bigram of the template, wherever
they stand in the text; no other window has a higher coefficient.

One pass over the texts, a row out for each row in; a task's state is the templates alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, Words, as_strings, mix, raw_bytes, text_chunks
from .license_texts import TEMPLATES

LEAST_DICE = 0.8

_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _BREAKS[_low:_high] = False


def normalised(texts: pa.Array) -> Words:
    """Words of the texts: letters and digits; Latin-1 signs and general punctuation (U+2000 to U+206F) separate too."""
    buf, off = raw_bytes(texts)
    wide = np.zeros(len(buf), bool)
    signs = np.flatnonzero(buf == 0xC2)
    wide[signs] = wide[np.minimum(signs + 1, len(buf) - 1)] = True
    marks = np.flatnonzero(buf == 0xE2)
    marks = marks[marks + 2 < len(buf)]
    marks = marks[(buf[marks + 1] == 0x80) | (buf[marks + 1] == 0x81)]
    for k in range(3):
        wide[marks + k] = True
    clean = np.where(wide, np.uint8(0x20), buf)
    return Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(clean)]), spaces=_BREAKS)


def bigrams(w: Words) -> np.ndarray:
    """Hash of each word with the next one; the last word of a row has no bigram, its place holds nothing of use."""
    out = np.zeros(len(w.hash), np.uint64)
    out[:-1] = mix(w.hash[:-1] * _BASE + mix(w.hash[1:]))
    return out


class Scanner:
    """Finds the passages of a text that reach `least` with a template; state is the templates alone."""

    def __init__(self, templates: Iterable[tuple[str, str]], least: float):
        self.least, self.names = least, []
        grams, self.words = [], []
        for name, text in templates:
            w = normalised(pa.array([text], pa.large_string()))
            if len(w.hash) < 2:
                raise ValueError(f"a template needs two words at least: {text!r}")
            self.names.append(name)
            grams.append(bigrams(w)[:-1])
            self.words.append(np.unique(w.hash))
        self.size = np.array([len(g) for g in grams])
        # Bounds of a passage's size, and the fewest bigrams that it has in common with the template.
        self.high = np.floor(self.size * (2 - least) / least + 1e-9).astype(np.int64)
        self.low = np.ceil(self.size * least / (2 - least) - 1e-9).astype(np.int64)
        self.need = np.ceil(least * (self.size + self.low) / 2 - 1e-9).astype(np.int64)
        self.known = np.unique(np.concatenate(grams))
        self.copies = np.stack([np.bincount(np.searchsorted(self.known, g), minlength=len(self.known)) for g in grams])
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of the templates' bigrams among the words."""
        grams = bigrams(w)
        inner = np.ones(len(grams), bool)
        inner[w.first[1:][w.first[1:] > w.first[:-1]] - 1] = False
        maybe = np.flatnonzero(inner & self.bitmap[(grams >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
        same = self.known[at] == grams[maybe]
        return maybe[same], at[same]

    def windows(self, t: int, place: np.ndarray, gram: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(coefficient, first bigram, last bigram) of the best window from each start, the shorter one on ties."""
        own = self.copies[t, gram] > 0
        place, gram = place[own], gram[own]
        need, most = self.need[t], self.high[t]
        if len(place) < need:
            return
        dense = place[need - 1 :] - place[: len(place) - need + 1] < most
        if not dense.any():
            return
        # A bigram counts in a window unless as many of its kind as the template has stand before it there.
        before = np.full(len(place), -1)
        order = np.lexsort((np.arange(len(place)), gram))
        copies = self.copies[t, gram[order]]
        back = np.arange(len(order)) - copies
        full = np.flatnonzero(back >= 0)
        full = full[gram[order[back[full]]] == gram[order[full]]]
        before[order[full]] = order[back[full]]
        for i in np.flatnonzero(dense):
            end = np.searchsorted(place, place[i] + most)
            size = place[i:end] - place[i] + 1
            dice = 2 * np.cumsum(before[i:end] < i) / (size + self.size[t])
            k = int(dice.argmax())
            if dice[k] >= self.least - 1e-12:
                yield float(dice[k]), int(place[i]), int(place[i + k])

    def scan(self, w: Words, row: int, place: np.ndarray, gram: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first word, last word) of passages that don't overlap, in order.

        The passage of the highest coefficient comes first; of equal ones that with more of the words that only some
        of these templates have, then the one further to the front, then by name. Passages that overlap it go.
        """
        if len(place) < self.need.min():
            return []
        counts = (self.copies[:, gram] > 0).sum(1)
        found = [(d, i, j + 1, t) for t in np.flatnonzero(counts >= self.need) for d, i, j in self.windows(t, place, gram)]
        best, ends = [], []
        ranked = sorted(found, key=lambda f: (-round(f[0], 12), -np.isin(self.words[f[3]], w.hash[f[1] : f[2] + 1]).sum(), f[1], self.names[f[3]]))
        for d, i, j, t in ranked:
            # Those that stay don't overlap, so their ends rise with their starts: only the next one on either side counts.
            k = bisect_left(ends, (i, j))
            if (k == 0 or ends[k - 1][1] < i) and (k == len(ends) or ends[k][0] > j):
                ends.insert(k, (i, j))
                best.append((self.names[t], d, int(i - w.first[row]), int(j - w.first[row]), int(i), int(j)))
        return sorted(best, key=lambda f: f[2])


_FOUND = "array<struct<license: string, dice: double, first_word: int, last_word: int, first_char: int, last_char: int>>"
_STRUCT = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("first_char", pa.int32()), ("last_char", pa.int32())]))


def with_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """(doc_id, found): one row for each row of docs, found its passages in order.

    A passage has the licence, the coefficient, its first and last word and its first and last character, all from 0.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch["text"])
            for a, b in text_chunks(texts):
                w = normalised(texts.slice(a, b - a))
                place, gram = scanner.hits(w)
                edges = np.searchsorted(place, w.first)
                # Counted in the text as it is: a sign that separates is several spaces in the words' buffer.
                chars = np.concatenate([[0], np.cumsum((raw_bytes(texts.slice(a, b - a))[0] & 0xC0) != 0x80)])
                rows = []
                for r, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                    found = scanner.scan(w, r, place[i:j], gram[i:j])
                    start = chars[w.off[r]]
                    rows.append([(name, d, x, y, int(chars[w.lo[p]] - start), int(chars[w.hi[q]] - start - 1)) for name, d, x, y, p, q in found])
                yield pa.record_batch([batch["doc_id"].slice(a, b - a), pa.array(rows, _STRUCT)], ["doc_id", "found"])

    view = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return view.mapInArrow(run, f"doc_id long, found {_FOUND}")


def scan_licenses(docs: DataFrame, templates: Iterable[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """Licence findings: doc_id, license, dice, first_word, last_word, first_char, last_char; one row per passage found.

    Needs columns doc_id and text; others are ignored. Passages of one text don't overlap: the one with the highest
    coefficient stays (see Scanner.scan for ties). Words and characters count from 0, both ends included. A null or
    empty text has no findings; a null doc_id is kept; rows that repeat an id are scanned each for itself, so they are
    found as often as they occur. An empty table gives an empty result.
    """
    return with_licenses(docs, templates, least).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def license_report(docs: DataFrame) -> DataFrame:
    """The most likely licence of every row: doc_id, license (null: none), dice, n_licenses, first_char, last_char.

    That is the licence of the passage with the most words, of equal ones the first. n_licenses counts the different
    licences found. One row for each row of docs, from that row's own text alone: null ids, repeated ids and repeated
    rows keep their own findings. Rows with a null or empty text have none. An empty table gives an empty result.
    """
    longest = F.reduce(
        F.slice("found", 2, F.greatest(F.size("found") - 1, F.lit(0))),
        F.get("found", F.lit(0)),
        lambda best, f: F.when(f["last_word"] - f["first_word"] > best["last_word"] - best["first_word"], f).otherwise(best),
    )
    n = F.size(F.array_distinct(F.transform("found", lambda f: f["license"])))
    out = with_licenses(docs).select("doc_id", longest.alias("best"), n.cast("long").alias("n_licenses"))
    return out.select("doc_id", F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"), "n_licenses", F.col("best.first_char").alias("first_char"), F.col("best.last_char").alias("last_char"))
