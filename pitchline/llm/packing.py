"""Packing tokenised documents into training sequences: best fit, then swap-based local search.

Documents become token ids plus an end marker; only longer ones are cut. The pieces, a few numbers each, are
dealt evenly into shards of a fixed number of pieces. A shard starts from best fit in falling order of length
and then improves the bins that are left underfull: it moves a piece, exchanges one for one or two for one, as
long as the sum of squared fills rises, until bins run empty or nothing helps. The bins that a shard leaves less
full than nine tenths go on to a next round, whose shards hold those of many. What is wasted is the last shard's few
bins, and the room in bins past nine tenths: the smaller the shards, the more of it (see the README for figures).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_strings, base_view, cut, raw_bytes, small_batches

LENGTH = 1024
END_ID = 2
#: Pieces that one shard packs.
SHARD_PIECES = 8000
#: Bytes from here on begin characters past U+027F.
_FAR = 0xCA


class Encoder:
    """Ids of a vocabulary file for `tokenizers`.

    The same byte-level merges run about five times faster through `tiktoken` with the vocabulary's ranks. They
    split texts of Latin letters in the same way, so such texts go there; any other text, and any that spells a
    special token, goes through `tokenizers` itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str, plain: bool) -> np.ndarray:
        if plain and self.fast and not any(t in text for t in self.special):
            try:
                return self.fast.encode_to_numpy(text)
            except BaseException as e:  # the matcher gives up on some endless runs of white space
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    """The encoder of a public vocabulary by name, with its ranks where they exist."""
    import os

    import public_tokenizers as public

    ranks = public.path(vocabulary.removesuffix(".json") + ".tiktoken")
    return Encoder(public.path(vocabulary), ranks if os.path.exists(ranks) else None, public.PATTERN)


def plain_texts(texts: pa.Array) -> np.ndarray:
    """For each text: no character past U+027F and no control or odd space beyond the usual white space."""
    buf, off = raw_bytes(texts)
    odd = (buf >= _FAR) | (buf == 0xC2) | ((buf < 0x20) & ~np.isin(buf, (9, 10, 13)))
    total = np.concatenate([[0], np.cumsum(odd)])
    return total[off[1:]] == total[off[:-1]]


def cut_points(tokens: int, most: int = LENGTH) -> list[int]:
    """Starts of the pieces: all of full length but the first, if there is more than one."""
    return [0, *range(tokens % most or most, tokens, most)] if tokens > most else [0]


def _pieces(vocabulary: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = as_strings(batch["text"])
            plain = plain_texts(texts)
            docs, piece, start, length, crc = [], [], [], [], []
            for doc, text, easy in zip(batch["doc_id"].to_pylist(), texts, plain):
                ids = np.append(enc.ids(text.as_py(), easy), np.uint32(end_id)).astype("<u4")
                starts = cut_points(len(ids), most)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    docs.append(doc)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins of indices: pieces by falling length, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(most + 1)]
    mask = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = most, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return bins


def _pairs(pieces: list[int], size: list[int]) -> dict[int, tuple[int, int]]:
    """A pair of pieces for each sum of two sizes."""
    by_size: dict[int, list[int]] = {}
    for i in pieces:
        by_size.setdefault(size[i], []).append(i)
    groups = list(by_size.values())
    out = {2 * size[g[0]]: (g[0], g[1]) for g in groups if len(g) > 1}
    return out | {size[g[0]] + size[h[0]]: (g[0], h[0]) for k, g in enumerate(groups) for h in groups[k + 1 :]}


def local_search(bins: list[list[int]], lengths: np.ndarray, most: int) -> list[list[int]]:
    """Improve underfull bins by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills."""
    size = lengths.tolist()
    fills = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fills) // most)
    live = [b for b in range(len(bins)) if fills[b] < most]
    while sum(f > 0 for f in fills) > least:
        live = sorted((b for b in live if 0 < fills[b] < most), key=lambda b: -fills[b])
        # Offers of each bin, emptiest bins last, by size: single pieces and pairs of pieces. Pieces of a bin that have
        # equal sizes are interchangeable, so it offers one of each size: a few dozen, as their sum is bounded.
        ones: dict[int, list[tuple[int, int]]] = {}
        twos: dict[int, list[tuple[int, int, int]]] = {}
        mask_one = mask_two = 0
        for b in live:
            for i in {size[i]: i for i in bins[b]}.values():
                ones.setdefault(size[i], []).append((b, i))
                mask_one |= 1 << size[i]
            for total, (i, j) in _pairs(bins[b], size).items():
                twos.setdefault(total, []).append((b, i, j))
                mask_two |= 1 << total
        touched: set[int] = set()
        better = False

        def offer(mask: int, offers: dict[int, list[tuple]], low: int, high: int, into: int) -> tuple | None:
            """The largest offer with low < size <= high of an untouched bin no fuller than `into`."""
            window = mask & ((1 << (high + 1)) - 1) & ~((1 << (low + 1)) - 1)
            while window:
                at = window.bit_length() - 1
                while offers[at] and offers[at][-1][0] in touched:
                    offers[at].pop()
                for o in reversed(offers[at]):
                    if o[0] == into or o[0] in touched:
                        continue
                    if fills[o[0]] > fills[into]:
                        break
                    return o
                window &= ~(1 << at)
            return None

        for b in live:
            gap = most - fills[b]
            if b in touched or not gap:
                continue
            best: tuple[int, list[int], list[int], int] | None = None  # gain, pieces that come, that go, donor
            for go in [[], *([i] for i in {size[i]: i for i in bins[b]}.values())]:
                gone = sum(size[i] for i in go)
                for mask, offers in ((mask_one, ones), (mask_two, twos)):
                    if (o := offer(mask, offers, gone, gone + gap, b)) and (best is None or sum(size[i] for i in o[1:]) - gone > best[0]):
                        best = (sum(size[i] for i in o[1:]) - gone, list(o[1:]), go, o[0])
            if best is None or best[0] < gap:
                for gone, (i, j) in _pairs(bins[b], size).items():
                    if (o := offer(mask_one, ones, gone, min(gone + gap, most), b)) and (best is None or size[o[1]] - gone > best[0]):
                        best = (size[o[1]] - gone, [o[1]], [i, j], o[0])
            if best:
                gain, come, go, donor = best
                bins[b] = [i for i in bins[b] if i not in go] + come
                bins[donor] = [i for i in bins[donor] if i not in come] + go
                fills[b] += gain
                fills[donor] -= gain
                touched |= {b, donor}
                better = True
        if not better:
            break
    return [b for b in bins if b]


def _packed(most: int, round_: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        lengths = shard["length"].to_numpy()
        order = np.argsort(shard["row"].to_numpy(), kind="stable")
        bins = local_search(best_fit(lengths[order], most), lengths[order], most)
        sequence, offset = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[order[i]], offset[order[i]] = k, at
                at += int(lengths[order[i]])
        fill = np.bincount(sequence, lengths)
        return shard.assign(sequence_id=sequence + (shard["shard"].to_numpy() << 24) + (round_ << 58), offset=offset, loose=(10 * fill < 9 * most)[sequence])

    return run


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, most: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Needs columns doc_id and text; others are ignored. A null or empty text is the end marker alone. Rows that
    repeat are packed as often as they occur, and a null doc_id is kept as it is. A document of more than
    `most` ids is cut into pieces of that length, of which the first may be shorter; no other is cut. Every
    sequence is filled without gaps from 0. An empty table gives an empty result.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    with small_batches(docs.sparkSession):
        pieces = cut(base_view(docs).mapInArrow(_pieces(vocabulary, end_id, most), schema).withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = pieces.where(F.col("length") < most)
    full = pieces.where(F.col("length") == most).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    columns, out, left, round_ = full.columns, full, part.count(), 0
    while True:
        shards = left // shard_pieces + 1
        dealt = part.select(*pieces.columns, F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
        placed = dealt.groupBy("shard").applyInPandas(_packed(most, round_), schema + ", row long, shard long, sequence_id long, offset long, loose boolean")
        if shards == 1:
            return out.unionByName(placed.select(*columns))
        placed = cut(placed, "placed")
        part, before = placed.where("loose"), left
        left, round_ = part.count(), round_ + 1
        if 2 * left > before or round_ == 8:
            # Pieces that don't fit together: another deal would leave as many bins.
            return out.unionByName(placed.select(*columns))
        out = out.unionByName(placed.where("not loose").select(*columns))
