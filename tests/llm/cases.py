"""Small tables of documents with every awkward case."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators might use inside; documents may have columns of any name.
CLASHES = ("node", "band", "size", "digest", "kept", "row", "key", "window", "sid", "u", "n", "text_sha256", "rejected_by", "component_id", "label", "score", "piece", "shard", "site", "rep", "copies", "rate", "words", "keys", "__id", "__sha", "__gone", "__row", "__copy")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(2)) + str(rng.randrange(vocabulary) % 97)
        out.append(w + (".\n" if i % 11 == 10 else ""))
    return " ".join(out)


def frame(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], SCHEMA)


def edge_rows():
    long_ = prose(99, 30_000)
    base = prose(1, 120)
    return [
        (1, base, "a"),
        (2, base.upper(), "a"),
        (3, base, None),
        (3, base, None),
        (4, None, "b"),
        (5, "", "b"),
        (6, " \n\t ", "b"),
        (None, prose(2, 60), "a"),
        (None, None, None),
        (7, long_, "b"),
        (8, "one", "a"),
        (9, "é" * 40 + " ñandú " * 30, "é"),
        (10, prose(3, 80) + " " + base, "a"),
        (11, base.replace(" ", "  "), "a"),
    ]


def clashing(df):
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES)])
