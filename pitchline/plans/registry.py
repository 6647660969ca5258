"""All queries of the package and their SQL, by name."""

from __future__ import annotations

from .base import Query
from . import etl, features, models, scores

BOOKS = (etl.BOOK, features.BOOK, scores.BOOK, models.BOOK)


def queries() -> dict[str, Query]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for book in BOOKS for name, text in book.sql.items()}
