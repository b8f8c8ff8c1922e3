"""Queries of the document-structuring operators and their SQL counterparts."""

from __future__ import annotations

from ..session import ship
from . import links, passes, quizzes, rest, shape, structure

_PARTS = (passes, structure, rest, links, shape, quizzes)


def queries() -> dict:
    out = {}
    for part in _PARTS:
        for name, f in part.queries().items():
            out[name] = lambda spark, sf_dir, f=f: f(ship(spark), sf_dir)
    return out


def oracle_sql() -> dict:
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
