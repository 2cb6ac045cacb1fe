"""Cluster paths as ``array<string>`` column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "$"


def path_validate(path: Column) -> Column:
    """The path; a segment with the separator raises an error."""
    return F.when(F.exists(path, lambda s: F.contains(s, F.lit(SEPARATOR))), F.raise_error(F.lit("a path segment contains $"))).otherwise(path)


def path_name(path: Column) -> Column:
    return F.array_join(path, SEPARATOR)


def path_parent(path: Column) -> Column:
    """Null for a path of at most one segment."""
    return F.when(F.size(path) > 1, F.slice(path, 1, F.size(path) - 1))


def path_ancestors(path: Column, with_self: bool = False) -> Column:
    """Proper non-empty prefixes, shortest first; the path itself last if asked for (an empty path is its only one)."""
    last = F.size(path) if with_self else F.size(path) - 1
    found = F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(path, 1, i)))
    alone = F.when(F.size(path) == 0, F.array(path)) if with_self else None
    return F.coalesce(*([found, alone] if with_self else [found]), F.array().cast("array<array<string>>"))


def path_truncate(path: Column, level: int | Column) -> Column:
    """The first ``level + 1`` segments; -1 gives the empty path."""
    if isinstance(level, int) and level < -1:
        raise ValueError("level must be at least -1")
    return F.slice(path, 1, (F.lit(level) if isinstance(level, int) else level) + 1)


def path_fill(path: Column, placeholder: str, length: int | Column) -> Column:
    """Padded on the right to ``length``; never shortened."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(path, F.array_repeat(F.lit(placeholder), F.greatest(length - F.size(path), F.lit(0))))


def is_ancestor_of(a: Column, b: Column) -> Column:
    """Strictly shorter and a prefix."""
    return (F.size(a) < F.size(b)) & (F.slice(b, 1, F.size(a)) == a)


def path_equal(a: Column, b: Column) -> Column:
    """Equality by name, so that the empty path equals one empty segment."""
    return path_name(a) == path_name(b)
