"""Running sums and prefix hashes within groups of any size.

A window over a group is one task. Here rows are dealt by range of (group, order) and sorted; each task scans its rows
once and numbers them from where it starts; then at most one carried value for each partition, from the partitions
before it, is added to the rows of its first group. The driver sees the first and the last row of each partition, nothing
else, so it grows with the number of partitions and not with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modsplit_spark.sources.workspace import materialize

BASE = 0x9E3779B97F4A7C15
WORD = 1 << 64
FIRST, LAST = 1, 2
#: Rows of a group up to which one task numbers them by a window.
GROUP_ROWS = 1_000_000


def _powers(exponents: np.ndarray) -> np.ndarray:
    """BASE to each exponent, modulo 2^64."""
    out, base, left = np.ones(len(exponents), np.uint64), np.uint64(BASE), exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & np.uint64(1), out * base, out)
            base, left = base * base, left >> np.uint64(1)
    return out


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ; null equals null."""
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (a.is_null().to_numpy(zero_copy_only=False) ^ b.is_null().to_numpy(zero_copy_only=False))


def _within(values: np.ndarray, edge: np.ndarray, carry: int) -> np.ndarray:
    """Running sums that begin anew at each edge; ``carry`` is added before the first."""
    total = np.cumsum(values)
    start = np.maximum.accumulate(np.where(edge, np.arange(len(values)), -1))
    before = np.where(start > 0, total[np.maximum(start - 1, 0)], 0).astype(values.dtype)
    return total - before + np.where(start < 0, np.array(carry % WORD, np.uint64).astype(values.dtype), values.dtype.type(0))


def _scan(batches: Iterator[pa.RecordBatch], keys: Sequence[str], sums: Sequence[str], hashes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    task, last_key, carry, head, held = TaskContext.get().partitionId(), None, [0] * (1 + len(sums) + len(hashes)), True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows, bool)
        for i, k in enumerate(keys):
            column = batch.column(k)
            edge[1:] |= _differs(column[1:], column[:-1])
            if last_key is not None:
                edge[0] |= bool(_differs(column[:1], last_key[i])[0])
        heads = head & (np.cumsum(edge) == 0)
        head = bool(heads[-1])
        ones = np.ones(batch.num_rows, np.int64)
        place = _within(ones, edge, carry[0])
        scanned = [place, *(_within(batch.column(c).to_numpy(), edge, x) for c, x in zip(sums, carry[1:], strict=False))]
        power = _powers(place - 1) if hashes else None
        for c, x in zip(hashes, carry[1 + len(sums) :], strict=True):
            scanned.append(_within(batch.column(c).to_numpy().view(np.uint64) * power, edge, x).view(np.int64))
        carry, last_key = [int(s[-1]) for s in scanned], [batch.column(k)[-1:] for k in keys]
        marks = np.zeros(batch.num_rows, np.int32)
        marks[0] |= FIRST * (held is None)
        columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in sums and name not in hashes]
        if held is not None:
            yield _marked(held)
        held = (columns, scanned, np.full(batch.num_rows, task, np.int32), marks, heads)
    if held is not None:
        held[3][-1] |= LAST
        yield _marked(held)


def _marked(held: tuple) -> pa.RecordBatch:
    columns, scanned, *marks = held
    arrays = [*columns, *map(pa.array, scanned), *map(pa.array, marks)]
    return pa.RecordBatch.from_arrays(arrays, [str(i) for i in range(len(arrays))])


def _carried(marks: list, keys: int, sums: int, hashes: int) -> dict[int, list[int]]:
    """What each partition's first group has before it: count, sums and hashes."""
    found: dict[int, list[int]] = {}
    by_task: dict[int, dict[int, tuple]] = {}
    for row in marks:
        for mark in (FIRST, LAST):
            if row[-2] & mark:
                by_task.setdefault(row[-3], {})[mark] = row
    key, tail = None, None
    for task in sorted(by_task):
        first, last = by_task[task][FIRST], by_task[task][LAST]
        end = list(last[keys : keys + 1 + sums + hashes])
        if tail is not None and tuple(first[:keys]) == key:
            found[task] = tail
            if last[-1]:
                power = pow(BASE, tail[0], WORD)
                end = [a + b for a, b in zip(tail[: 1 + sums], end[: 1 + sums], strict=True)] + [(a + power * b) % WORD for a, b in zip(tail[1 + sums :], end[1 + sums :], strict=True)]
        key, tail = tuple(last[:keys]), end
    return found


def _joined(before: pd.Series, power: pd.Series, local: pd.Series) -> pd.Series:
    b, p, x = (s.to_numpy(np.int64).view(np.uint64) for s in (before, power, local))
    return pd.Series((b + p * x).view(np.int64))


def _signed(x: int) -> int:
    x %= WORD
    return x - WORD if x >= WORD // 2 else x


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], place: str, sums: Mapping[str, Column] | None = None, hashes: Mapping[str, Column] | None = None) -> DataFrame:
    """``df``, written, with ``place`` (1, 2, ... within the group ``by`` in ``order``), the running sum of each of ``sums`` (64-bit
    whole numbers, the row's own included) and a 64-bit hash of each of ``hashes`` over the group's rows so far.

    ``df`` is read twice, once for a sample of its order, so it should be a table. Rows that ``order`` leaves equal come in any
    order. Null keys are a group; keys are plain columns (no arrays or structs). Each row's key and values must fit in
    memory, no group need do so."""
    by, sums, hashes = list(by), dict(sums or {}), dict(hashes or {})
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    names = df.columns
    zero = F.lit(0).cast("long")
    wide = df.select("*", *(F.coalesce(c.cast("long"), zero).alias(n) for n, c in (sums | hashes).items()))
    dealt = wide.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order) if by else wide.repartitionByRange(*order).sortWithinPartitions(*order)
    added = [place, *sums, *hashes]
    fields = [*df.schema.fields, *(T.StructField(n, T.LongType()) for n in added), T.StructField("_task", T.IntegerType()), T.StructField("_mark", T.IntegerType()), T.StructField("_head", T.BooleanType())]
    scanned = materialize(dealt.mapInArrow(partial(_scan, keys=by, sums=list(sums), hashes=list(hashes)), T.StructType(fields)), "running")
    marks = scanned.where("_mark > 0").select(*by, *added, "_task", "_mark", "_head").collect()
    carried = _carried([tuple(r) for r in marks], len(by), len(sums), len(hashes))
    if not carried:
        return scanned.select(*names, *added)
    rows = [(task, pow(BASE, c[0], WORD), *c) for task, c in carried.items()]
    carry = df.sparkSession.createDataFrame([tuple(map(_signed, r)) for r in rows], ", ".join(f"`{n}` long" for n in ["_task", "_power", *(f"_{n}" for n in added)]))
    both = scanned.join(F.broadcast(carry.withColumn("_head", F.lit(True))), ["_task", "_head"], "left")
    join = F.pandas_udf(_joined, "long")
    out = [(F.col(n) + F.coalesce(F.col(f"_{n}"), zero)).alias(n) for n in [place, *sums]]
    one = F.lit(1).cast("long")
    out += [join(F.coalesce(F.col(f"_{n}"), zero), F.coalesce("_power", one), F.col(n)).alias(n) for n in hashes]
    return both.select(*names, *out)


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str, most_rows: int | None = None) -> DataFrame:
    """``df`` with ``name`` (long), the row's place from 0 within the group ``by`` in ``order``, which must leave no two rows equal.

    ``df`` is written and its groups counted. If none is over ``most_rows`` a window numbers them; else ``running`` does, and no group is one task."""
    most_rows = GROUP_ROWS if most_rows is None else most_rows
    table = materialize(df, "numbered")
    if (table.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > most_rows:
        placed = running(table, by, order, "_place")
        return placed.withColumn(name, F.col("_place") - 1).drop("_place")
    return table.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long") - 1)
