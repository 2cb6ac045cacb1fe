"""Recursive acyclic bisection of all units' components, level by level.

A valid split puts no directed edge from the second part to the first, so it is a prefix of a topological
order. Component nodes are numbered in such an order; for each position the weight of the edges
across it is a running sum, and of the positions that balance a block the one with the least cut
splits it.

Where only the one order is swept, blocks of up to ``GROUP_NODES`` nodes are split to the end in tasks that take many blocks side by side. Larger
ones go level by level: every such block of every unit is split in the same pass, and a level is two window passes. ``EXACT_NODES`` and less can be split by trying all valid
splits, which finds the least cut. With ``refine`` the others in groups are swept in several orders, so that a block which one order can't balance
is not given up, and the best split is improved by moving single nodes across it. Every node has the status of the block it ended in.

Of nodes with names the edges of similarity need not be made for large components: how many nodes of a similar name stand before and after a place gives
what it adds to the cut.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from modsplit_spark.operators import graph
from modsplit_spark.operators.graph import UNIT, spread
from modsplit_spark.operators.ranks import _differs
from modsplit_spark.sources.workspace import materialize, materialize_observed

EPS, PARTS, MIN_WEIGHT = 0.1, 2, 2
SCALE = 65536
#: Rows of blocks that are split side by side.
SIDE_ROWS = 100_000
#: Components up to which all splits are tried: 2^12 of them.
EXACT_NODES = 12
#: Nodes, and ten times as many edges, of a component up to which one task splits it to the end.
GROUP_NODES = 20_000
#: A component up to which all its nodes may move to improve the split of a block, and up to which the block's own may; in larger ones none do.
ALL_MOVE, MOVE_NODES = 256, 4_000
#: Why a block was not split further: it weighs less than two nodes; no order tried has a balanced prefix.
LIGHT, INFEASIBLE = "light", "infeasible"
#: Orders drawn beside the planned ones, best prefixes that are improved, and moves in a row that may make a split worse.
DRAWN, STARTS, PATIENCE = 8, 3, 12


def balance_bound(weight: Column, k: int = PARTS, eps: float = EPS) -> Column:
    """Most that a part of a block may weigh."""
    return F.ceil(F.lit(1 + eps) * F.ceil(weight / F.lit(k)).cast("double"))


def edge_units(w: Column) -> Column:
    """A weight in whole units of 1 / 65536, halves to even."""
    return F.bround(w * SCALE).cast("long")


def cut_weight(edges: DataFrame, labels: DataFrame, node: str = "ix") -> DataFrame:
    """``(unit, cut)``: units of weight on edges between different labels; self-edges don't count."""
    left = labels.select(*UNIT, F.col(node).alias("a"), F.col("label").alias("_a"))
    right = labels.select(*UNIT, F.col(node).alias("b"), F.col("label").alias("_b"))
    joined = edges.where("a != b").join(left, [*UNIT, "a"]).join(right, [*UNIT, "b"])
    return joined.groupBy(*UNIT).agg(F.sum(F.when(F.col("_a") != F.col("_b"), edge_units(F.col("w"))).otherwise(0)).alias("cut"))


def cut_curve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (unit, wcc, pos, …) with ``cut``: units of weight on edges from up to ``pos`` to beyond it. Nodes without an edge are left out."""
    own = edges.where("a != b").select(*UNIT, "wcc", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), edge_units(F.col("w")).alias("u"))
    steps = own.select(*UNIT, "wcc", F.col("lo").alias("pos"), F.col("u")).unionByName(own.select(*UNIT, "wcc", F.col("hi").alias("pos"), (-F.col("u")).alias("u"))).groupBy(*UNIT, "wcc", "pos").agg(F.sum("u").alias("u"))
    running = F.sum("u").over(W.partitionBy(*UNIT, "wcc").orderBy("pos"))
    return nodes.join(steps, [*UNIT, "wcc", "pos"]).withColumn("cut", running).drop("u")


def acyclic_bisect(blocks: DataFrame, eps: float = EPS, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """``blocks`` (unit, wcc, path, pos, weight, cut) with ``label`` 0 or 1 from the best feasible split of each block, or
    null where the block is too light or none is feasible. Ties: least imbalance, then first position."""
    block = [*UNIT, "wcc", "path"]
    before = F.sum("weight").over(W.partitionBy(*block).orderBy("pos"))
    whole = F.sum("weight").over(W.partitionBy(*block))
    rest, bound = F.col("_all") - F.col("_left"), balance_bound(F.col("_all"))
    feasible = (F.col("_all") >= min_weight) & (F.col("_left") >= 1) & (rest >= 1) & (F.col("_left") <= bound) & (rest <= bound)
    choice = F.when(feasible, F.struct(F.col("cut").alias("cut"), F.abs(F.col("_left") - rest).alias("gap"), F.col("pos").alias("pos")))
    weighed = blocks.withColumn("_left", before).withColumn("_all", whole).withColumn("_choice", choice)
    best = F.min("_choice").over(W.partitionBy(*block))
    return weighed.withColumn("_best", best).withColumn("label", F.when(F.col("_best").isNotNull(), (F.col("pos") > F.col("_best.pos")).cast("int"))).drop("_left", "_all", "_choice", "_best")


class _Component:
    """One component in a task: weights, edges, and its splits. Nodes are numbered from 0 in order of ``pos``."""

    def __init__(self, rows: pd.DataFrame, eps: float, min_weight: int):
        nodes, edges = rows[rows["b"].isna()].sort_values("pos"), rows[rows["b"].notna()]
        edges = edges[edges["pos"].isin(nodes["pos"]) & edges["b"].isin(nodes["pos"])]
        self.pos, self.weight = nodes["pos"].to_numpy(np.int64), nodes["weight"].to_numpy(np.int64)
        self.a, self.b = (np.searchsorted(self.pos, edges[c].to_numpy(np.int64)) for c in ("pos", "b"))
        self.units, self.directed = edges["units"].to_numpy(np.int64), edges["directed"].to_numpy(bool)
        self.n, self.eps, self.min_weight = len(self.pos), eps, min_weight
        self.paths: list[list[int]] = [[] for _ in range(self.n)]
        self.status = [LIGHT] * self.n

    def bound(self, whole: int) -> int:
        return math.ceil((1 + self.eps) * math.ceil(whole / PARTS))

    def run(self, split) -> None:
        """Split blocks until ``split`` gives no labels for them."""
        open_ = [np.arange(self.n)]
        while open_:
            block = open_.pop()
            whole = int(self.weight[block].sum())
            labels = split(block, whole) if whole >= self.min_weight else None
            if labels is None:
                for i in block:
                    self.status[i] = INFEASIBLE if whole >= self.min_weight else LIGHT
                continue
            for i, label in zip(block, labels, strict=True):
                self.paths[i].append(int(label))
            open_ += [block[labels == label] for label in (0, 1)]

    def balanced(self, left: np.ndarray, whole: int) -> np.ndarray:
        bound = self.bound(whole)
        return (left >= 1) & (whole - left >= 1) & (left <= bound) & (whole - left <= bound)

    # -- all splits

    @cached_property
    def _all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        side = (np.arange(1 << self.n)[:, None] >> np.arange(self.n)) & 1
        cut, valid = np.zeros(1 << self.n, np.int64), np.ones(1 << self.n, bool)
        for a, b, units, directed in zip(self.a, self.b, self.units, self.directed, strict=True):
            cut += int(units) * (side[:, a] != side[:, b])
            if directed:
                valid &= side[:, a] <= side[:, b]
        return side, cut, valid

    def exact(self, block: np.ndarray, whole: int) -> np.ndarray | None:
        """The least cut of the whole component among splits without a directed edge back that balance the block; ties: least
        imbalance, then the least set."""
        side, cut, valid = self._all
        left = whole - side[:, block] @ self.weight[block]
        good = np.flatnonzero(valid & self.balanced(left, whole))
        return side[good[np.lexsort((good, np.abs(2 * left - whole)[good], cut[good]))[0]], block] if len(good) else None

    # -- prefixes of an order

    def curve(self, place: np.ndarray) -> np.ndarray:
        """Units across each prefix of the order in which node i stands at ``place[i]``."""
        ends = np.sort(np.stack([place[self.a], place[self.b]]), axis=0)
        return np.cumsum(np.bincount(ends[0], self.units, self.n) - np.bincount(ends[1], self.units, self.n)).round().astype(np.int64)

    def prefix(self, block: np.ndarray, whole: int, place: np.ndarray, curve: np.ndarray) -> tuple[int, int, int] | None:
        """(cut, imbalance, place of the last node) of the best balanced prefix."""
        at = np.sort(place[block])
        order = np.argsort(place[block])
        left = np.cumsum(self.weight[block][order])
        good = np.flatnonzero(self.balanced(left, whole))
        if not len(good):
            return None
        best = good[np.lexsort((good, np.abs(2 * left - whole)[good], curve[at[good]]))[0]]
        return int(curve[at[best]]), int(abs(2 * left[best] - whole)), int(at[best])

    @cached_property
    def _own(self) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(self.n)
        return place, self.curve(place)

    def sweep(self, block: np.ndarray, whole: int) -> np.ndarray | None:
        place, curve = self._own
        best = self.prefix(block, whole, place, curve)
        return None if best is None else (block > best[2]).astype(np.int64)

    # -- several orders and moves

    @cached_property
    def _next(self) -> tuple[list[list[int]], list[list[int]]]:
        after, before = [[] for _ in range(self.n)], [[] for _ in range(self.n)]
        for a, b in {(int(a), int(b)) for a, b, d in zip(self.a, self.b, self.directed, strict=True) if d}:
            after[a].append(b)
            before[b].append(a)
        return after, before

    @cached_property
    def _near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each node's neighbours begin, the neighbours, and the units to them."""
        from_, to, units = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a]), np.concatenate([self.units, self.units])
        order = np.argsort(from_, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(from_, minlength=self.n))]), to[order], units[order]

    @cached_property
    def _forward(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Distinct directed edges, and for each node those after and before it."""
        after, before = self._next
        edges = np.array([(i, j) for i, x in enumerate(after) for j in x], np.int64).reshape(-1, 2).T
        return edges, [(np.array(x, np.int64), np.array(y, np.int64)) for x, y in zip(after, before, strict=True)]

    def ordered(self, rank, backwards: bool = False) -> np.ndarray:
        """Places in a topological order that takes the ready node of least rank; backwards from the last node."""
        after, before = self._next
        after, before = (before, after) if backwards else (after, before)
        wait, place = [len(x) for x in before], np.zeros(self.n, np.int64)
        ready = [(rank(i), i) for i in range(self.n) if not wait[i]]
        heapq.heapify(ready)
        for k in range(self.n):
            _, i = heapq.heappop(ready)
            place[i] = self.n - 1 - k if backwards else k
            for j in after[i]:
                wait[j] -= 1
                if not wait[j]:
                    heapq.heappush(ready, (rank(j), j))
        return place

    def grown(self, backwards: bool) -> np.ndarray:
        """Places in a topological order that takes the ready node which adds least to the cut."""
        after, before = self._next
        after, before = (before, after) if backwards else (after, before)
        wait, place = [len(x) for x in before], np.zeros(self.n, np.int64)
        at, near, units = (x.tolist() for x in self._near)
        cost = [sum(units[s:e]) for s, e in zip(at, at[1:], strict=False)]
        ready, taken = [(cost[i], i) for i in range(self.n) if not wait[i]], [False] * self.n
        heapq.heapify(ready)
        k = 0
        while ready:
            c, i = heapq.heappop(ready)
            if taken[i] or c != cost[i]:
                continue
            taken[i], place[i], k = True, (self.n - 1 - k if backwards else k), k + 1
            for j, u in zip(near[at[i] : at[i + 1]], units[at[i] : at[i + 1]], strict=True):
                cost[j] -= 2 * u
                if not taken[j] and not wait[j]:
                    heapq.heappush(ready, (cost[j], j))
            for j in after[i]:
                wait[j] -= 1
                if not wait[j]:
                    heapq.heappush(ready, (cost[j], j))
        return place

    @cached_property
    def _orders(self) -> list[tuple[np.ndarray, np.ndarray]]:
        level = [0] * self.n
        for i in np.argsort(self.ordered(lambda i: i)):
            for j in self._next[0][i]:
                level[j] = max(level[j], level[i] + 1)
        weight = self.weight.tolist()
        drawn = np.random.default_rng(self.n).random((DRAWN, self.n))
        places = [self._own[0], self.grown(False), self.grown(True)]
        places += [self.ordered(lambda i, s=s: (level[i], s * weight[i]), back) for s in (1, -1) for back in (False, True)]
        places += [self.ordered(lambda i, s=s: s * weight[i], back) for s in (1, -1) for back in (False, True)]
        places += [self.ordered(lambda i, r=r: r[i]) for r in drawn]
        return [(p, self.curve(p)) for p in places]

    def refined(self, block: np.ndarray, whole: int) -> np.ndarray | None:
        """The best split that prefixes of several orders and moves from them give. Ties: least imbalance, then the earlier order."""
        found = [(best, k) for k, (place, curve) in enumerate(self._orders) if (best := self.prefix(block, whole, place, curve))]
        chosen = None
        for (cut, _, at), k in sorted(found, key=lambda f: (f[0][:2], f[1]))[:STARTS]:
            label = (self._orders[k][0] > at).astype(np.int64)
            if self.n <= MOVE_NODES:
                cut, label = self.moved(block, whole, cut, label)
            gap = abs(2 * int(self.weight[block][label[block] == 0].sum()) - whole)
            if chosen is None or (cut, gap) < chosen[:2]:
                chosen = cut, gap, label
        return None if chosen is None else chosen[2][block]

    def moved(self, block: np.ndarray, whole: int, cut: int, label: np.ndarray) -> tuple[int, np.ndarray]:
        """Passes of single moves: the node whose move lowers the cut most, or raises it least, goes across and stays for the pass; a pass
        keeps the best of its states, and the last pass is one that finds none better. Edges stay forward and the block balanced."""
        a, b, u, out, into = self.a, self.b, self.units, *self._forward
        at, near, units = self._near
        weight, free = np.zeros(self.n, np.int64), np.full(self.n, self.n <= ALL_MOVE)
        weight[block], free[block] = self.weight[block], True
        bound, side = self.bound(whole), label.copy()
        while True:
            held, now, best, path, kept = int(weight[side == 0].sum()), cut, cut, [], 0
            signed = np.where(side[a] != side[b], u, -u)
            gain = np.bincount(a, signed, self.n) + np.bincount(b, signed, self.n)
            # What keeps a node: an edge on to a node of the first part, or from one of the second.
            held_back = np.where(side == 0, np.bincount(out[0], side[out[1]] == 0, self.n), np.bincount(out[1], side[out[0]] == 1, self.n))
            may = free.copy()
            while len(path) - kept <= PATIENCE:
                left = held + np.where(side == 0, -weight, weight)
                good = np.flatnonzero(may & (held_back == 0) & (left >= max(1, whole - bound)) & (left <= min(bound, whole - 1)))
                if not len(good):
                    break
                i = int(good[gain[good].argmax()])
                now -= int(gain[i])
                held, may[i] = int(left[i]), False
                nearby, w = near[at[i] : at[i + 1]], units[at[i] : at[i + 1]]
                np.add.at(gain, nearby, np.where(side[nearby] == side[i], 2 * w, -2 * w))
                side[i] ^= 1
                after, before = into[i]
                # On to the second part frees the nodes before it and keeps those after it there; back, the other way round.
                step = 1 if side[i] else -1
                held_back[before[side[before] == 0]] -= step
                held_back[after[side[after] == 1]] += step
                path.append(i)
                if now < best:
                    best, kept = now, len(path)
            side[path[kept:]] ^= 1
            if best == cut:
                return cut, side
            cut = best


def _grouped(rows: pd.DataFrame, eps: float, min_weight: int, exact_nodes: int, refine: bool) -> pd.DataFrame:
    c = _Component(rows, eps, min_weight)
    c.run(c.exact if c.n <= exact_nodes else c.refined if refine else c.sweep)
    return pd.DataFrame({"commit_key": rows["commit_key"].iloc[0], "parent_id": rows["parent_id"].iloc[0], "wcc": int(rows["wcc"].iloc[0]), "pos": c.pos, "path": pd.Series(c.paths, dtype=object), "status": pd.Series(c.status, dtype=object)})


def _sweep_blocks(start: np.ndarray, weight: np.ndarray, cut: np.ndarray, eps: float, min_weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's labels begin, the labels, and whether its last block is infeasible, of blocks that begin at ``start``. A level of all blocks is one pass."""
    none, found, infeasible, at = np.iinfo(np.int64).max, [], np.zeros(len(weight), bool), np.arange(len(weight))
    while len(at):
        w, c, place = weight[at], cut[at], np.arange(len(at))
        block = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
        whole, run = np.add.reduceat(w, start), np.cumsum(w)
        left = run - (run - w)[start][block]
        rest, bound = whole[block] - left, np.ceil((1 + eps) * np.ceil(whole / PARTS))[block]
        good = (whole[block] >= min_weight) & (left >= 1) & (rest >= 1) & (left <= bound) & (rest <= bound)
        for value in (c, np.abs(left - rest), place):
            best = np.minimum.reduceat(np.where(good, value, none), start)
            good &= value == best[block]
        split = best < none
        infeasible[at] = ((whole >= min_weight) & ~split)[block]
        kept = split[block]
        label = (place > best[block])[kept]
        at, part = at[kept], 2 * block[kept] + label
        found.append((at, label))
        start = np.flatnonzero(np.diff(part, prepend=-1))
    begins = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([a for a, _ in found]), minlength=len(weight)) if found else np.zeros(0, np.int64))])
    labels = np.zeros(begins[-1], np.int32)
    for level, (rows, label) in enumerate(found):
        labels[begins[rows] + level] = label
    return begins, labels, infeasible


def _sweep_rows(batches: Iterator[pa.RecordBatch], keys: list[str], eps: float, min_weight: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and place; blocks are taken as a whole, many at once."""

    def split(rows: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        begins, labels, infeasible = _sweep_blocks(start, rows["weight"].to_numpy(), rows["cut"].to_numpy(), eps, min_weight)
        grown = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(labels))
        own = {c: rows[c].combine_chunks() for c in (*UNIT, "wcc", "pos", "path")}
        return pa.RecordBatch.from_pydict(own | {"grown": grown, "infeasible": pa.array(infeasible)})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SIDE_ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            start = _starts(rows, keys)
            if len(start) > 1:
                yield split(rows.slice(0, start[-1]), start[:-1])
                rows = rows.slice(start[-1])
            held = rows.to_batches()
    if sum(b.num_rows for b in held):
        rows = pa.Table.from_batches(held).combine_chunks()
        yield split(rows, _starts(rows, keys))


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    edge = np.ones(rows.num_rows, bool)
    edge[1:] = np.logical_or.reduce([_differs(c[1:], c[:-1]) for c in (rows[k].combine_chunks() for k in keys)])
    return np.flatnonzero(edge)


def _swept(blocks: DataFrame, eps: float, min_weight: int) -> DataFrame:
    """``blocks`` (unit, wcc, path, pos, weight, cut), none over what a task holds, split to the end by the sweep."""
    keys = [*UNIT, "wcc", "block"]
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = blocks.select(*UNIT, F.col("wcc").cast("int").alias("wcc"), F.array_join(F.transform("path", lambda x: x.cast("string")), "").alias("block"), F.col("pos").cast("int").alias("pos"), "path", long("weight"), long("cut"))
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, "pos")
    found = sorted_.mapInArrow(partial(_sweep_rows, keys=keys, eps=eps, min_weight=min_weight), "commit_key string, parent_id string, wcc int, pos int, path array<int>, grown array<int>, infeasible boolean")
    return found.select(*UNIT, "wcc", "pos", F.concat("path", "grown").alias("path"), F.when(F.col("infeasible"), INFEASIBLE).otherwise(LIGHT).alias("status"))


def partition_components(nodes: DataFrame, edges: DataFrame, eps: float = EPS, min_weight: int = MIN_WEIGHT, exact_nodes: int = 0, refine: bool = False) -> DataFrame:
    """As ``recursive_partition``, each component in one task to the end. Edges without a column ``directed`` all are."""
    directed = F.col("directed") if "directed" in edges.columns else F.lit(True)
    own = edges.where("a != b").select(*UNIT, "wcc", F.col("a").cast("long").alias("pos"), F.lit(0).cast("long").alias("weight"), F.col("b").cast("long").alias("b"), edge_units(F.col("w")).alias("units"), directed.alias("directed"))
    rows = nodes.select(*UNIT, "wcc", F.col("pos").cast("long").alias("pos"), F.col("weight").cast("long").alias("weight"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("units"), F.lit(False).alias("directed")).unionByName(own)

    def paths(held: pd.DataFrame) -> pd.DataFrame:
        return _grouped(held, eps, min_weight, exact_nodes, refine)

    return spread(rows, *UNIT, "wcc").groupBy(*UNIT, "wcc").applyInPandas(paths, "commit_key string, parent_id string, wcc int, pos int, path array<int>, status string")


def exact_partition(nodes: DataFrame, edges: DataFrame, eps: float = EPS, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """As ``recursive_partition``, by trying all splits. For components of up to ``EXACT_NODES`` nodes."""
    return partition_components(nodes, edges, eps, min_weight, EXACT_NODES).drop("status")


def recursive_partition(nodes: DataFrame, edges: DataFrame, eps: float = EPS, min_weight: int = MIN_WEIGHT, exact_nodes: int = 0, refine: bool = False, group_nodes: int = GROUP_NODES) -> DataFrame:
    """``(unit, wcc, pos, path array<int>, status)``: labels of every level for the nodes of ``nodes`` (unit, wcc, pos, weight) that have an
    edge, and why their last block stays whole: ``light`` or ``infeasible``.

    Components of up to ``exact_nodes`` nodes get the least cut, those of up to ``group_nodes`` the sweep of their order or, with ``refine``, the best of several
    orders and moves. Of larger ones a level splits all blocks of over ``group_nodes`` by the sweep. Blocks shrink to at most 55 % a
    level, so levels grow with the logarithm of the largest component. A level writes what it has split to the shared folder; only
    blocks that are still as large go on, the others are split to the end side by side."""
    nodes, own = materialize(nodes, "partition-nodes"), materialize(edges.where("a != b"), "partition-edges")
    if not exact_nodes and not refine:
        return _by_levels(cut_curve(nodes, own), eps, min_weight, group_nodes)
    ends = own.select(*UNIT, "wcc", F.col("a").alias("pos")).unionByName(own.select(*UNIT, "wcc", F.col("b").alias("pos")))
    touched = nodes.join(ends.distinct(), [*UNIT, "wcc", "pos"], "left_semi")
    sizes = ends.groupBy(*UNIT, "wcc").agg(F.count("*").alias("ends"))
    giant = materialize(_giant(touched, sizes, group_nodes), "giant")
    if giant.isEmpty():
        return partition_components(touched, own, eps, min_weight, exact_nodes, refine)
    few = partition_components(touched.join(giant, [*UNIT, "wcc"], "left_anti"), own.join(giant, [*UNIT, "wcc"], "left_anti"), eps, min_weight, exact_nodes, refine)
    return few.unionByName(_by_levels(cut_curve(nodes.join(giant, [*UNIT, "wcc"], "left_semi"), own.join(giant, [*UNIT, "wcc"], "left_semi")), eps, min_weight, group_nodes))


def _giant(nodes: DataFrame, ends: DataFrame, group_nodes: int) -> DataFrame:
    """``(unit, wcc)`` of components that no task holds, from their nodes and the ends of their edges (unit, wcc, ends)."""
    sizes = nodes.groupBy(*UNIT, "wcc").agg(F.count("*").alias("nodes")).join(ends, [*UNIT, "wcc"])
    return sizes.where((F.col("nodes") > group_nodes) | (F.col("ends") > 20 * group_nodes)).select(*UNIT, "wcc")


def _by_levels(curve: DataFrame, eps: float, min_weight: int, group_nodes: int = GROUP_NODES) -> DataFrame:
    """The blocks of ``curve`` split to the end by the sweep, level by level while they have over ``group_nodes`` nodes."""
    large = F.count(F.when(F.col("large"), 1)).alias("large")
    over = lambda *block: F.count("*").over(W.partitionBy(*UNIT, "wcc", *block)) > group_nodes
    first = curve.withColumn("path", F.array().cast("array<int>")).withColumn("status", F.lit(LIGHT)).withColumn("open", F.lit(True)).withColumn("large", over())
    now, seen = materialize_observed(first, "blocks", large)
    done, small = now.where("not open"), now.where("open and not large")
    whole = F.sum("weight").over(W.partitionBy(*UNIT, "wcc", "path"))
    while seen["large"]:
        split = acyclic_bisect(now.where("large").withColumn("status", F.when(whole >= min_weight, INFEASIBLE).otherwise(LIGHT)), eps, min_weight)
        grown = split.withColumn("path", F.when(F.col("label").isNotNull(), F.concat("path", F.array("label"))).otherwise(F.col("path"))).withColumn("open", F.col("label").isNotNull()).drop("label", "large")
        now, seen = materialize_observed(grown.withColumn("large", F.col("open") & over("path")), "blocks", large)
        done, small = done.unionByName(now.where("not open")), small.unionByName(now.where("open and not large"))
    ended = done.select(*UNIT, F.col("wcc").cast("int").alias("wcc"), F.col("pos").cast("int").alias("pos"), "path", "status")
    return _swept(small, eps, min_weight).unionByName(ended)


def partition_dag(scc_nodes: DataFrame, scc_edges: DataFrame, exact_nodes: int = 0, refine: bool = False, similarity_joins: bool = False) -> DataFrame:
    """``(unit, scc, path, status)``: the weak component's number, then the labels. Nodes without edges have the number alone and status ``alone``.

    With ``similarity_joins`` edges of similarity hold a weak component together too; else those between two components are dropped."""
    wcc = materialize(graph.weak_components(scc_nodes, scc_edges if similarity_joins else scc_edges.where("directed"), node="scc"), "wcc")
    inner = graph.component_edges(scc_edges, wcc)
    nodes = scc_nodes.join(wcc, [*UNIT, "scc"]).select(*UNIT, "wcc", F.col("scc").alias("pos"), "weight")
    labels = recursive_partition(nodes, inner, exact_nodes=exact_nodes, refine=refine).select(*UNIT, F.col("pos").alias("scc"), "path", "status")
    joined = wcc.join(labels, [*UNIT, "scc"], "left")
    return joined.select(*UNIT, "scc", F.concat(F.array("wcc"), F.coalesce("path", F.array().cast("array<int>"))).alias("path"), F.coalesce("status", F.lit("alone")).alias("status"))


def assign_clusters(nodes: DataFrame, scc: DataFrame, paths: DataFrame) -> DataFrame:
    """``(unit, ix, entity_id, name, path)`` and ``status`` where ``paths`` has it: every node has its component's path."""
    return nodes.join(scc, [*UNIT, "ix"]).join(paths, [*UNIT, "scc"]).select(*UNIT, "ix", "entity_id", "name", "path", *(["status"] if "status" in paths.columns else []))


def cluster_units(nodes: DataFrame, directed: DataFrame, similar: DataFrame, exact_nodes: int = EXACT_NODES, refine: bool = True, similarity_joins: bool = False) -> DataFrame:
    """Cluster paths and statuses of all nodes of all units, from indexed nodes, dependency edges and similarity edges.

    ``similar`` may come from any frame (unit, a, b, sim) with a < b."""
    edges = materialize(graph.edge_weights(directed, similar), "edges")
    scc = materialize(graph.strong_components(nodes, edges.where("directed")), "scc")
    scc_nodes, scc_edges = graph.condense_nodes(nodes, scc), graph.condense_edges(edges, scc)
    return assign_clusters(nodes, scc, partition_dag(scc_nodes, materialize(scc_edges, "scc-edges"), exact_nodes, refine, similarity_joins))


def cluster_named_units(nodes: DataFrame, directed: DataFrame, docs: DataFrame, sims: DataFrame, exact_nodes: int = EXACT_NODES, refine: bool = True, group_nodes: int = GROUP_NODES) -> DataFrame:
    """As ``cluster_units`` with the similarity edges of ``docs`` (parent_id, entity_id, doc) and ``sims`` (parent_id, doc_a, doc_b, sim), which are made
    only for components that one task splits. Dependencies alone hold a weak component together."""
    part = [*UNIT, "wcc"]
    directed = materialize(directed.select(*UNIT, "a", "b"), "directed")
    scc = materialize(graph.strong_components(nodes, directed), "scc")
    comps = materialize(graph.condense_nodes(nodes, scc).select(*UNIT, "scc", F.array_min("members").alias("node"), "weight"), "scc-nodes")
    ends = [scc.select(*UNIT, F.col("ix").alias(x), F.col("scc").alias(f"_{x}")) for x in "ab"]
    between = directed.join(ends[0], [*UNIT, "a"]).join(ends[1], [*UNIT, "b"]).select(*UNIT, F.col("_a").alias("a"), F.col("_b").alias("b"))
    wcc = materialize(graph.weak_components(comps, between, node="scc"), "wcc")
    named = docs.select("parent_id", "entity_id", "doc", F.lit(False).alias("is_client"))
    placed = materialize(comps.join(wcc, [*UNIT, "scc"]).select(*part, F.col("scc").alias("pos"), "node", "weight"), "places")
    members = nodes.join(scc, [*UNIT, "ix"]).join(placed.withColumnRenamed("pos", "scc"), [*UNIT, "scc"]).join(named, ["parent_id", "entity_id", "is_client"], "left")
    mixed = graph.mixed_edges(materialize(members.select(*part, "node", "ix", "doc"), "members"), directed, sims, ["wcc"])
    mixed = mixed._replace(others=materialize(mixed.others.where("a != b"), "others"))
    sizes = W.partitionBy(*part)
    touched = placed.withColumn("_n", F.count("*").over(sizes)).where("_n > 1").drop("_n")
    giant = materialize(_giant(touched, _ends(mixed), group_nodes), "giant")
    place = placed.select(*part, "node", "pos")
    own = _at_places(mixed.among(giant, "left_anti").edges(), place)
    labels = partition_components(touched.join(giant, part, "left_anti"), own, EPS, MIN_WEIGHT, exact_nodes, refine)
    if not giant.isEmpty():
        labels = labels.unionByName(_by_levels(named_curve(touched.join(giant, part, "left_semi"), mixed.among(giant), place), EPS, MIN_WEIGHT, group_nodes))
    paths = wcc.join(labels.select(*UNIT, F.col("pos").alias("scc"), "path", "status"), [*UNIT, "scc"], "left")
    paths = paths.select(*UNIT, "scc", F.concat(F.array("wcc"), F.coalesce("path", F.array().cast("array<int>"))).alias("path"), F.coalesce("status", F.lit("alone")).alias("status"))
    return assign_clusters(nodes, scc, paths)


def _at_places(edges: DataFrame, place: DataFrame) -> DataFrame:
    """Edges (unit, wcc, a, b, ...) of nodes, between their places."""
    part = [*UNIT, "wcc"]
    left, right = (place.select(*part, F.col("node").alias(x), F.col("pos").alias(f"_{x}")) for x in "ab")
    return edges.join(left, [*part, "a"]).join(right, [*part, "b"]).drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})


def _ends(mixed: graph.Mixed) -> DataFrame:
    """``(unit, wcc, ends)``: twice the edges between two nodes, those of similarity by the numbers of nodes of two names."""
    held = mixed.seats.groupBy(*mixed.by, "doc").agg(F.count("*").alias("n"))
    left, right = (held.select(*mixed.by, F.col("doc").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = left.join(mixed.near, ["parent_id", "doc_a"]).join(right, [*mixed.by, "doc_b"]).select(*mixed.by, (F.col("n_a") * (F.col("n_b") - (F.col("doc_a") == F.col("doc_b")).cast("long"))).alias("ends"))
    counted = pairs.unionByName(mixed.taken.select(*mixed.by, F.lit(-2).cast("long").alias("ends"))).unionByName(mixed.others.select(*mixed.by, F.lit(2).cast("long").alias("ends")))
    return counted.groupBy(*mixed.by).agg(F.sum("ends").alias("ends"))


def named_curve(nodes: DataFrame, mixed: graph.Mixed, place: DataFrame) -> DataFrame:
    """``nodes`` (unit, wcc, pos, weight) with ``cut`` as ``cut_curve`` has it of all edges of ``mixed``. ``place`` gives each ``node`` its ``pos``.

    A node adds the units to each similar node beyond it and takes off those before it, so the numbers of nodes of a name on
    either side are enough, and pairs that a dependency joins too are put right one by one."""
    part = mixed.by
    at = materialize(mixed.seats.withColumnRenamed("ix", "node").join(place, [*part, "node"]).select(*part, "doc", "pos"), "seat-places")
    near = mixed.near.select("parent_id", F.col("doc_a").alias("doc"), "doc_b", edge_units(F.col("sim")).alias("units"))
    asks = at.join(near, ["parent_id", "doc"]).select(*part, F.col("doc_b").alias("doc"), "pos", "units", (F.col("doc") == F.col("doc_b")).cast("long").alias("own"), F.lit(0).cast("long").alias("held"))
    marks = at.select(*part, "doc", "pos", F.lit(None).cast("long").alias("units"), F.lit(0).cast("long").alias("own"), F.lit(1).cast("long").alias("held"))
    name = W.partitionBy(*part, "doc")
    both = asks.unionByName(marks).withColumn("_to", F.sum("held").over(name.orderBy("pos"))).withColumn("_all", F.sum("held").over(name))
    similar = both.where("units is not null").select(*part, "pos", (F.col("units") * (F.col("_all") - 2 * F.col("_to") + F.col("own"))).alias("u"))
    single = _at_places(mixed.others.select(*part, "a", "b", edge_units(F.col("w")).alias("u")).unionByName(mixed.taken.select(*part, "a", "b", (-edge_units(F.col("sim"))).alias("u"))), place)
    steps = similar.unionByName(single.select(*part, F.least("a", "b").alias("pos"), "u")).unionByName(single.select(*part, F.greatest("a", "b").alias("pos"), (-F.col("u")).alias("u")))
    running = F.sum("u").over(W.partitionBy(*part).orderBy("pos"))
    return nodes.join(steps.groupBy(*part, "pos").agg(F.sum("u").alias("u")), [*part, "pos"]).withColumn("cut", running).select(*part, "pos", "weight", "cut")
