"""Random forests on binned rows, a tree in one task.

A tree sees a row only by the bins of its features, so equal rows are one row with a
count for each fold. These rows go to every task once, as bytes, and a task grows whole
trees, level by level; deep trees need no job a level. Trees, bins and importances follow
Spark's forests: Gini impurity, at most 32 bins a feature from about 10,000 rows, Poisson
bags of the rows, square root of the features a node, leaves with equal predictions merged.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particlelake.operators.cluster.stacked import Batches, Packed, _unpacked
from particlelake.runtime import cut_lineage

BINS = 32
#: Rows that bins are found from: those with the smallest hashes.
SAMPLE_ROWS = 10_000
#: Bytes of binned rows and of the arrays that growing takes for each; larger tables take Spark's own forest.
MOST_BYTES, WORK_BYTES = 512 << 20, 200
#: Held-out rows whose votes are added up in one task, and jobs a core.
PART_ROWS, JOBS = 65_536, 8
#: Cells of a histogram that a row may pay for.
CELLS = 8
EPSILON = 1e-12


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Cuts between values of one feature: all if there are few, otherwise nearest to equal shares."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middle) < bins:
        return middle
    total = np.cumsum(counts)
    wanted = len(values) / bins * np.arange(1, bins)
    above = np.searchsorted(total, wanted).clip(1, len(middle) - 1)
    nearest = np.where(wanted - total[above - 1] < total[above] - wanted, above - 1, above)
    return middle[np.unique(nearest)]


@dataclass
class BinnedRows:
    """Distinct (codes, label) rows and how many rows of each fold they stand for."""

    codes: np.ndarray
    label: np.ndarray
    counts: np.ndarray
    classes: int


def binned_rows(points: DataFrame, packed: Packed, classes: int, folds: int, most_bytes: int = MOST_BYTES) -> BinnedRows | None:
    """The rows of ``packed``, whose labels are class and fold; None if they are too many for one task."""
    chosen = points.select("h", "x").orderBy("h", "x").limit(SAMPLE_ROWS).select("x").toArrow().column("x").combine_chunks()
    sample = chosen.flatten().to_numpy().reshape(len(chosen), -1) - packed.centre
    edges = [bin_edges(sample[:, j]) for j in range(packed.dims)]

    def coded(batches: Batches) -> Batches:
        for _, chunk in _unpacked(batches):
            codes = np.column_stack([np.searchsorted(e, chunk.x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)
            fields = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(chunk.labels[:, 0]), pa.array(chunk.labels[:, 1])]
            yield pa.RecordBatch.from_arrays(fields, names=["code", "label", "fold"])

    rows = packed.frame.withColumn("part", F.lit(0)).mapInArrow(coded, "code binary, label int, fold int")
    counts = [F.count_if(F.col("fold") == f).cast("int").alias(f"n{f}") for f in range(folds)]
    known = cut_lineage(rows.groupBy("code", "label").agg(*counts))
    if known.count() * (packed.dims + 4 * (folds + 1) + WORK_BYTES) > most_bytes:
        return None
    # one order, so trees do not depend on the tasks
    table = known.orderBy("code", "label").toArrow().combine_chunks()
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return BinnedRows(codes, table.column("label").to_numpy(), np.column_stack([table.column(f"n{f}").to_numpy() for f in range(folds)]), classes)


@dataclass
class Tree:
    """Nodes by level; the children of an inner node are ``left`` and the next one, leaves have -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    sums: np.ndarray
    gain: np.ndarray

    def votes(self, codes: np.ndarray) -> np.ndarray:
        """Class shares of the leaf of every row."""
        node = np.zeros(len(codes), np.int64)
        moving = np.arange(len(codes))
        while len(moving):
            moving = moving[self.left[node[moving]] >= 0]
            at = node[moving]
            node[moving] = self.left[at] + (codes[moving, self.feature[at]] > self.cut[at])
        return (self.sums / self.sums.sum(axis=1, keepdims=True))[node]

    def importances(self, features: int) -> np.ndarray:
        inner = self.left >= 0
        found = np.bincount(self.feature[inner], self.gain[inner] * self.sums[inner].sum(axis=1), features)
        return found / found.sum() if found.sum() > 0 else found


def _dense_scores(at: np.ndarray, code: np.ndarray, label: np.ndarray, w: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cut of each node and its score, from a histogram of all nodes."""
    nodes, classes = total.shape
    cells = np.bincount((at * BINS + code) * classes + label, w, nodes * BINS * classes).reshape(nodes, BINS, classes)
    left = np.cumsum(cells, axis=1)[:, :-1]
    right = total[:, None] - left
    filled = cells.any(axis=2)
    n, rest = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (left * left).sum(axis=2) / n + (right * right).sum(axis=2) / rest
    more = np.cumsum(filled[:, ::-1], axis=1)[:, ::-1][:, 1:] > 0
    score = np.where(filled[:, :-1] & more, score, -np.inf)
    cut = score.argmax(axis=1)
    return cut, score[np.arange(nodes), cut]


def _sorted_scores(at: np.ndarray, code: np.ndarray, label: np.ndarray, w: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by sorting the rows, for many nodes of few rows.

    Squares of class sums grow by 2 c w - w² when a row of weight w takes its class to c.
    """
    nodes, classes = total.shape
    rows = len(at)
    bits = max(1, int(rows - 1).bit_length())
    place, mask = np.arange(rows), (1 << bits) - 1

    def within(values: np.ndarray, group: np.ndarray) -> np.ndarray:
        summed = np.cumsum(values)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return summed - np.repeat(np.r_[0.0, summed[first[1:] - 1]], np.diff(np.r_[first, rows]))

    group = at * classes + label
    order = np.sort(((group * BINS + code) << bits) | place) & mask
    grown = np.empty(rows)
    grown[order] = within(w[order], group[order])
    order = np.sort(((at * BINS + code) << bits) | place) & mask
    node, value, weight = at[order], code[order], w[order]
    same = within((2.0 * grown[order] - weight) * weight, node)
    met = within(total[node, label[order]] * weight, node)
    n = within(weight, node)
    last = np.flatnonzero((node[1:] == node[:-1]) & (value[1:] != value[:-1]))
    cut, best = np.zeros(nodes, np.int64), np.full(nodes, -np.inf)
    if len(last):
        whole, squares = total.sum(axis=1), (total * total).sum(axis=1)
        node, same, n = node[last], same[last], n[last]
        score = same / n + (squares[node] - 2.0 * met[last] + same) / np.maximum(whole[node] - n, 1e-300)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        best[node[first]] = np.maximum.reduceat(score, first)
        top = np.flatnonzero(score == best[node])
        top = top[np.r_[True, node[top[1:]] != node[top[:-1]]]]
        cut[node[top]] = value[last[top]]
    return cut, best


def grow(rows: BinnedRows, bag: np.ndarray, weight: np.ndarray, rng: np.random.Generator, max_depth: int) -> Tree:
    """One tree on rows that count ``bag`` times the weight of their class."""
    features, classes = rows.codes.shape[1], rows.classes
    tried = math.ceil(math.sqrt(features))
    row = np.flatnonzero(bag)
    label, w = rows.label[row].astype(np.int64), bag[row] * weight[rows.label[row]]
    at, nodes = np.zeros(len(row), np.int64), 1
    levels: list[list[np.ndarray]] = []
    size = 0
    for depth in range(max_depth + 1):
        total = np.bincount(at * classes + label, w, nodes * classes).reshape(nodes, classes)
        whole = np.maximum(total.sum(axis=1), 1e-300)
        impurity = 1.0 - (total * total).sum(axis=1) / whole**2
        feature, cut, left, gain = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.full(nodes, -1), np.zeros(nodes)
        levels.append([feature, cut, left, total, gain])
        size += nodes
        open_ = np.flatnonzero(impurity > EPSILON) if depth < max_depth else np.zeros(0, np.int64)
        if not len(open_):
            break
        # rows of open nodes only, with the nodes numbered anew
        number = np.full(nodes, -1)
        number[open_] = np.arange(len(open_))
        kept = number[at] >= 0
        row, label, w, at = row[kept], label[kept], w[kept], number[at[kept]]
        total = total[open_]
        several = np.sort(rng.random((len(open_), features)).argpartition(tried - 1, axis=1)[:, :tried], axis=1)
        best, which, where = np.full(len(open_), -np.inf), np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        scores = _dense_scores if len(open_) * BINS * classes <= CELLS * len(row) else _sorted_scores
        for j in range(tried):
            code = rows.codes[row, several[at, j]].astype(np.int64)
            found, score = scores(at, code, label, w, total)
            better = score > best
            best[better], which[better], where[better] = score[better], several[better, j], found[better]
        right = rows.codes[row, which[at]] > where[at]
        sides = np.bincount((at * 2 + right) * classes + label, w, len(open_) * 2 * classes).reshape(len(open_), 2, classes)
        with np.errstate(divide="ignore", invalid="ignore"):
            pure = ((sides * sides).sum(axis=2) / sides.sum(axis=2)).sum(axis=1) / whole[open_]
        won = pure - (1.0 - impurity[open_])
        split = (best > -np.inf) & (won > EPSILON)
        chosen = open_[split]
        feature[chosen], cut[chosen], gain[chosen] = which[split], where[split], won[split]
        left[chosen] = size + 2 * np.arange(len(chosen))
        number = np.full(len(open_), -1)
        number[split] = 2 * np.arange(len(chosen))
        kept = split[at]
        row, label, w, at = row[kept], label[kept], w[kept], number[at[kept]] + right[kept]
        nodes = 2 * len(chosen)
        if not nodes:
            break
    tree = Tree(*[np.concatenate(parts) for parts in zip(*levels)])
    predicted = tree.sums.argmax(axis=1)
    end = size
    for level in reversed(levels):
        end -= len(level[0])
        inner = end + np.flatnonzero(tree.left[end: end + len(level[0])] >= 0)
        a = tree.left[inner]
        alike = (tree.left[a] < 0) & (tree.left[a + 1] < 0) & (predicted[a] == predicted[a + 1])
        tree.left[inner[alike]] = -1
    return tree


def forests(
    rows: BinnedRows, weights: Sequence[np.ndarray], packed: Packed, trees: int, seed: int, max_depth: int
) -> tuple[list[float], np.ndarray]:
    """Balanced accuracy on each held-out fold, and the feature importances of a forest of all rows.

    ``weights`` are those of the classes without each fold, then of all rows.
    """
    spark = packed.frame.sparkSession
    folds = rows.counts.shape[1]
    shared = spark.sparkContext.broadcast((rows, [np.asarray(w, float) for w in weights]))
    share = max(1, math.ceil((folds + 1) * trees / (JOBS * spark.sparkContext.defaultParallelism)))
    jobs = [(fit, first, min(trees, first + share)) for fit in range(folds + 1) for first in range(0, trees, share)]

    def grown(batches: Batches) -> Batches:
        rows, weights = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fit, first, last = jobs[i]
                used = rows.counts.sum(axis=1) - (rows.counts[:, fit] if fit < folds else 0)
                held = rows.codes[rows.counts[:, fit] > 0] if fit < folds else rows.codes[:0]
                found = np.zeros((len(held), rows.classes)) if fit < folds else np.zeros((1, rows.codes.shape[1]))
                for t in range(first, last):
                    rng = np.random.default_rng([seed, fit, t])
                    tree = grow(rows, rng.poisson(used), weights[fit], rng, max_depth)
                    found += tree.votes(held) if fit < folds else tree.importances(rows.codes.shape[1])
                parts = range(0, len(found), PART_ROWS)
                fields = [pa.array([fit] * len(parts), pa.int32()), pa.array([p // PART_ROWS for p in parts], pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [*fields, pa.array([found[p: p + PART_ROWS].tobytes() for p in parts], pa.binary())], names=["fit", "part", "found"]
                )

    def added(table: pa.Table) -> pa.Table:
        fit, part = table.column("fit")[0].as_py(), table.column("part")[0].as_py()
        found = sum(np.frombuffer(v.as_buffer()) for v in table.column("found"))
        if fit < folds:
            rows = shared.value[0]
            held = np.flatnonzero(rows.counts[:, fit])[part * PART_ROWS: (part + 1) * PART_ROWS]
            label, times = rows.label[held], rows.counts[held, fit].astype(float)
            hit = times * (found.reshape(len(held), -1).argmax(axis=1) == label)
            found = np.concatenate([np.bincount(label, v, rows.classes) for v in (hit, times)])
        return pa.table({"fit": pa.array([fit], pa.int32()), "found": pa.array([found.tobytes()], pa.binary())})

    partial = spark.range(len(jobs), numPartitions=len(jobs)).mapInArrow(grown, "fit int, part int, found binary")
    totals = [np.zeros(2 * rows.classes) for _ in range(folds)] + [np.zeros(rows.codes.shape[1])]
    for r in partial.groupBy("fit", "part").applyInArrow(added, "fit int, found binary").collect():
        totals[r["fit"]] = totals[r["fit"]] + np.frombuffer(r["found"])
    shared.unpersist()
    importance = totals.pop()
    hits, seen = (np.array([t.reshape(2, -1)[i] for t in totals]) for i in (0, 1))
    accuracy = [float((h[n > 0] / n[n > 0]).mean()) for h, n in zip(hits, seen)]
    return accuracy, importance / importance.sum() if importance.sum() > 0 else importance
