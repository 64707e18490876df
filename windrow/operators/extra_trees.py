"""Extremely randomised trees: one random threshold per node and feature, drawn by a hash counter between the node's extremes.

All trees grow level by level in two passes a level: the extremes of every feature in every node, then the sums left of every drawn threshold.
A kernel adds both up for its whole task, so what is shuffled is bounded by trees x nodes x features; the driver draws the thresholds and
picks the splits from the summed tables.  The same seed draws the same thresholds in any engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from windrow.session import checkpoint

#: rows a task's kernel takes at a time
BLOCK = 65_536


def uniform(seed: int, tree: int, node: int, feature: int) -> float:
    """Number in [0, 1): the first 32 bits of the md5 of "seed-tree-node-feature"."""
    return int(hashlib.md5(f"{seed}-{tree}-{node}-{feature}".encode()).hexdigest()[:8], 16) / 2**32


@dataclass(frozen=True)
class Forest:
    """Per tree, by node number (1 the root, 2n and 2n + 1 the children of n): the feature (-1: a leaf), its threshold, and the leaf's mean."""

    features: tuple[str, ...]
    split: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, df: DataFrame, name: str = "prediction", leaves: str | None = None) -> DataFrame:
        """``df`` with the mean over the trees and, if asked, the leaf number of every tree."""
        fields = [*df.schema.fields, T.StructField(name, T.DoubleType()), *([T.StructField(leaves, T.ArrayType(T.LongType()))] if leaves else [])]
        schema = to_arrow_schema(T.StructType(fields))
        at = [df.columns.index(f) for f in self.features]
        split, threshold, value, trees = self.split, self.threshold, self.value, len(self.split)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _columns(batch, at)
                total, nodes = np.zeros(batch.num_rows), np.zeros((batch.num_rows, trees), np.int64)
                for t in range(trees):
                    nodes[:, t] = _walk(x, split[t], threshold[t])
                    total += value[t][nodes[:, t]]
                out = [pa.array(total / trees)]
                if leaves:
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, trees), pa.int32()), pa.array(nodes.ravel())))
                yield pa.RecordBatch.from_arrays([*[c.cast(schema.field(i).type) for i, c in enumerate(batch.columns)], *out], schema=schema)

        return df.mapInArrow(run, T.StructType(fields))


def _columns(batch: pa.RecordBatch, at: Sequence[int]) -> np.ndarray:
    """Features x rows, so that a node reads one feature of its rows from one stretch of memory."""
    return np.array([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at], float).reshape(len(at), batch.num_rows)


def _walk(x: np.ndarray, split: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Node every row ends in; a missing value goes right.  A leaf is its own child, so all rows take every level's step."""
    inner = np.flatnonzero(split >= 0)
    child = np.repeat(np.arange(len(split)), 2)
    child[2 * inner], child[2 * inner + 1] = 2 * inner, 2 * inner + 1
    start, flat, rows, node = np.maximum(split, 0) * x.shape[1], x.ravel(), np.arange(x.shape[1]), np.ones(x.shape[1], np.int64)
    for _ in range(int(inner.max(initial=0)).bit_length()):
        at = start.take(node)
        at += rows
        right = ~(flat.take(at) <= threshold.take(node))
        node += node
        node += right
        node = child.take(node)
    return node


def _members(x: np.ndarray, split: np.ndarray, threshold: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every node from ``first`` on that rows end in, and their numbers."""
    node = _walk(x, split, threshold)
    order = np.argsort(node.astype(np.uint16) if len(split) <= 2**16 else node, kind="stable")  # short numbers are sorted by their digits
    sizes = np.bincount(node, minlength=len(split))
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(sizes[first:]) + first:
        yield int(k), order[ends[k] - sizes[k]:ends[k]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``BLOCK`` rows: a node's few calls then serve many rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def grow(df: DataFrame, features: Sequence[str], target: str, trees: int = 20, depth: int = 6, minimum: int = 8, seed: int = 42) -> Forest:
    """Forest of ``trees`` trees of at most ``depth`` levels whose leaves have at least ``minimum`` rows.

    A node splits at the drawn threshold with the largest drop of the squared error; equal drops: the first feature.  Rows without a target
    take no part.
    """
    count, places = len(features), 2 ** (depth + 1)
    split, threshold, value = np.full((trees, places), -1), np.zeros((trees, places)), np.zeros((trees, places))
    rows = checkpoint(df.where(F.col(target).isNotNull()).select(*[F.col(f).cast("double") for f in features], F.col(target).cast("double").alias("_y")))
    kind = "tree int, node int, f int, n double, s double, a double, b double"
    names = [c.split()[0] for c in kind.split(", ")]

    def tables(drawn: np.ndarray | None) -> dict[tuple[int, int], np.ndarray]:
        """Per open (tree, node): features x (rows, target sum, least, most), or (rows, target sum) left of the drawn thresholds."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in _blocks(batches):
                x, y = _columns(batch, range(count)), np.asarray(batch.column(count).to_numpy(zero_copy_only=False), float)
                for t in range(trees):
                    for k, own in _members(x, split[t], threshold[t], first):
                        px, py = x.take(own, axis=1), y[own]
                        into = sums.setdefault((t, k), np.tile([0.0, 0.0, np.inf, -np.inf], (count, 1)))
                        if drawn is None:
                            into[:, 0] += len(py)
                            into[:, 1] += py.sum()
                            least, most = px.min(axis=1), px.max(axis=1)
                            for f in np.flatnonzero(np.isnan(least)):
                                known = px[f][~np.isnan(px[f])]
                                least[f], most[f] = known.min(initial=np.inf), known.max(initial=-np.inf)
                            into[:, 2] = np.minimum(into[:, 2], least)
                            into[:, 3] = np.maximum(into[:, 3], most)
                        else:
                            left = px <= drawn[t, k][:, None]
                            into[:, 0] += np.count_nonzero(left, axis=1)
                            into[:, 1] += left @ py
            out = [(t, k, f, *map(float, v)) for (t, k), s in sums.items() for f, v in enumerate(s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 3 else pa.float64()) for i, c in enumerate(zip(*out))], names=names)

        found: dict[tuple[int, int], np.ndarray] = {}
        sums = rows.mapInArrow(run, kind).groupBy("tree", "node", "f").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("a").alias("a"), F.max("b").alias("b"))
        for r in sums.collect():  # trees x open nodes x features
            found.setdefault((r["tree"], r["node"]), np.zeros((count, 4)))[r["f"]] = r["n"], r["s"], r["a"], r["b"]
        return found

    for level in range(depth + 1):
        first = 2**level  # nodes of this level
        whole = tables(None)
        for (t, k), w in whole.items():
            value[t, k] = w[0, 1] / w[0, 0]
        if level == depth or not whole:
            break
        drawn = np.full((trees, places, count), -np.inf)
        for (t, k), w in whole.items():
            for f in range(count):
                if w[f, 2] < w[f, 3]:
                    drawn[t, k, f] = w[f, 2] + uniform(seed, t, k, f) * (w[f, 3] - w[f, 2])
        left = tables(drawn)
        for (t, k), w in whole.items():
            n, s, best = w[0, 0], w[0, 1], 1e-9
            for f in range(count):
                nl, sl = left[t, k][f, :2] if (t, k) in left else (0.0, 0.0)
                if min(nl, n - nl) < minimum:
                    continue
                gain = round(sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n, 9)
                if gain > best:
                    best, split[t, k], threshold[t, k] = gain, f, drawn[t, k, f]
        if not (split[:, first:2 * first] >= 0).any():
            break
    return Forest(tuple(features), split, threshold, value)
