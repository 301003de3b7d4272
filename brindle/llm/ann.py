"""Approximate nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square stop.

Vectors get one more component so that all have the norm of the longest; then the largest inner product is the least
distance. Gaussian (2-stable) projections take them to ``DIMS`` dimensions, where a kd-tree splits the widest dimension
at its median down to leaves. A query visits leaves by the distance of their boxes to its projection, so projected
neighbours come in increasing order up to a leaf, and verifies them on the vectors themselves. For a pair at distance d the
squared projected distance is d^2 times a chi-square variable with ``DIMS`` degrees of freedom: the search stops once a
vector nearer than the k-th best would have its projection beyond the next leaf only with probability ``1 - CERTAIN``.

Nulls: rows with a null id, and vectors that are null, empty, zero, of an unusual size or with null or non-finite
components, take no part. Equal vectors are indexed once, ties go to the smaller id, and rows with the query's own id are
never its neighbours. An empty table gives no rows. Only the id and the vector column are read, so further columns can
have any name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

DIMS = 8
CERTAIN = 0.9
LEAF = 32
BLOCK_ROWS = 32768
GROUP_ROWS = 4096
SEED = 11


def chi_square(x: float, freedom: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, freedom // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def chi_square_point(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


def kd_tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The points' order by leaves and the leaves' ends."""
    order, cuts, todo = np.arange(len(points)), [0], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            cuts.append(b)
            continue
        part = points[order[a:b]]
        wide = np.argmax(part.max(axis=0) - part.min(axis=0))
        middle = leaf * max(1, round((b - a) / 2 / leaf))
        order[a:b] = order[a:b][np.argpartition(part[:, wide], middle)]
        todo += [(a + middle, b), (a, a + middle)]
    return order, np.array(cuts)


def search(table: DataFrame, every: int, k: int, id_column: str = "vec_id", vector: str = "embedding", certain: float = CERTAIN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest inner products found for ids that ``every`` divides."""
    rows = blocks.vectors(table, id_column, vector, zero=False)
    rows = blocks.written(rows, "vectors")
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    stop = chi_square_point(certain, DIMS)

    def project(size: int) -> np.ndarray:
        return np.random.default_rng(SEED).standard_normal((size + 1, DIMS))

    def build(ids: np.ndarray, vecs: np.ndarray) -> tuple:
        vecs, names = blocks.distinct(ids, vecs, k + 1)
        rest = np.sqrt(np.maximum(0, longest - np.einsum("ij,ij->i", vecs, vecs)))
        points = np.hstack([vecs, rest[:, None]]) @ project(vecs.shape[1])
        order, cuts = kd_tree(points, LEAF)
        members = blocks.chunked(order, cuts, LEAF)
        inside = np.where(members[:, :, None] >= 0, points[members], np.nan)
        return members, np.nanmin(inside, axis=1), np.nanmax(inside, axis=1), vecs, names

    def answer(made: tuple, own: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        members, low, high, vecs, names = made
        points = np.hstack([queries, np.zeros((len(queries), 1))]) @ project(vecs.shape[1])
        bounds = np.zeros((len(queries), len(members)))
        for d in range(DIMS):
            x = points[:, d, None]
            bounds += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
        norms = np.einsum("ij,ij->i", queries, queries)

        def done(live: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
            return bound >= stop * np.maximum(0, norms[live] + longest - 2 * least)

        found, _ = blocks.Leaves(members, vecs).search(queries, bounds, min(k + 1, len(vecs)), done)
        return blocks.expand(found, own, names, lambda q, r: vecs[r] @ queries[q], k)

    return blocks.search(rows, every, k, build, answer, "double", block_rows, GROUP_ROWS)
