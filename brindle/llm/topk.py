"""Exact top-k inner products of integer vectors through distances to pivots.

Pivots are a bounded sample: ``PIVOTS`` vectors with the smallest hash of their id. Every vector is keyed by its nearest
pivot and the distance to it; the vectors of a pivot, sorted by that distance, are cut into annuli. For a query q, a pivot
at distance d and an annulus of distances from a to b, the triangle inequality keeps every vector of the annulus at least
g = max(0, d - b, a - d) away, so its inner product is at most (|q|^2 + N^2 - g^2) / 2 with N the largest norm there, and
also at most q.p + |q| b. Annuli are taken by the better of the two bounds, highest first, and the search stops when the
next bound is below the k-th best product: results are exact whatever the pivots.

Nulls: rows with a null id, and vectors that are null, empty, of an unusual size or with null or non-finite components,
take no part. Equal vectors are indexed once, ties go to the smaller id, and rows with the query's own id are never its
results. Products must stay below 2^63. An empty table gives no rows. Only the id and the vector column are read, so
further columns can have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

PIVOTS = 64
ANNULUS = 32
SCALE = 256
BLOCK_ROWS = 32768
GROUP_ROWS = 4096


def search(table: DataFrame, every: int, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest integer products for ids that ``every`` divides."""
    rows = blocks.vectors(table, id_column, vector, zero=True)
    rows = blocks.written(rows.select("id", F.transform("vec", lambda x: F.floor(x * float(scale)).cast("double")).alias("vec")), "vectors")
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()  # a fixed number of rows
    centres = np.unique(np.array([r["vec"] for r in chosen], float), axis=0) if chosen else np.zeros((0, 1))

    def build(ids: np.ndarray, vecs: np.ndarray) -> tuple:
        vecs, names = blocks.distinct(ids, vecs, k + 1)
        norms = np.einsum("ij,ij->i", vecs, vecs)
        square = np.maximum(0, norms[:, None] + np.einsum("ij,ij->i", centres, centres) - 2 * vecs @ centres.T)
        pivot = square.argmin(axis=1)
        far = np.sqrt(square[np.arange(len(vecs)), pivot])
        order = np.lexsort((far, pivot))
        cuts = np.searchsorted(pivot[order], np.arange(len(centres) + 1))
        members = blocks.chunked(order, cuts, ANNULUS)
        there = members >= 0
        a, b = np.where(there, far[members], np.inf).min(axis=1), np.where(there, far[members], 0).max(axis=1)
        return members, pivot[members[:, 0]], a, b, np.where(there, norms[members], 0).max(axis=1), vecs, names

    def answer(made: tuple, own: np.ndarray, queries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        members, pivot, a, b, largest, vecs, names = made
        norms = np.einsum("ij,ij->i", queries, queries)
        product = queries @ centres.T
        d = np.sqrt(np.maximum(0, norms[:, None] + np.einsum("ij,ij->i", centres, centres) - 2 * product))
        gap = np.maximum(0, np.maximum(d[:, pivot] - b, a - d[:, pivot]) - 1e-6)
        most = np.minimum((norms[:, None] + largest - gap**2) / 2, product[:, pivot] + np.sqrt(norms)[:, None] * (b + 1e-6))
        most += 1e-9 * np.abs(most) + 0.5  # products are integers: the slack only covers rounding

        found, _ = blocks.Leaves(members, vecs).search(queries, -most, min(k + 1, len(vecs)), lambda live, bound, least: -bound < least)
        whole, asked = vecs.astype(np.int64), queries.astype(np.int64)
        return blocks.expand(found, own, names, lambda q, r: whole[r] @ asked[q], k)

    return blocks.search(rows, every, k, build, answer, "long", block_rows, GROUP_ROWS)
