"""Exact top-k by inner product through a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; sorted by that key, each pivot's
vectors lie in rings. For a query at distance d from a pivot, a vector in the ring from low to high is, by the triangle
inequality, at least max(0, d - high, low - d) away, so its inner product is at most half of the query's
squared norm plus the ring's greatest squared norm less that distance squared; it is also at most the
pivot's inner product plus the query's norm times high. Rings are opened in the order of the lesser
bound, and the search stops at rings whose bound is below the k-th score found.

Pivots are the means of a bounded sample's clusters. They only decide how much is opened: every row is
indexed and the result is exact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inner_products import ANY, LEAST, MOST, SLACK, draw, one_query_each, packed, placed, search, whole_vectors

SCALE = 1024
MOST_PIVOTS = 256
ROUNDS = 6
TOP = 10
QUERY_EVERY = 100


def choose(sample: dict[int, np.ndarray], n: int, seed: int = 5) -> dict[int, tuple[int, np.ndarray]]:
    """For each length the number of its first pivot, and its pivots: means of clusters of the sample."""
    found, begin = {}, 0
    total = sum(map(len, sample.values()))
    for dim, rows in sample.items():
        k = max(1, round(min(MOST_PIVOTS, math.sqrt(n) / 8) * len(rows) / total))
        rng = np.random.default_rng(seed)
        pivots = np.unique(rows[rng.permutation(len(rows))[:k]], axis=0)
        for _ in range(ROUNDS):
            nearest = _squares(rows, pivots).argmin(axis=1)
            pivots = np.array([rows[nearest == p].mean(axis=0) for p in np.unique(nearest)])
        found[dim] = begin, pivots
        begin += len(pivots)
    return found


def _squares(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T))


def _place(pivots: dict[int, tuple[int, np.ndarray]]):
    def place(dim: int, x: np.ndarray, norms: np.ndarray):
        if dim not in pivots:
            return np.full(len(x), ANY), np.zeros(len(x)), np.zeros((len(x), 0))
        begin, points = pivots[dim]
        squares = _squares(x, points)
        nearest = squares.argmin(axis=1)
        return begin + nearest, np.sqrt(squares[np.arange(len(x)), nearest]), np.zeros((len(x), 0))

    return place


def _bounds(pivots: dict[int, tuple[int, np.ndarray]]):
    def bounds(dim: int, q: np.ndarray, least: np.ndarray, most: np.ndarray, rings: dict):
        if dim not in pivots:
            return np.full((len(q), len(rings["cell"])), -math.inf), np.full((len(q), len(rings["cell"])), math.inf)
        begin, points = pivots[dim]
        pivot = np.maximum(rings["centre"] - begin, 0)
        size = (q**2).sum(axis=1)[:, None]
        away = np.sqrt(_squares(q, points))[:, pivot]
        gap = np.maximum(0.0, np.maximum(away - rings["high"], rings["low"] - away))
        norm = np.where(np.isfinite(rings["norm"]), rings["norm"], 0.0) ** 2
        by_distance = (size + norm - gap**2) / 2
        by_pivot = (q @ points.T)[:, pivot] + np.sqrt(size) * rings["high"]
        return np.full(away.shape, -math.inf), np.minimum(by_distance, by_pivot) + SLACK * (size + norm) + 1

    return bounds


def top_products(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` the ``k`` other rows of
    highest inner product, of ``embeddings(vec_id, embedding)`` with components floor(scale * x).

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components, and rows without an
    id, take no part; zero vectors do. Vectors meet those of their own length only. Repeated rows are candidates
    each; an id that is repeated asks once, with the first of its vectors by numbers, and never finds its own id.
    Scores beyond a long count as its ends. An empty table gives no rows; other columns are not looked at.
    """
    vectors = whole_vectors(embeddings.select("vec_id", F.lit(None).cast("long").alias("label"), "embedding"), scale)
    count, row_bytes = vectors.agg(F.count("*"), F.avg(F.octet_length("vec"))).first()
    pivots = choose(draw(vectors, count, row_bytes or 0), count)
    index = packed(placed(vectors, _place(pivots)), "distance")
    queries = one_query_each(vectors.where(F.col("vec_id") % every == 0)).select(
        "*", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs")
    )
    found = search(queries, index, _bounds(pivots), k)
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id as query_id, row_number() over (partition by q.vec_id order by list_dot_product(q.e, c.e) desc, c.vec_id)::int as rank,
       c.vec_id, list_dot_product(q.e, c.e)::bigint as score
from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
where q.vec_id % 100 = 0
qualify rank <= 10"""


def op12_pivot_search(spark, sf_dir):
    """The ten highest inner products of every hundredth vector; see ``top_products`` for odd rows."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
