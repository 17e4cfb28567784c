"""Hard negatives through a cover tree over norm-augmented candidates.

A component is added to every candidate so that all have the greatest norm; then inner products with an anchor
fall as distances grow, and a ball or ring around a node's centre bounds them from both sides. The tree's levels are
nested: points of a bounded sample are taken farthest first, each level has four times as many of them as the
one above, and a point hangs on the nearest of that level. Every row goes down to a lowest node, and the covering
radius of each node, level by level, is the greatest distance of all rows below it, so the bounds hold
for all rows, whatever the sample was.

An anchor goes down level by level and leaves out nodes whose bounds lie outside the scores it looks for; of the
rings in the lowest nodes the best are opened first, and their vectors are scored exactly. First an anchor finds its
positives among rows of its label; each positive's score is a window in which it then looks for
rows of other labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .inner_products import ANY, LEAST, MOST, SLACK, beside, draw, one_query_each, packed, placed, search, whole_vectors

SCALE = 256
FAN = 4
MOST_NODES = 1024
"""Lowest nodes of one length of vectors."""

ANCHOR_EVERY, POSITIVES, NEGATIVES = 100, 5, 5
LEAST_SHARE = 80
"""A negative has at least so many hundredths of the positive's score."""


@dataclass(frozen=True)
class Tree:
    first: int
    """The number of the first lowest node."""
    centres: np.ndarray
    """Augmented points in the order taken; level l has the first ``FAN**l`` of them."""
    norm: float
    sizes: list[int]
    parents: list[np.ndarray]
    """For each level but the top, the place of each point's parent in the level above."""
    radii: list[np.ndarray] | None = None


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, norm**2 - (x**2).sum(axis=1)))[:, None]])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def grow(sample: np.ndarray, norm: float, most: int, first: int = 0) -> Tree:
    """The nested levels of a sample: points farthest from those taken, and their parents."""
    points = np.unique(augmented(sample, norm), axis=0)
    taken, nearest = [0], _apart(points, points[:1])[:, 0]
    while len(taken) < min(most, len(points)) and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _apart(points, points[taken[-1:]])[:, 0])
    centres, sizes = points[taken], [1]
    while sizes[-1] < len(centres):
        sizes.append(min(FAN * sizes[-1], len(centres)))
    parents = [_apart(centres[:below], centres[:above]).argmin(axis=1) for above, below in zip(sizes, sizes[1:])]
    return Tree(first, centres, norm, sizes, parents)


def descend(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest node of each augmented row, nearest child by nearest child, and its distances from the nodes passed."""
    at = np.zeros(len(x), dtype=np.int64)
    far = [_apart(x, tree.centres[:1])[:, 0]]
    for size, parents in zip(tree.sizes[1:], tree.parents):
        away = _apart(x, tree.centres[:size])
        child = np.where(parents[None, :] == at[:, None], away, math.inf).argmin(axis=1)
        far.append(away[np.arange(len(x)), child])
        at = child
    return at, np.stack(far, axis=1)


def _place(trees: dict[int, Tree]):
    def place(dim: int, x: np.ndarray, norms: np.ndarray):
        if dim not in trees:
            return np.full(len(x), ANY), np.zeros(len(x)), np.zeros((len(x), 0))
        node, far = descend(trees[dim], augmented(x, trees[dim].norm))
        return trees[dim].first + node, far[:, -1], far

    return place


def measured(tree: Tree, reach: dict[int, list[float]]) -> Tree:
    """``tree`` with covering radii: the greatest distance from each node of a row below it, -1 where there is none."""
    n = len(tree.centres)
    lowest = np.full((n, len(tree.sizes)), -1.0)
    for node, far in reach.items():
        lowest[node - tree.first] = far
    radii, up = [], np.arange(n)
    for level in range(len(tree.sizes) - 1, -1, -1):
        radius = np.full(tree.sizes[level], -1.0)
        np.maximum.at(radius, up, lowest[:, level])
        radii.append(radius)
        if level:
            up = tree.parents[level - 1][up]
    return Tree(tree.first, tree.centres, tree.norm, tree.sizes, tree.parents, radii[::-1])


def _products(size: np.ndarray, norm: float, away: np.ndarray) -> np.ndarray:
    """The inner product of an anchor of squared norm ``size`` and a candidate so far away."""
    return (size + norm**2 - away**2) / 2


def open_leaves(tree: Tree, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lowest nodes each anchor reaches, level by level, and its distance from them."""
    size = (q**2).sum(axis=1)[:, None]
    slack = SLACK * (size + tree.norm**2) + 1
    bare = np.hstack([q, np.zeros((len(q), 1))])
    wanted = np.ones((len(q), 1), dtype=bool)
    away = np.zeros((len(q), 1))
    for level, (count, radius) in enumerate(zip(tree.sizes, tree.radii)):
        if level:
            wanted = wanted[:, tree.parents[level - 1]]
        some = np.flatnonzero(wanted.any(axis=0))
        away = np.full((len(q), count), math.inf)
        away[:, some] = _apart(bare, tree.centres[some])
        near, far = np.maximum(0.0, away - radius), away + radius
        inside = (_products(size, tree.norm, near) + slack >= least[:, None]) & (_products(size, tree.norm, far) - slack <= most[:, None])
        wanted = wanted & inside & (radius >= 0)[None, :]
    return wanted, away


def _bounds(trees: dict[int, Tree]):
    def bounds(dim: int, q: np.ndarray, least: np.ndarray, most: np.ndarray, rings: dict):
        if dim not in trees:
            return np.full((len(q), len(rings["cell"])), -math.inf), np.full((len(q), len(rings["cell"])), math.inf)
        tree = trees[dim]
        node = np.maximum(rings["centre"] - tree.first, 0)
        wanted, away = open_leaves(tree, q, least, most)
        wanted, away = wanted[:, node], np.where(wanted, away, 0.0)[:, node]
        size = (q**2).sum(axis=1)[:, None]
        slack = SLACK * (size + tree.norm**2) + 1
        near = np.maximum(0.0, np.maximum(away - rings["high"], rings["low"] - away))
        low, high = _products(size, tree.norm, away + rings["high"]) - slack, _products(size, tree.norm, near) + slack
        return np.where(wanted, low, math.inf), np.where(wanted, high, -math.inf)

    return bounds


def hard_negatives(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``embeddings(vec_id, embedding, label)``.

    Anchors are rows whose id is divisible by 100; their positives are the five other rows of their label of highest
    inner product, and a positive's negatives the first five rows of other labels whose score is no higher, and at least
    80 hundredths of it. Components are floor(scale * x); ties go to the smaller id. A positive score below zero has
    no negatives. Rows with a null id, label or vector, or a null or non-finite component, take no part; zero vectors
    do. Vectors meet those of their own length only. Repeated rows are candidates each, so a repeated positive has its
    negatives twice; an id that is repeated is one anchor, with the first of its vectors by numbers, and never finds its
    own id. Scores beyond a long count as its ends. An empty table gives no rows; other columns are not looked at.
    """
    labelled = embeddings.where("label is not null").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"
    )
    vectors = whole_vectors(labelled, scale)
    bounded = F.when(F.col("norm") < math.inf, F.col("norm"))
    count, row_bytes, norm = vectors.agg(F.count("*"), F.avg(F.octet_length("vec")), F.max(bounded)).first()
    trees, begin = {}, 0
    sample = draw(vectors, count, row_bytes or 0)
    total = sum(map(len, sample.values()))
    for dim, rows in sample.items():
        share = min(MOST_NODES, math.sqrt(count) / 8) * len(rows) / total
        trees[dim] = grow(rows, norm, max(1, round(share)), begin)
        begin += len(trees[dim].centres)
    index = packed(placed(vectors, _place(trees)), "label", "distance")
    levels = max((len(tree.sizes) for tree in trees.values()), default=0)
    reach = index.blocks.where(F.col("centre") != ANY).groupBy("dim", "centre").agg(F.array(*(F.max(F.get("far", F.lit(i))) for i in range(levels))).alias("far")).collect()
    trees = {dim: measured(tree, {r["centre"]: r["far"][: len(tree.sizes)] for r in reach if r["dim"] == dim}) for dim, tree in trees.items()}
    bounds = _bounds(trees)

    anchors = kept(one_query_each(vectors.where(F.col("vec_id") % ANCHOR_EVERY == 0)), "anchors")
    everything = anchors.select("*", F.array(F.lit(LEAST)).alias("lows"), F.array(F.lit(MOST)).alias("highs"))
    positives = search(everything, index, bounds, POSITIVES, same_label=True).where("score >= 0")
    by_anchor = positives.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score"))).alias("positives"))
    by_anchor = kept(by_anchor, "positives")
    # The least whole score of 80 hundredths or more. The product may not fit a long; hundreds and the rest do.
    least = F.expr(f"transform(positives, p -> p.score div 100 * {LEAST_SHARE} + (p.score % 100 * {LEAST_SHARE} + 99) div 100)")
    windows = anchors.join(beside(by_anchor), "query").select(
        *anchors.columns, least.alias("lows"), F.transform("positives", lambda p: p["score"]).alias("highs")
    )
    negatives = search(kept(windows, "windows"), index, bounds, NEGATIVES, same_label=False)
    return negatives.join(beside(by_anchor), "query").withColumn("positive", F.get("positives", F.col("slot"))).select(
        F.col("query").alias("anchor_id"), "positive.positive_id", "rank", F.col("vec_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.e, c.e)::bigint as score
  from v a join v c on a.vec_id <> c.vec_id and len(a.e) = len(c.e) where a.vec_id % 100 = 0),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5"""


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; see ``hard_negatives`` for odd rows."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
