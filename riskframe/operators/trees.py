"""Exact additive contributions of tree ensembles (path-dependent Shapley values).

The fitted ensemble becomes a table of leaves: value, and per feature on the way to
the leaf the interval that leads there and the share of the training weight that
goes there (the product over its splits).  Its size is that of the model.  For a
row, a leaf and the features on its path, feature i adds

    (in_i - share_i) * value * sum over s of c_s * s! (m - 1 - s)! / m!

where m features are on the path, in_i says whether the row's value lies in the
interval and c_s are the coefficients of the product of (share_j + in_j t) over the
other features: the Shapley value of the game in which an absent feature follows the
training weights.  Contributions and the base add up to the ensemble's score.

Rows go through ``mapInArrow`` in batches: per leaf one comparison per interval gives
the pattern of features that are in, and each distinct pattern is worked out once.
No shuffle, no limit on rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float                            # times the tree's weight
    features: tuple[int, ...]
    low: tuple[float, ...]                  # x > low and x <= high
    high: tuple[float, ...]
    share: tuple[float, ...]

    def terms(self, inside: np.ndarray) -> np.ndarray:
        """(patterns, features on the path): what each feature adds for each pattern."""
        m = len(self.features)
        out = np.zeros(inside.shape)
        scale = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
        for i in range(m):
            poly = np.zeros((len(inside), m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    up = poly[:, :-1] * inside[:, j, None]
                    poly *= self.share[j]
                    poly[:, 1:] += up
            out[:, i] = (inside[:, i] - self.share[i]) * self.value * (poly @ scale)
        return out


def leaves(model) -> list[Leaf]:
    """Leaves of a fitted MLlib tree ensemble on continuous features.  The score is the
    probability of class 1 of a random forest (mean of the trees), the margin of gradient
    boosted trees (weighted sum)."""
    java = model._java_obj
    trees, weights = java.trees(), list(java.treeWeights())
    forest = "RandomForest" in type(model).__name__
    total = sum(weights)
    out: list[Leaf] = []

    def walk(node, path: dict[int, tuple[float, float, float]], scale: float) -> None:
        stats = node.impurityStats()
        if node.subtreeDepth() == 0:
            value = stats.stats()[1] / stats.count() if forest else node.prediction()
            f = tuple(sorted(path))
            out.append(Leaf(value * scale, f, *[tuple(path[i][k] for i in f) for k in range(3)]))
            return
        i, t = node.split().featureIndex(), node.split().threshold()
        low, high, share = path.get(i, (-np.inf, np.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, t))), (node.rightChild(), (max(low, t), high))):
            walk(child, path | {i: (*bounds, share * child.impurityStats().count() / stats.count())}, scale)

    for tree, w in zip(trees, weights):
        walk(tree.rootNode(), {}, w / total if forest else w)
    return out


def base_value(table: Sequence[Leaf]) -> float:
    """The score when no feature is known: leaves by their share of the training weight."""
    return float(sum(x.value * np.prod(x.share) for x in table))


def explain(table: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, features) contributions of ``x`` (rows, features)."""
    out = np.zeros(x.shape)
    for leaf in table:
        if not leaf.features:
            continue
        part = x[:, leaf.features]
        inside = (part > np.array(leaf.low)) & (part <= np.array(leaf.high))
        pattern = inside @ (1 << np.arange(len(leaf.features)))
        distinct, at = np.unique(pattern, return_inverse=True)
        bits = (distinct[:, None] >> np.arange(len(leaf.features)) & 1).astype(np.float64)
        out[:, leaf.features] += leaf.terms(bits)[at]
    return out


def tree_contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, base, score, feature, value, contribution) for every row and feature.

    ``model`` is a pipeline of this library ending in a forest or boosted trees; missing
    values are filled as it fills them.  An empty table gives an empty table."""
    table = leaves(model.stages[-1])
    base = base_value(table)
    vectors = df
    for stage in model.stages[:-1]:
        vectors = stage.transform(vectors)
    d = vectors.select(F.struct(*[F.col(f"`{k}`") for k in key]).alias("__row"), vector_to_array("features").alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(len(b), len(features))
            phi = explain(table, x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(features)), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], ["__row", "__x", "__phi"])

    out = d.mapInArrow(run, d.select("__row", "__x", F.col("__x").alias("__phi")).schema)
    names = F.array(*[F.lit(c) for c in features])
    score = F.aggregate("__phi", F.lit(base), lambda a, c: a + c)
    return out.select(*[F.col(f"__row.`{k}`").alias(k) for k in key], F.lit(base).alias("base"), score.alias("score"),
                      F.inline(F.arrays_zip(names.alias("feature"), F.col("__x").alias("value"), F.col("__phi").alias("contribution"))))
