"""Embedding near-dedup by a pivot-permutation index.

Reference points are a bounded, hash-ordered sample of the vectors.  A vector is
described by its ``prefix`` nearest reference points in order; vectors of one
label that share at least ``shared`` of them are candidates, found through
inverted lists (label, reference point) -> vectors.  Two vectors that share that
many have their smallest shared point among the first prefix - shared + 1 of
either (in point order), so a vector is filed only under those, and a pair is
counted and verified only in the list of its smallest shared point.  Verification
is the cosine in double precision, so no link below the limit is reported; the
index may miss links (recall is measured against brute force in the tests).

Equal vectors of a label are one node, however many rows share it.  A list longer
than ``LIST_ROWS`` is cut into chunks and every pair of chunks is a unit of work
of its own.  A unit returns each vector's number of links and a spanning forest,
never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors with a null label, link with nothing (0 links, their own
component); vectors of different length never link; rows with equal vectors
link with each other; a null id cannot name a component unless it is alone; an
empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import broadcast_within, save
from riskframe.llm.components import connected_components

PREFIX, SHARED = 8, 3
MAX_PIVOTS = 1024           # bound of the sample of reference points
LIST_ROWS = 1024
SEED = 20240


def usable(vec: Column) -> Column:
    """Not null, not empty, every component there and finite."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def unit_rows(vecs: list, dim: int) -> np.ndarray:
    """Rows of length 1 (scaled by the largest component first, so that huge
    and tiny vectors neither overflow nor vanish)."""
    m = np.array(vecs, np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def pivot_points(sample: list, n: int, apart: float = 0.8) -> dict[int, np.ndarray]:
    """At most ``n`` reference points per vector length, no two of them with a
    cosine above ``apart`` (points that stand close together would be
    ordered by noise); lengths the sample misses get seeded random
    directions when they are met."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    out = {0: np.zeros((n, 0))}
    for d, v in by.items():
        u, take = unit_rows(v, d), []
        for i in range(len(u)):
            if len(take) < n and not (take and (u[take] @ u[i] > apart).any()):
                take.append(i)
        out[d] = u[take]
    return out


def _points(pivots: dict, dim: int) -> np.ndarray:
    if dim not in pivots:
        pivots[dim] = unit_rows(np.random.default_rng(SEED + dim).standard_normal((len(pivots[0]), dim)), dim)
    return pivots[dim]


def describe(units: np.ndarray, points: np.ndarray, prefix: int) -> np.ndarray:
    """Indices of each row's nearest reference points, nearest first."""
    k = min(prefix, len(points))
    sim = units @ points.T
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (root, node) of a symmetric boolean matrix."""
    out, fresh = [], linked.any(axis=1)
    for root in np.flatnonzero(fresh).tolist():
        if not fresh[root]:
            continue
        fresh[root] = False
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & fresh)
            fresh[front] = False
            out.extend((root, x) for x in front.tolist())
    return out


def _describe_fn(pivots_b, prefix: int, shared: int):
    def run(batches):
        pivots = dict(pivots_b.value)
        for b in batches:
            vecs, dims = b.column("vec").to_pylist(), b.column("dim").to_pylist()
            rows, points, nears, units = [], [], [], []
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                u = unit_rows([vecs[i] for i in at], dim)
                near = describe(u, _points(pivots, dim), prefix).astype("<i4")
                keep = max(1, near.shape[1] - shared + 1)
                first = np.sort(near, axis=1)[:, :keep]
                for i, row, x, n in zip(at, u, first.tolist(), near):
                    for p in x:
                        rows.append(i); points.append(p); nears.append(n.tobytes()); units.append(row.tobytes())
            t = pa.Table.from_batches([b]).select(["label", "dim", "node", "n"]).take(pa.array(rows, pa.int64()))
            t = t.append_column("pivot", pa.array(points, pa.int32())).append_column("near", pa.array(nears, pa.binary())) \
                .append_column("unit", pa.array(units, pa.binary()))
            yield from t.to_batches()
    return run


def verify(pivot: int, node: np.ndarray, n: np.ndarray, near: np.ndarray, units: np.ndarray, side: np.ndarray, cross: bool,
           shared: int, min_cosine: float):
    """One list (or pair of chunks): (node, links) and forest edges.  A pair
    counts where its smallest shared point is this list's."""
    seen, col = np.unique(near, return_inverse=True)
    hot = np.zeros((len(node), len(seen)), np.float32)
    hot[np.arange(len(node))[:, None], col.reshape(near.shape)] = 1
    less = hot[:, seen < pivot]
    links = ((hot @ hot.T) >= min(shared, near.shape[1])) & ((less @ less.T) == 0) & (units @ units.T >= min_cosine)
    links &= (side[:, None] != side[None, :]) if cross else ~np.eye(len(node), dtype=bool)
    degree = links @ n.astype(np.float64)
    got = np.flatnonzero(degree)
    return node[got], degree[got].astype(np.int64), [(int(node[a]), int(node[b])) for a, b in forest(links)]


def _verify_fn(shared: int, min_cosine: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim, pivot = t.column("dim")[0].as_py(), t.column("pivot")[0].as_py()
        num = lambda c: t.column(c).to_numpy()
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), "<i4").reshape(len(t), -1)
        units = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(t), dim)
        node, deg, edges = verify(pivot, num("node"), num("n"), near, units, num("own"), t.column("c1")[0].as_py() != t.column("c2")[0].as_py(),
                                  shared, min_cosine)
        a, b = [e[0] for e in edges], [e[1] for e in edges]
        return pa.table({"edge": pa.array([False] * len(node) + [True] * len(a), pa.bool_()),
                         "a": pa.array([*node.tolist(), *a], pa.int64()), "b": pa.array([*deg.tolist(), *b], pa.int64())})
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    min_cosine: float = 0.98, prefix: int = PREFIX, shared: int = SHARED, n_pivots: int | None = None) -> DataFrame:
    """One row per vector: id, n_links (other rows linked directly),
    component_id (smallest id reachable, itself included), kept."""
    spark = vectors.sparkSession
    v = F.col("vec")
    d = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    ok = usable(v) & F.col("label").isNotNull() & F.exists(v, lambda x: x != 0)
    keyed = d.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("h1", F.when(F.col("ok"), F.xxhash64("vec"))) \
        .withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(SEED), "vec")))
    classes = save(keyed.where("ok").groupBy("label", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.any_value("vec").alias("vec"))
        .withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")
    m = n_pivots or min(MAX_PIVOTS, max(16, 2 * math.isqrt(classes.count())))
    sample = [r["vec"] for r in classes.select("vec", F.xxhash64("h1", "h2").alias("o")).orderBy("o", "vec").limit(MAX_PIVOTS).collect()]   # the bounded sample
    pivots = spark.sparkContext.broadcast(pivot_points(sample, m))
    filed = classes.select("label", "dim", "node", "n", "vec").mapInArrow(
        _describe_fn(pivots, prefix, shared), f"label {classes.schema['label'].dataType.simpleString()}, dim int, node long, n long, "
        "pivot int, near binary, unit binary")
    large = save(filed.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > LIST_ROWS)
                 .select("label", "dim", "pivot", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("chunks")), "pivot-large")
    cut = filed.join(broadcast_within(large), ["label", "dim", "pivot"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))) \
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .withColumn("c1", F.least("own", "other")).withColumn("c2", F.greatest("own", "other")).drop("chunks", "other")
    found = save(units.groupBy("label", "dim", "pivot", "c1", "c2").applyInArrow(
        _verify_fn(shared, min_cosine), "edge boolean, a long, b long"), "pivot-links")
    degree = found.where("NOT edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("degree"))
    comp = connected_components(found.where("edge").select("a", "b"))
    of = save(classes.select("label", "h1", "h2", "n", "least", "node").join(degree, "node", "left").join(comp, "node", "left")
              .withColumn("component", F.coalesce("component", "node")), "pivot-components")
    best = save(of.groupBy("component").agg(F.min("least").alias("component_id")), "pivot-best")
    named = save(of.join(best, "component").select("label", "h1", "h2", (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"), "pivot-named")
    out = keyed.select("id", "label", "h1", "h2").join(broadcast_within(named), ["label", "h1", "h2"], "left")
    cid = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                      F.col("id").eqNullSafe(cid).alias("kept"))
