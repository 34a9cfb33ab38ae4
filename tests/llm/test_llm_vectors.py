"""Top-k search and pivot near-dedup against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import Union
from pyspark.sql import functions as F
from pyspark.sql import types as T

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                    T.StructField("vec", T.StringType()), T.StructField("id", T.StringType()), T.StructField("dim", T.StringType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", "z") for i, v, lab in rows], VEC)


def sample(n=260, dim=12, seed=4):
    rng = np.random.default_rng(seed)
    f = lambda x: [float(np.float32(y)) for y in x]
    rows = [(i, f(rng.standard_normal(dim)), int(i % 3)) for i in range(n)]
    base = rng.standard_normal(dim)
    rows += [(1000 + i, f(base + 0.05 * rng.standard_normal(dim)), 1) for i in range(60)]           # a tight group
    rows += [(2000 + i, rows[i % 4][1], rows[i % 4][2]) for i in range(20)]                           # equal vectors
    rows += [(2100 + i, [3.0 * x for x in rows[i][1]], rows[i][2]) for i in range(5)]                 # scaled
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * dim, 1), (3003, [1.0, None] + [0.0] * (dim - 2), 1), (3004, [math.nan] * dim, 1),
             (3005, [math.inf] + [0.0] * (dim - 1), 1), (3006, rows[0][1], None), (3007, [1.0, 2.0], 0), (3008, [1.0, 2.0], 0), (3050, [1.0, 2.5], 0),
             (None, rows[0][1], 0), (0, rows[0][1], 0)]
    return rows


def _fine(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [512, 16])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    from riskframe.llm import topk
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "SLICE_BLOCKS", 2)
    monkeypatch.setattr(topk, "PACK_BLOCKS", 3)
    rng = np.random.default_rng(2)
    rows = sample() + [(20, [float(x) for x in rng.standard_normal(12).astype(np.float32)], 0) for _ in range(9)]        # one id, many vectors
    rows += [(30, [4.0] + [0.0] * 11, 0), (31, [3.0] + [0.0] * 11, 0), (31, [2.0] + [0.0] * 11, 0), (31, [3.0] + [0.0] * 11, 0)]
    by = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and _fine(v)]
    want = []
    for n, (q, x) in enumerate(by):
        if q % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, v)), i) for m, (i, v) in enumerate(by) if m != n and len(v) == len(x))[:5]
            want += [(q, r, i, -y) for r, (y, i) in enumerate(s, 1)]
    got = topk.top_k(vectors(spark, rows).withColumn("row", F.lit("r")).withColumn("score", F.lit("s")), F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_large_values_and_empty(spark):
    from riskframe.llm import topk
    big = [(i, [float(np.float32(1e12 * (i + 1))), float(i), 1.0], 0) for i in range(12)]
    by = {i: [math.floor(256 * x) for x in v] for i, v, _ in big}
    score = {i: min(sum(a * b for a, b in zip(by[0], by[i])), 2 ** 63 - 1) for i in by if i}      # beyond 64 bits: saturated
    want = [(0, r, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)]
    got = topk.top_k(vectors(spark, big), F.col("id") == 0).collect()
    assert sorted(map(tuple, got)) == want
    half = [(i, [v[0] / 1e6, *v[1:]], 0) for i, v, _ in big]                          # beyond 53 bits, within 64
    by = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in half}
    score = {i: sum(a * b for a, b in zip(by[0], by[i])) for i in by if i}
    want = [(0, r, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)]
    assert sorted(map(tuple, topk.top_k(vectors(spark, half), F.col("id") == 0).collect())) == want
    assert topk.top_k(vectors(spark, []), F.col("id") % 50 == 0).count() == 0
    assert topk.top_k(vectors(spark, big), F.lit(False)).count() == 0


def _links(rows, limit=0.98):
    u, deg = Union(), Counter()
    ok = [(k, v, lab) for k, (_, v, lab) in enumerate(rows) if lab is not None and _fine(v) and any(v)]
    for a, (i, x, la) in enumerate(ok):
        for j, y, lb in ok[:a]:
            if la == lb and len(x) == len(y):
                x_, y_ = np.array(x, float), np.array(y, float)
                if x_ @ y_ / (np.linalg.norm(x_) * np.linalg.norm(y_)) >= limit:
                    deg[i] += 1
                    deg[j] += 1
                    u.join(i, j)
    return u, deg


@pytest.mark.parametrize("list_rows", [1024, 8])
def test_pivot_dedup_links_and_components(spark, monkeypatch, list_rows):
    from riskframe.llm import pivots
    monkeypatch.setattr(pivots, "LIST_ROWS", list_rows)
    rows = sample()
    u, deg = _links(rows)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        least[u.find(k)].append(r[0])
    comp = lambda k: min((x for x in least[u.find(k)] if x is not None), default=None)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(vectors(spark, rows)).collect())
    want = Counter((r[0], deg[k], comp(k), r[0] == comp(k)) for k, r in enumerate(rows))
    assert sum(n * x[1] for x, n in got.items()) >= 0.9 * sum(deg.values())          # recall
    assert got == want                                                              # here it finds every link


def test_pivot_dedup_recall_on_a_hot_table(spark):
    """Recall of the operator itself, production parameters, against brute force: clusters
    around the limit of which one holds a third of the rows, among scattered rows."""
    from riskframe.llm import pivots
    rng = np.random.default_rng(1)
    dim, rows = 64, []
    for size in [500, 120, 80, *[20] * 15, *[4] * 30]:
        base = rng.standard_normal(dim)
        rows += [base + rng.uniform(0.05, 0.2) * rng.standard_normal(dim) for _ in range(size)]
    rows += list(rng.standard_normal((300, dim)))
    table = [(int(i), [float(np.float32(x)) for x in rows[k]], int(k % 2)) for i, k in enumerate(rng.permutation(len(rows)))]
    total = 0
    for lab in (0, 1):
        u = np.array([v for _, v, x in table if x == lab], np.float64)
        u /= np.linalg.norm(u, axis=1)[:, None]
        total += int((u @ u.T >= 0.98).sum()) - len(u)
    got = pivots.near_duplicates(vectors(spark, table)).agg(F.sum("n_links")).first()[0]
    assert total > 10_000 and 0.9 * total <= got <= total


def test_pivot_dedup_empty_and_unusable(spark):
    from riskframe.llm import pivots
    assert pivots.near_duplicates(vectors(spark, [])).count() == 0
    got = pivots.near_duplicates(vectors(spark, [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, 2.0], None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
