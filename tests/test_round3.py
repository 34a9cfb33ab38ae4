"""Exact neighbours, SMOTE, tree contributions against brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- neighbours -----------------------------------------------------------

def _points(seed=1):
    rng = np.random.default_rng(seed)
    x = [rng.normal(size=(120, 3)), rng.normal(size=(80, 3)) * 0.01 + 5, rng.integers(0, 3, (60, 3)).astype(float),      # ties
         np.tile([[2.0, 2.0, 2.0]], (50, 1)), np.tile([[-0.0, 0.0, 1.0]], (4, 1))]                                      # copies
    x = np.concatenate(x)
    ids = rng.permutation(len(x) * 3)[:len(x)].tolist()
    return ids, x


def _brute(ids, x, k):
    d = np.zeros((len(x), len(x)))
    for f in range(x.shape[1]):
        d += (x[:, f, None] - x[None, :, f]) ** 2
    return {ids[i]: [(d[i, j], ids[j]) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], ids[j]))[:k]] for i in range(len(x))}


@pytest.mark.parametrize("k,pivots,queries", [(1, 1, 20_000), (5, 7, 20_000), (5, 40, 9), (60, 12, 20_000), (500, 5, 20_000)])
def test_nearest_equals_brute_force(spark, monkeypatch, k, pivots, queries):
    from riskframe.operators import neighbors
    monkeypatch.setattr(neighbors, "CELL_QUERIES", queries)
    ids, x = _points()
    rows = [(i, *map(float, v), "e") for i, v in zip(ids, x)]
    bad = [(10_001, None, 1.0, 1.0, ""), (10_002, float("nan"), 1.0, 1.0, ""), (10_003, float("inf"), 1.0, 1.0, ""), (None, 2.0, 2.0, 2.0, "")]
    df = spark.createDataFrame(rows + bad, "id long, a double, `b c` double, vec double, node string").repartition(3)
    got = {r.id: [(s.d2, s.id) for s in r.neighbours] for r in neighbors.nearest(df, "id", ["a", "b c", "vec"], k, pivots).collect()}
    assert got == _brute(ids, x, k)


def test_nearest_of_few_and_no_rows(spark):
    from riskframe.operators.neighbors import nearest
    df = spark.createDataFrame([(1, 0.0), (2, 3.0)], "id long, a double")
    assert {r.id: [s.id for s in r.neighbours] for r in nearest(df, "id", ["a"], 5).collect()} == {1: [2], 2: [1]}
    assert nearest(df.where("id = 1"), "id", ["a"]).first().neighbours == []
    assert nearest(df.where("id > 5"), "id", ["a"]).count() == 0
    with pytest.raises(ValueError):
        nearest(df, "id", [])


@pytest.mark.parametrize("ratio", [0.1, 2.5])
def test_smote_meets_the_ratio_on_segments_between_neighbours(spark, ratio):
    from riskframe.operators.sample import smote, smote_under
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 2)), np.tile([[1.0, 1.0]], (30, 1)), rng.normal(size=(300, 2)) + 2])
    rows = [(i, int(i < 90), float(a), float(b)) for i, (a, b) in enumerate(x)] + [(1000, 1, None, 0.5)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = smote(df, "id", "y", ["a", "b"], ratio=ratio, pivots=5).collect()
    n = Counter(r.y for r in out)
    assert n[0] == 300 and n[1] == max(91, int(300 * ratio))
    near = {i: [j for _, j in v] for i, v in _brute(list(range(90)), x[:90], 5).items()}
    made = [r for r in out if r.copy > 0]
    per = Counter(r.id for r in made)
    assert not made or (max(per.values()) - min(per.values()) <= 1 or len(per) < 90)
    for r in made:
        assert r.neighbour in near[r.id]
        p, q, v = x[r.id], x[r.neighbour], np.array([r.a, r.b])
        t = (v - p) @ (q - p) / max((q - p) @ (q - p), 1e-300)
        assert -1e-9 <= t < 1 and np.allclose(p + t * (q - p), v, atol=1e-9)
    again = smote(df.repartition(5), "id", "y", ["a", "b"], ratio=ratio, pivots=2).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    both = Counter(r.y for r in smote_under(df, "id", "y", ["a", "b"]).collect())
    assert both == {1: 150, 0: 150}


def test_smote_without_partners_makes_nothing(spark):
    from riskframe.operators.sample import smote
    df = spark.createDataFrame([(1, 1, 0.0)] + [(i, 0, 1.0) for i in range(2, 9)], "id long, y int, a double")
    assert smote(df, "id", "y", ["a"]).count() == 8


# --- tree contributions ---------------------------------------------------

def _train(spark, kind, depth, n=400, **params):
    from riskframe.operators import model as MD
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (x[:, 2] > 1)).astype(int)
    rows = [(i, int(t), *[None if rng.random() < 0.03 else float(v) for v in r]) for i, (t, r) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d double")
    return MD.fit(df, list("abcd"), "y", kind, maxDepth=depth, **params), df


def _enumerated(trees, weights, forest, x):
    """Shapley values over all subsets; absent features follow the training weights."""
    def value(node, known):
        if node.subtreeDepth() == 0:
            s = node.impurityStats()
            return s.stats()[1] / s.count() if forest else node.prediction()
        i, t = node.split().featureIndex(), node.split().threshold()
        a, b = node.leftChild(), node.rightChild()
        if i in known:
            return value(a if x[i] <= t else b, known)
        wa, wb = a.impurityStats().count(), b.impurityStats().count()
        return (wa * value(a, known) + wb * value(b, known)) / (wa + wb)

    from math import factorial as f
    game = {s: sum(w * value(t.rootNode(), set(s)) for t, w in zip(trees, weights)) for k in range(5) for s in itertools.combinations(range(4), k)}
    phi = [sum(f(len(s)) * f(3 - len(s)) / f(4) * (game[tuple(sorted((*s, i)))] - game[s]) for s in game if i not in s) for i in range(4)]
    return game[()], phi, game[(0, 1, 2, 3)]


@pytest.mark.parametrize("kind,params", [("rf", {"numTrees": 4}), ("gbt", {"maxIter": 3})])
def test_tree_contributions_equal_subset_enumeration(spark, kind, params):
    from riskframe.operators.trees import tree_contributions
    model, df = _train(spark, kind, 4, **params)
    java = model.stages[-1]._java_obj
    weights = list(java.treeWeights())
    if kind == "rf":
        weights = [w / sum(weights) for w in weights]
    got = {}
    for r in tree_contributions(model, df, list("abcd"), ["id"]).collect():
        got.setdefault(r.id, {})[r.feature] = r
    assert len(got) == 400 and all(len(v) == 4 for v in got.values())
    vectors = {r.id: r.features.toArray() for r in model.transform(df).where("id < 6").select("id", "features").collect()}
    for i, x in vectors.items():
        base, phi, full = _enumerated(list(java.trees()), weights, kind == "rf", x)
        assert abs(got[i]["a"].base - base) < 1e-9
        assert np.allclose([got[i][c].contribution for c in "abcd"], phi, atol=1e-9)
        assert abs(got[i]["a"].score - full) < 1e-9


@pytest.mark.parametrize("kind,params,column", [("rf", {"numTrees": 20}, "probability"), ("gbt", {"maxIter": 10}, "rawPrediction")])
def test_tree_contributions_add_up_to_the_models_score(spark, kind, params, column):
    from pyspark.ml.functions import vector_to_array
    from riskframe.operators.trees import tree_contributions
    model, df = _train(spark, kind, 6, **params)
    want = {r.id: r.s for r in model.transform(df).select("id", vector_to_array(column)[1].alias("s")).collect()}
    x = tree_contributions(model, df, list("abcd"), ["id"])
    got = {r.id: r.s for r in x.groupBy("id").agg((F.first("base") + F.sum("contribution")).alias("s")).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert tree_contributions(model, df.where("id < 0"), list("abcd"), ["id"]).count() == 0


# --- correlations of wide tables ------------------------------------------

def test_gram_correlations_of_189_columns_equal_numpy(spark):
    from riskframe.operators.gram import correlations
    rng = np.random.default_rng(11)
    n, p = 500, 189
    x = rng.normal(size=(n, p)) * 10.0 ** rng.integers(-3, 4, p) + 1e3 * rng.integers(0, 2, p)
    x[:, 1] = 2 * x[:, 0] + 1
    x[:, 2] = 3.3
    x[rng.random((n, p)) < 0.05] = np.nan
    x[:, 3] = np.nan
    cols = [f"c {i}" for i in range(p)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], T.StructType([T.StructField(c, T.DoubleType()) for c in cols])).repartition(3)
    got = {(r.feature_a, r.feature_b): r.corr for r in correlations(df, cols).collect()}
    assert len(got) == p * (p - 1) // 2
    for i in range(p):
        for j in range(i + 1, p):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            r = got[cols[i], cols[j]]
            if {2, 3} & {i, j}:
                assert r is None
            else:
                assert abs(r - np.corrcoef(a, b)[0, 1]) < 1e-8
    assert {r.corr for r in correlations(df.limit(0), cols[:3]).collect()} == {None}
    assert correlations(df, cols[:1]).count() == 0


def test_gram_equals_the_pairwise_aggregate(spark):
    from riskframe.operators.profile import corr_matrix, pair_corr
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_linenumber"]
    want = df.agg(*[pair_corr(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in itertools.combinations(cols, 2)]).first().asDict()
    got = {f"{r.feature_a}|{r.feature_b}": r.corr for r in corr_matrix(df, cols).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-10 for k in want)


# --- batch tables ---------------------------------------------------------

def test_batches_replay_failure_and_purge(spark, tmp_path):
    from riskframe.sources.batches import commits, purge, read_batches, write_batch
    path = str(tmp_path / "t")
    row = lambda b, n: spark.createDataFrame([(i, b) for i in range(n)], "v long, b string")
    seen = lambda: Counter(r.b for r in read_batches(spark, path, "b").collect())
    write_batch(row("007", 3).unionByName(row("a/b c", 4)), path, "b")
    write_batch(row("007", 5), path, "b")                                   # a rerun replaces its batch
    write_batch(row("007", 5), path, "b")
    assert seen() == {"007": 5, "a/b c": 4}
    with pytest.raises(Exception):
        write_batch(row("008", 2).withColumn("v", F.when(F.col("v") == 1, F.raise_error(F.lit("stop"))).otherwise(F.col("v"))), path, "b")
    with pytest.raises(Exception):
        write_batch(row(None, 2), path, "b")
    assert seen() == {"007": 5, "a/b c": 4}
    row("009", 2).write.mode("append").partitionBy("b").parquet(path)        # files without a commit record
    assert seen() == {"007": 5, "a/b c": 4}
    assert {r.b: r.n_rows for r in commits(spark, path, "b").collect()} == {"007": 5, "a/b c": 4}
    assert [(r.b, r.n_rows) for r in purge(spark, path, "b", F.col("b") < "1").collect()] == [("007", 5)]
    assert seen() == {"a/b c": 4}
    assert not [x for x in (tmp_path / "t").iterdir() if x.name in ("b=007", "b=009")]
    assert purge(spark, path, "b", F.col("b") < "1").count() == 0


def test_sample_with_replacement_is_exact_and_repeatable(spark):
    from riskframe.operators.sample import sample_with_replacement
    df = spark.range(50).select((F.col("id") * 3).alias("id"), F.lit("x").alias("s"))
    a = sorted((r.draw, r.id) for r in sample_with_replacement(df, "id", 500).collect())
    b = sorted((r.draw, r.id) for r in sample_with_replacement(df.repartition(7), "id", 500).collect())
    assert a == b and [d for d, _ in a] == list(range(500)) and len({i for _, i in a}) == 50
    assert a != sorted((r.draw, r.id) for r in sample_with_replacement(df, "id", 500, seed=1).collect())
    assert sample_with_replacement(df.limit(0), "id", 10).count() == 0


def test_impute_drops_rows(spark):
    from riskframe.operators import fit as FI
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, None), (3, 1.0, 4.0)], "id long, a double, b double")
    s = FI.fit_impute(df, {"a": "drop", "b": "mean"})
    assert sorted((r.id, r.b) for r in FI.impute(df, s).collect()) == [(2, 3.0), (3, 4.0)]
    with pytest.raises(ValueError):
        FI.fit_impute(df, {"a": "other"})
