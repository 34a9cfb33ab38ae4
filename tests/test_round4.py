"""Bounded tasks and shuffles of wide jobs."""

import numpy as np
import pytest

from riskframe.llm import phrases as P
from riskframe.operators import model as MD
from riskframe.operators import neighbors as N
from riskframe.operators import relate as R
from riskframe.operators import search as SE
from riskframe.plans import q_marts
from riskframe.plans.bind import clustered_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rollup", ["rollup_bureau", "rollup_previous", "rollup_pos", "rollup_card", "rollup_installments"])
def test_wide_rollups_combine_before_their_shuffle(spark, rollup, capsys):
    getattr(q_marts, f"q_{rollup}")(spark, SF).explain()
    assert "REBALANCE_PARTITIONS_BY_COL" in capsys.readouterr().out


def test_mart_joins_lines_to_orders_once(spark):
    files = " ".join(q_marts.build_mart(spark, SF).inputFiles())
    assert "mart-lines" in files and "mart-orders" in files
    assert "lineitem.parquet" not in files and "orders.parquet" not in files


def test_clustered_rows_are_all_rows_with_an_applicant(spark, tmp_path):
    orders = [(i, None if i == 3 else i % 2, "F", 1.0, "1-URGENT") for i in range(6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string") \
        .selectExpr("*", "DATE'2000-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.o_orderkey for r in clustered_rows(spark, str(tmp_path), "bureau").collect()]
    assert sorted(got) == [0, 1, 2, 4, 5]


def test_training_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(MD, "TASK_ROWS", 10)
    t = MD.training_table(spark.range(0, 95, 1, 1))
    assert t.rdd.getNumPartitions() == 10 and t.count() == 95
    assert max(t.rdd.glom().map(len).collect()) <= 20
    monkeypatch.setattr(MD, "TASK_ROWS", 1000)
    assert MD.training_table(spark.range(0, 95, 1, 1)).rdd.getNumPartitions() == 1


def test_known_and_unknown_read_written_tables(spark):
    batch = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    stored = spark.createDataFrame([(1, 10.0), (9, 90.0)], "k long, f double")
    seen = []

    def compute(unknown):
        seen.extend(unknown.inputFiles())
        return unknown.where("k = 2").distinct().selectExpr("k", "20D AS f")
    out = R.known_unknown(batch, "k", stored, compute)
    assert seen and all("unknown" in x for x in seen)
    rows = sorted((r.k or 0, r.f or 0.0, r.source) for r in out.collect())
    assert rows == [(0, 0.0, "computed"), (1, 10.0, "precomputed"), (2, 20.0, "computed"), (2, 20.0, "computed")]


def test_neighbour_pairs_are_few_and_exact():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(600, 20)) + 50.0, rng.normal(size=(40, 20)) + 50.0
    i, j, d = N._pairs(q, x, 5, np.full(40, np.inf))
    want = N._squares(q, x)
    assert len(i) == 40 * 6                                  # no ties: six nodes a query
    assert (d == want[i, j]).all()
    assert all(set(j[i == r]) == set(np.argsort(want[r], kind="stable")[:6]) for r in range(40))


def test_training_tables_of_concurrent_fits_take_few_tasks(spark):
    df = spark.range(0, 200, 1, 8).selectExpr("id", "CAST(id % 4 = 0 AS INT) AS y", "id * 1D AS a")
    folds = df.selectExpr("id", "CAST(id % 2 AS INT) AS fold")
    data = SE.prepare(df, ["a"], "y", "id", folds, 2)
    assert SE.train_table(data, 0).rdd.getNumPartitions() == 1


def test_counters_are_not_held_twice():
    keys, counts = [np.array([3, 1], np.uint64), np.array([3], np.uint64)], [np.array([1, 2]), np.array([4])]
    k, c = P._added(keys, counts)
    assert (k.tolist(), c.tolist(), keys, counts) == ([1, 3], [2, 5], [], [])
