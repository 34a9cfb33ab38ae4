"""Arrow batches of texts are bounded by bytes; held-out rows of a search are written once."""

import pyarrow as pa
from pyspark.sql import functions as F

from riskframe.llm import common as C
from riskframe.operators import model as MD
from riskframe.operators import search as SE


def _largest(spark, df):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})
    return df.mapInArrow(sizes, "rows long, bytes long").agg(F.max("rows").alias("rows"), F.max("bytes").alias("bytes"), F.sum("rows").alias("all")).first()


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    C.text_batches(spark)
    got = _largest(spark, spark.range(0, 600, 1, 1).select(F.repeat(F.lit("0123456789"), 2_000).alias("text")))
    assert got["all"] == 600 and got["bytes"] <= C.TEXT_BATCH_BYTES + 50_000
    short = _largest(spark, spark.range(0, 3000, 1, 1).select(F.lit("word").alias("text")))
    assert short["all"] == 3000 and short["rows"] == C.TEXT_BATCH_ROWS


def test_a_size_the_user_chose_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(3 << 20))
    try:
        C.text_batches(spark)
        assert spark.conf.get(key).rstrip("b") == str(3 << 20)
    finally:
        spark.conf.set(key, before)


def _search_rows(spark, n):
    df = spark.range(0, n, 1, 8).select("id", F.expr("IF(id % 3 = 0, 1, 0)").alias("y"), F.expr("xxhash64(id) % 1000 / 500 + IF(id % 3 = 0, 1, 0)").alias("a"),
                                        F.expr("IF(id % 11 = 0, NULL, xxhash64(id, 7) % 1000 / 500)").alias("b"))
    return df, df.select("id", F.expr("CAST(id DIV 3 % 2 AS INT)").alias("fold"))


def test_few_features_are_read_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(MD, "TASK_ROWS", 10)
    df, folds = _search_rows(spark, 240)
    data = SE.prepare(df, ["a", "b"], "y", "id", folds, 2)
    assert SE.train_table(data, 0).rdd.getNumPartitions() == 1


def test_held_rows_are_made_once_a_fold(spark, monkeypatch):
    df, folds = _search_rows(spark, 240)
    made, rows = [], SE.Folds.rows
    monkeypatch.setattr(SE.Folds, "rows", lambda self, fold, held: made.append((fold, held)) or rows(self, fold, held))
    got = SE.search(df, ["a", "b"], "y", "id", folds, {"regParam": SE.Range(1e-3, 1.0, log=True)}, trials=3, per_round=2, k=2, workers=2).collect()
    assert len(got) == 3 and sorted(made) == [(0, False), (0, True), (1, False), (1, True)]
