"""Stored sketches and documents of unknown keys."""

import random

import pytest
from pyspark.sql import functions as F


def test_merged_sketches_against_exact_values(spark):
    from riskframe.operators.sketches import batch_sketches, merged
    rng = random.Random(3)
    # one key holds most rows; a null key; a group without values; NaN
    rows = [(f"d{i % 7}", "hot" if i % 3 else ("cold" if i % 2 else None), rng.randrange(9000), rng.gauss(0, 1) if i % 50 else float("nan"), i) for i in range(30_000)]
    rows += [("d1", "none", None, None, 1)] * 3
    df = spark.createDataFrame(rows, "day string, `the key` string, u long, v double, n_rows int")
    got, again = [{r["the key"]: r for r in merged(batch_sketches(x, ["day", "the key"], ["u"], ["v"]), ["the key"], ["u"], ["v"], (0.01, 0.5, 0.99)).collect()}
                  for x in (df.repartition(3), df.repartition(11))]
    assert set(got) == {"hot", "cold", None, "none"}
    for side in (got, again):
        for k in ("hot", "cold", None):
            mine = [r for r in rows if r[1] == k]
            users = len({r[2] for r in mine})
            assert side[k].n_rows == len(mine) and abs(side[k].distinct_u - users) <= 0.03 * users
            v = [r[3] for r in mine if r[3] == r[3]]
            for p, q in zip((0.01, 0.5, 0.99), side[k].q_v):
                assert abs(sum(x <= q for x in v) / len(v) - p) <= 0.01
        assert (side["none"].n_rows, side["none"].distinct_u, side["none"].q_v) == (3, 0, None)
    assert merged(batch_sketches(df.limit(0), ["day"], ["u"], ["v"]), ["day"], ["u"], ["v"]).count() == 0


def test_documents_become_one_table(spark):
    from riskframe.sources.documents import document_keys, documents_to_table
    docs = ['{"a": 1, "b": 1.5, "c": true, "mix": 1, "ID": 7, "nil": null, "it\'s": "x"}', '{"a": 2, "b": 2, "mix": "two", "o": {"p": [1, 2]}}',
            '{"a": null, "mix": {"x": 1}}', '{"a": 3', "[1, 2]", "5", "", None, "{}", '{"a": 4, "c": false, "o": [3]}']
    df = spark.createDataFrame(list(enumerate(docs)), "id long, doc string")
    t = documents_to_table(df, "doc", ["id"])
    assert [(f.name, f.dataType.simpleString()) for f in t.schema] == [
        ("id", "bigint"), ("doc_ID", "bigint"), ("a", "bigint"), ("b", "double"), ("c", "boolean"), ("it's", "string"), ("mix", "string"), ("nil", "string"), ("o", "string")]
    got = {r["id"]: tuple(r)[1:] for r in t.collect()}
    assert got[0] == (7, 1, 1.5, True, "x", "1", None, None)
    assert got[1] == (None, 2, 2.0, None, None, "two", None, '{"p":[1,2]}')
    assert got[2] == (None, None, None, None, None, '{"x":1}', None, None)
    assert all(got[i] == (None,) * 8 for i in range(3, 9)) and got[9] == (None, 4, None, False, None, None, None, "[3]")
    assert {r.key: r.n for r in document_keys(df, "doc").collect()}["a"] == 3
    assert documents_to_table(df.limit(0), "doc", ["id"]).columns == ["id"]
    with pytest.raises(ValueError, match="more than 3 keys"):
        documents_to_table(df, "doc", ["id"], max_keys=3)
    twice = documents_to_table(df.select("id", "doc", F.lit(1).alias("doc_id")), "doc", ["id", "doc_id"])
    assert twice.columns[:3] == ["id", "doc_id", "doc_doc_ID"] and twice.count() == len(docs)
