"""Bounded shuffles, workers and fits of the text and search jobs."""

import random

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import substrings as S


def _prose(rng, n):
    return " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))


def test_only_suffixes_of_repeated_prefixes_are_sent(spark):
    rng = random.Random(3)
    passage = _prose(rng, 80)
    rows = [_prose(rng, 400) for _ in range(40)] + [f"{_prose(rng, 50)} {passage} {_prose(rng, 50)}" for _ in range(2)]
    texts = spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "text string, i int").repartition(2, "i")
    texts = texts.select("text", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16).alias("key"))
    census = S._census(texts, 35)
    bits, mask = S._bitmap(census)
    prefixes = np.array([r.prefix for r in census.collect()], np.int64).view(np.uint64) & np.uint64(mask)
    assert len(prefixes) and all(bits[int(x) >> 3] >> (int(x) & 7) & 1 for x in prefixes)
    sent = S._sent(texts, 35, S._hot(census, 20_000), (bits, mask), [0]).where("words IS NOT NULL").collect()
    n = sum(len(S._unpacked(r.prefix)) // 8 for r in sent)
    assert 0 < n <= 2 * len(prefixes) + 5                       # not one of about 1,400 anchors
    got = {r.i: r.n_removed for r in S.remove_repeats(spark.createDataFrame([(t, i) for i, t in enumerate(rows)], "text string, i int"), keep=["i"]).collect()}
    assert got == {i: 80 if i >= 40 else 0 for i in range(42)}


def test_phrase_counters_are_summed_beside_their_keys():
    from riskframe.llm import phrases as P
    rng = np.random.default_rng(5)
    top = (1 << P.COUNT_BITS) - 1
    keys = np.unique(rng.integers(0, 1 << P.HASH_BITS, 500).astype(np.uint64))
    keys[-1] = (1 << P.HASH_BITS) - 1
    counts = rng.integers(1, 9, len(keys))
    counts[:6] = [top - 1, top, top + 1, 2 * top, 10 * top + 3, 1]
    assert P._beside(keys, counts).nbytes < 8 * len(keys) + 8 * 30               # not 16 bytes a counter
    held = [keys, keys[::2], keys[:0]], [counts, counts[::2], counts[:0]]
    k, n = P._added(*held)
    want = counts.copy()
    want[::2] += counts[::2]
    assert held == ([], []) and k.tolist() == keys.tolist() and n.tolist() == want.tolist()
    k, n = P._added([], [])
    assert not len(k) and not len(n)


def test_a_summary_takes_counters_in_any_order():
    from riskframe.llm import phrases as P
    s = P.Summary(100, 10)
    for keys, counts in (([5, 9], [1, 2]), ([1, 5, 7], [4, 4, 4]), ([], []), ([11], [10])):
        s.merge(np.array(keys, np.uint64), np.array(counts, np.int64))
    assert s.keys.tolist() == [1, 5, 7, 9, 11] and s.counts.tolist() == [4, 5, 4, 2, 10] and s.frequent().tolist() == [11]


def test_feature_counters_of_a_worker_are_bounded(monkeypatch):
    import pyarrow as pa

    from riskframe.llm import toxicity as T
    rng = random.Random(8)
    rows = [_prose(rng, 60) for _ in range(50)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})
    monkeypatch.setattr(T, "HELD_FEATURES", 100)
    parts = list(T._count_fn()(iter([batch])))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 1_000
    got = {}
    for p in parts:
        for f, n in zip(p.column("feature").to_pylist(), p.column("n").to_pylist()):
            got[f] = got.get(f, 0) + n
    assert got == {f: sum(f in T.doc_features(t) for t in rows) for f in got} and len(got) == len(set().union(*map(T.doc_features, rows)))


def test_ids_are_decoded_from_a_written_table(spark):
    import corpus_pipeline as C
    df = spark.createDataFrame([(1, "a b", "en", "s", 3), (2, None, None, "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = C.encode(spark, df, "")
    assert any("pipeline-ids" in f for f in out.inputFiles())       # no worker encodes and decodes side by side
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == [(1, 2), (2, 0)]
