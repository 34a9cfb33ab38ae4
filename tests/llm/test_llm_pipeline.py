"""The pipeline and the registered queries."""

import collections
import os
import sys

import pytest

import __spark_entry__ as E
from riskframe.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def _canon(v):
    return "NULL" if v is None else repr(round(v, 9)) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("key", sorted(Q.ORACLE))
def test_oracle(spark, key):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[key](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(Q.ORACLE[key])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert sorted(tuple(_canon(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(_canon(r[i]) for i in at) for r in res.fetchall())


def test_one_query_for_each_operator():
    names = [q for q in E.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()


def test_pipeline_stages(spark):
    """Every stage on its own input, its decisions against the operators' plain twins."""
    import corpus_pipeline as C
    from llm_fixtures import Union, simhash_plain
    from riskframe.llm.common import save, table
    import re
    d = table(spark, SF, "documents")
    columns, inputs = d.columns, []
    for name, stage in C.STAGES:
        inputs.append(d)
        d = save(stage(spark, d, SF), "test-pipeline")
        if stage is not C.encode:
            assert d.columns == columns, name
    raw, nontoxic, lines, near, mixed = (x.collect() for x in inputs)
    ids = [collections.Counter(r.doc_id for r in x) for x in (raw, nontoxic, lines, near, mixed)]
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    clean = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 0").collect()}
    assert len((set(ids[0]) - set(ids[1])) & clean) <= 1 and (set(ids[0]) - set(ids[1])) & toxic
    # line dedup: no line with words stands twice; texts only lose lines
    seen = collections.Counter(x.lower() for r in lines for x in r.text.split("\n") if re.search(r"\w", x))
    assert max(seen.values()) == 1
    old = {r.doc_id: r.text.split("\n") for r in nontoxic}
    assert all(set(r.text.split("\n")) <= set(old[r.doc_id]) and r.n_chars == len(r.text) for r in lines)
    # near copies: one document of each group
    u, fps = Union(), []
    for r in lines:
        w = (r.text or "").encode().lower().split()
        fps.append(simhash_plain([b" ".join(w[i:i + 3]).decode() for i in range(max(1, len(w) - 2))] if w else []))
        u.find(len(fps) - 1)
        for j in range(len(fps) - 1):
            if (fps[-1] ^ fps[j]).bit_count() <= 3:
                u.join(len(fps) - 1, j)
    least = collections.defaultdict(list)
    for k, r in enumerate(lines):
        least[u.find(k)].append(r.doc_id)
    assert set(ids[3]) == {min(x) for x in least.values()}
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].values()) <= 2
    # ids decode to the texts
    import hashlib
    want = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in d.collect()) == want


def test_operators_swallow_no_import_errors():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for f in [f"{top}/corpus_pipeline.py", *(f"{top}/riskframe/llm/{x}" for x in os.listdir(f"{top}/riskframe/llm") if x.endswith(".py"))]:
        assert "except ImportError" not in open(f).read() and "except ModuleNotFoundError" not in open(f).read()
    assert "riskframe" in sys.modules
