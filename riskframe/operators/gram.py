"""Correlations of wide tables from a blocked Gram matrix.

One pass over the rows: every task multiplies its batches (columns shifted by a rough
centre, gaps as zeros) into four matrices of sums over the rows where both columns
have a value -- number, x_i, x_i^2 and x_i x_j -- and emits them once, cut into blocks
of columns.  Blocks are added up in two rounds (first within slices of the tasks), so
that no task receives a block from every other one.  What is shuffled follows the
number of tasks and columns, not the rows; the pairs never exist as columns of a plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block, slices of the first round, rows that fix the centre.
BLOCK, SLICES, CENTRE_ROWS = 64, 32, 1_000
#: A variance below this share of the mean square around the centre is rounding.
CONSTANT = 1e-10


def _cuts(p: int) -> list[tuple[int, int]]:
    return [(a, min(p, a + BLOCK)) for a in range(0, p, BLOCK)]


def gram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(bi, bj, sums): sums of block pair bi <= bj as four little-endian double matrices:
    number, sum of x_i, sum of x_i^2, of x_j, of x_j^2 and of x_i x_j over complete pairs."""
    d = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))
    first = [r["x"] for r in d.limit(CENTRE_ROWS).collect()]        # the centre only spares digits: any rows do
    centre = np.zeros(len(cols))
    if first:
        m = np.array([[np.nan if v is None else v for v in r] for r in first], np.float64)
        ok = np.isfinite(m)
        centre = np.where(ok.any(0), np.where(ok, m, 0).sum(0) / np.maximum(ok.sum(0), 1), 0.0)
    cuts = _cuts(len(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1) - centre
            there = ~np.isnan(x)                                    # null and NaN are missing
            x = np.where(there, x, 0.0)
            m = there.astype(np.float64)
            part = [m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x]
            sums = part if sums is None else [a + c for a, c in zip(sums, part)]
        if sums is not None:
            n, s, q, p = sums
            where = TaskContext.get().partitionId() % SLICES
            for i, (a, b) in enumerate(cuts):
                for j, (c, d) in enumerate(cuts[i:], i):
                    block = np.stack([n[a:b, c:d], s[a:b, c:d], q[a:b, c:d], s[c:d, a:b].T, q[c:d, a:b].T, p[a:b, c:d]])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([where], pa.int32()),
                                                      pa.array([block.astype("<f8").tobytes()], pa.binary())], ["bi", "bj", "slice", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<f8") for b in t["sums"].to_pylist())
        return t.slice(0, 1).set_column(t.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

    parts = d.mapInArrow(run, "bi int, bj int, slice int, sums binary")
    parts = parts.groupBy("bi", "bj", "slice").applyInArrow(add, "bi int, bj int, slice int, sums binary")
    return parts.select("bi", "bj", "sums").groupBy("bi", "bj").applyInArrow(add, "bi int, bj int, sums binary")


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, corr) of every pair of columns, a before b: Pearson's r over
    the rows where both have a value; null where a side is constant there or no row is left."""
    cols = list(cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    cuts = _cuts(len(cols))
    pairs = df.sparkSession.createDataFrame([(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))], "bi int, bj int")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw in zip(*[c.to_pylist() for c in batch.columns]):
                (a, b), (c, d) = cuts[i], cuts[j]
                n, si, qi, sj, qj, p = np.frombuffer(raw, "<f8").reshape(6, b - a, d - c) if raw else np.zeros((6, b - a, d - c))
                with np.errstate(all="ignore"):
                    vi, vj = qi - si * si / n, qj - sj * sj / n
                    r = (p - si * sj / n) / np.sqrt(vi * vj)
                    r = np.where((vi > CONSTANT * qi) & (vj > CONSTANT * qj), np.clip(r, -1.0, 1.0), np.nan)
                x, y = np.nonzero(np.arange(a, b)[:, None] < np.arange(c, d)[None, :])
                v = r[x, y]
                yield pa.RecordBatch.from_arrays([pa.array([cols[a + k] for k in x]), pa.array([cols[c + k] for k in y]), pa.array(v, mask=np.isnan(v))],
                                                 ["feature_a", "feature_b", "corr"])

    sums = pairs.join(gram(df, cols), ["bi", "bj"], "left")          # an empty table still has its pairs
    return sums.mapInArrow(finish, "feature_a string, feature_b string, corr double")
