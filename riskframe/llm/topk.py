"""Exact top-k search by block-at-a-time pruning.

Vectors become whole numbers, floor(scale * x).  The rows, ranged by (length, id),
are packed into blocks: ids, forward index (the matrix) and per term the block's
largest and smallest value.  A query's bound on a block is the sum over terms of
the larger of q * max and q * min.

1. Every query scores the block with its highest bound; its k-th score there is a
   threshold.
2. Only (query, block) pairs whose bound reaches the threshold go on, as thin
   rows.  They are dealt over the cells of a grid of query blocks and blocks; a cell
   receives each block it needs once, however many pairs name it.  In a cell
   every query takes its blocks in order of their bounds and stops when the next
   bound falls below its k-th score (bounds equal to it are scored: ties go to
   smaller ids).
3. The cells' lists (k rows per query and cell) are merged.

Blocks and cells have fixed sizes however large the table is.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows with a null id, take no part; rows that share an id are
separate candidates and separate queries, of which only the row itself is left out
(ties of one id go to either row); scores compare vectors of equal length only; a
query with fewer than k candidates returns all; scores beyond 64 bits saturate; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import parallelism, save
from riskframe.llm.pivots import usable

BLOCK_ROWS = 512        # rows of a block and of a query block
SLICE_BLOCKS = 32       # blocks, and query blocks, of a cell, about
PACK_BLOCKS = 128       # blocks whose bounds are taken together
HITS = "qrow long, query_id long, vec_id long, score long"


def whole(vecs: list, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) as integer-valued doubles."""
    return np.floor(np.array(vecs, np.float64).reshape(-1, dim) * scale)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding: doubles while every sum fits in 53 bits, else
    Python integers, saturated at 64 bits."""
    top = lambda x: float(np.abs(x).max(initial=0.0))
    if top(a) * top(b) * max(1, a.shape[1]) < 2 ** 53:
        return a @ b.T
    big = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    return np.clip(big(a) @ big(b).T, -2 ** 63, 2 ** 63 - 1)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds (queries x blocks) of the scores in blocks."""
    b = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    return b + np.where(np.abs(b) < 2 ** 52, 0, np.abs(b) * 1e-9)      # beyond 53 bits: room for rounding


def _pack(m: np.ndarray) -> bytes:
    return m.astype("<i4").tobytes() if np.abs(m).max(initial=0.0) < 2 ** 31 else m.astype("<f8").tobytes()


def _unpack(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _blocks_fn(rows: int, scale: float):
    """Consecutive rows of equal length become blocks."""
    def block(part: int, seq: int, dim: int, ids: list, vecs: list) -> pa.RecordBatch:
        m = whole(vecs, dim, scale)
        ids, rows = zip(*ids)
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "blk": pa.array([(part << 32) + seq], pa.int64()), "ids": [np.array(ids, "<i8").tobytes()],
            "rows": [np.array(rows, "<i8").tobytes()],
            "mat": [_pack(m)], "high": [m.max(axis=0).tobytes()], "low": [m.min(axis=0).tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq, at, ids, vecs = TaskContext.get().partitionId(), 0, None, [], []
        for b in batches:
            for i, r, d, v in zip(*(b.column(c).to_pylist() for c in ("id", "row", "dim", "vec"))):
                if ids and (d != at or len(ids) == rows):
                    yield block(part, seq, at, ids, vecs)
                    seq, ids, vecs = seq + 1, [], []
                at = d
                ids.append((i, r))
                vecs.append(v)
        if ids:
            yield block(part, seq, at, ids, vecs)
    return run


def _blocks(v: DataFrame, scale: float, name: str) -> DataFrame:
    n = parallelism(v.sparkSession)
    # the row as well: one id may hold a third of the table
    return save(v.repartitionByRange(n, "dim", "id", "row").sortWithinPartitions("dim", "id", "row").mapInArrow(
        _blocks_fn(BLOCK_ROWS, scale), "dim int, blk long, ids binary, rows binary, mat binary, high binary, low binary"), name)


def _packs_fn(n_blocks: int):
    """Bounds of many blocks in one row."""
    def run(batches):
        held: dict[int, list] = {}
        row = lambda d, x: pa.RecordBatch.from_pydict({
            "dim": pa.array([d], pa.int32()), "blks": [np.array([i[0] for i in x], "<i8").tobytes()],
            "highs": [b"".join(i[1] for i in x)], "lows": [b"".join(i[2] for i in x)]})
        for b in batches:
            for d, k, hi, lo in zip(*(b.column(c).to_pylist() for c in ("dim", "blk", "high", "low"))):
                held.setdefault(d, []).append((k, hi, lo))
                if len(held[d]) == n_blocks:
                    yield row(d, held.pop(d))
        for d, x in held.items():
            yield row(d, x)
    return run


def _bound_rows(b: pa.RecordBatch):
    """(query block, ids, bounds, block names, row) of (query block x pack) rows."""
    for r in b.to_pylist():
        ids, blks = _ids(r["ids"]), _ids(r["blks"])
        dim = r["dim"]
        q = _unpack(r["mat"], dim, len(ids))
        hi, lo = (np.frombuffer(r[c], np.float64).reshape(len(blks), dim) for c in ("highs", "lows"))
        yield r, ids, blks, bounds(q, hi, lo)


def _best_fn(batches):
    """Each query's block with the highest bound in a pack."""
    for b in batches:
        for r, ids, blks, bd in _bound_rows(b):
            at = bd.argmax(axis=1)
            n = len(ids)
            yield pa.RecordBatch.from_pydict({"qb": pa.array([r["qb"]] * n, pa.int64()), "q": pa.array(range(n), pa.int32()),
                                              "bound": bd[np.arange(n), at], "blk": pa.array(blks[at], pa.int64())})


def _alive_fn(batches):
    """The (query, block) pairs of a pack whose bound reaches the query's k-th score."""
    for b in batches:
        for r, ids, blks, bd in _bound_rows(b):
            kth, done = np.array(r["kth"], np.float64), np.array(r["done"], np.int64)
            live = (bd >= kth[:, None]) & (done[:, None] != blks[None, :])
            for j in np.flatnonzero(live.any(axis=0)).tolist():
                q = np.flatnonzero(live[:, j])
                yield pa.RecordBatch.from_pydict({"qb": pa.array([r["qb"]], pa.int64()), "blk": pa.array([blks[j]], pa.int64()),
                                                  "q": pa.array([q.tolist()], pa.list_(pa.int32())), "bound": pa.array([bd[q, j].tolist()], pa.list_(pa.float64()))})


def meet(qblocks: DataFrame, packs: DataFrame) -> DataFrame:
    """Every query block with every pack of its length: dealt over a grid of
    about ``parallelism`` cells, so that each side is copied only its square
    root times and no cell holds one side whole."""
    g = max(1, math.isqrt(parallelism(packs.sparkSession)))
    cells = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    q = qblocks.withColumn("gq", F.pmod(F.xxhash64("qb"), F.lit(g)).cast("int")).withColumn("gp", cells)
    p = packs.withColumn("gp", F.pmod(F.xxhash64("blks"), F.lit(g)).cast("int")).withColumn("gq", cells)
    return q.join(p, ["dim", "gq", "gp"])


class Best:
    """A query's k best (score, id, row) so far."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor, self.rows = k, floor, []

    def add(self, scores, ids, rows) -> None:
        self.rows = sorted([*self.rows, *((-s, i, r) for s, i, r in zip(scores, ids, rows))])[:self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, -self.rows[-1][0])


def _score(q: np.ndarray, q_rows: np.ndarray, which: np.ndarray, best: list, m: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Score some queries on one block."""
    s = dot(q[which], m)
    for r, w in enumerate(which.tolist()):
        own = best[w]
        hit = np.flatnonzero((s[r] >= own.floor) & (rows != q_rows[w]))
        if len(hit) > own.k:                       # keep the k best, all that tie with the k-th
            low = np.partition(s[r][hit], len(hit) - own.k)[len(hit) - own.k]
            hit = hit[s[r][hit] >= low]
        if len(hit):
            own.add([int(x) for x in s[r][hit].tolist()], ids[hit].tolist(), rows[hit].tolist())


def _cell_fn(k: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        blocks = {r["blk"]: (_unpack(r["mat"], r["dim"], len(_ids(r["ids"]))), _ids(r["ids"]), _ids(r["rows"])) for r in rows if r["kind"] == "block"}
        wanted: dict[int, list] = {}
        for r in rows:
            if r["kind"] == "pair":
                wanted.setdefault(r["qb"], []).append(r)
        out = []
        for x in (r for r in rows if r["kind"] == "query"):
            q_ids, q_rows = _ids(x["ids"]), _ids(x["rows"])
            q = _unpack(x["mat"], x["dim"], len(q_ids))
            kth = np.array(x["bound"], np.float64) if x["bound"] else np.full(len(q_ids), -np.inf)
            kth = np.where(np.isfinite(kth) & (np.abs(kth) >= 2 ** 53), kth - np.abs(kth) * 1e-9, kth)     # a rounded long: a little room
            best = [Best(k, f) for f in kth]
            pairs = wanted[x["qb"]]
            bound = np.full((len(q_ids), len(pairs)), -np.inf)
            for j, r in enumerate(pairs):
                bound[r["q"], j] = r["bound"]
            order = np.argsort(-bound, axis=1, kind="stable")
            for step in range(len(pairs)):         # every query's next block, the queries of a block together
                at = order[:, step]
                b = bound[np.arange(len(q_ids)), at]
                live = np.flatnonzero((b > -np.inf) & (b >= np.array([float(y.floor) for y in best])))
                for j in np.unique(at[live]).tolist():
                    _score(q, q_rows, live[at[live] == j], best, *blocks[pairs[j]["blk"]])
            out += [(int(q_rows[i]), int(q_ids[i]), v, -s) for i, y in enumerate(best) for s, v, _ in y.rows]
        return pa.table({c: pa.array([o[n] for o in out], pa.int64()) for n, c in enumerate(("qrow", "query_id", "vec_id", "score"))})
    return run


def _scored(pairs: DataFrame, qblocks: DataFrame, blocks: DataFrame, k: int, cells: tuple[int, int]) -> DataFrame:
    """HITS of written ``pairs`` (qb, blk, q, bound); ``qblocks`` may have ``kth``, the scores to reach."""
    cell = [F.pmod(F.xxhash64("qb"), F.lit(cells[0])).cast("int").alias("cq"), F.pmod(F.xxhash64("blk"), F.lit(cells[1])).cast("int").alias("cp")]
    p = pairs.select(*cell, "qb", "blk", "q", "bound")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    body = ["dim", "ids", "rows", "mat"]
    floors = F.col("kth").alias("bound") if "kth" in qblocks.columns else none("bound", "array<double>")
    q = p.select("cq", "cp", "qb").distinct().join(qblocks.select("qb", *body, floors), "qb").select(
        "cq", "cp", F.lit("query").alias("kind"), "qb", none("blk", "long"), none("q", "array<int>"), "bound", *body)
    b = p.select("cq", "cp", "blk").distinct().join(blocks.select("blk", *body), "blk").select(
        "cq", "cp", F.lit("block").alias("kind"), none("qb", "long"), "blk", none("q", "array<int>"), none("bound", "array<double>"), *body)
    thin = p.select("cq", "cp", F.lit("pair").alias("kind"), "qb", "blk", "q", "bound", none("dim", "int"), *[none(c, "binary") for c in body[1:]])
    return thin.unionByName(q).unionByName(b).groupBy("cq", "cp").applyInArrow(_cell_fn(k), HITS)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every
    query with all other rows.  ``is_query`` is a condition on the column ``id``."""
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    v = save(d.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec")), "topk-rows")
    v = save(v.withColumn("row", F.monotonically_increasing_id()), "topk-numbered")         # the number is written before it is used
    blocks = _blocks(v, scale, "topk-blocks")
    qblocks = _blocks(v.where(is_query), scale, "topk-queries").select("dim", F.col("blk").alias("qb"), "ids", "rows", "mat")
    packs = save(blocks.select("dim", "blk", "high", "low").repartition("dim", F.pmod(F.xxhash64("blk"), F.lit(parallelism(v.sparkSession))))
                 .mapInArrow(_packs_fn(PACK_BLOCKS), "dim int, blks binary, highs binary, lows binary"), "topk-packs")
    cells = tuple(max(1, -(-x.count() // SLICE_BLOCKS)) for x in (qblocks, blocks))

    # 1. the best block of every query
    best = save(meet(qblocks, packs).mapInArrow(_best_fn, "qb long, q int, bound double, blk long")
                .groupBy("qb", "q").agg(F.max(F.struct("bound", "blk")).alias("b")).select("qb", "q", "b.bound", "b.blk"), "topk-best")
    first = best.groupBy("qb", "blk").agg(F.sort_array(F.collect_list(F.struct("q", "bound"))).alias("x"))     # at most one query block
    first = save(first.select("qb", "blk", F.col("x.q").alias("q"), F.col("x.bound").alias("bound")), "topk-first-pairs")
    one = save(_scored(first, qblocks, blocks, k, cells), "topk-first")

    # 2. blocks whose bound reaches the k-th score
    w = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    kth = one.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("qrow", F.col("score").cast("double").alias("kth"))
    state = best.join(v_ids(qblocks), ["qb", "q"]).join(kth, "qrow", "left").groupBy("qb").agg(F.sort_array(F.collect_list(F.struct(
        "q", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"), "blk"))).alias("x")).select("qb", F.col("x.kth").alias("kth"), F.col("x.blk").alias("done"))
    known = save(qblocks.join(state, "qb"), "topk-state")
    alive = save(meet(known, packs).mapInArrow(_alive_fn, "qb long, blk long, q array<int>, bound array<double>"), "topk-alive")
    rest = _scored(alive, known, blocks, k, cells)

    # 3. merge
    out = one.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def v_ids(qblocks: DataFrame) -> DataFrame:
    """(qb, q, qrow): the queries by their place in a query block."""
    def run(batches):
        for b in batches:
            for qb, raw in zip(b.column("qb").to_pylist(), b.column("rows").to_pylist()):
                ids = _ids(raw)
                yield pa.RecordBatch.from_pydict({"qb": pa.array([qb] * len(ids), pa.int64()), "q": pa.array(range(len(ids)), pa.int32()),
                                                  "qrow": pa.array(ids, pa.int64())})
    return qblocks.select("qb", "rows").mapInArrow(run, "qb long, q int, qrow long")
