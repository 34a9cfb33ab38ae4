"""SimHash near-dedup by anchor-point covering.

Fingerprints: A-Z lower-cased words, word shingles, XXH64 of each (repeats
included), a bit is 1 if more than half of the hashes set it.

Linking at ``max_distance`` differing bits: the 64 bits are cut into as many
segments as leave at most one differing bit in one of them (3 bits: two halves).
The anchors of a segment are the words of a covering code: Hamming(31, 26) --
every 31-bit word lies within distance 1 of exactly one code word -- times the
bits left over.  A fingerprint is at home at its own anchor (covering radius 1)
and is replicated to every anchor within radius 1 + threshold 1 (16 or 17 per
half), so two fingerprints that differ in one bit of the segment meet at the
home anchor of either.  Per anchor the homes are compared with all
replicas on the whole 64 bits.

Only distinct fingerprints are compared (equal ones are one node, however many
documents share it), an anchor with many fingerprints is cut into pairs of
chunks that are separate units of work, and a unit returns a spanning forest of
its links, not the pairs.  Components are contracted over the cluster.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows with equal ids are separate rows of the same id; a null id takes
part but cannot name a component unless no other id is reachable; an empty
table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import broadcast_within, lean, parallelism, save, text_batches
from riskframe.llm.components import connected_components

#: An anchor with more rows than this is cut into chunk pairs (exact: every
#: home chunk still meets every replica chunk).
ANCHOR_ROWS = 4096


# --- fingerprints ---------------------------------------------------------

def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, block: int = 65_536) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()      # ASCII case and white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, block):
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[i:i + block], stops[i:i + block])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``keep`` columns and __fp: the fingerprint of every row as a signed 64-bit integer."""
    text_batches(docs.sparkSession)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["__row", "__fp"])

    out = d.mapInArrow(lean(run), T.StructType([d.schema["__row"], T.StructField("__fp", T.LongType())]))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], "__fp")


# --- covering code --------------------------------------------------------

def segments(max_distance: int) -> list[tuple[int, int]]:
    """(first bit, number of bits): enough segments that one of them holds at
    most one of ``max_distance`` differing bits."""
    n = max_distance // 2 + 1
    if not 0 <= max_distance or 64 // n < 3:
        raise ValueError("max_distance must be between 0 and 41")
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _code(bits: int) -> tuple[int, list[int], list[list[int]]]:
    """Hamming code on the lowest 2^r - 1 of ``bits`` bits: r, the parity masks,
    and per syndrome the flips that lead to code words within distance 2."""
    r = (bits + 1).bit_length() - 1
    n = (1 << r) - 1
    masks = [sum(1 << (p - 1) for p in range(1, n + 1) if p >> j & 1) for j in range(r)]
    flips = [[0]]
    for s in range(1, n + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, n + 1) if i < (i ^ s)]
        flips.append([1 << (s - 1), *pairs])
    return r, masks, flips


def anchors(fp: np.ndarray, first: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor) of the homes and of the replicas of unsigned fingerprints
    in one segment."""
    seg = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    r, masks, flips = _code(bits)
    n = (1 << r) - 1
    syndrome = np.zeros(len(fp), np.int64)
    for j, m in enumerate(masks):
        syndrome |= (np.bitwise_count(seg & np.uint64(m)).astype(np.int64) & 1) << j
    flip = np.zeros(n + 1, np.uint64)
    flip[1:] = np.uint64(1) << (np.arange(1, n + 1, dtype=np.uint64) - np.uint64(1))
    home = seg ^ flip[syndrome]
    rows, at = [], []
    order = np.argsort(syndrome, kind="stable")
    bounds = np.searchsorted(syndrome[order], np.arange(n + 2))
    for s in range(n + 1):
        own = order[bounds[s]:bounds[s + 1]]
        if len(own):
            f = np.array(flips[s], np.uint64)
            rows.append(np.repeat(own, len(f)))
            at.append((seg[own][:, None] ^ f[None, :]).ravel())
    # the bits that the code leaves over: one of them may be the differing one
    for b in range(n, bits):
        rows.append(np.arange(len(fp)))
        at.append(home ^ np.uint64(1 << b))
    return np.arange(len(fp)), home, np.concatenate(rows), np.concatenate(at)


def _anchor_fn(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signed = b.column(0).to_numpy(zero_copy_only=False)
            fp = signed.view(np.uint64)
            for i in range(0, len(fp), 20_000):
                for k, (first, bits) in enumerate(parts):
                    part, own = fp[i:i + 20_000], signed[i:i + 20_000]
                    hr, ha, rr, ra = anchors(part, first, bits)
                    row = np.concatenate((hr, rr))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), k, np.int32)), pa.array(np.concatenate((ha, ra)).view(np.int64)),
                         pa.array(own[row]), pa.array(np.concatenate((np.ones(len(hr), bool), np.zeros(len(rr), bool))))],
                        ["seg", "anchor", "fp", "home"])
    return run


# --- comparison per anchor ------------------------------------------------

def _forest(homes: np.ndarray, others: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links (distance <= limit) between two sets of
    unsigned fingerprints: a breadth-first search over blocks of the distance matrix."""
    out: list[tuple[int, int]] = []
    fresh_h, fresh_o = np.ones(len(homes), bool), np.ones(len(others), bool)
    for start in range(len(homes)):
        if not fresh_h[start]:
            continue
        fresh_h[start] = False
        front, side, root = np.array([start]), 0, int(homes[start])
        while len(front):
            mine, them, fresh = (homes, others, fresh_o) if side == 0 else (others, homes, fresh_h)
            left = np.flatnonzero(fresh)
            hit = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                rest = np.flatnonzero(~hit)
                hit[rest] |= (np.bitwise_count(mine[front[i:i + 256]][:, None] ^ them[left[rest]][None, :]) <= limit).any(axis=0)
            front = left[hit]
            fresh[front] = False
            out.extend((root, int(x)) for x in them[front] if int(x) != root)
            side = 1 - side
    return out


def _compare_fn(limit: int):
    """Rows arrive sorted by unit of work; each unit's links leave as a forest."""
    def emit(unit):
        fp = np.concatenate([u[0] for u in unit]).view(np.uint64)
        home = np.concatenate([u[1] for u in unit])
        edges = _forest(np.unique(fp[home]), np.unique(fp[~home]), limit)
        return np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)

    def send(found):
        if found:
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None            # the unit that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            fp, home = b.column(4).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            begins = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1))
            ends = np.concatenate((begins[1:], [len(fp)]))
            # only units with a home and two fingerprints can link
            works = (np.minimum.reduceat(fp, begins) != np.maximum.reduceat(fp, begins)) & np.logical_or.reduceat(home, begins)
            found, first = [], 0
            if held and (keys[0] == key).all():
                held.append((fp[:ends[0]], home[:ends[0]]))
                first = 1
            if first < len(begins):
                if held:
                    found.append(emit(held))
                last = len(begins) - 1
                found.extend(emit([(fp[begins[u]:ends[u]], home[begins[u]:ends[u]])])
                             for u in (np.flatnonzero(works[first:last]) + first).tolist())
                held, key = [(fp[begins[last]:], home[begins[last]:])], keys[-1]
            yield from send(found)
        if held:
            yield from send([emit(held)])
    return run


def links(nodes: DataFrame, max_distance: int = 3, fp: str = "__fp") -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``max_distance`` bits:
    a set whose components are those of all such pairs."""
    spark = nodes.sparkSession
    rows = save(nodes.select(F.col(fp).alias("fp")).distinct().mapInArrow(
        lean(_anchor_fn(segments(max_distance))), "seg int, anchor long, fp long, home boolean"), "simhash-anchors")
    # an anchor matters if it is some fingerprint's home and holds another row
    sizes = rows.groupBy("seg", "anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes"))
    large = save(sizes.where((F.col("n") > ANCHOR_ROWS) & (F.col("homes") > 0)).select(
        "seg", "anchor", F.ceil(F.col("n") / ANCHOR_ROWS).cast("int").alias("chunks")), "simhash-large")
    j = rows.join(broadcast_within(large), ["seg", "anchor"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    # homes of a chunk go to all replica chunks and the other way round
    units = j.select("seg", "anchor", "fp", "home", own.alias("own"), F.explode(every).alias("other")).select(
        "seg", "anchor", F.when(F.col("home"), F.col("own")).otherwise(F.col("other")).alias("hc"),
        F.when(F.col("home"), F.col("other")).otherwise(F.col("own")).alias("rc"), "fp", "home")
    n = parallelism(spark)
    return (units.repartition(n, "seg", "anchor", "hc", "rc").sortWithinPartitions("seg", "anchor", "hc", "rc")
            .mapInArrow(lean(_compare_fn(max_distance)), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 3,
                    seed: int = 42) -> DataFrame:
    """(id, __fp, __group, component_id): one row per document; ``component_id``
    is the smallest id reachable over links of at most ``max_distance`` bits,
    ``__group`` the smallest fingerprint reachable."""
    fps = save(fingerprints(docs, text_col, [id_col], shingle, seed), "simhash-fps")
    nodes = save(fps.groupBy("__fp").agg(F.min(F.col(f"`{id_col}`")).alias("least")), "simhash-nodes")
    comp = connected_components(links(nodes, max_distance))
    of = nodes.join(comp.withColumnRenamed("node", "__fp"), "__fp", "left").select(
        "__fp", "least", F.coalesce("component", "__fp").alias("component"))
    of = save(of, "simhash-components")
    best = save(of.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-best")
    named = save(of.join(best, "component").select("__fp", F.col("component").alias("__group"), "component_id"), "simhash-named")
    return fps.join(broadcast_within(named), "__fp").select(F.col(f"`{id_col}`"), "__fp", "__group", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the row whose id
    names the group; of several such rows with that id, the one with the
    smallest text."""
    near = save(near_duplicates(docs, id_col, text_col, **kw).select(
        F.col(f"`{id_col}`").alias("__id"), "__fp", "__group", F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")).alias("stays")), "simhash-near")
    per_id = near.groupBy("__id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("stays").alias("stays"))
    # ids that go, and the (rare) ids of several rows, leave the plain path
    odd = save(per_id.where(~F.col("stays") | (F.col("n") > 1)), "simhash-odd")
    key = F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
    plain = docs.join(broadcast_within(odd.select("__id")), key, "left_anti")
    shared = save(odd.where(F.col("stays")).select("__id"), "simhash-shared")
    rows = docs.join(broadcast_within(shared), key, "left_semi").select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    known = near.where("stays").join(shared, "__id", "left_semi").select(F.col("__id").alias("__i"), F.col("__fp").alias("__f"), "__group").distinct()
    marked = fingerprints(rows, "__text", ["__id", "__text", "__row"], kw.get("shingle", 3), kw.get("seed", 42))
    first = (marked.join(known, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__fp") == F.col("__f")))
             .groupBy("__id", "__group").agg(F.min_by("__row", F.coalesce("__text", F.lit(""))).alias("__row")))
    return plain.unionByName(first.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
