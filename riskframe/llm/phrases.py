"""Phrase collocation mining: Misra-Gries summaries, then exact counts of what survives.

1. *Summaries.*  Every task counts the n-grams (1 to ``longest`` words inside a piece) of
   its texts by a 48-bit hash; the counts, cut by hash range into partitions, are
   Misra-Gries summaries that merge: a partition adds the counters of all tasks one
   after another and, above its capacity, subtracts the (capacity + 1)-th largest
   count from all and drops what falls to zero.  Each unit subtracted takes more than
   ``capacity`` occurrences with it, so with a capacity above mass / threshold less
   than ``threshold`` is subtracted altogether, and every n-gram that occurs
   ``threshold`` times survives.  The capacity comes from a proven bound on the mass
   (a word and its separator are two bytes); should one partition hold more than
   its share, its capacity grows rather than let an n-gram go.
2. *Exact counts.*  Survivors whose counter plus what was subtracted reaches the
   threshold set bits in a bitmap of at most ``BITMAP_BYTES``, the only thing that is
   broadcast.  A second pass counts the n-grams that hit it as strings, by an
   ordinary aggregate; hash collisions and foreign bits only bring extra rows,
   which the threshold then removes.
3. *Scores.*  Parts of a candidate occur at least as often as it does, so they are in
   the same table of counts; joins on the parts give every cut its counts.

Defined results: null text is empty; a null group is named ``und``; a text without
words adds nothing; repeated rows count again; an empty table gives an empty
table; columns other than text and group are not read.  Texts of any length are
read whole, in blocks of words that overlap by ``longest - 1``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import parallelism, save, spread_keys, text_batches

#: Bytes of text and words that are counted at once, and counters of a task before they are sent.
BLOCK_BYTES, BLOCK_WORDS, TASK_COUNTERS = 2 << 20, 1 << 18, 2_000_000
#: Size limit of the bitmap of survivors.
BITMAP_BYTES = 32 << 20
#: Bits of an n-gram's hash, and n-gram occurrences that one partition should hold at most.
HASH_BITS, PARTITION_MASS = 48, 32_000_000
#: Bits of a count that is held beside its key, and rows of counters that are added at once at most.
COUNT_BITS, WAITING = 64 - HASH_BITS, 1_000
#: Capacity over the mass bound divided by the threshold.
SLACK = 1.0

_BREAK = 0xFF                                               # no byte of UTF-8
_TABLE = bytes(_BREAK if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
#: Odd multipliers of the hash.
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


# --- n-grams of a block of texts ------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(group, distinct words, word numbers with -1 between pieces) block by block."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush():
        for group, texts in held.items():
            # one split for all texts: breaks become words of their own
            words = b"\xff".join(texts).translate(_TABLE).replace(b"\xff", b" \xff ").split()
            for a in range(0, max(len(words), 1), BLOCK_WORDS):
                # the two words before the block are the start of no n-gram of it
                part = words[a:a + BLOCK_WORDS + 2]
                if part:
                    d = pa.array(part, pa.binary()).dictionary_encode()
                    codes = d.indices.to_numpy().astype(np.int64)
                    brk = pc.index(d.dictionary, pa.scalar(b"\xff", pa.binary())).as_py()
                    codes[codes == brk] = -1
                    yield group, d.dictionary, codes, min(BLOCK_WORDS, len(part))
        held.clear()

    for b in batches:
        for group, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                t = text.encode("utf-8", "surrogatepass")
                held.setdefault(group, []).append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    size = 0
    yield from flush()


def _ngrams(codes: np.ndarray, n: int, starts: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams that start at the first ``starts`` places, as (rows of word numbers, counts)."""
    m = min(starts, len(codes) - n + 1)
    if m <= 0:
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64)
    ok = codes[:m] >= 0
    key = codes[:m].copy()
    for j in range(1, n):
        ok &= codes[j:j + m] >= 0
        key = key * vocabulary + codes[j:j + m]             # below 2 ** 63: BLOCK_WORDS + 3 cubed is
    key, counts = np.unique(key[ok], return_counts=True)
    parts = []
    for _ in range(n):
        key, c = np.divmod(key, vocabulary)
        parts.append(c)
    return np.stack(parts[::-1], axis=1), counts


def _word_hashes(words: pa.Array, group: str) -> np.ndarray:
    import xxhash
    seed = xxhash.xxh64_intdigest(group.encode("utf-8", "surrogatepass")) & 0x7FFFFFFF
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def _hash(parts: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = np.full(len(parts), parts.shape[1], np.uint64)
    for j in range(parts.shape[1]):
        x = (x ^ words[parts[:, j]]) * _M[j % 3]
        x ^= x >> np.uint64(29)
    return (x * _M[1]) >> np.uint64(64 - HASH_BITS)


# --- summaries ------------------------------------------------------------

def _beside(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Key and count in one number, sorted without a second array; a count over
    ``COUNT_BITS`` becomes several counters of its key."""
    top = (1 << COUNT_BITS) - 1
    counts = counts.astype(np.int64)
    x = (keys << np.uint64(COUNT_BITS)) | (counts % top).astype(np.uint64)
    big = counts >= top
    if not big.any():
        return x
    whole = np.repeat((keys[big] << np.uint64(COUNT_BITS)) | np.uint64(top), counts[big] // top)
    return np.concatenate([x[counts % top > 0], whole])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts.  Empties both lists: millions of counters
    are not held twice."""
    parts = []
    while keys:
        parts.append(_beside(keys.pop(), counts.pop()))
    x = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    del parts
    x.sort()
    n = x & np.uint64((1 << COUNT_BITS) - 1)
    x >>= np.uint64(COUNT_BITS)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[first], (np.add.reduceat(n, first) if len(x) else n).astype(np.int64)


class Summary:
    """Misra-Gries counters of one partition."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken = capacity, threshold, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counters of sorted distinct keys: known ones in place, the others between them."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        self.counts[at[known]] += counts[known]
        at, keys, counts = at[~known], keys[~known], counts[~known]
        self.keys, self.counts = np.insert(self.keys, at, keys), np.insert(self.counts, at, counts)
        if len(self.keys) > self.capacity:
            d = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            if self.taken + d >= self.threshold:            # more than its share of the mass: grow
                d = self.threshold - 1 - self.taken
                self.capacity *= 2
            if d:
                self.taken += d
                left = self.counts > d
                self.keys, self.counts = self.keys[left], self.counts[left] - d

    def frequent(self) -> np.ndarray:
        return self.keys[self.counts + self.taken >= self.threshold]


def _packed(a: np.ndarray) -> bytes:
    return bytes([a.dtype.itemsize]) + len(a).to_bytes(4, "little") + pa.Codec("zstd").compress(a.tobytes(), asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    size, n = b[0], int.from_bytes(b[1:5], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(b[5:], decompressed_size=n * size, asbytes=True), f"<u{size}")


def _summaries(texts: DataFrame, longest: int, names: list[int]) -> DataFrame:
    """(p, first, keys, counts): counters of a task in a hash range (p: its name); keys as sorted differences."""
    partitions = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush(k, c):
            cuts = np.searchsorted(k, [(p << HASH_BITS) // partitions for p in range(partitions + 1)])
            for p in range(partitions):
                a, b = cuts[p], cuts[p + 1]
                if a < b:
                    d = np.diff(k[a:b], prepend=np.uint64(0))
                    first, d[0] = int(d[0]), 0
                    d = d.astype(np.uint32) if int(d.max()) < 1 << 32 else d
                    n = c[a:b]
                    n = n.astype(np.uint8) if int(n.max()) < 256 else n.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array([names[p]], pa.int32()), pa.array([first], pa.int64()), pa.array([_packed(d)], pa.binary()),
                                                      pa.array([_packed(n)], pa.binary())], ["p", "first", "keys", "counts"])

        for group, words, codes, starts in _blocks(batches):
            hashes = _word_hashes(words, group)
            for n in range(1, longest + 1):
                parts, c = _ngrams(codes, n, starts, len(words))
                keys.append(_hash(parts, hashes))
                counts.append(c.astype(np.min_scalar_type(int(c.max(initial=0)))))
                held += len(c)
            if held > TASK_COUNTERS:
                k, c = _added(keys, counts)
                if len(k) > TASK_COUNTERS // 2:
                    yield from flush(k, c)
                    held = 0
                else:
                    keys, counts, held = [k], [c], len(k)
                del k, c
        if held:
            yield from flush(*_added(keys, counts))

    return texts.mapInArrow(run, "p int, first long, keys binary, counts binary")


def _survivors(summaries: DataFrame, capacity: int, threshold: int) -> DataFrame:
    """(p, n, keys): n-gram hashes that may reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition's counters, and those that came since it was last added to
        held: dict[int, tuple[Summary, list, list]] = {}
        for b in batches:
            for p, first, k, c in zip(*[x.to_pylist() for x in b.columns]):
                s, keys, counts = held.setdefault(p, (Summary(capacity, threshold), [], []))
                new = _unpacked(k).astype(np.uint64)
                new[0] += np.uint64(first)
                keys.append(np.cumsum(new, dtype=np.uint64))
                counts.append(_unpacked(c))
                if sum(map(len, keys)) > capacity // 4 or len(keys) >= WAITING:
                    s.merge(*_added(keys, counts))
        for p, (s, keys, counts) in held.items():
            s.merge(*_added(keys, counts))
            k = s.frequent()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([_packed(k)], pa.binary())], ["p", "n", "keys"])

    return summaries.mapInArrow(run, "p int, n long, keys binary")


def _bitmap(survivors: DataFrame, partitions: int) -> tuple[np.ndarray, int]:
    """(bits, shift): bit ``hash >> shift`` is set for every survivor.  Tasks send slices of the bitmap."""
    n = survivors.agg(F.sum("n")).first()[0] or 0
    bits = min((BITMAP_BYTES * 8).bit_length() - 1, max(10, (32 * n).bit_length()))
    shift = HASH_BITS - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = _unpacked(k).astype(np.uint64) >> np.uint64(shift)
                if len(at):
                    low, high = int(at[0]) >> 3, int(at[-1]) >> 3
                    part = np.zeros((high - low + 1) * 8, np.uint8)
                    part[(at - np.uint64(low * 8)).astype(np.int64)] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["low", "part"])

    out = np.zeros(1 << max(0, bits - 3), np.uint8)
    for r in survivors.select("p", "keys").mapInArrow(run, "low long, part binary").toLocalIterator():
        a = np.frombuffer(r["part"], np.uint8)
        out[r["low"]:r["low"] + len(a)] |= a
    return out, shift


def phrase_counts(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = 3, threshold: int = 10) -> DataFrame:
    """(grp, k, phrase, f): exact counts of every phrase of 1 to ``longest`` words that
    occurs ``threshold`` times in its group, and k = 0 with the group's words."""
    if not 1 <= longest <= 3:
        raise ValueError("longest must be 1 to 3")
    spark = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("grp"), F.col(f"`{text_col}`").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint") + 1)).first()[0] or 0
    mass = longest * (size // 2 + 1)                        # n-gram occurrences at most
    partitions = max(parallelism(spark), -(-mass // PARTITION_MASS))
    capacity = int(SLACK * mass / partitions / threshold) + 1_000
    summaries = _summaries(texts, longest, spread_keys(spark, partitions)).repartition(partitions, "p")
    survivors = save(_survivors(summaries, capacity, threshold), "phrase-survivors")
    bitmap, shift = _bitmap(survivors, partitions)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def rows(group, k, phrases, counts):
            n = len(counts)
            return pa.RecordBatch.from_arrays([pa.array([group] * n, pa.string()), pa.array(np.full(n, k, np.int32)), phrases, pa.array(counts, pa.int64())],
                                              ["grp", "k", "phrase", "f"])

        for group, words, codes, starts in _blocks(batches):
            hashes = _word_hashes(words, group)
            yield rows(group, 0, pa.array([""]), [int((codes[:starts] >= 0).sum())])
            for n in range(1, longest + 1):
                parts, c = _ngrams(codes, n, starts, len(words))
                at = _hash(parts, hashes) >> np.uint64(shift)
                hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                parts, c = parts[hit], c[hit]
                if len(c):
                    names = [words.take(pa.array(parts[:, j])) for j in range(n)]
                    phrases = names[0] if n == 1 else pc.binary_join_element_wise(*names, pa.scalar(b" ", pa.binary()))
                    for a in range(0, len(c), 20_000):
                        yield rows(group, n, phrases.slice(a, 20_000).cast(pa.string()), c[a:a + 20_000])

    return save(texts.mapInArrow(run, "grp string, k int, phrase string, f long").groupBy("grp", "k", "phrase").agg(F.sum("f").alias("f"))
                .where((F.col("k") == 0) | (F.col("f") >= threshold)), "phrase-counts")


# --- scores ---------------------------------------------------------------

def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", threshold: int = 10, covered_percent: int = 50,
                 top: int | None = 2000, salts: int = 64) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score) of phrases of two and three words.

    score = floor(10^6 a^2 / (l r)) of the lowest-scoring cut (ties: the smallest), in
    decimal integers; a phrase that lies in a longer candidate with at least
    ``covered_percent`` of its count goes; the first ``top`` of every group by score, a and phrase."""
    t = phrase_counts(docs, text_col, group_col, 3, threshold)
    c = t.where("k > 1").select("grp", "phrase", "k", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    join = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    parts = F.when(F.col("k") == 2, F.array(*[F.struct(F.lit(1).alias("cut"), F.lit(s).alias("side"), join(i, 1).alias("part")) for i, s in ((1, "l"), (2, "r"))])).otherwise(
        F.array(*[F.struct(F.lit(cut).alias("cut"), F.lit(s).alias("side"), join(i, n).alias("part"))
                  for cut, s, i, n in ((1, "l", 1, 1), (1, "r", 2, 2), (2, "l", 1, 2), (2, "r", 3, 1))]))
    x = c.select("grp", "phrase", "a", F.explode(parts).alias("x")).select("grp", "phrase", "a", "x.*")
    found = x.join(t.where("k > 0").select("grp", F.col("phrase").alias("part"), "f"), ["grp", "part"])
    cuts = found.groupBy("grp", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"),
                                                          F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    d = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.withColumn("num", F.lit(1_000_000).cast("decimal(7,0)") * (d("a") * d("a"))).withColumn("den", d("l") * d("r"))
    best = cuts.groupBy("grp", "phrase", "a").agg(F.min(F.struct(F.expr("num div den").alias("score"), "cut", "l", "r")).alias("b"))
    # two-word candidates inside three-word ones
    longer = c.where("k = 3").select("grp", F.explode(F.array(join(1, 2), join(2, 2))).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("grp", "phrase").agg(F.max("f").alias("longest"))
    n = t.where("k = 0").select("grp", F.col("f").alias("n"))
    out = best.join(longer, ["grp", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < covered_percent * F.col("a"), F.lit(True)))
    out = out.join(n, "grp").select("grp", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:
        # a group's candidates are cut to ``top`` in slices first: no task ranks a whole group
        out = out.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        out = out.withColumn("__r", F.row_number().over(Window.partitionBy("grp", "__salt").orderBy(*order))).where(F.col("__r") <= top)
        out = out.drop("__r", "__salt").withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= top)
    else:
        out = out.withColumn("rank", F.lit(None).cast("int"))
    return out.select("grp", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
