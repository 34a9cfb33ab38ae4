"""Substring dedup: prefix-partitioned suffix trees over words.

A window of ``window`` words that starts at two places of the corpus is a repeat.

*Suffixes.*  Shipping every suffix with its own window of words would multiply the
corpus by ``window``, so the trees are sparse: of the ``window - PREFIX + 1`` places
in a window where a run of ``PREFIX`` words can begin, the one with the smallest
hash (ties: the first) is the window's *anchor*.  Equal windows have their
anchor at the same place, about every twelfth word is one, and the suffix that begins
at an anchor is sent once, with the words to its left that its windows cover.
*Prefixes.*  The suffix's first ``PREFIX`` words decide its group.  A census over
all texts counts every prefix.  The suffix of a prefix that occurs once holds no
repeat and is not sent: a bitmap of at most ``BITMAP_BYTES`` names the prefixes that
occur again (bits that two prefixes share only send more).  A prefix that more than ``limit`` suffixes share (never
more than ``HOT`` prefixes, a broadcast of 8 MB) is too large for a group and is
lengthened to the whole window: each window start is then a suffix of its own.
The number of groups follows the bytes of the corpus, so that one holds
``GROUP_BYTES``.
*Subtrees.*  In a group the suffixes of all window starts are sorted by their words
(real words, no hashes); the lengths of common prefixes of neighbours are the
inner nodes, and a node at least ``window`` deep gives its leaves as
repeats; neighbouring starts join to maximal ones.  Equal pieces of one task are
one suffix and are marked where they are found, so a passage that a third of
the corpus holds reaches its group once per task.
*Removal.*  The spans, one row per text, are joined to the texts by a digest.

Defined results: null text has no words and stays null; texts of fewer than
``window`` words lose nothing; rows of equal text repeat each other; an empty
table gives an empty table; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import parallelism, save, spread_keys, text_batches

#: Words that decide a suffix's group.
PREFIX = 12
#: Suffixes of one prefix beyond which it is lengthened (at least), and lengthened prefixes at most.
LIMIT, HOT = 20_000, 1_000_000
#: Bytes of words in a group, of text in a block, and suffixes that a subtree sorts at once.
GROUP_BYTES, BLOCK_BYTES, SORTED = 24 << 20, 8 << 20, 200_000
#: Bytes sent per byte of text, at most about.
SENT = 3.5
#: Size limit of the bitmap of repeated prefixes, and bits of it that a task makes at once.
BITMAP_BYTES, SLICE_BITS = 32 << 20, 1 << 16

_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_NONE = 0xFFFFFFFF


# --- anchors --------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[0]
    x = (x ^ (x >> np.uint64(29))) * _M[1]
    return x ^ (x >> np.uint64(32))


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from every place on, by doubling."""
    out, done, step, power = None, 0, 1, words
    while True:
        if n & step:
            if out is None:
                out = power
            else:
                m = len(power) - done
                out = out[:m] * _M[2] + _mixed(power[done:])
            done += step
        step *= 2
        if step > n:
            return _mixed(out[:max(0, len(words) - n + 1)])
        half = step // 2
        power = _mixed(power[:len(power) - half] * _M[1] + power[half:]) if len(power) > half else power[:0]


class Block:
    """Words of some texts in a row, and the suffixes at their anchors."""

    def __init__(self, texts: Sequence[bytes], window: int):
        import xxhash
        split = [t.split() for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        self.ends = np.cumsum(sizes)
        words = [w for x in split for w in x]
        d = pa.array(words, pa.binary()).dictionary_encode()
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(w) for w in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
        hashes = hashes[d.indices.to_numpy()] if len(words) else hashes
        self.text = b" ".join(words)
        self.at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
        runs = _run_hashes(hashes, PREFIX)
        places = window - PREFIX + 1
        n = len(words) - window + 1
        if n <= 0:
            self.starts = self.anchors = np.zeros(0, np.int64)
            return
        doc = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(np.arange(n) + window <= self.ends[doc[:n]])
        view = np.lib.stride_tricks.sliding_window_view(runs, places)
        anchors = np.concatenate([view[a:a + 65_536].argmin(axis=1) for a in range(0, n, 65_536)])[starts] + starts
        self.doc, self.starts, self.anchors, self.hashes, self.runs = doc, starts, anchors, hashes, runs

    def suffixes(self, window: int, hot: np.ndarray | None, repeated: tuple[np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefix hash, first window start, last window start) of every suffix, or of those whose
        prefix is ``repeated`` (bits, mask)."""
        s, a = self.starts, self.anchors
        if len(s) and repeated is not None:
            bits, mask = repeated
            at = self.runs[a] & np.uint64(mask)
            again = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            s, a = s[again], a[again]
        if not len(s):
            return np.zeros(0, np.uint64), s, s
        prefix = self.runs[a]
        cut = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))
        if hot is not None and len(hot):
            long = hot[np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)] == prefix
            if long.any():
                cut[1:] |= long[1:] | long[:-1]
                cut |= long
                whole = _run_hashes(self.hashes, window)
                prefix = np.where(long, whole[s], prefix)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(s)) - 1
        return prefix[first], s[first], s[last]


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[Block, list]]:
    """Blocks with the other columns' values of their texts."""
    texts, rest, size = [], [], 0
    for b in batches:
        for i, t in enumerate(b.column(0).to_pylist()):
            if t:
                texts.append(t.encode("utf-8", "surrogatepass"))
                rest.append(b.column(1)[i].as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield Block(texts, window), rest
                    texts, rest, size = [], [], 0
    if texts:
        yield Block(texts, window), rest


def _census(texts: DataFrame, window: int) -> DataFrame:
    """(prefix, n): hashes of the prefixes that more than one suffix begins with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches, window):
            prefix, _, _ = block.suffixes(window, None)
            k, n = np.unique(prefix, return_counts=True)
            for a in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a:a + 50_000].view(np.int64)), pa.array(n[a:a + 50_000])], ["prefix", "n"])

    return save(texts.mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where("n > 1"), "substring-prefixes")


def _hot(census: DataFrame, limit: int) -> np.ndarray:
    """Sorted hashes of the prefixes that more than ``limit`` suffixes begin with."""
    # at most bytes / 2 / limit rows, which is HOT
    return np.sort(np.array([r[0] for r in census.where(F.col("n") > limit).select("prefix").collect()], np.int64).view(np.uint64))


def _bitmap(census: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, mask): bit ``prefix & mask`` is set for every prefix of the census (anchors are
    smallest hashes: only their low bits are even).  Tasks make slices of ``SLICE_BITS``
    bits; the driver lays them side by side."""
    each = SLICE_BITS.bit_length() - 1
    bits = max(each, min((BITMAP_BYTES * 8).bit_length() - 1, (16 * census.count()).bit_length()))
    mask = (1 << bits) - 1

    def run(group: pa.Table) -> pa.Table:
        at = group.column("at").to_numpy()
        part = np.zeros(SLICE_BITS, np.uint8)
        part[at & (SLICE_BITS - 1)] = 1
        return pa.table({"slice": pa.array([int(at[0]) >> each], pa.int64()), "part": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    at = census.select(F.expr(f"prefix & {mask}L").alias("at"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in at.groupBy(F.expr(f"at div {SLICE_BITS}")).applyInArrow(run, "slice long, part binary").collect():
        first = r["slice"] * (SLICE_BITS // 8)
        out[first:first + SLICE_BITS // 8] = np.frombuffer(r["part"], np.uint8)
    return out, mask


# --- groups ---------------------------------------------------------------

def _packed(a) -> bytes:
    b = a.tobytes() if isinstance(a, np.ndarray) else a
    return len(b).to_bytes(4, "little") + pa.Codec("zstd").compress(b, asbytes=True)


def _unpacked(b: bytes) -> bytes:
    return pa.Codec("zstd").decompress(b[4:], decompressed_size=int.from_bytes(b[:4], "little"), asbytes=True)


_SENT = T.StructType([T.StructField("g", T.IntegerType())] + [T.StructField(c, T.BinaryType()) for c in ("words", "prefix", "doc", "start", "keys")])


def _runs(x: np.ndarray) -> Iterator[np.ndarray]:
    """Places of equal values."""
    order = np.argsort(x, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(x[order]) != 0, [True]))) if len(x) else []
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield order[i:j]


def _sent(texts: DataFrame, window: int, hot: np.ndarray, repeated: tuple[np.ndarray, int], groups: Sequence[int]) -> DataFrame:
    """Per block and group one row with its pieces, and one with spans (words
    null) that the block itself shows to be repeated, dealt by text."""
    shared = texts.sparkSession.sparkContext.broadcast((hot, repeated))
    group_keys = np.array(groups, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(g, words, prefix, doc, start, keys):
            return pa.RecordBatch.from_arrays([pa.array([int(group_keys[g])], pa.int32()), *[pa.array([x], pa.binary()) for x in (
                words, prefix, _packed(doc.astype(np.uint32)), _packed(start.astype(np.uint32)), b"".join(keys))]], _SENT.names)

        for block, keys in _blocks(batches, window):
            prefix, first, last = block.suffixes(window, *shared.value)
            if not len(prefix):
                continue
            doc = block.doc[first]
            begin = np.concatenate(([0], block.ends))[doc]
            left, right = block.at[first].tolist(), (block.at[last + window] - 1).tolist()
            seen: dict[bytes, int] = {}
            which = np.fromiter((seen.setdefault(block.text[a:b], len(seen)) for a, b in zip(left, right)), np.int64, len(left))
            pieces = list(seen)
            one = np.unique(which, return_index=True)[1]
            many = np.bincount(which)[which] > 1
            # equal pieces: repeated whatever other tasks hold
            d, a, b = doc[many], (first - begin)[many], (last - begin)[many] + window
            to = np.array([int.from_bytes(k[:4], "little") % len(group_keys) for k in keys], np.int64)[d]
            for at in _runs(to):
                yield row(to[at[0]], None, None, b[at], a[at], [keys[x] for x in d[at].tolist()])
            g = (prefix[one] % np.uint64(len(group_keys))).astype(np.int64)
            for pick in _runs(g):
                at = one[pick]
                own, place = np.unique(doc[at], return_inverse=True)
                yield row(g[pick[0]], _packed(b"\n".join([pieces[x] for x in pick.tolist()])), _packed(prefix[at]), np.where(many[at], _NONE, place),
                          (first - begin)[at], [keys[x] for x in own.tolist()])

    return texts.mapInArrow(run, _SENT)


# --- subtrees -------------------------------------------------------------

def deep_leaves(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For the suffixes of ``words`` (numbers) at ``starts``, cut off at ``window``
    words: whether a leaf hangs below an inner node at that depth.

    The suffixes in order, with the common prefix lengths of neighbours, are the
    subtree: a run of neighbours with lengths of at least d is a node of depth d."""
    rows = words[starts[:, None] + np.arange(window)].astype(">i4")
    order = np.argsort(rows.view(np.dtype((np.void, 4 * window)))[:, 0])
    rows = rows[order]
    same = rows[1:] == rows[:-1]
    common = np.where(same.all(axis=1), window, same.argmin(axis=1))
    deep = np.zeros(len(starts) + 1, bool)
    deep[1:-1] = common >= window
    out = np.zeros(len(starts), bool)
    out[order] = deep[1:] | deep[:-1]
    return out


def _repeats(window: int):
    def run(group: pa.Table) -> pa.Table:
        prefix, doc, start, pieces, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        out = [[], [], []]
        for r in group.to_pylist():
            own = [r["keys"][i:i + 16] for i in range(0, len(r["keys"]), 16)]
            if r["words"] is None:
                out[0] += own
                out[1].append(np.frombuffer(_unpacked(r["start"]), "<u4"))
                out[2].append(np.frombuffer(_unpacked(r["doc"]), "<u4"))
                continue
            place = np.frombuffer(_unpacked(r["doc"]), "<u4").astype(np.int64)
            doc.append(np.where(place == _NONE, -1, place + len(keys)))
            keys += own
            prefix.append(np.frombuffer(_unpacked(r["prefix"]), "<u8"))
            start.append(np.frombuffer(_unpacked(r["start"]), "<u4").astype(np.int64))
            pieces += _unpacked(r["words"]).split(b"\n")
        prefix, doc, start = np.concatenate(prefix), np.concatenate(doc), np.concatenate(start)
        # a prefix with one suffix has no inner node
        order = np.argsort(prefix, kind="stable")
        p = prefix[order]
        new = np.concatenate((np.ones(min(len(p), 1), bool), p[1:] != p[:-1], np.ones(1, bool)))
        order = order[~(new[1:] & new[:-1])]
        sizes = np.array([pieces[i].count(b" ") + 1 for i in order.tolist()], np.int64)
        # blocks of whole prefixes, so that all leaves of a node are in one
        p = prefix[order]
        a = 0
        total = np.concatenate(([0], np.cumsum(sizes - window + 1)))
        while a < len(order):
            b = max(a + 1, int(np.searchsorted(total, total[a] + SORTED, "right")) - 1)
            b = int(np.searchsorted(p, p[b - 1], "right"))
            part, n = order[a:b], sizes[a:b]
            words = pa.array(b" ".join([pieces[i] for i in part.tolist()]).split(), pa.binary()).dictionary_encode().indices.to_numpy()
            base = np.concatenate(([0], np.cumsum(n)))
            piece = np.repeat(np.arange(len(part)), n - window + 1)
            place = np.arange(len(piece)) - np.repeat(np.concatenate(([0], np.cumsum(n - window + 1)))[:-1], n - window + 1)
            hit = deep_leaves(words, base[piece] + place, window) & (doc[part][piece] >= 0)
            piece, place = piece[hit], place[hit]
            if len(piece):                                  # neighbouring starts of a piece: one maximal repeat
                cut = np.concatenate(([True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)))
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(piece)) - 1
                at = part[piece[first]]
                out[0] += [keys[i] for i in doc[at].tolist()]
                out[1].append(start[at] + place[first])
                out[2].append(start[at] + place[last] + window)
            a = b
        empty = np.zeros(0, np.int64)
        return pa.table({"key": pa.array(out[0], pa.binary()), "a": pa.array(np.concatenate(out[1] or [empty]), pa.int32()),
                         "b": pa.array(np.concatenate(out[2] or [empty]), pa.int32())})
    return run


def repeated_spans(texts: DataFrame, window: int = 35) -> DataFrame:
    """(key, spans): per distinct text its word spans [a, b) covered by windows that
    start elsewhere too.  ``texts`` has text and key (16 bytes that name the text)."""
    spark = texts.sparkSession
    if window <= PREFIX:
        raise ValueError(f"window must be over {PREFIX} words")
    text_batches(spark)
    texts = texts.select("text", "key")
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    census = _census(texts, window)
    hot, repeated = _hot(census, max(LIMIT, -(-size // 2 // HOT))), _bitmap(census)
    p = parallelism(spark)
    groups = spread_keys(spark, p, max(1, -(-int(size * SENT) // GROUP_BYTES // p)))
    # spans found in a task travel with its pieces, as a row of the task's own group
    found = _sent(texts, window, hot, repeated, groups).groupBy("g").applyInArrow(_repeats(window), "key binary, a int, b int")
    return save(found.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "substring-spans")


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_removed and ``kept``: the words outside every
    repeat, joined by one space (null for null text)."""
    text_batches(docs.sparkSession)
    digest = F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text")).withColumn("key", digest)
    spans = repeated_spans(d, window)
    j = d.join(spans.hint("shuffle_hash"), "key", "left").select("row", "text", "spans")
    fields = [T.StructField("row", j.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                left = np.ones(len(words), bool)
                for s in spans or ():
                    left[s["a"]:s["b"]] = False
                n.append(len(words))
                gone.append(int(len(words) - left.sum()))
                if gone[-1]:
                    words = [words[i] for i in np.flatnonzero(left).tolist()]
                kept.append(None if text is None else b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["row", "n_words", "n_removed", "kept"])

    out = j.mapInArrow(run, T.StructType(fields))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "n_words", "n_removed", "kept")
