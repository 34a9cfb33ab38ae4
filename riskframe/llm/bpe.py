"""Byte-level BPE encoding and decoding with public rank files.

Texts up to ``chunk_chars`` characters are encoded as they are.  Longer ones
are cut into overlapping chunks that are spread over the cluster and
pre-tokenised in parallel; two neighbouring chunks are stitched at the first
position that both name as a pre-token boundary (the pre-tokeniser looks only
forward, so from a common boundary on both see the same pre-tokens), and the
pieces between the stitches are encoded in parallel and put in order.  A text
with two neighbours that share no boundary in the overlap (one pre-token longer
than the overlap) is encoded whole, which is exact too.  Decoding concatenates
the raw bytes of the ids.

Defined results: null text is the empty text (no ids); ids, extra columns and
repeated rows are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import lean, save, text_batches

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024

_ENCODERS: dict = {}


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def _encoder(raw: bytes, pattern: str):
    """One encoder per Python worker and rank file."""
    key = (hash(raw), pattern)
    if key not in _ENCODERS:
        import tiktoken
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={})
    return _ENCODERS[key]


def read_ranks(path: str) -> bytes:
    """The rank file's bytes; its size is fixed by the vocabulary (under 1 MB)."""
    with open(path, "rb") as f:
        return f.read()


def final_boundaries(matches, n: int, last: bool) -> list[int]:
    """Ends of the matches that cannot change when text follows: the pattern
    looks one character beyond a match, so ends within the last two characters
    of a chunk are open unless the chunk ends the text."""
    return [m.end() for m in matches if last or m.end() < n - 1]


def _encode_fn(raw_b, pattern: str, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(raw_b.value, pattern)
        for b in batches:
            i = b.schema.get_field_index(text)
            ids = [np.array(enc.encode_ordinary(t or ""), "<u4").tobytes() for t in b.column(i).to_pylist()]
            cols = [c for k, c in enumerate(b.columns) if k != i] + [pa.array(ids, pa.binary())]
            names = [n for k, n in enumerate(b.schema.names) if k != i] + [out]
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def _split_fn(chunk: int, overlap: int):
    def run(batches):
        for b in batches:
            for uid, text in zip(b.column("__uid").to_pylist(), b.column("__text").to_pylist()):
                n = max(1, -(-(len(text) - overlap) // chunk))     # the last chunk is at most chunk + overlap long
                for k in range(n):
                    end = len(text) if k == n - 1 else (k + 1) * chunk + overlap
                    yield pa.RecordBatch.from_pydict({"__uid": pa.array([uid], pa.int64()), "__k": pa.array([k], pa.int64()),
                                                      "__n": pa.array([n], pa.int64()), "__chunk": [text[k * chunk:end]]})
    return run


def _pretoken_fn(pattern: str, chunk: int, overlap: int):
    def run(batches):
        import regex
        pat = regex.compile(pattern)
        for b in batches:
            heads, tails = [], []
            for k, n, text in zip(b.column("__k").to_pylist(), b.column("__n").to_pylist(), b.column("__chunk").to_pylist()):
                ends = final_boundaries(pat.finditer(text), len(text), k == n - 1)
                at = k * chunk
                heads.append([at + e for e in ends if e <= overlap])
                tails.append([at + e for e in ends if e >= chunk] if k < n - 1 else [])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*b.schema.names, "__head", "__tail"])
    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``docs`` with ``text_col`` replaced by ``ids_col``: the ids of the whole
    text as little-endian unsigned 32-bit integers.  A column of ``docs``
    already named ``ids_col`` is replaced."""
    spark = docs.sparkSession
    text_batches(spark)
    raw_b = spark.sparkContext.broadcast(ranks)
    keep = [c for c in docs.columns if c not in (text_col, ids_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row") if keep else F.lit(0).alias("__row"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    row_type = rows.schema["__row"].dataType
    back = [F.col(f"__row.`{c}`").alias(c) for c in keep] + [F.col("__ids").alias(ids_col)]

    short = rows.where(F.length("__text") <= chunk_chars).mapInArrow(
        lean(_encode_fn(raw_b, pattern, "__text", "__ids")),
        T.StructType([T.StructField("__row", row_type), T.StructField("__ids", T.BinaryType())]))

    # written once: the row numbers must be the same where texts are cut and where rows come back
    long = save(rows.where(F.length("__text") > chunk_chars).withColumn("__uid", F.monotonically_increasing_id()), "bpe-long")
    chunks = (long.select("__uid", "__text").mapInArrow(lean(_split_fn(chunk_chars, overlap_chars)), "__uid long, __k long, __n long, __chunk string")
              .repartition("__uid", "__k")
              .mapInArrow(lean(_pretoken_fn(pattern, chunk_chars, overlap_chars)),
                          "__uid long, __k long, __n long, __chunk string, __head array<long>, __tail array<long>"))
    w = Window.partitionBy("__uid").orderBy("__k")
    stitched = (chunks.withColumn("__sync", F.array_min(F.array_intersect("__tail", F.lead("__head").over(w))))
                .withColumn("__from", F.coalesce(F.lag("__sync").over(w), F.lit(0)))
                .withColumn("__ok", F.min(F.col("__sync").isNotNull() | (F.col("__k") == F.col("__n") - 1)).over(Window.partitionBy("__uid"))))
    at = F.col("__k") * chunk_chars
    piece = F.when(F.col("__ok"), F.col("__chunk").substr((F.col("__from") - at + 1).cast("int"),
                                                          (F.coalesce("__sync", at + F.length("__chunk")) - F.col("__from")).cast("int"))) \
        .when(F.col("__k") < F.col("__n") - 1, F.col("__chunk").substr(F.lit(1), F.lit(chunk_chars))).otherwise(F.col("__chunk"))
    pieces = stitched.select("__uid", "__k", "__ok", piece.alias("__piece"))
    whole = (pieces.where(~F.col("__ok")).groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("__k", "__piece"))).alias("p"))
             .select("__uid", F.lit(0).cast("long").alias("__k"), F.array_join(F.col("p.__piece"), "").alias("__piece")))
    encoded = (pieces.where("__ok").select("__uid", "__k", "__piece").unionByName(whole).repartition("__uid", "__k")
               .mapInArrow(lean(_encode_fn(raw_b, pattern, "__piece", "__ids")), "__uid long, __k long, __ids binary"))
    # one text's pieces meet again: bounded by the text, which was one cell of the input
    texts = encoded.groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("__k", "__ids"))).alias("p")).select(
        "__uid", F.aggregate(F.transform("p", lambda x: x["__ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("__ids"))
    longs = long.select("__uid", "__row").join(texts, "__uid").select("__row", "__ids")
    return short.unionByName(longs).select(*back)


def decode(encoded: DataFrame, ranks: bytes, ids_col: str = "ids", bytes_col: str = "raw") -> DataFrame:
    """Add ``bytes_col``: the concatenated raw bytes of the ids (null ids: no bytes).
    ``encoded`` must not hold two columns of that name."""
    raw_b = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        vocab = _VOCAB.get(hash(raw_b.value))
        if vocab is None:
            by = {i: t for t, i in _ranks(raw_b.value).items()}
            vocab = _VOCAB[hash(raw_b.value)] = [by.get(i, b"") for i in range(max(by) + 1)]
        for b in batches:
            out = [b"".join(map(vocab.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "__raw"])

    keep = [c for c in encoded.columns if c != bytes_col]
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(f"`{ids_col}`").alias("__ids"))
    out = rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField("__raw", T.BinaryType())]))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in keep], F.col("__raw").alias(bytes_col))


_VOCAB: dict = {}
