"""Small tables with every awkward case and plain Python twins of the operators."""

import random

import numpy as np
from pyspark.sql import types as T

#: names that operators could use themselves
CLASH = ["ids", "raw", "size", "line", "key", "__x", "host", "a b"]


def docs(spark, rows, clash=True):
    """(doc_id, text, source) rows with extra columns of clashing names."""
    names = CLASH if clash else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                           *[T.StructField(c, T.StringType()) for c in names]])
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in names]) for i, r in enumerate(rows)], schema)


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def texts(seed=7, n=40):
    """Unique texts, exact copies, near copies, a long text, empties and nulls."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(30, 90)) + "\n" + words(rng, 40) for _ in range(n)]
    out = [(i, t, f"src{i % 4}" if i % 9 else None) for i, t in enumerate(base)]
    k = len(out)
    for i in range(12):                         # near copies: one word changed
        w = base[i % 3].split(" ")
        w[rng.randrange(5, len(w))] = f"changed{i}"
        out.append((k + i, " ".join(w), "src0"))
    k = len(out)
    out += [(k + i, base[5], "src0") for i in range(6)]
    k = len(out)
    out += [(k, None, "src1"), (k + 1, "", "src1"), (k + 2, "  \n\t ", None), (k + 3, words(rng, 30_000), "src2"), (k + 4, "!!! ???\n...", "src2"),
            (k + 5, "short", "é"), (None, base[7], "src3"), (3, base[3], "src3"), (3, base[3], "src3"), (k + 6, "İstanbul ÀÉ ß x\x0by", "src1")]
    return out


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def simhash_plain(words_, seed=42):
    """SimHash of a list of features, bit by bit."""
    import xxhash
    h = [xxhash.xxh64_intdigest(w.encode(), seed) for w in words_]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def edit_distance(a, b):
    prev = np.arange(len(b) + 1)
    other = np.frombuffer(b.encode("utf-32-le"), "<u4")
    for n, ch in enumerate(a, 1):
        cur = np.concatenate(([n], np.minimum(prev[1:] + 1, prev[:-1] + (other != ord(ch)))))
        prev = np.minimum.accumulate(cur - np.arange(len(cur))) + np.arange(len(cur))
    return int(prev[-1])
