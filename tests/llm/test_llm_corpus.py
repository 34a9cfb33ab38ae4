"""Merkle manifest, substring dedup and phrase mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import docs, texts, words
from pyspark.sql import functions as F
from pyspark.sql import types as T


def H(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


# --- Merkle ---------------------------------------------------------------

def _enc(v):
    if v is None:
        return b"-"
    b = str(v).encode()
    return str(len(b)).encode() + b":" + b


def _manifest(rows, found):
    """Plain tree: rows are (doc_id, lang, text); one tuple per row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, H(b"".join(_enc(x) for x in r)), H(b"".join(_enc(x) for x in found(r))), r[0]))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def way(t, i):
        for level in t[:-1]:
            a = i - i % 8
            yield "".join(level[a:i]), "".join(level[i + 1:a + 8])
            i //= 8

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names]) if names else None
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, met, id_) in enumerate(sorted(groups[g])):
            path = [*way(trees[g], i), *way(top, k)]
            node = met
            for a, b in path:
                node = H(a + node + b)
            out.append((id_, leaf, trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return Counter(out)


def _merkle(spark, rows):
    from riskframe.llm import merkle
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()),
                           *[T.StructField(c, T.StringType()) for c in ("key", "pos", "digest", "n", "block", "a b")]])
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], schema)
    low = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    x = merkle.manifest(df, fields=["doc_id", "lang", "text"], found={"text": low})
    assert x.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in x.collect())


def _found(r):
    change = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[2] is not None
    return (r[0], r[1], r[2].lower() if change else r[2])


@pytest.mark.parametrize("sizes", [[], [1], [1, 1], [8, 9], [1, 64, 65, 513], [4097, 3, 4096]])
def test_merkle_matches_a_plain_tree(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(i * 7 % 5003, f"l{g}", rng.choice(["Text A", "all lower", "É Ä x", ""]) + str(i)) for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert _merkle(spark, rows) == _manifest(rows, _found)


def test_merkle_nulls_ties_repeats_and_long_text(spark):
    rows = [(None, None, None), (None, None, "X"), (3, None, "A"), (3, None, "A"), (3, None, "B"), (3, "en", None), (5, "", "Q"), (6, "é", "W" * 300_000),
            (-4, "en", ""), (2 ** 62 + 1, "en", "Big")] + [(9, "en", "Same")] * 40 + [(i, f"lang{i:03d}", "T") for i in range(100)]
    assert _merkle(spark, rows) == _manifest(rows, _found)


def test_merkle_finds_every_change(spark):
    from riskframe.llm import merkle
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"), F.concat(F.lit("Row "), "id").alias("text"))
    hit = F.col("doc_id") == 137
    x = merkle.manifest(df, fields=["doc_id", "text"], found={"text": F.when(hit, F.lit("other")).otherwise(F.col("text"))})
    assert [r.doc_id for r in x.where("not verified").collect()] == [137]
    assert merkle.manifest(df, fields=["doc_id", "text"]).where("not verified").count() == 0


# --- substrings -----------------------------------------------------------

def _repeated(rows, window):
    """doc number -> covered word places, by a dictionary of all windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    n = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def _substring_rows(seed=5):
    rng = random.Random(seed)
    rows = [r[1] for r in texts(seed)]
    passage = words(rng, 60)
    rows += [f"{words(rng, rng.randrange(40))} {passage}\n{words(rng, rng.randrange(40))}" for _ in range(25)]       # a shared passage
    rows += [f"{words(rng, 10)} {' '.join(passage.split()[5:39])} {words(rng, 9)}" for _ in range(4)]                 # 34 words of it: too few
    rows += [f"{words(rng, 10)} {' '.join(passage.split()[5:40])} {words(rng, 9)}" for _ in range(2)]                 # 35 words
    rows += ["a " * 200, "a b " * 120, "x " * 34, "x " * 35, "x " * 36, words(rng, 35)]                               # periods, borders
    line = words(rng, 20)
    rows += [(line + "\n") * 30 + words(rng, 50)]                                                                      # repeats inside one text
    edit = words(rng, 300).split()
    rows += [" ".join(edit[:i] + ["Edit"] + edit[i + 1:]) for i in range(0, 300, 23)]                                  # near copies
    return rows


@pytest.mark.parametrize("limit,block,group,ordered", [(20_000, 8 << 20, 24 << 20, 200_000), (3, 4_000, 30_000, 50), (0, 20_000, 10_000, 7)])
def test_substrings_match_a_dictionary_of_windows(spark, monkeypatch, limit, block, group, ordered):
    from riskframe.llm import substrings
    for k, v in (("LIMIT", limit), ("BLOCK_BYTES", block), ("GROUP_BYTES", group), ("SORTED", ordered)):
        monkeypatch.setattr(substrings, k, v)
    rows = _substring_rows()
    df = docs(spark, [(i if i % 7 else None, t, "s") for i, t in enumerate(rows)]).withColumn("place", F.monotonically_increasing_id())
    df = df.repartition(3, "place")
    got = {r.place: r for r in substrings.remove_repeats(df, keep=["place", "key", "a b", "doc_id"]).collect()}
    order = [r.text for r in df.orderBy("place").select("text").collect()]
    want = _repeated(order, 35)
    assert len(got) == len(rows) == len(order)
    for (place, r), text, w in zip(sorted(got.items()), order, want):
        assert (r.n_words, r.n_removed, r.kept) == (w[0], w[1], None if text is None else w[2])


def test_substrings_other_windows_and_empty_tables(spark):
    from riskframe.llm import substrings
    rows = _substring_rows(9)
    df = docs(spark, [(i, t, "s") for i, t in enumerate(rows)])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(df, window=50).collect()}
    assert got == {i: w[:2] for i, w in enumerate(_repeated(rows, 50))}
    assert substrings.remove_repeats(df.where("doc_id < 0")).count() == 0
    assert substrings.remove_repeats(df.where("text is null")).where("n_words = 0 and kept is null").count() == 1
    with pytest.raises(ValueError):
        substrings.remove_repeats(df, window=12)


def test_subtree_leaves_are_the_repeated_windows():
    from riskframe.llm.substrings import deep_leaves
    rng = np.random.default_rng(1)
    for window in (1, 2, 5):
        w = rng.integers(0, 3, 400).astype(np.int32)
        starts = np.arange(len(w) - window + 1)
        n = Counter(tuple(w[i:i + window]) for i in starts)
        assert deep_leaves(w, starts, window).tolist() == [n[tuple(w[i:i + window])] > 1 for i in starts]


# --- phrases --------------------------------------------------------------

def _phrases(rows, threshold=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = defaultdict(list)
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= threshold}
    longest = Counter()
    for (lang, p), a in cand.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longest[lang, q] = max(longest[lang, q], a)
    for (lang, p), a in cand.items():
        if 100 * longest[lang, p] >= covered * a:
            continue
        score, cut = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return {lang: [(r, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for r, x in enumerate(sorted(v)[:top], 1)] for lang, v in out.items()}


def _phrase_rows(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß", "don't", "Straße", "x\x1cy", " z"]
    rows = []
    for i in range(160):
        t = [rng.choice(vocab[: 5 + rng.randrange(len(vocab) - 5)]) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(3)):
            t.insert(rng.randrange(len(t) + 1), "New York City" if i % 3 else "nEw yORK")
        sep = [rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! ", ":"]) for _ in t]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(a + b for a, b in zip(t, sep))))
    rows += [("en", None), (None, ""), ("fr", "one"), ("en", ".,;"), ("es", "a b c " * 9_000), ("de", "same text twice here"), *[("de", "same text twice here")] * 30]
    return rows


@pytest.mark.parametrize("words_,counters,partitions", [(1 << 20, 4_000_000, 32_000_000), (50, 300, 3_000)])
def test_phrases_match_a_dictionary(spark, monkeypatch, words_, counters, partitions):
    from riskframe.llm import phrases
    for k, v in (("BLOCK_WORDS", words_), ("BLOCK_BYTES", 8 * words_), ("TASK_COUNTERS", counters), ("PARTITION_MASS", partitions)):
        monkeypatch.setattr(phrases, k, v)
    rows = _phrase_rows()
    schema = "lang string, text string, grp string, k string, phrase string, f string, part string, n string"
    df = spark.createDataFrame([(*r, *"abcdef") for r in rows], schema).repartition(3)
    for top in (2000, 7):
        got = defaultdict(list)
        for r in phrases.collocations(df, top=top).orderBy("grp", "rank").collect():
            got[r.grp].append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert dict(got) == _phrases(rows, top=top)
    assert phrases.collocations(df.where("lang = 'none'")).count() == 0


def test_misra_gries_keeps_every_frequent_item():
    from riskframe.llm.phrases import Summary
    rng = np.random.default_rng(7)
    for threshold, capacity in ((10, None), (10, 40), (4, 10)):
        stream = np.concatenate([rng.integers(0, 1 << 40, 4_000), np.repeat(rng.integers(0, 1 << 40, 50), rng.integers(2, 30, 50))]).astype(np.uint64)
        rng.shuffle(stream)
        s = Summary(capacity or len(stream) // threshold + 1, threshold)
        for part in np.array_split(stream, 37):
            s.merge(*np.unique(part, return_counts=True))
        k, n = np.unique(stream, return_counts=True)
        assert set(k[n >= threshold].tolist()) <= set(s.frequent().tolist())
        assert s.taken < threshold and (capacity or len(s.keys) <= s.capacity)


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_000_007, 3_100_000_000_003, 3_200_000_000_001
    d = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    x = d.selectExpr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    assert x.first()[0] == 1_000_000 * a * a // (l * r)
