"""BPE, mixing, SimHash near-dedup, line dedup and components against brute force."""

import base64
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_fixtures import CLASH, Union, docs, edit_distance, simhash_plain, texts, words
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def table(spark, rows):
    return docs(spark, rows).cache()


# --- components -----------------------------------------------------------

def test_components_match_union_find(spark):
    from riskframe.llm.components import connected_components
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(70)]                   # a long path
    edges += [(5000, 5001 + i) for i in range(200)]                     # a hub
    edges += [(7, 7), (edges[0][1], edges[0][0]), edges[1]]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame([*edges, (None, 4), (4, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: u.find(n) for n in nodes}
    assert connected_components(df.where("a > 99999")).count() == 0


# --- BPE --------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as P
    from riskframe.llm import bpe
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN


def _tik(ranks, pattern):
    import tiktoken
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 40), (32_768, 1024)])
def test_bpe_is_exact_and_round_trips(spark, rows, ranks, chunk, overlap):
    from riskframe.llm import bpe
    raw, pattern = ranks
    odd = [(900, "a" * 500 + " b", "s"), (901, " " * 300 + "x\n\n\n  y's don't", "s"), (902, "日本語のテキスト。" * 40, "s"),
           (903, "\n" * 90 + "1234567890" * 30 + "!?" * 70, "s"), (904, "don't we'll I'd " * 30, "s"), (905, "😀🇫🇷é́ <|endoftext|> " * 20, "s")]
    d = docs(spark, rows + odd)
    got = bpe.decode(bpe.encode(d, raw, pattern, chunk_chars=chunk, overlap_chars=overlap), raw, bytes_col="bytes")
    assert set(got.columns) == set(d.columns) - {"text"} | {"bytes"}       # a column named ids is replaced
    enc = _tik(raw, pattern)
    want = Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows + odd)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in got.collect()) == want


def test_bpe_empty_table(spark, ranks):
    from riskframe.llm import bpe
    assert bpe.decode(bpe.encode(docs(spark, []), *ranks), ranks[0]).count() == 0


# --- mixing ---------------------------------------------------------------

def _targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water filling by repeated sharing."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())


def test_mixing_targets_and_copies(spark, rows, table):
    from riskframe.llm import mixing
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = _targets(sizes)
    got = mixing.rate_copies(table, keep=["doc_id", "size"]).collect()
    assert len(got) == len(rows)
    for r in got:
        s = r["__source"]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert int(rate) <= r["__copies"] <= min(2, int(rate) + 1)
    again = mixing.rate_copies(table.repartition(7), keep=["doc_id", "size"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert mixed.count() == sum(r["__copies"] for r in got)
    assert mixing.rate_copies(docs(spark, [])).count() == 0
    assert mixing.rate_copies(docs(spark, [(1, None, "a"), (2, "", None)]), keep=["doc_id"]).agg(F.sum("__copies")).first()[0] == 0


def test_mixing_taken_words_come_near_the_target(spark):
    from riskframe.llm import mixing
    rng = random.Random(1)
    d = docs(spark, [(i, words(rng, rng.randrange(5, 30)), f"s{i % 5}") for i in range(4000)])
    for r in mixing.rate_copies(d).groupBy("__source", "target").agg(F.sum(F.col("__copies") * F.col("__size")).alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.08 * r.target


def test_mixing_misses_a_target_by_less_than_one_document(spark):
    from riskframe.llm import mixing
    rng = random.Random(2)
    rows = [(i, words(rng, rng.choice((0, 3, 10, 40, 400))), rng.choice(("a", "a", "a", "b", "c", None))) for i in range(300)]
    rows += [(7, "the same row again and again", "b")] * 90 + [(None, "no id", "c")] * 5 + [(8, None, "a")] * 20
    d = docs(spark, rows).select("doc_id", "text", "source", F.lit(1).alias("__at"), F.lit(2).alias("__p"), F.lit(3).alias("cum___one"))
    per = mixing.rate_copies(d, keep=["__p", "__at"])
    assert per.columns[:2] == ["__p", "__at"] and per.count() == len(rows)
    for r in per.groupBy("__source").agg(F.first("target").alias("target"), F.sum(F.col("__copies") * F.col("__size")).alias("taken"),
                                         F.max("__size").alias("largest")).collect():
        assert abs(r.taken - r.target) < r.largest
    assert mixing.mix(d).columns == d.columns
    # whatever the offset, the number of extra copies is the same to within one
    times = [mixing.rate_copies(d.where("source = 'a'"), seed=f"s{k}", share=1.4).agg(F.sum("__copies")).first()[0] for k in range(3)]
    assert max(times) - min(times) <= 1


# --- SimHash near-dedup ---------------------------------------------------

def _fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    return simhash_plain([" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else [])


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_covering_meets_every_close_pair(distance):
    from riskframe.llm import simhash
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2 ** 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, size=rng.integers(0, distance + 1), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    met = np.zeros(len(x), bool)
    for first, bits in simhash.segments(distance):
        _, home, _, _ = simhash.anchors(x, first, bits)
        _, _, row, at = simhash.anchors(y, first, bits)
        own = defaultdict(set)
        for r, a in zip(row.tolist(), at.tolist()):
            own[r].add(a)
        met |= np.array([int(home[i]) in own[i] for i in range(len(x))])
    assert met.all()


@pytest.mark.parametrize("anchor_rows", [4096, 3])
def test_simhash_near_duplicates(spark, rows, table, monkeypatch, anchor_rows):
    from riskframe.llm import simhash
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", anchor_rows)         # 3: every busy anchor is cut into chunks
    got = simhash.near_duplicates(table).collect()
    fps = [_fingerprint(t) for _, t, _ in rows]
    u = Union()
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                u.join(i, j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[u.find(i)].append(r[0])
    want = Counter((r[0], fps[i], min(x for x in least[u.find(i)] if x is not None)) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r["__fp"] % 2 ** 64, r.component_id) for r in got) == want
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert kept.count() == len({u.find(i) for i in range(len(rows))})
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_simhash_empty_table(spark):
    from riskframe.llm import simhash
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


# --- line dedup -----------------------------------------------------------

def _line_groups(rows):
    import regex
    occ = []
    for i, t, _ in {(r[0], r[1], None) for r in rows}:                  # equal id and text: one document
        for place, line in enumerate((t or "").split("\n")):
            w = tuple(x for x in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if x)
            if w:
                occ.append((i, t, place, w))
    lines = sorted({o[3] for o in occ})
    fps = [simhash_plain(w) for w in lines]
    u = Union()
    for i in range(len(lines)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = " ".join(lines[i]), " ".join(lines[j])
                if edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                    u.join(i, j)
    index = {w: i for i, w in enumerate(lines)}
    return occ, {o: u.find(index[o[3]]) for o in occ}


def test_line_dedup_keeps_one_occurrence_of_each_group(spark):
    from riskframe.llm import lines
    rng = random.Random(11)
    long = words(rng, 120)
    near = [long.replace(long.split()[k], f"x{k}", 1) for k in range(0, 100, 5)]            # a hub with many near lines
    bag = [" ".join(rng.sample(["aa", "bb", "cc", "dd", "ee", "ff"], 6)) for _ in range(12)]     # equal fingerprints, far apart in edits
    rows = texts(3, 15) + [(500 + i, f"unique {words(rng, 9)}\n{t}\nFooter line, the same!", "s") for i, t in enumerate([*near, *bag])]
    rows += [(900, "FOOTER line the  same\n\n--\nFooter line, the same!", "s"), (901, words(rng, 400) + "\n" + words(rng, 3), "s")]
    d = docs(spark, rows)
    got = lines.dedup_lines(d, removed_col="gone").collect()
    occ, group = _line_groups(rows)
    removed = {(r.doc_id, p) for r in got for p in r.gone}
    kept = Counter(group[o] for o in occ if (o[0], o[2]) not in removed)
    assert set(kept.values()) == {1} and set(kept) == set(group.values())
    assert len(got) == len({(r[0], r[1]) for r in rows})
    by = {(r.doc_id, "\n".join(r.text.split("\n")) if r.text is not None else None): r for r in got}
    text = {}
    for i, t, _ in rows:
        text.setdefault(i, t)
    for r in got:
        if r.text is not None and r.doc_id is not None:
            assert r.text == "\n".join(x for k, x in enumerate(text[r.doc_id].split("\n")) if k not in set(r.gone))
    assert by and all(c in got[0].asDict() for c in CLASH)
    first = {g: min((o[0] if o[0] is not None else -1, o[2]) for o in occ if group[o] == g) for g in set(group.values())}
    for o in occ:
        if o[0] is not None and (o[0], o[2]) not in removed:
            assert first[group[o]] == (o[0], o[2]) or first[group[o]][0] == -1
    dropped = lines.dedup_lines(d, drop_emptied=True)
    assert dropped.columns == d.columns and dropped.count() < len(got)
    assert {r.doc_id for r in dropped.where("text IS NULL OR text = ''").collect()} == {r[0] for r in rows if not r[1]}


def test_line_simhash_of_long_lines(spark):
    from riskframe.llm import lines
    rng = random.Random(2)
    t = [words(rng, n, 50) for n in (1, 2, 126, 127, 128, 254, 255, 1000, 40_000)]
    got = {r.id: r.fp % 2 ** 64 for r in lines.occurrences(docs(spark, [(i, x, "s") for i, x in enumerate(t)]), "doc_id", "text").collect()}
    assert got == {i: simhash_plain(x.split()) for i, x in enumerate(t)}


def test_line_dedup_empty_table(spark):
    from riskframe.llm import lines
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    assert lines.dedup_lines(docs(spark, [(1, None, None), (2, "", None)])).count() == 2


def test_line_dedup_is_native(spark, table):
    from riskframe.llm import lines
    p = lines.occurrences(table, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p and p.count("split(lower") == 1




@pytest.mark.parametrize("edit", ["word", "letters"])
def test_line_links_need_edit_similarity_alone(spark, edit):
    """Of pairs of lines of edit similarity 0.8 and more at least nine in ten are linked, at every length."""
    from riskframe.llm import lines
    rng = random.Random(5)
    letter = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choice(letter) for _ in range(n))
    rows, sizes = [], [(2, 4), (5, 9), (10, 19), (20, 39), (40, 79), (80, 159)]
    for k, (lo, hi) in enumerate(sizes):
        for i in range(40):
            a = [word(rng.randrange(4, 9)) for _ in range(rng.randrange(lo, hi + 1))]
            b = list(a)
            if edit == "word":
                j = min(range(len(b)), key=lambda x: len(b[x]))
                b[j] = word(len(b[j]))
            else:
                for j in rng.sample(range(len(b)), max(1, len(b) // 10)):
                    p = rng.randrange(len(b[j]) + 1)
                    b[j] = b[j][:p] + rng.choice(letter) + b[j][p:]
            a, b = " ".join(a), " ".join(b)
            if edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                rows += [(k * 1000 + 2 * i, a, "s"), (k * 1000 + 2 * i + 1, b, "s")]
    got = {r.doc_id for r in lines.dedup_lines(docs(spark, rows), max_distance=None, removed_col="gone").collect() if r.gone}
    assert all(i % 2 for i in got)                                      # the first of a pair stays
    for k in range(len(sizes)):
        pairs = [i for i, _, _ in rows if i // 1000 == k and i % 2]
        if pairs:
            assert sum(i in got for i in pairs) >= 0.9 * len(pairs), sizes[k]
    # a hub whose bucket holds unrelated lines, and text without blanks
    shared = "the same long passage of words stands in each of these lines and goes on and on"
    many = [(i, f"{shared} {words(rng, 20, 10 ** 6)}", "s") for i in range(30)]
    many += [(100, many[20][1] + " more", "s"), (200, "日本語の文書がここにあります。" * 8, "s"), (201, "日本語の文書がここにあります。" * 7 + "日本語の文章がここにあります。", "s")]
    gone = {r.doc_id for r in lines.dedup_lines(docs(spark, many), max_distance=None, removed_col="gone").collect() if r.gone}
    assert {100, 201} <= gone


def test_line_keys_are_native(spark, table):
    from riskframe.llm import lines
    p = lines.keyed(table, "doc_id", "text", 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in p and "Arrow" not in p


def test_line_keys_hold_their_places(spark):
    """Every key with a place is the hash of the text that stands there; a gram that a line holds twice has none."""
    from riskframe.llm import lines
    rng = random.Random(8)
    rows = [(i, words(rng, n, 10 ** 6), "s") for i, n in enumerate((4, 6, 9, 14, 30, 80, 300))]
    rows += [(50, "日本語の文書がここにあります" + "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(60)), "s"), (60, "the very same passage comes again " * 6, "s")]
    k = lines.keyed(docs(spark, rows), "doc_id", "text", 0.8).selectExpr("id", "len", "inline(keys)")
    t = docs(spark, rows).selectExpr("doc_id AS id", "trim(text) AS t")
    at = "exists(array(6, 10, 16), c -> shiftright(xxhash64(c, substring(t, at + 1, c)), 20) = key)"
    got = k.join(t, "id").selectExpr("id", "at IS NULL AS anywhere", f"at IS NULL OR {at} AS good").collect()
    assert all(r.good for r in got) and {r.id for r in got if not r.anywhere} >= {r[0] for r in rows if 20 <= len(r[1]) and r[0] != 60}
    assert any(r.anywhere for r in got if r.id == 60)


def test_passages_at_unrelated_places_are_no_candidates(spark):
    from riskframe.llm import lines
    rng = random.Random(3)
    shared = words(rng, 25, 10 ** 6)
    for n in (3, 20):                           # rare keys, busy keys
        rows = [(i, f"{shared} {words(rng, 35, 10 ** 6)}" if i < n else f"{words(rng, 35, 10 ** 6)} {shared}", "s") for i in range(2 * n)]
        x = lines.keyed(docs(spark, rows), "doc_id", "text", 0.8).withColumn("lid", F.col("id"))
        pairs, buckets = lines._by_keys(x, 0.8)
        assert all((r.a < n) == (r.b < n) for r in pairs.collect())
        if n == 3:
            assert pairs.count()
        else:
            assert {(r.lid < n) == (r.hub < n) for r in buckets.collect()} == {True, False}
            assert not buckets.where(f"(lid < {n}) <> (hub < {n}) AND " + " AND ".join(
                lines._fits(a, f"hub_{a}", "len", "hub_len", 0.8) for a in ("at", "at2"))).count()


def test_workers_give_memory_back(monkeypatch):
    from riskframe.llm import common
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.lean(lambda batches: (2 * x for x in batches))(iter([1, 2]))) == [2, 4] and given == [1]
    monkeypatch.undo()
    common.give_back()


def test_line_dedup_returns_every_row(spark):
    from riskframe.llm import lines
    rows = [(None, None, "a"), (None, None, "b"), (None, "", "a"), (None, "", "b"), (1, "--", "a"), (1, "--", "b"), (2, "some words\n--\nanother line entirely", "a"),
            (2, "some words\n--\nanother line entirely", "b"), (2, "some words\n--\nmore words", "b"), (3, "alone", "a")]
    got = lines.dedup_lines(docs(spark, rows), max_distance=None, every_row=True, removed_col="gone").collect()
    assert Counter((r.doc_id, r.text, tuple(r.gone)) for r in got) == Counter(
        [(None, None, ())] * 2 + [(None, "", ())] * 2 + [(1, "--", ())] * 2 + [(2, rows[6][1], ())] + [(2, "--", (0, 2))] * 2 + [(3, "alone", ())])
    kept = lines.dedup_lines(docs(spark, rows), max_distance=None, every_row=True, drop_emptied=True)
    assert kept.count() == len(rows) - 2 and len({r.key for r in kept.collect()}) == len(rows) - 2


def test_edit_check_equals_the_plain_distance():
    from llm_fixtures import edit_distance
    from riskframe.llm.lines import within
    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abcde é") for _ in range(rng.randrange(90)))
        b = list(a)
        for _ in range(rng.randrange(16)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randrange(2)] = rng.choice(["", "x", "yz", "é"])
        b, room = "".join(b), rng.randrange(16)
        assert within(a, b, room) == (edit_distance(a, b) <= room)
    assert within("", "", 0) and not within("", "ab", 1) and within("abc" * 2000, "abc" * 2000 + "d", 1)


def test_batched_edit_check_equals_brute_force():
    from riskframe.llm import edits
    rng = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def pair(length, letters):
        a = "".join(rng.choice(letters) for _ in range(length))
        if rng.random() < 0.3:
            return a, "".join(rng.choice(letters) for _ in range(max(0, length + rng.randrange(-5, 6))))
        b = list(a)
        for _ in range(rng.randrange(int(length * 0.3) + 2)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        return a, "".join(b)

    pairs = [pair(rng.randrange(max(1, n - 40), n + 10), "abcd" if i % 2 else "abcdefghi é😀") for n in (12, 70, 140) for i in range(250)]
    pairs += [("", ""), ("", "a"), ("x" * 30, "x" * 30), ("x" * 200, "y" * 200)]
    room = [int(max(map(len, p)) * rng.choice((0.05, 0.2, 0.3))) for p in pairs]
    want = [distance(*p) <= r for p, r in zip(pairs, room)]
    assert [edits.within(*p, r) for p, r in zip(pairs, room)] == want
    assert edits.near([p[0] for p in pairs], [p[1] for p in pairs], room).tolist() == want and edits.near([], [], []).tolist() == []
    # longer lines: unrelated ones leave their group early
    pairs = [pair(rng.randrange(560, 640), "abcdefgh ") for _ in range(300)]
    room = [int(max(map(len, p)) * 0.2) for p in pairs]
    assert edits.near([p[0] for p in pairs], [p[1] for p in pairs], room).tolist() == [edits.within(*p, r) for p, r in zip(pairs, room)]


def test_edit_check_when_wide_pairs_leave_early():
    """Unrelated pairs with wide rooms leave a group; the others' narrower band must not miss columns."""
    from riskframe.llm import edits
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    pairs, room = [], []
    for k in range(160):
        if k % 4:
            n = rng.randrange(500, 512)
            pairs.append((f"x{text(n)}x", f"y{text(n)}y"))
            room.append(135)
        else:                                   # the path runs 50 rows below the diagonal
            x = text(450)
            pairs.append((f"x{text(50)}{x}x", f"y{x}{text(50)}y"))
            room.append(104 + rng.randrange(10))
    want = [edits.within(*p, r) for p, r in zip(pairs, room)]
    assert sum(want) == 40 and edits.near([p[0] for p in pairs], [p[1] for p in pairs], room).tolist() == want


def test_letters_never_ask_for_more_edits_than_needed():
    from riskframe.llm import edits
    rng = random.Random(2)
    a = ["".join(rng.choice("abcé日 ") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    b = [x[rng.randrange(len(x)):] + rng.choice(["", "z", "日本"]) for x in a]
    least = edits.letters_differ(a, b).tolist()
    assert all(n <= edit_distance(x, y) for n, x, y in zip(least, a, b)) and max(least) > 5
    assert edits.letters_differ(["aab"], ["bcc"]).tolist() == [2]


def test_lines_of_one_group_are_not_compared_again(spark, monkeypatch):
    """Near copies that are far from their bucket's hub meet one of them, not each other."""
    from riskframe.llm import lines
    rng = random.Random(4)
    shared = words(rng, 12, 10 ** 6)
    long, short = f"{shared} {words(rng, 40, 10 ** 6)}", f"{shared} {words(rng, 12, 10 ** 6)}"
    n = 60
    rows = [(i, f"{long if i < n else short} q{i:03}", "s") for i in range(2 * n)]
    sent = []
    similar = lines._similar
    monkeypatch.setattr(lines, "_similar", lambda e, *a: sent.append(e.count()) or similar(e, *a))
    got = {r.doc_id for r in lines.dedup_lines(docs(spark, rows), max_distance=None, removed_col="gone").collect() if r.gone}
    assert got == set(range(2 * n)) - {0, n}
    assert sum(sent) < 10 * n                   # every pair of the short ones: 1,770
