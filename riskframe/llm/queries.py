"""The registered queries of this subpackage and their DuckDB oracles.

Each query is a thin binding of one operator to its whole table; ``queries()``
and ``oracle_sql()`` are merged into the driver's tables by ``__spark_entry__``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import lines
    x = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), max_distance=None, every_row=True, removed_col="removed")
    return x.select("doc_id", F.size("removed").cast("bigint").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"),
                    F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import licenses
    x = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", F.array_join("licenses", "|").alias("licenses"), F.size("licenses").cast("bigint").alias("n_licenses"),
                    F.size("sentence_ids").cast("bigint").alias("n_sentences"))


#: the single-sentence rules (the texts hold no others)
_REFS = (
    ("(?:this work is )?licensed under the apache license version", "Apache-"), ("(?:released|licensed|this project is licensed) under the mit license", "MIT"),
    ("(?:this work is )?licensed under the gnu general public license version", "GPL-"), ("(?:this work is )?licensed under the gnu lesser general public license version", "LGPL-"),
    ("licensed under cc by nc", "CC-BY-NC-"), ("licensed under cc by nc nd", "CC-BY-NC-ND-"), ("licensed under cc by nc sa", "CC-BY-NC-SA-"),
    ("licensed under cc by sa", "CC-BY-SA-"), ("licensed under cc by", "CC-BY-"), ("this work is dedicated to the public domain", "CC0"), ("all rights reserved", "Proprietary"))
OP2_SQL = (
    "WITH s AS (SELECT doc_id, text, unnest(string_split_regex(text, '[.!?;:](\\s|$)|\n')) AS x, generate_subscripts(string_split_regex(text, '[.!?;:](\\s|$)|\n'), 1) AS i FROM documents), "
    "n AS (SELECT doc_id, i, trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS x FROM s), "
    "l AS (SELECT doc_id, i, CASE " + " ".join(
        f"WHEN regexp_full_match(x, '{r} [0-9]+( [0-9]+)*') THEN '{n}' || replace(regexp_extract(x, '([0-9]+( [0-9]+)*)$', 1), ' ', '.')" if n.endswith("-") else
        f"WHEN regexp_full_match(x, '{r}') THEN '{n}'" for r, n in _REFS) + " END AS l FROM n) "
    "SELECT d.doc_id, COALESCE(g.l, '') AS licenses, COALESCE(g.c, 0) AS n_licenses, COALESCE(g.c, 0) AS n_sentences FROM documents d LEFT JOIN "
    "(SELECT doc_id, string_agg(l, '|' ORDER BY i) AS l, COUNT(*) AS c FROM l WHERE l IS NOT NULL GROUP BY doc_id) g USING (doc_id)")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import html
    x = html.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return x.withColumn("n_chars", F.length("text").cast("bigint"))


OP3_SQL = r"""
WITH a AS (SELECT page_id, url, COALESCE(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS h FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(h, '</?(p|h1|br)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS lines FROM a),
c AS (SELECT page_id, url, list_transform(lines, lambda x: trim(regexp_replace(replace(replace(
        regexp_replace(x, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))) AS lines FROM b),
d AS (SELECT page_id, url, array_to_string(list_transform(list_filter(lines, lambda x: x <> ''), lambda x: regexp_replace(x, '&amp;?', '&', 'g')), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import topk
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256e0 * x::DOUBLE)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    from riskframe.llm import bpe
    ranks = bpe.read_ranks(P.path(RANKS))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = bpe.decode(bpe.encode(d, ranks, P.PATTERN), ranks)
    return x.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("raw", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import toxicity
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(d, table(spark, sf_dir, "labels"))
    return toxicity.score(d, model).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import mixing
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    t = mixing.rate_copies(d, keep=["doc_id"])
    return t.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, SUM(size)::DOUBLE AS size FROM d GROUP BY source),
w AS (SELECT *, [3e0, 1e0, 2e0][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
c AS (SELECT *, size * 2e0 AS cap, size * 2e0 / w AS level FROM w),
t AS (SELECT LEAST(SUM(size) * 1.5e0, SUM(cap)) AS budget, SUM(w) AS w_all FROM c),
l AS (SELECT level, SUM(cap) AS cap, SUM(w) AS w FROM c GROUP BY level),
k AS (SELECT level, COALESCE(SUM(cap) OVER o, 0e0) AS cap_before, COALESCE(SUM(w) OVER o, 0e0) AS w_before FROM l
      WINDOW o AS (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT COALESCE(MAX(CASE WHEN (budget - cap_before) / (w_all - w_before) > level THEN level END), -1e0) AS stopped FROM k, t),
q AS (SELECT SUM(CASE WHEN level <= stopped THEN cap ELSE 0e0 END) AS gone, SUM(CASE WHEN level > stopped THEN w ELSE 0e0 END) AS w_left FROM c, p),
r AS (SELECT source, size, CASE WHEN level <= stopped THEN cap ELSE LEAST(cap, (budget - gone) * w / NULLIF(w_left, 0e0)) END AS target FROM c, p, q, t),
x AS (SELECT doc_id, d.size, r.size AS ssize, target, COALESCE(LEAST(target / NULLIF(r.size, 0e0), 2e0), 0e0) AS rate, r.source,
      CAST('0x' || substr(md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || COALESCE(text, '')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496e0 AS u,
      CAST('0x' || substr(md5('mix-1:offset:' || COALESCE(r.source, '')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496e0 AS o
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, rate - FLOOR(rate) AS f, (ROW_NUMBER() OVER (PARTITION BY source ORDER BY size, u))::DOUBLE AS n FROM x)
SELECT doc_id, size::BIGINT AS size, ssize::BIGINT AS source_size, target,
       CAST((FLOOR(rate) + FLOOR(n * f + o) - FLOOR((n - 1e0) * f + o)) * size AS BIGINT) AS taken FROM y
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import urls
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark, urls.RULES), keep=["page_id"])


OP8_SQL = r"""
WITH u AS (SELECT page_id, translate(COALESCE(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, h, p, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
o AS (SELECT DISTINCT host, path FROM u),
f AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM o, r
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, u.host, u.path, f.rule,
       COALESCE(f.verdict, CASE WHEN regexp_matches(u.host, '(^|[.\-])(adult|porn|casino|bets|pills|spam|ads|warez)([.\-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (host, path)
"""

def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import simhash
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(d).select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import pivots
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import merkle
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(d, found={"text": F.when(tampered, lower).otherwise(F.col("text"))})


#: the tree, level by level (8 ** 7 leaves a group at most, far above the compared sizes)
_UP = "".join(
    f"t{i + 1} AS (SELECT grp, pos // 8 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d, COUNT(*) OVER (PARTITION BY grp) AS n FROM t{i} WHERE n > 1 GROUP BY grp, pos // 8 "
    f"UNION ALL SELECT grp, pos, d, n FROM t{i} WHERE n = 1), " for i in range(7))
_TOP = "".join(
    f"u{i + 1} AS (SELECT pos // 8 AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d, COUNT(*) OVER () AS n FROM u{i} WHERE n > 1 GROUP BY pos // 8 "
    f"UNION ALL SELECT pos, d, n FROM u{i} WHERE n = 1), " for i in range(3))


def _fold(prev: str, t: str, i: int, same: str) -> str:
    """One level: the siblings of a row's node join its proof, the node found becomes its parent."""
    sib = lambda op: f"(SELECT COALESCE(string_agg(s.d, '' ORDER BY s.pos), '') FROM {t}{i} s WHERE {same}s.n > 1 AND s.pos // 8 = p.spot // 8 AND s.pos {op} p.spot)"
    grew = f"(SELECT MAX(s.n) > 1 FROM {t}{i} s WHERE {same}TRUE)"
    return (f"SELECT doc_id, grp, lpos, leaf, gpos, CASE WHEN grew THEN spot // 8 ELSE spot END AS spot, proof || l || r AS proof, "
            f"CASE WHEN grew THEN sha256(l || found || r) ELSE found END AS found FROM (SELECT p.*, {sib('<')} AS l, {sib('>')} AS r, {grew} AS grew FROM {prev} p)")


_ENC = lambda c: f"COALESCE(octet_length(encode(CAST({c} AS VARCHAR)))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_ENC(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of the decimal id, bit by bit: every byte is followed by seven zeros
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda c: [ascii(c)::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT]))), "
        "lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295::BIGINT)")
OP11_SQL = (
    f"WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, {_LEAF('text')} AS leaf, "
    f"CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_LEAF(_LOW)} ELSE {_LEAF('text')} END AS found FROM documents), "
    "l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS lpos FROM d), "
    "t0 AS (SELECT grp, lpos AS pos, leaf AS d, COUNT(*) OVER (PARTITION BY grp) AS n FROM l), " + _UP +
    "g AS (SELECT grp, d, ROW_NUMBER() OVER (ORDER BY encode(grp)) - 1 AS gpos FROM t7), "
    "u0 AS (SELECT gpos AS pos, d, COUNT(*) OVER () AS n FROM g), " + _TOP +
    "p0 AS (SELECT doc_id, l.grp, lpos, leaf, gpos, lpos AS spot, '' AS proof, found FROM l JOIN g USING (grp)), "
    + "".join(f"p{i + 1} AS ({_fold(f'p{i}', 't', i, 's.grp = p.grp AND ')}), " for i in range(7))
    + "q0 AS (SELECT doc_id, grp, lpos, leaf, gpos, gpos AS spot, proof, found FROM p7), "
    + "".join(f"q{i + 1} AS ({_fold(f'q{i}', 'u', i, '')}), " for i in range(3))
    + "r AS (SELECT MAX(d) AS root FROM u3) SELECT q3.doc_id, q3.leaf, g.d AS subroot, r.root, sha256(q3.proof) AS proof_sha256, q3.found AS folded_root, q3.found = r.root AS verified "
      "FROM q3 JOIN g USING (grp), r")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import substrings
    x = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return x.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d),
x AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS t FROM s),
b AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY t) AS n FROM x) WHERE n > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM b),
k AS (SELECT r, COUNT(*) AS n_removed FROM g GROUP BY r),
v AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE r IN (SELECT r FROM k)),
o AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM v ANTI JOIN g USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_removed, 0) AS n_removed,
       sha256(CASE WHEN n_removed IS NULL THEN array_to_string(w, ' ') ELSE COALESCE(kept, '') END) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN o USING (r)
""".replace("\\\\", "\\")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.llm import phrases
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text")).withColumnRenamed("grp", "lang")


OP13_SQL = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, COUNT(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, SUM(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT lang, phrase, k, a, 1 AS cut, x[1] AS lp, array_to_string(x[2:], ' ') AS rp FROM c
      UNION ALL SELECT lang, phrase, k, a, 2, x[1] || ' ' || x[2], x[3] FROM c WHERE k = 3),
s AS (SELECT u.lang, u.phrase, u.k, a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.lp JOIN f r ON r.lang = u.lang AND r.phrase = u.rp),
b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
t AS (SELECT lang, a, unnest([x[1] || ' ' || x[2], x[2] || ' ' || x[3]]) AS phrase FROM c WHERE k = 3),
m AS (SELECT lang, phrase, MAX(a) AS longest FROM t GROUP BY ALL),
o AS (SELECT b.*, n.n FROM b JOIN n USING (lang) LEFT JOIN m USING (lang, phrase) WHERE COALESCE(100 * longest < 50 * a, TRUE)),
z AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
"""


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_licenses": op2_licenses, "op3_html": op3_html, "op4_topk": op4_topk, "op5_bpe": op5_bpe, "op6_toxicity": op6_toxicity, "op7_mixing": op7_mixing, "op8_url_filter": op8_url_filter, "op9_pivot_dedup": op9_pivot_dedup, "op10_simhash": op10_simhash,
           "op11_merkle": op11_merkle, "op12_substring_dedup": op12_substring_dedup, "op13_phrases": op13_phrases}
ORACLE = {"op2_licenses": OP2_SQL, "op3_html": OP3_SQL, "op4_topk": OP4_SQL, "op7_mixing": OP7_SQL, "op8_url_filter": OP8_SQL,
          "op11_merkle": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_phrases": OP13_SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
