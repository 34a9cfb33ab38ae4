"""Joins (D), set operations and sampling (G) bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.exprs import pseudonym
from riskframe.operators import loan
from riskframe.operators import relate as R
from riskframe.operators import sample as SM
from riskframe.plans.bind import role, with_roles
from riskframe.plans.q_features import LKEY, SCORED_SQL, scored
from riskframe.plans.q_features import PSEUDO_SALT
from riskframe.plans.registry import query
from riskframe.plans.sqlgen import rnd_sql, round_double_cols

ORACLE: dict[str, str] = {}


def reg(k, s):
    ORACLE[k] = s


def T(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def H(key, seed=42):
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '_{seed}'), 1, 8) AS BIGINT)"


LI_SEL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"


# D4
@query("cascade_subset")
def q_cascade(spark, d):
    cust = T(spark, d, "customer").where(F.col("c_mktsegment") == "AUTOMOBILE")
    _, orders, li = R.cascade_subset(cust, "c_custkey", [(T(spark, d, "orders"), "o_custkey", "o_orderkey"),
                                                          (T(spark, d, "lineitem"), "l_orderkey", "l_orderkey")])
    return li.select(*LKEY, "l_quantity")


reg("cascade_subset", (
    f"SELECT {LI_SEL}, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN "
    "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'))"))


# D5
@query("known_unknown")
def q_known_unknown(spark, d):
    prev = role(spark, d, "previous_application")
    early = T(spark, d, "orders").where(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("SK_ID_CURR"))
    pre = loan.rollup_previous(prev.join(early, "SK_ID_CURR", "left_semi"), ["Approved", "Canceled", "Refused"]) \
        .select("SK_ID_CURR", "PREV_AMT_CREDIT_SUM", "PREV_SK_ID_PREV_COUNT")
    batch = role(spark, d, "application").select("SK_ID_CURR")

    def compute(unknown):
        p = prev.join(unknown, "SK_ID_CURR", "left_semi")
        return loan.rollup_previous(p, ["Approved", "Canceled", "Refused"]).select(
            "SK_ID_CURR", "PREV_AMT_CREDIT_SUM", "PREV_SK_ID_PREV_COUNT")
    return round_double_cols(R.known_unknown(batch, "SK_ID_CURR", pre, compute))


reg("known_unknown", with_roles("previous_application", "application") + (
    ", early AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995), "
    f"f AS (SELECT SK_ID_CURR AS k, {rnd_sql('COALESCE(SUM(AMT_CREDIT), 0)')} AS PREV_AMT_CREDIT_SUM, COUNT(SK_ID_PREV) AS PREV_SK_ID_PREV_COUNT "
    "FROM previous_application GROUP BY SK_ID_CURR) "
    "SELECT SK_ID_CURR, PREV_AMT_CREDIT_SUM, PREV_SK_ID_PREV_COUNT, "
    "CASE WHEN SK_ID_CURR IN (SELECT k FROM early) THEN 'precomputed' ELSE 'computed' END AS source "
    "FROM application LEFT JOIN f ON SK_ID_CURR = f.k"))


# D6
@query("pred_compare")
def q_pred_compare(spark, d):
    s = scored(spark, d)
    a = s.select(*LKEY, F.col("PROBABILITY").alias("proba_a"))
    b = s.select(*[F.col(k).alias(f"{k}_b") for k in LKEY], F.col("PROBABILITY2").alias("proba_b"))
    cond = [a[k] == b[f"{k}_b"] for k in LKEY]
    j = a.join(b, cond, "inner").select(*LKEY, "proba_a", "proba_b", F.abs(F.col("proba_a") - F.col("proba_b")).alias("abs_diff"))
    return round_double_cols(j)


_K4 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
reg("pred_compare", (
    "SELECT a.l_orderkey, CAST(a.l_linenumber AS BIGINT) AS l_linenumber, a.l_partkey, a.l_suppkey, "
    f"{rnd_sql('a.l_quantity / 50e0')} AS proba_a, {rnd_sql('b.l_extendedprice / 105000e0')} AS proba_b, "
    f"{rnd_sql('abs(a.l_quantity / 50e0 - b.l_extendedprice / 105000e0)')} AS abs_diff "
    "FROM lineitem a JOIN lineitem b ON " + " AND ".join(f"a.{k} = b.{k}" for k in _K4)))


def _cust(spark, d):
    return T(spark, d, "customer")


GROUP = ["c_nationkey", "c_mktsegment"]


# E12
@query("fit_group_means")
def q_fit_group_means(spark, d):
    train = _cust(spark, d).where(F.col("c_acctbal") > 5000)
    return round_double_cols(R.fit_group_means(train, GROUP, "c_acctbal"))


reg("fit_group_means", f"SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, {rnd_sql('AVG(c_acctbal)')} AS group_mean, COUNT(*) AS group_n "
    "FROM customer WHERE c_acctbal > 5000 GROUP BY ALL")


# D7
@query("map_lookup")
def q_map_lookup(spark, d):
    c = _cust(spark, d)
    train = c.where(F.col("c_acctbal") > 5000)
    state = R.fit_group_means(train, GROUP, "c_acctbal")
    overall = train.agg(F.avg("c_acctbal")).first()[0]   # one scalar of fitted state
    return round_double_cols(R.map_lookup(c.select("c_custkey", *GROUP), state, GROUP, overall, "acctbal_group_mean"))


reg("map_lookup", (
    "WITH st AS (SELECT c_nationkey, c_mktsegment, AVG(c_acctbal) AS m FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) "
    f"SELECT c.c_custkey, CAST(c.c_nationkey AS BIGINT) AS c_nationkey, c.c_mktsegment, {rnd_sql('COALESCE(st.m, (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 5000))')} "
    "AS acctbal_group_mean FROM customer c LEFT JOIN st ON c.c_nationkey = st.c_nationkey AND c.c_mktsegment = st.c_mktsegment"))


# E11
@query("vs_group_mean")
def q_vs_group_mean(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return round_double_cols(R.vs_group_mean(o, ["o_orderpriority"], "o_totalprice"))


reg("vs_group_mean", (
    "SELECT o_orderpriority, o_orderkey, " + rnd_sql("o_totalprice") + " AS o_totalprice, "
    + rnd_sql("o_totalprice / (AVG(o_totalprice) OVER (PARTITION BY o_orderpriority) + 1e-5)") + " AS o_totalprice_vs_group_mean, "
    + rnd_sql("AVG(o_totalprice) OVER (PARTITION BY o_orderpriority)") + " AS o_totalprice_group_mean FROM orders"))


# D8
@query("id_remap")
def q_id_remap(spark, d):
    c = _cust(spark, d)
    mapping = c.select(F.col("c_custkey").alias("old_id"), pseudonym("c_custkey", PSEUDO_SALT).alias("new_id"))
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey")
    return R.id_remap(o, "o_custkey", mapping)


reg("id_remap", (
    f"SELECT o_orderkey, COALESCE((CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR) || '{PSEUDO_SALT}'), 1, 8) AS BIGINT) "
    "% 900000) + 100000, o_custkey) AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey"))


# D9
@query("truth_join")
def q_truth_join(spark, d):
    from riskframe.operators import metrics as M
    docs = T(spark, d, "documents").select("doc_id", F.least(F.col("n_chars") / F.lit(20000.0), F.lit(1.0)).alias("score"))
    lab = T(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    j = docs.join(lab, "doc_id", "inner")
    n = j.agg(F.count(F.lit(1)).alias("n_matched"))
    auc = M.roc_auc(j, "label", "score")
    acc = M.class_metrics(j, "label", "score", 0.05).select("accuracy", "precision", "recall")
    return round_double_cols(n.crossJoin(auc).crossJoin(acc).withColumn("enough_rows", F.col("n_matched") >= 100))


reg("truth_join", (
    "WITH j AS (SELECT LEAST(n_chars / 20000e0, 1e0) AS score, quality AS TARGET FROM documents JOIN labels USING (doc_id)), "
    "st AS (SELECT score, CAST(COUNT_IF(TARGET = 1) AS DOUBLE) AS pos, CAST(COUNT_IF(TARGET <> 1) AS DOUBLE) AS neg FROM j GROUP BY score), "
    "c AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp, "
    "SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM st), "
    "cm AS (SELECT COUNT_IF(TARGET = 1 AND score >= 0.05e0) AS tp, COUNT_IF(TARGET = 0 AND score >= 0.05e0) AS fp, "
    "COUNT_IF(TARGET = 1 AND score < 0.05e0) AS fn, COUNT_IF(TARGET = 0 AND score < 0.05e0) AS tn FROM j) "
    f"SELECT (SELECT COUNT(*) FROM j) AS n_matched, (SELECT {rnd_sql('SUM(neg * (2e0 * tp - pos) / 2e0) / (MAX(P) * MAX(N))')} FROM c) AS roc_auc, "
    f"{rnd_sql('COALESCE((tp + tn) / NULLIF(CAST(tp + fp + fn + tn AS DOUBLE), 0), 0)')} AS accuracy, "
    f"{rnd_sql('COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0)')} AS precision, "
    f"{rnd_sql('COALESCE(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0)')} AS recall, (SELECT COUNT(*) FROM j) >= 100 AS enough_rows FROM cm"))


# D10
@query("table_diff")
def q_table_diff(spark, d):
    s = scored(spark, d)
    a = s.select(*LKEY, "PROBABILITY", "PROBABILITY2")
    b = s.select(*LKEY, "PROBABILITY", F.round("PROBABILITY2", 3).alias("PROBABILITY2"))
    return round_double_cols(R.table_diff(a, b, LKEY, ["PROBABILITY", "PROBABILITY2"], 1e-4))


def _table_diff_sql():
    keys = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"
    la = (f"SELECT {keys}, 'PROBABILITY' AS feature, l_quantity / 50e0 AS v FROM lineitem UNION ALL "
          f"SELECT {keys}, 'PROBABILITY2', l_extendedprice / 105000e0 FROM lineitem")
    lb = (f"SELECT {keys}, 'PROBABILITY' AS feature, l_quantity / 50e0 AS v FROM lineitem UNION ALL "
          f"SELECT {keys}, 'PROBABILITY2', round(l_extendedprice / 105000e0, 3) FROM lineitem")
    on = " AND ".join(f"a.{k} = b.{k}" for k in _K4 + ["feature"])
    sel = ", ".join(f"COALESCE(a.{k}, b.{k}) AS {k}" for k in _K4 + ["feature"])
    return (f"SELECT {sel}, {rnd_sql('a.v')} AS value_a, {rnd_sql('b.v')} AS value_b, {rnd_sql('abs(a.v - b.v)')} AS abs_diff "
            f"FROM ({la}) a FULL JOIN ({lb}) b ON {on} "
            "WHERE COALESCE((a.v IS NULL) <> (b.v IS NULL) OR abs(a.v - b.v) > 1e-4, false)")


reg("table_diff", _table_diff_sql())


# G1
@query("union_all")
def q_union_all(spark, d):
    o = T(spark, d, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    b = o.where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_totalprice")
    return round_double_cols(a.unionByName(b))


reg("union_all", f"SELECT o_orderkey, {rnd_sql('o_totalprice')} AS o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    f"SELECT o_orderkey, {rnd_sql('o_totalprice')} FROM orders WHERE o_orderpriority LIKE '1%'")


# G2
@query("dedup_first")
def q_dedup_first(spark, d):
    o = T(spark, d, "orders")
    a = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", F.lit("finished").alias("origin"), "o_totalprice")
    b = o.where(F.col("o_orderpriority").startswith("1")).select("o_orderkey", F.lit("urgent").alias("origin"),
                                                                 (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return round_double_cols(SM.dedup_first([a, b], "o_orderkey"))


reg("dedup_first", (
    "WITH u AS (SELECT o_orderkey, 'finished' AS origin, o_totalprice, 0 AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL "
    "SELECT o_orderkey, 'urgent', o_totalprice * 2, 1 FROM orders WHERE o_orderpriority LIKE '1%') "
    f"SELECT o_orderkey, origin, {rnd_sql('o_totalprice')} AS o_totalprice FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY src, origin, o_totalprice) = 1"))


# G3
def _years(spark, d):
    o = T(spark, d, "orders")
    return (o.where(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("cust")),
            o.where(F.year("o_orderdate") == 2001).select(F.col("o_custkey").alias("cust")))


@query("id_intersect")
def q_id_intersect(spark, d):
    a, b = _years(spark, d)
    return a.intersect(b)


@query("id_except")
def q_id_except(spark, d):
    a, b = _years(spark, d)
    return a.distinct().join(b, "cust", "left_anti")


_Y = ("(SELECT o_custkey AS cust FROM orders WHERE year(o_orderdate) = 1995)",
      "(SELECT o_custkey AS cust FROM orders WHERE year(o_orderdate) = 2001)")
reg("id_intersect", f"SELECT cust FROM {_Y[0]} a INTERSECT SELECT cust FROM {_Y[1]} b")
reg("id_except", f"SELECT cust FROM {_Y[0]} a EXCEPT SELECT cust FROM {_Y[1]} b")


# G5
@query("hash_sample")
def q_hash_sample(spark, d):
    return SM.hash_sample(T(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


reg("hash_sample", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {H('o_orderkey')}, o_orderkey LIMIT 1000")


@query("replacement_sample")
def q_replacement_sample(spark, d):
    """As many draws with replacement as there are customers, per segment."""
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return SM.sample_with_replacement(c, "c_custkey", c.count())


reg("replacement_sample", (
    "WITH c AS (SELECT c_custkey, c_mktsegment, ROW_NUMBER() OVER (ORDER BY c_custkey) AS r, COUNT(*) OVER () AS n FROM customer), "
    "d AS (SELECT unnest(range((SELECT COUNT(*) FROM customer))) AS draw) SELECT draw, c_custkey, c_mktsegment FROM d JOIN c ON c.r = 1 + CAST(FLOOR("
    "CAST('0x' || substr(md5(CAST(draw AS VARCHAR) || '_42'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496e0 * c.n) AS BIGINT)"))


# G6
@query("strat_sample")
def q_strat_sample(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SM.stratified_sample(o, "o_orderkey", "o_orderstatus", 100)


reg("strat_sample", f"SELECT o_orderkey, o_orderstatus FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {H('o_orderkey')}, o_orderkey) <= 100")


# G7
@query("strat_split")
def q_strat_split(spark, d):
    s = scored(spark, d).select("l_orderkey", "l_linenumber", "TARGET", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"))
    out = SM.stratified_split(s, "rid", "TARGET", 0.7)
    return out.groupBy("TARGET", "split").count()


reg("strat_split", (f"SELECT TARGET, CASE WHEN {H('l_orderkey * 10 + l_linenumber')} / 4294967296e0 < 0.7e0 THEN 'train' ELSE 'val' END AS split, "
                    f"COUNT(*) AS count FROM ({SCORED_SQL}) s GROUP BY ALL"))


# G8
@query("strat_kfold")
def q_strat_kfold(spark, d):
    c = role(spark, d, "application").select("SK_ID_CURR", "TARGET")
    return SM.stratified_kfold(c, "SK_ID_CURR", "TARGET", 5)


reg("strat_kfold", with_roles("application") + (
    f"SELECT SK_ID_CURR, TARGET, CAST((ROW_NUMBER() OVER (PARTITION BY TARGET ORDER BY {H('SK_ID_CURR')}, SK_ID_CURR) - 1) % 5 AS BIGINT) AS fold "
    "FROM application"))


# G9
@query("class_weights")
def q_class_weights(spark, d):
    return round_double_cols(SM.class_weights(scored(spark, d), "TARGET"))


reg("class_weights", f"SELECT TARGET, COUNT(*) AS n, {rnd_sql('SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*))')} AS weight "
    f"FROM ({SCORED_SQL}) s GROUP BY TARGET")


# G10
@query("undersample")
def q_undersample(spark, d):
    c = role(spark, d, "application").select("SK_ID_CURR", "TARGET")
    return SM.undersample(c, "SK_ID_CURR", "TARGET", 1, 0.5)


reg("undersample", with_roles("application") + (
    "SELECT SK_ID_CURR, TARGET FROM application WHERE TARGET = 1 UNION ALL "
    f"SELECT SK_ID_CURR, TARGET FROM (SELECT * FROM application WHERE TARGET <> 1 ORDER BY {H('SK_ID_CURR')}, SK_ID_CURR "
    "LIMIT (SELECT CAST(FLOOR(COUNT(*) / 0.5) AS BIGINT) FROM application WHERE TARGET = 1))"))


# G11 + G12
SMOTE_FEATS = ["AMT_INCOME_TOTAL", "DAYS_BIRTH", "EXT_1", "EXT_2", "EXT_3", "CNT_CHILDREN"]
_SMOTE_COLS = ["SK_ID_CURR", "TARGET", "AMT_INCOME_TOTAL / 1e3 AS AMT_INCOME_TOTAL", "DAYS_BIRTH / 1e3 AS DAYS_BIRTH", "COALESCE(EXT_SOURCE_1, 0.5e0) AS EXT_1",
               "EXT_SOURCE_2 AS EXT_2", "COALESCE(EXT_SOURCE_3, 0.5e0) AS EXT_3", "CNT_CHILDREN"]


def _smote_input(spark, d):
    return role(spark, d, "application").selectExpr(*[c.replace("e0", "D").replace("1e3", "1000D") for c in _SMOTE_COLS])


@query("smote")
def q_smote(spark, d):
    return round_double_cols(SM.smote(_smote_input(spark, d), "SK_ID_CURR", "TARGET", SMOTE_FEATS))


@query("smote_under")
def q_smote_under(spark, d):
    return round_double_cols(SM.smote_under(_smote_input(spark, d), "SK_ID_CURR", "TARGET", SMOTE_FEATS))


@query("smote_compare")
def q_smote_compare(spark, d):
    """G13 on the rows that SMOTE made: mean and deviation per feature, original and new."""
    x = SM.smote(_smote_input(spark, d), "SK_ID_CURR", "TARGET", SMOTE_FEATS).where("TARGET = 1")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in SMOTE_FEATS])
    x = x.select((F.col("copy") > 0).alias("made"), F.inline(cells))
    val = lambda made: F.when(F.col("made") == F.lit(made), F.col("v"))
    out = x.groupBy("feature").agg(*[f(val(m)).alias(f"{t}_{n}") for m, t in ((False, "original"), (True, "synthetic")) for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])
    return round_double_cols(out.withColumn("mean_diff_pct", F.try_divide(F.col("synthetic_mean") - F.col("original_mean"), F.abs("original_mean")) * 100))


@query("knn")
def q_knn(spark, d):
    """The five nearest applicants of every applicant."""
    from riskframe.operators.neighbors import nearest
    x = nearest(_smote_input(spark, d), "SK_ID_CURR", SMOTE_FEATS, 5)
    return round_double_cols(x.select("SK_ID_CURR", F.posexplode("neighbours").alias("p", "x")).select(
        "SK_ID_CURR", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.d2").alias("d2")))


def _knn_sql(where):
    d2 = " + ".join(f"(a.{c}::DOUBLE - b.{c}::DOUBLE) * (a.{c}::DOUBLE - b.{c}::DOUBLE)" for c in SMOTE_FEATS)
    return (f"SELECT a.SK_ID_CURR, b.SK_ID_CURR AS neighbour, {d2} AS d2, ROW_NUMBER() OVER (PARTITION BY a.SK_ID_CURR ORDER BY {d2}, b.SK_ID_CURR) AS rank "
            f"FROM base a JOIN base b ON a.SK_ID_CURR <> b.SK_ID_CURR {where} QUALIFY rank <= 5")


_SMOTE_BASE = with_roles("application") .rstrip() + f", base AS (SELECT {', '.join(_SMOTE_COLS)} FROM application) "
reg("knn", _SMOTE_BASE + f"SELECT SK_ID_CURR, rank, neighbour, {rnd_sql('d2')} AS d2 FROM ({_knn_sql('')}) x")


def _smote_sql(ratio):
    h = lambda s: f"CAST('0x' || substr(md5(CAST(x.SK_ID_CURR AS VARCHAR) || '_' || CAST(copy AS VARCHAR) || '_{s}'), 1, 8) AS BIGINT)"
    mix = ", ".join(f"x.{c}::DOUBLE + u * (y.{c}::DOUBLE - x.{c}::DOUBLE) AS {c}" for c in SMOTE_FEATS)
    return _SMOTE_BASE + (
        f", nn AS ({_knn_sql('AND a.TARGET = 1 AND b.TARGET = 1')}), "
        f"c AS (SELECT CAST(GREATEST(FLOOR(COUNT(*) FILTER (TARGET <> 1) * {ratio}e0) - COUNT(*) FILTER (TARGET = 1), 0) AS BIGINT) AS new FROM base), "
        f"m AS (SELECT SK_ID_CURR, COUNT(*) OVER () AS m, ROW_NUMBER() OVER (ORDER BY {H('SK_ID_CURR')}, SK_ID_CURR) AS r FROM (SELECT DISTINCT SK_ID_CURR FROM nn)), "
        "e AS (SELECT SK_ID_CURR, unnest(range(1, 1 + CAST(new // m AS BIGINT) + CASE WHEN r <= new % m THEN 1 ELSE 0 END)) AS copy FROM m, c), "
        f"s AS (SELECT x.SK_ID_CURR, copy, {h(42)} % (SELECT COUNT(*) FROM nn WHERE nn.SK_ID_CURR = x.SK_ID_CURR) + 1 AS pick, {h('42u')} / 4294967296e0 AS u FROM e x), "
        f"z AS (SELECT SK_ID_CURR, TARGET, {', '.join(f'{c}::DOUBLE AS {c}' for c in SMOTE_FEATS)}, 0 AS copy, NULL::BIGINT AS neighbour FROM base UNION ALL "
        f"SELECT x.SK_ID_CURR, x.TARGET, {mix}, copy, y.SK_ID_CURR FROM s JOIN nn ON nn.SK_ID_CURR = s.SK_ID_CURR AND nn.rank = s.pick "
        "JOIN base x ON x.SK_ID_CURR = s.SK_ID_CURR JOIN base y ON y.SK_ID_CURR = nn.neighbour) ")


_SMOTE_OUT = "SELECT SK_ID_CURR, TARGET, " + ", ".join(f"{rnd_sql(c)} AS {c}" for c in SMOTE_FEATS) + ", copy, neighbour FROM z"
reg("smote", _smote_sql(1.0) + _SMOTE_OUT)
reg("smote_under", _smote_sql(0.5) + _SMOTE_OUT + (
    f" WHERE TARGET = 1 OR SK_ID_CURR IN (SELECT SK_ID_CURR FROM base WHERE TARGET <> 1 ORDER BY {H('SK_ID_CURR')}, SK_ID_CURR "
    "LIMIT (SELECT COUNT(*) FROM z WHERE TARGET = 1))"))
reg("smote_compare", _smote_sql(1.0) + ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, copy > 0 AS made, {c} AS v FROM z WHERE TARGET = 1" for c in SMOTE_FEATS) + "), "
    "g AS (SELECT feature, AVG(v) FILTER (NOT made) AS om, STDDEV_SAMP(v) FILTER (NOT made) AS os, AVG(v) FILTER (made) AS sm, STDDEV_SAMP(v) FILTER (made) AS ss FROM v GROUP BY feature) "
    f"SELECT feature, {rnd_sql('om')} AS original_mean, {rnd_sql('os')} AS original_std, {rnd_sql('sm')} AS synthetic_mean, {rnd_sql('ss')} AS synthetic_std, "
    f"{rnd_sql('(sm - om) / NULLIF(abs(om), 0) * 100')} AS mean_diff_pct FROM g")


# G14 + G13
def _drifted(spark, d):
    ev = T(spark, d, "events")
    return SM.inject_drift(ev, "event_id", ["value"], "event_type", ["view", "click", "signup", "purchase", "error"])


@query("inject_drift")
def q_inject_drift(spark, d):
    return round_double_cols(_drifted(spark, d).select("event_id", "event_type", "value"))


def _inject_sql():
    u = f"({H('event_id', 7)} / 4294967296e0)"
    cats = "['view', 'click', 'signup', 'purchase', 'error']"
    val = (f"CASE WHEN {u} < 0.05e0 THEN NULL WHEN {u} < 0.06e0 THEN value * -10e0 ELSE value * 1.2e0 END")
    cat = f"CASE WHEN {u} >= 0.5e0 AND {u} < 0.6e0 THEN {cats}[CAST({H('event_id', 8)} % 5 AS INTEGER) + 1] ELSE event_type END"
    return f"SELECT event_id, {cat} AS event_type, {rnd_sql(val)} AS value FROM events"


reg("inject_drift", _inject_sql())


@query("compare_stats")
def q_compare_stats(spark, d):
    ev = T(spark, d, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    dr = _drifted(spark, d).select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))

    def st(df, tag):
        return df.agg(*[F.avg(c).alias(f"{c}_mean_{tag}") for c in ("value", "k")],
                      *[F.stddev_samp(c).alias(f"{c}_std_{tag}") for c in ("value", "k")])
    return round_double_cols(st(ev, "original").crossJoin(st(dr, "synthetic")))


def _cmp_sql():
    u = f"({H('event_id', 7)} / 4294967296e0)"
    val = f"CASE WHEN {u} < 0.05e0 THEN NULL WHEN {u} < 0.06e0 THEN value * -10e0 ELSE value * 1.2e0 END"
    base = "SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"
    drf = f"SELECT {val} AS value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"
    sel = []
    for tag, src in (("original", "o"), ("synthetic", "s")):
        for c in ("value", "k"):
            sel.append(f"(SELECT {rnd_sql(f'AVG({c})')} FROM {src}) AS {c}_mean_{tag}")
            sel.append(f"(SELECT {rnd_sql(f'STDDEV_SAMP({c})')} FROM {src}) AS {c}_std_{tag}")
    return f"WITH o AS ({base}), s AS ({drf}) SELECT {', '.join(sel)}"


reg("compare_stats", _cmp_sql())
