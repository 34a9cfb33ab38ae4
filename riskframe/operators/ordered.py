"""Running totals over a global order without a single-partition window.

Spark's ``Window.orderBy`` with no ``partitionBy`` moves every row to ONE
task.  ``running_sum`` instead

1. range-partitions the rows by (groups, order value) and writes them once
   with their partition number -- a hot group is split by value, the number
   of ranges is the session's shuffle parallelism;
2. sums every (group, partition); only a group that crosses a range border
   needs an offset, and a partition can only begin inside one group, so the
   offset table has at most two rows per partition;
3. runs the real window partitioned by (group, partition) and adds the offset.

The input is expected to hold one row per (group, order value) -- callers
pre-aggregate, which also removes every hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def n_ranges(spark) -> int:
    """One order range per shuffle partition: the cluster's configured
    parallelism."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return 200


def running_sum(df: DataFrame, order_col: str, sum_cols: Sequence[str], groups: Sequence[str] = (),
                ascending: bool = True, ranges: int | None = None, prefix: str = "cum_",
                totals: bool = False) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows ordered by ``order_col`` up to
    and including the current row, per ``groups`` (null groups are a group).
    Rows must be unique per (groups, order_col).  ``totals=True`` adds the
    group totals ``tot_<c>``.

    The ranged rows are written once as a Parquet table in the shared
    folder: their partition numbers stay fixed for the offsets and the
    windows, and a lost executor re-reads the table."""
    from riskframe.sources.io import materialize
    groups = list(groups)
    o = F.col(order_col).asc() if ascending else F.col(order_col).desc()
    t = materialize(df.repartitionByRange(ranges or n_ranges(df.sparkSession), *[F.col(g) for g in groups], o)
                    .withColumn("__p", F.spark_partition_id()), "running-sum")
    per_group = Window.partitionBy(*groups)
    before = per_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy(*groups, "__p").agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    crossing = (sums.withColumn("__n", F.count(F.lit(1)).over(per_group))
                .select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__p").alias("__q"), "__n",
                        *[F.sum(f"__t_{c}").over(before).alias(f"__off_{c}") for c in sum_cols],
                        *[F.sum(f"__t_{c}").over(per_group).alias(f"__tot_{c}") for c in sum_cols])
                .where("__n > 1"))
    on = t["__p"] == crossing["__q"]
    for g in groups:
        on = on & t[g].eqNullSafe(crossing[f"__g_{g}"])
    # at most two rows per range: a group that ends in it and one that begins in it
    j = t.join(F.broadcast(crossing), on, "left")
    local = Window.partitionBy(*groups, "__p")
    w = local.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    extra = [F.coalesce(F.col(f"__tot_{c}"), F.sum(c).over(local)).alias(f"tot_{c}") for c in sum_cols] if totals else []
    return j.select(*df.columns, *[F.when(F.col(f"__off_{c}").isNull(), F.sum(c).over(w)).otherwise(
        F.col(f"__off_{c}") + F.sum(c).over(w)).alias(f"{prefix}{c}") for c in sum_cols], *extra)


#: Half-width of the rank bracket around a quantile, as a share of the rows; far
#: above the error of the approximate ranks (1 / ACCURACY), so the bracket
#: always holds the exact ranks.
BRACKET, ACCURACY, SMALL_GROUP = 0.005, 10_000, 2_000


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], groups: Sequence[str] = (),
                    ranges: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / numpy default, same as
    Spark's ``percentile``) without holding a group's values in one task.

    One aggregate brackets every wanted rank by two approximate quantiles (groups
    below ``SMALL_GROUP`` rows: by their extremes); one aggregate counts the
    rows below each bracket; only values inside a bracket (about a hundredth of
    the rows) are counted per distinct value, ranked by a running count and
    matched against the wanted ranks.  Returns (groups..., p_index, p,
    quantile); groups with no non-null value are absent."""
    from riskframe.sources.io import materialize
    groups = list(groups)
    v = F.col(value_col).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).select(*groups, v.alias("__v"))
    ends = [min(1.0, max(0.0, p + s)) for p in probs for s in (-BRACKET, BRACKET)]
    b = base.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__e"),
                                  F.min("__v").alias("__min"), F.max("__v").alias("__max")).where("__n > 0")
    small = F.col("__n") < SMALL_GROUP
    n = F.col("__n")
    targets = F.array(*[F.struct(
        F.lit(i).alias("pi"), F.lit(float(p)).alias("p"), ((n - 1).cast("double") * F.lit(float(p))).alias("h"),
        F.when(small | F.lit(p <= BRACKET), F.col("__min")).otherwise(F.col("__e")[2 * i]).alias("from"),
        F.when(small | F.lit(p >= 1 - BRACKET), F.col("__max")).otherwise(F.col("__e")[2 * i + 1]).alias("to")) for i, p in enumerate(probs)])
    brackets = materialize(b.select(*[F.col(g).alias(f"__g_{g}") for g in groups], targets.alias("__t")), "quantile-brackets")
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    # one row per group; without groups a single row
    j = base.join(brackets, on) if groups else base.crossJoin(F.broadcast(brackets))
    below = j.groupBy(*groups).agg(*[F.count_if(F.col("__v") < F.col("__t")[i]["from"]).alias(f"__b{i}") for i in range(len(probs))])
    below = below.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.array(*[f"__b{i}" for i in range(len(probs))]).alias("__below"))
    hits = F.filter("__t", lambda t: (t["from"] <= F.col("__v")) & (F.col("__v") <= t["to"]))
    inside = j.select(*groups, "__v", F.explode(hits).alias("t")).groupBy(*groups, F.col("t.pi").alias("p_index"), F.col("t.p").alias("p"),
                                                                         F.col("t.h").alias("__h"), "__v").agg(F.count(F.lit(1)).alias("__c"))
    cum = running_sum(inside, "__v", ["__c"], [*groups, "p_index", "p", "__h"], ranges=ranges)
    k = cum.join(below, on) if groups else cum.crossJoin(F.broadcast(below))
    last = F.col("__below")[F.col("p_index")] + F.col("cum___c") - 1
    first = last - F.col("__c") + 1
    lo, hi = F.floor("__h"), F.ceil("__h")
    g = k.groupBy(*groups, "p_index", "p", "__h").agg(
        F.max(F.when((lo >= first) & (lo <= last), F.col("__v"))).alias("__lo_v"), F.max(F.when((hi >= first) & (hi <= last), F.col("__v"))).alias("__hi_v"))
    q = F.col("__lo_v") + (F.col("__h") - lo) * (F.col("__hi_v") - F.col("__lo_v"))
    return g.select(*groups, "p_index", "p", q.alias("quantile"))


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """exact_quantiles for several columns at once: (feature, p_index, p, quantile)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("__s")).select("__s.*")
    return exact_quantiles(long, "value", probs, ["feature"])
