"""Deterministic (hash-ordered) sampling, stratification and folds.

The hash is md5 of (key, seed) -- a pure function of the row, so results do
not depend on partitioning or executor loss, and the same rows are picked by
the SQL oracle.  Per-group "first n by hash" never sorts a whole group in one
task: a 65,536-bucket hash histogram per group fixes an exact cut-off bucket;
buckets below it are taken whole and only the cut bucket is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import hash_bigint
from riskframe.operators.ordered import running_sum

HIST_BUCKETS = 65536


def with_hash(df: DataFrame, key: str, seed=42, name: str = "__h") -> DataFrame:
    return df.withColumn(name, hash_bigint(key, seed=seed))


def hash_top_n(df: DataFrame, key: str, n, groups: Sequence[str] = (), seed=42) -> DataFrame:
    """Exactly the ``n`` rows with the smallest (hash, key) per group.

    ``n`` is an int or a one-row / per-group DataFrame with column ``__n``.
    Histogram -> cut-off bucket -> rank only the cut bucket's rows."""
    groups = list(groups)
    h = with_hash(df, key, seed).withColumn("__bk", F.floor(F.col("__h") / F.lit(4294967296 // HIST_BUCKETS)))
    hist = h.groupBy(*groups, "__bk").agg(F.count(F.lit(1)).alias("__c"))
    # histogram: groups x 65,536 rows at most -> the window below is over buckets, not rows
    w = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("__bk") \
        .rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("__cum", F.sum("__c").over(w))
    if isinstance(n, int):
        hist = hist.withColumn("__n", F.lit(n))
    else:
        hist = hist.join(n, groups) if groups else hist.crossJoin(n)
    cut = hist.where(F.col("__cum") - F.col("__c") < F.col("__n")).groupBy(*groups).agg(
        F.max(F.struct(F.col("__bk").alias("bk"), (F.col("__cum") - F.col("__c")).alias("before"))).alias("__m"),
        F.first("__n").alias("__n"))
    cut = cut.select(*groups, F.col("__m.bk").alias("__cut"), (F.col("__n") - F.col("__m.before")).alias("__need"))
    # cut: one row per group (one row without groups -> broadcast; with groups
    # its size follows the stratum count: the planner decides)
    if groups:
        cand = h.join(cut, groups, "inner")
    else:
        cand = h.crossJoin(F.broadcast(cut))
    # buckets below the cut are taken whole; only the cut bucket (~1/65,536 of
    # a group) is ranked, so no task sorts a whole (possibly hot) group
    below = cand.where(F.col("__bk") < F.col("__cut"))
    edge = cand.where(F.col("__bk") == F.col("__cut"))
    rw = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("__h", key)
    edge = edge.withColumn("__r", F.row_number().over(rw)).where(F.col("__r") <= F.col("__need")).drop("__r")
    return below.unionByName(edge).drop("__h", "__bk", "__cut", "__need")


def hash_sample(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    return hash_top_n(df, key, n, (), seed)


def sample_with_replacement(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """``n`` draws with replacement, numbered ``draw``: draw i takes the row of rank
    floor(u_i N) by ``key`` (unique), u_i from 52 bits of a hash of i and the seed.
    Exactly n rows (none from an empty table), the same for any partitioning."""
    from riskframe.sources.io import materialize
    ranked = materialize(running_sum(df.withColumn("__one", F.lit(1)), key, ["__one"]).drop("__one"), "ranked")
    count = ranked.agg(F.count(F.lit(1)).alias("__N"))              # one row
    u = F.conv(F.substring(F.md5(F.concat_ws("_", F.col("id").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(count)).where("__N > 0").select(
        F.col("id").alias("draw"), (F.floor(u * F.col("__N")) + 1).alias("cum___one"))
    return draws.join(ranked, "cum___one").select("draw", *df.columns)


def stratified_sample(df: DataFrame, key: str, strata: str, n_per: int, seed=42) -> DataFrame:
    return hash_top_n(df, key, n_per, [strata], seed)


def stratified_split(df: DataFrame, key: str, label: str, train_frac: float = 0.7, seed=42) -> DataFrame:
    """Row-local split: train when hash/2^32 < train_frac.  The hash does not
    depend on ``label``, so every class is split in about that share."""
    u = hash_bigint(key, seed=seed).cast("double") / F.lit(4294967296.0)
    return df.withColumn("split", F.when(u < F.lit(train_frac), "train").otherwise("val"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed=42, ranges: int | None = None) -> DataFrame:
    """fold = (rank of (hash, key) within the class) mod k -- exact ranks from
    a distributed running count over distinct hashes (no per-class window)."""
    h = with_hash(df, key, seed)
    counts = h.groupBy(label, "__h").agg(F.count(F.lit(1)).alias("__c"))
    cum = running_sum(counts, "__h", ["__c"], [label], ranges=ranges)
    j = h.join(cum.select(label, "__h", (F.col("cum___c") - F.col("__c")).alias("__before")), [label, "__h"])
    # ties on the 32-bit hash: rank inside the (class, hash) group, tiny by construction
    tw = Window.partitionBy(label, "__h").orderBy(key)
    return j.withColumn("fold", ((F.col("__before") + F.row_number().over(tw) - 1) % k).cast("int")).drop("__h", "__before")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: N / (n_classes * N_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("__N"), F.count(F.lit(1)).alias("__k"))
    return c.crossJoin(t).select(label, "n", (F.col("__N") / (F.col("__k") * F.col("n"))).alias("weight"))


def undersample(df: DataFrame, key: str, label: str, minority=1, ratio: float = 1.0, seed=42) -> DataFrame:
    """All minority rows + the first minority/ratio majority rows by hash."""
    mino = df.where(F.col(label) == F.lit(minority))
    majo = df.where(F.col(label) != F.lit(minority))
    n = mino.agg(F.floor(F.count(F.lit(1)) / F.lit(ratio)).cast("bigint").alias("__n"))
    return mino.unionByName(hash_top_n(majo, key, n, (), seed))


def minority_neighbours(df: DataFrame, key: str, label: str, features: Sequence[str], minority=1, k: int = 5, pivots: int | None = None) -> DataFrame:
    """The minority rows that have neighbours, with their ``k`` nearest minority
    rows, written once: ``smote`` takes it as ``near``, for several ratios."""
    from riskframe.operators.neighbors import nearest
    from riskframe.sources.io import materialize
    small = df.where(F.col(label) == F.lit(minority)).select(F.col(key).cast("bigint").alias(key), label, *[F.col(c).cast("double").alias(c) for c in features])
    return materialize(small.join(nearest(small, key, features, k, pivots), key).where(F.size("neighbours") > 0), "smote-near")


def smote(df: DataFrame, key: str, label: str, features: Sequence[str], minority=1, ratio: float = 1.0, k: int = 5, seed=42,
          pivots: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """Oversample the minority to ``ratio`` times the majority: every new row is
    x + u (y - x) for a minority row x, one y of its ``k`` nearest minority
    neighbours (exact, ``neighbors.nearest``) and u in [0, 1), both drawn by hash.

    The new rows are dealt evenly over the minority rows, the remainder to the rows
    of smallest hash, so the counts meet the ratio exactly.  Returns key, label, the
    features, ``copy`` (0: the row itself, else the number of the new row made from it)
    and ``neighbour`` (its y).  No new rows where the ratio holds already or where no
    minority row has a neighbour; rows with a missing feature stay but have no neighbours.
    ``near``: ``minority_neighbours`` of the same rows, where they are known."""
    from riskframe.sources.io import materialize
    cols = [F.col(c).cast("double").alias(c) for c in features]
    rows = materialize(df.select(F.col(key).cast("bigint").alias(key), label, *cols), "smote-rows")
    small = rows.where(F.col(label) == F.lit(minority))
    near = minority_neighbours(rows, key, label, features, minority, k, pivots) if near is None else near
    # one row: how many new rows each minority row makes, and how many make one more
    n = rows.agg(F.count_if(F.col(label) == F.lit(minority)).alias("few"), F.count_if(F.col(label) != F.lit(minority)).alias("many"))
    n = n.crossJoin(near.agg(F.count(F.lit(1)).alias("m"))).select("m", F.greatest(F.floor(F.col("many") * F.lit(float(ratio))) - F.col("few"), F.lit(0)).alias("new"))
    n = materialize(n.select(F.expr("CASE WHEN m > 0 THEN new div m ELSE 0 END").alias("per"), F.expr("CASE WHEN m > 0 THEN new % m ELSE 0 END").alias("__n")), "smote-counts")
    every = near.crossJoin(F.broadcast(n.select("per"))).where("per > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("per").cast("int")))).drop("per")
    extra = hash_top_n(near, key, n.select("__n"), (), seed).crossJoin(F.broadcast(n.select("per"))).withColumn("copy", (F.col("per") + 1).cast("int")).drop("per")
    made = every.unionByName(extra)
    pick = (hash_bigint(key, "copy", seed=seed) % F.size("neighbours")).cast("int") + 1
    u = hash_bigint(key, "copy", seed=f"{seed}u").cast("double") / F.lit(4294967296.0)
    made = made.withColumn("neighbour", F.element_at("neighbours", pick)["id"]).withColumn("__u", u)
    other = small.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"__y_{c}") for c in features])
    new = made.join(other, "neighbour").select(key, label, *[(F.col(c) + F.col("__u") * (F.col(f"__y_{c}") - F.col(c))).alias(c) for c in features], "copy", "neighbour")
    return rows.select(key, label, *features, F.lit(0).alias("copy"), F.lit(None).cast("bigint").alias("neighbour")).unionByName(new)


def smote_under(df: DataFrame, key: str, label: str, features: Sequence[str], minority=1, over: float = 0.5, under: float = 1.0, k: int = 5,
                seed=42, pivots: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """SMOTE to ``over`` times the majority, then the majority cut by hash to
    minority / ``under`` rows."""
    from riskframe.sources.io import materialize
    x = materialize(smote(df, key, label, features, minority, over, k, seed, pivots, near), "smote")
    return undersample(x, key, label, minority, under, seed)


def dedup_first(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union several sources; per key keep the row from the first source.

    ``min(struct(source_rank, row))`` per key is an aggregate, so a key with
    many copies is combined map-side instead of landing in one window task."""
    tagged = None
    for i, f in enumerate(frames):
        t = f.withColumn("__src", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    cols = [c for c in tagged.columns if c not in (key, "__src")]
    g = tagged.groupBy(key).agg(F.min(F.struct("__src", *cols)).alias("__m"))
    return g.select(key, *[F.col(f"__m.{c}").alias(c) for c in cols])


def inject_drift(df: DataFrame, key: str, numeric: Sequence[str], category: str | None, categories: Sequence[str],
                 shift: float = 0.2, null_frac: float = 0.05, oor_frac: float = 0.01, seed=7) -> DataFrame:
    """Deterministic drift: +shift on numeric values, category re-drawn for
    ~10 % of rows, extra NULLs and out-of-range values, chosen by row hash."""
    u = hash_bigint(key, seed=seed).cast("double") / F.lit(4294967296.0)
    out = {}
    for c in numeric:
        v = F.col(c) * F.lit(1.0 + shift)
        v = F.when(u < F.lit(null_frac), F.lit(None)).when(u < F.lit(null_frac + oor_frac), F.col(c) * F.lit(-10.0)).otherwise(v)
        out[c] = v
    if category:
        idx = (hash_bigint(key, seed=seed + 1) % F.lit(len(categories))).cast("int")
        arr = F.array(*[F.lit(x) for x in categories])
        out[category] = F.when((u >= F.lit(0.5)) & (u < F.lit(0.6)), F.element_at(arr, idx + 1)).otherwise(F.col(category))
    return df.withColumns(out)
