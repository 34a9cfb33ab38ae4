"""Joins: cascaded subsets, known/unknown split, lookups, remaps, table diff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.sources.io import materialize


def cascade_subset(parent: DataFrame, parent_key: str, chain: Sequence[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Subset every table of a key chain to the rows reachable from ``parent``.

    ``chain`` = [(child, fk_to_previous_level, own_key)]; each level is a
    left-semi join on the previous level's keys (ids are never collected)."""
    out = [parent]
    prev, prev_key = parent, parent_key
    for child, fk, own in chain:
        sub = child.join(prev.select(F.col(prev_key).alias(fk)), fk, "left_semi")
        out.append(sub)
        prev, prev_key = sub, own
    return out


def known_unknown(batch: DataFrame, key: str, precomputed: DataFrame, compute) -> DataFrame:
    """Every row of ``batch`` once: with the features stored in ``precomputed``, or
    else with those of ``compute(unknown_batch)`` (null where it has none), and
    a source tag.  Both are joined to the batch, so no applicant is lost.
    The stored features and the unknown part are read twice: each is written once, so
    that no task holds the sorts and aggregates behind them beside its own."""
    precomputed = materialize(precomputed, "known")
    known = precomputed.withColumn("source", F.lit("precomputed"))
    unknown = materialize(batch.join(precomputed.select(key), key, "left_anti"), "unknown")
    fresh = compute(unknown)
    stored = batch.join(known, key, "inner")
    computed = unknown.join(fresh, key, "left").withColumn("source", F.lit("computed"))
    return stored.unionByName(computed, allowMissingColumns=True)


def fit_group_means(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """State table: mean of ``value`` per category (plus its row count)."""
    return df.groupBy(*group).agg(F.avg(value).alias("group_mean"), F.count(F.lit(1)).alias("group_n"))


def map_lookup(df: DataFrame, state: DataFrame, group: Sequence[str], default: float, out: str) -> DataFrame:
    """Category -> stored mean; unseen categories get ``default`` (overall mean)."""
    return df.join(state.select(*group, "group_mean"), list(group), "left").withColumn(
        out, F.coalesce(F.col("group_mean"), F.lit(default))).drop("group_mean")


def vs_group_mean(df: DataFrame, group: Sequence[str], value: str, eps: float = 1e-5) -> DataFrame:
    """value / (mean of its group + eps): aggregate then join back.

    The aggregate combines map-side (a hot group costs one partial row per
    task); AQE broadcasts the aggregated side when it is small, otherwise
    sort-merges with skew splitting -- unlike ``avg().over(partitionBy)``,
    which would put a hot group into a single task."""
    m = df.groupBy(*group).agg(F.avg(value).alias("__gm"))
    return df.join(m, list(group), "left").withColumn(
        f"{value}_vs_group_mean", F.try_divide(F.col(value), F.col("__gm") + F.lit(eps))).withColumnRenamed(
        "__gm", f"{value}_group_mean")


def id_remap(df: DataFrame, col: str, mapping: DataFrame, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """Replace ids through a mapping table (unmapped ids kept)."""
    m = mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return df.join(m, df[col] == m["__old"], "left").withColumn(col, F.coalesce("__new", F.col(col))).drop("__old", "__new")


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float = 1e-4) -> DataFrame:
    """Cell-wise differences: one full outer join of the wide rows, then only the
    cells that differ are exploded.  NULL == NULL counts as equal;
    |a - b| > tol is a difference; a row on one side only differs in its
    non-null cells."""
    wide = lambda df, side: df.select(*keys, F.struct(*[F.col(c).cast("double").alias(c) for c in cols]).alias(side))
    j = wide(a, "a").join(wide(b, "b"), list(keys), "full")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a.{c}").alias("value_a"), F.col(f"b.{c}").alias("value_b"),
                               F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).alias("abs_diff")) for c in cols])
    differs = F.filter(cells, lambda s: F.coalesce((s["value_a"].isNull() != s["value_b"].isNull()) | (s["abs_diff"] > F.lit(tol)), F.lit(False)))
    return j.select(*keys, F.inline(differs))
