"""Mixing sources to target weights.

One aggregate counts the words of every source; the sources' targets (weights
shared over the whole budget, stopped at ``max_repeat`` times the source's own
size, the excess shared again by weight) follow from two running totals over
the one-row-per-source table; a document is then taken ``floor(rate)`` times
plus one Bernoulli copy with probability equal to the fraction.

The draws of a source are balanced: its documents stand by size and, within a size, by
a hash of the seed, the id and the text; a running sum of the fraction begins at a
hash of the seed and the source, and a document whose step passes a whole number is
taken once more.  Over the offsets every document has the fraction as its
probability, and as sizes only rise along the order, the words taken miss the target by
less than the largest document.  Reruns and recomputed tasks agree.

Defined results: null text has size 0; a null source is a source of its own and
comes last (its offset is that of an empty name); a source without words has target 0 and is not
taken; rows with equal id and text are numbered and take their turns; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import broadcast_within, save
from riskframe.operators.ordered import running_sum

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(id_: Column, text: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from 52 bits of an md5 (spelled alike in SQL engines)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def offset(source: Column, seed: str = SEED) -> Column:
    """Where a source's draws begin: uniform in [0, 1)."""
    key = F.concat(F.lit(seed + ":offset:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target, rate).

    Sources in code-point order (null last) take the weights in turn.  The
    water level: sources sorted by cap / weight are stopped one after another
    until the budget left per weight left no longer exceeds the next cap."""
    spark = sizes.sparkSession
    src = save(sizes.select("source", F.col("source_size").cast("double").alias("size"), F.lit(1).alias("one"),
                            # null sorts last: a flag ahead of the name
                            F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))).alias("key")), "mix-sources")
    ranked = running_sum(src, "key", ["one"])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("cum_one") - 1) % len(weights) + 1).cast("int"))
    # where a source has no words its cap is 0: it is stopped first and takes nothing
    caps = save(ranked.select("source", "size", "key", w.alias("w"), (F.col("size") * max_repeat).alias("cap"))
                .withColumn("level", F.col("cap") / F.col("w")), "mix-caps")
    total = caps.agg(F.least(F.sum("size") * share, F.sum("cap")).alias("budget"), F.sum("w").alias("w_all"))
    # sources with equal level stop together: totals per level, then a running total over levels
    levels = running_sum(caps.groupBy("level").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w")), "level", ["cap", "w"])
    step = levels.crossJoin(F.broadcast(total)).select(          # total: one row
        "level", "cum_cap", "cum_w", "budget", "w_all",
        ((F.col("budget") - (F.col("cum_cap") - F.col("cap"))) / (F.col("w_all") - (F.col("cum_w") - F.col("w")))).alias("water"))
    # a level is stopped if the water, with all lower levels stopped, stands above it
    top = step.agg(F.coalesce(F.max(F.when(F.col("water") > F.col("level"), F.col("level"))), F.lit(-1.0)).alias("stopped"))
    rest = caps.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(total))
    left = rest.agg(F.first("budget").alias("budget"), F.sum(F.when(F.col("level") <= F.col("stopped"), F.col("cap")).otherwise(0.0)).alias("gone"),
                    F.sum(F.when(F.col("level") > F.col("stopped"), F.col("w")).otherwise(0.0)).alias("w_left"), F.first("stopped").alias("stopped"))
    t = caps.crossJoin(F.broadcast(left)).withColumn("target", F.when(F.col("level") <= F.col("stopped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.try_divide((F.col("budget") - F.col("gone")) * F.col("w"), F.col("w_left")))))
    return t.select("source", F.col("size").cast("bigint").alias("source_size"), "target",
                    F.least(F.coalesce(F.try_divide("target", "size"), F.lit(0.0)), F.lit(float(max_repeat))).alias("rate"))


def rate_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, max_repeat: float = 2.0,
                seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Per document: ``keep`` columns, ``__source``, ``__size``, ``source_size``, ``target`` and
    ``__copies`` (how often the mix takes it)."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    d = docs.select(kept.alias("__keep"), F.col(f"`{source_col}`").alias("__source"), words(F.col(f"`{text_col}`")).alias("__size"), F.lit(1).alias("__one"),
                    draw(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed).alias("__u"))
    sizes = docs.select(F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("n")) \
        .groupBy("source").agg(F.sum("n").alias("source_size"))
    t = save(source_targets(sizes, weights, share, max_repeat), "mix-targets")
    t = broadcast_within(t.select(F.col("source").alias("__s"), "source_size", "target", "rate", offset(F.col("source"), seed).alias("__off")))
    # rows of equal id and text are numbered, so they can be split among ranges
    at = F.struct("__size", "__u", F.monotonically_increasing_id().alias("n"))
    ranked = running_sum(d.select("__keep", "__source", "__size", "__one", at.alias("__at")), "__at", ["__one"], ["__source"])
    j = ranked.join(t, F.col("__source").eqNullSafe(F.col("__s")), "left")
    whole, n = F.floor("rate"), F.col("cum___one")
    part = F.col("rate") - whole
    drawn = F.floor(n * part + F.col("__off")) - F.floor((n - 1) * part + F.col("__off"))
    return j.select(*[F.col(f"__keep.`{c}`").alias(c) for c in keep], "__source", "__size", "source_size", "target",
                    (whole + drawn).cast("bigint").alias("__copies"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every column of ``docs``, each row as often as it is taken."""
    t = rate_copies(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[F.col(f"`{c}`") for c in _needed(kw)]),
                    keep=["__row"], **kw)
    return t.where("__copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__i")).select(
        *[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def _needed(kw) -> list[str]:
    return list(dict.fromkeys([kw.get("id_col", "doc_id"), kw.get("text_col", "text"), kw.get("source_col", "source")]))
