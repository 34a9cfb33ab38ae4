"""JSON documents of unknown keys to a table.

The documents become VARIANT values.  One aggregate over (key, value type)
finds the columns: only whole numbers make a BIGINT, numbers a DOUBLE, booleans a
BOOLEAN, anything else or a mixture a STRING (objects and arrays as JSON text).
``try_variant_get`` then takes each column from the value.  The keys, not the rows,
pass the driver; more than ``max_keys`` are an error, never a cut.

Defined results: null, broken and non-object documents give a row of nulls; a missing
key, a JSON null give null; keys that are null everywhere are STRING; columns
stand in code-point order after ``keep``; a key that equals a kept column (letter case
aside) is named ``doc_<key>``; an empty table gives the kept columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 2000


def _path(key: str) -> str:
    for quote in "'\"":
        if quote not in key:
            return f"$[{quote}{key}{quote}]"
    raise ValueError(f"a key with both kinds of quotes has no path: {key}")


def _variant(doc: Column) -> Column:
    return F.try_parse_json(doc)


def document_keys(df: DataFrame, doc: str) -> DataFrame:
    """(key, type, n): each key's column type and its values that are not null."""
    v = df.select(F.try_variant_get(_variant(F.col(f"`{doc}`")), "$", "map<string,variant>").alias("m"))
    each = v.select(F.explode("m").alias("key", "value")).select("key", F.schema_of_variant("value").alias("t"))
    kind = F.when(F.col("t") == "VOID", None).when(F.col("t").isin("BIGINT", "BOOLEAN"), F.col("t")).when(
        F.col("t").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "DOUBLE").otherwise("STRING")
    kinds = F.collect_set("kind")           # at most four values a key
    one = F.when(F.size(kinds) == 1, kinds[0]).when(F.forall(kinds, lambda k: k.isin("BIGINT", "DOUBLE")) & (F.size(kinds) > 0), F.lit("DOUBLE"))
    return each.select("key", kind.alias("kind")).groupBy("key").agg(F.coalesce(one, F.lit("STRING")).alias("type"), F.count("kind").alias("n"))


def documents_to_table(df: DataFrame, doc: str, keep: Sequence[str] = (), max_keys: int = MAX_KEYS) -> DataFrame:
    found = sorted((r["key"], r["type"]) for r in document_keys(df, doc).limit(max_keys + 1).collect())
    if len(found) > max_keys:
        raise ValueError(f"the documents have more than {max_keys} keys")
    taken, cols = {c.lower() for c in keep}, []
    for key, kind in found:
        name = key
        while name.lower() in taken:
            name = f"doc_{name}"
        taken.add(name.lower())
        cols.append(F.try_variant_get("__v", _path(key), kind).alias(name))
    return df.select(*[F.col(f"`{c}`") for c in keep], _variant(F.col(f"`{doc}`")).alias("__v")).select(*[F.col(f"`{c}`") for c in keep], *cols)
