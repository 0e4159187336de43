"""Pairs of texts whose quantities meet, by equality joins on what the quantities are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.functions.quantities import opposite, relative_difference
from dissona.runtime import durable


_SUBJECT = ("g", "metric", "scope", "unit")


def _quantities(items: DataFrame, group: str, item: str, quantities: str) -> DataFrame:
    """g, key, at, metric, scope, unit, q: a row for each quantity. Extracted once, and checkpointed for both sides of a join."""
    x = items.select(F.col(group).alias("g"), F.col(item).alias("key"), F.posexplode_outer(quantities).alias("at", "q")).filter("q is not null")  # the plain form would infer filters that extract anew
    return durable(x.select("g", "key", "at", F.col("q.metric").alias("metric"), F.col("q.scope").alias("scope"), F.col("q.unit").alias("unit"), "q"))


def _one_subject(a: str, b: str) -> Column:
    """Equal group and metric, and equal scope and unit where none equals none."""
    return (F.col(f"{a}.g") == F.col(f"{b}.g")) & (F.col(f"{a}.metric") == F.col(f"{b}.metric")) & F.col(f"{a}.scope").eqNullSafe(F.col(f"{b}.scope")) & F.col(f"{a}.unit").eqNullSafe(F.col(f"{b}.unit"))


def _by_pair(met: DataFrame, group: str) -> DataFrame:
    """group, a_key, b_key, and d, the pair's quantities in the order of a, then b, of rows g, a_key, b_key, a_at, b_at, a, b."""
    found = met.groupBy(F.col("g").alias(group), "a_key", "b_key").agg(F.array_sort(F.collect_list(F.struct("a_at", "b_at", "a", "b"))).alias("d"))
    return found.withColumn("d", F.transform("d", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))


def flipping(items: DataFrame, group: str, item: str, quantities: str) -> DataFrame:
    """group, a_key < b_key, d: pairs of items of a group with quantities of opposite direction.

    What goes up meets what goes down of one metric, scope and unit, so a row is made for each flip and no other, whatever a subject's size.
    """
    x = _quantities(items, group, item, quantities)
    up, down = (x.filter(F.col("q.polarity").isin(*kinds)).alias(p) for p, kinds in (("u", ("up", "pos")), ("v", ("down", "neg"))))
    met = up.join(down, _one_subject("u", "v") & (F.col("u.key") != F.col("v.key")))
    first = F.col("u.key") < F.col("v.key")
    pick = lambda c, name: (F.when(first, F.col(f"u.{c}")).otherwise(F.col(f"v.{c}")).alias(f"a{name}"), F.when(first, F.col(f"v.{c}")).otherwise(F.col(f"u.{c}")).alias(f"b{name}"))
    return _by_pair(met.select(F.col("u.g").alias("g"), *pick("key", "_key"), *pick("at", "_at"), *pick("q", "")), group)


def disagreeing(items: DataFrame, group: str, item: str, quantities: str, threshold: float = 0.10) -> DataFrame:
    """group, a_key < b_key, d: pairs of items of a group with values that differ by the threshold or more, without a flip. A negative threshold raises.

    Values of one metric, scope and unit meet once each, however many items have them; those that disagree are joined to their items.
    So equal values, as of copies, make no pairs.
    """
    if threshold < 0:
        raise ValueError("the threshold can't be negative")
    x = _quantities(items, group, item, quantities).withColumn("class", F.xxhash64(*_SUBJECT, "q.value", "q.polarity"))
    kinds = x.groupBy(*_SUBJECT, "q").agg(F.first("class").alias("class"))
    a, b = kinds.alias("a"), kinds.alias("b")
    differ = ~opposite(F.col("a.q"), F.col("b.q")) & F.coalesce(relative_difference(F.col("a.q"), F.col("b.q")) >= threshold, F.lit(False))
    pairs = a.join(b, _one_subject("a", "b") & differ).select(F.col("a.g").alias("g"), F.col("a.q").alias("a"), F.col("b.q").alias("b"), F.col("a.class").alias("a_class"), F.col("b.class").alias("b_class"))
    own = lambda p: x.select(F.col("class").alias(f"{p}_class"), F.col("q").alias(f"{p}_q"), F.col("key").alias(f"{p}_key"), F.col("at").alias(f"{p}_at"), F.col("g").alias(f"{p}_g"))
    met = pairs.join(own("a"), "a_class").filter("a_q = a and a_g = g").join(own("b"), "b_class").filter("b_q = b and b_g = g and a_key < b_key")  # a hash may be shared
    return _by_pair(met.select("g", "a_key", "b_key", "a_at", "b_at", "a", "b"), group)
