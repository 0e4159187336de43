"""Identifiers derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_id(*parts: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts put together, without a separator."""
    return F.substring(F.sha2(F.concat(*(F.col(p) if isinstance(p, str) else p for p in parts)), 256), 1, 16)


def pair_key(*ids: Column | str) -> Column:
    """Sorted ids joined by colons. One id, or an id that is null, raises."""
    if len(ids) < 2:
        raise ValueError("a pair key needs two ids or more")
    return pair_key_of(F.array(*(F.col(i) if isinstance(i, str) else i for i in ids)))


def pair_key_of(ids: Column | str) -> Column:
    """The key of an array of ids; null where an id is null or there are fewer than two."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    text = F.transform(ids, lambda x: x.cast("string"))
    return F.when((F.size(ids) >= 2) & ~F.exists(ids, lambda x: x.isNull()), F.array_join(F.array_sort(text), ":"))


def is_pair_key(key: Column | str) -> Column:
    return (F.col(key) if isinstance(key, str) else key).rlike(r"^[0-9a-f]{16}(:[0-9a-f]{16})+\z")


def checked_pair_key(key: Column | str) -> Column:
    """The key; one that isn't segments of 16 hex digits joined by colons raises."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(is_pair_key(key), key).otherwise(F.raise_error(F.concat(F.lit("not a pair key: "), F.coalesce(key, F.lit("null")))))


def unordered_finding_id(doc_a: Column, span_a: Column, doc_b: Column, span_b: Column) -> Column:
    """The same for (a, b) and (b, a): a hash over the two sorted (document, span) pairs, parts joined by a bar."""
    sides = F.array_sort(F.array(F.struct(doc_a.alias("d"), span_a.alias("s")), F.struct(doc_b.alias("d"), span_b.alias("s"))))
    return F.substring(F.sha2(F.array_join(F.flatten(F.transform(sides, lambda x: F.array(x["d"], x["s"]))), "|"), 256), 1, 16)


def mined_pair_id(term: Column, a: Column, b: Column) -> Column:
    """The term's first 24 characters, an underscore and ten hex digits of the sorted ids."""
    return F.concat(F.substring(term, 1, 24), F.lit("_"), F.substring(F.sha2(F.concat_ws(":", F.least(a, b), F.greatest(a, b)), 256), 1, 10))
