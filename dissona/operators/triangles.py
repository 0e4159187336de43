"""Groups of three assertions that are pairwise candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.runtime import durable


def canonical_edges(edges: DataFrame) -> DataFrame:
    """u < v, the best score of each pair."""
    return edges.filter("a_id <> b_id").groupBy(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v")).agg(F.max("score").alias("s"))


def _directed(e: DataFrame) -> DataFrame:
    """Edges x -> y of canonical ones, from the end with fewer edges (then the lesser id) to the other."""
    degree = e.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    both = e.join(degree.toDF("u", "du"), "u").join(degree.toDF("v", "dv"), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"), "s")


def triangles(edges: DataFrame, docs: DataFrame, *, id_column: str = "id", doc_column: str = "doc_id") -> DataFrame:
    """a_id < b_id < c_id, scores s_ab, s_ac, s_bc, and min_edge, of at least two documents.

    Wedges are made at the end of an edge that has fewer edges. No vertex has more than sqrt(2m) of m edges towards such with as many,
    so a hub makes few, whatever its id, and m ** 1.5 bounds all wedges.
    """
    e = canonical_edges(edges)
    out = _directed(e)
    y, z = out.select("x", F.col("y").alias("u"), F.col("s").alias("s_u")), out.select("x", F.col("y").alias("v"), F.col("s").alias("s_v"))
    found = y.join(z, "x").filter("u < v").join(e, ["u", "v"])
    ends = F.array_sort(F.array("x", "u", "v"))
    x = F.col("x")
    lowest, highest = x < F.col("u"), x > F.col("v")  # where x stands among the others; what faces the edge (u, v) is x
    s_u, s_v, s = F.col("s_u"), F.col("s_v"), F.col("s")
    found = found.select(
        ends[0].alias("a_id"), ends[1].alias("b_id"), ends[2].alias("c_id"),
        F.when(lowest, s_u).when(highest, s).otherwise(s_u).alias("s_ab"), F.when(lowest, s_v).when(highest, s_u).otherwise(s).alias("s_ac"), F.when(lowest, s).when(highest, s_v).otherwise(s_v).alias("s_bc"),
    )
    d = docs.select(F.col(id_column).alias("id"), F.col(doc_column).alias("doc"))
    for p in "abc":
        found = found.join(d.select(F.col("id").alias(f"{p}_id"), F.col("doc").alias(f"{p}_doc")), f"{p}_id")
    return found.filter(F.size(F.array_distinct(F.array("a_doc", "b_doc", "c_doc"))) >= 2).select("a_id", "b_id", "c_id", "s_ab", "s_ac", "s_bc", F.least("s_ab", "s_ac", "s_bc").alias("min_edge"))


def best_triangles(edges: DataFrame, docs: DataFrame, cap: int, *, id_column: str = "id", doc_column: str = "doc_id", shares: tuple[float, ...] = (1 / 64, 1 / 8)) -> DataFrame:
    """top_triangles(triangles(edges, docs), cap), from as few edges as settle it.

    A triangle whose weakest edge has score t is one of the edges of score t or more. So triangles are sought among the best share of
    edges first; if there are cap of them, no weaker edge can make a better one, else among more. The result is written.
    """
    if cap < 0:
        raise ValueError("the cap can't be negative")
    e = durable(canonical_edges(edges).select(F.col("u").alias("a_id"), F.col("v").alias("b_id"), F.col("s").alias("score")))
    least = e.agg(F.percentile_approx("score", F.array(*(F.lit(1 - x) for x in shares)), F.lit(10_000))).first()[0] if cap else None
    for t in [*(least or []), None]:  # an estimate serves, as all edges from it on are taken
        found = durable(triangles(e if t is None else e.filter(F.col("score") >= t), docs, id_column=id_column, doc_column=doc_column)) if cap else triangles(e.limit(0), docs, id_column=id_column, doc_column=doc_column)
        if t is None or found.count() >= cap:
            break
    return top_triangles(found, cap)


def top_triangles(found: DataFrame, cap: int) -> DataFrame:
    """The cap strongest by their weakest edge, then by ids. None for 0; a negative cap raises."""
    if cap < 0:
        raise ValueError("the cap can't be negative")
    return found.orderBy(F.desc("min_edge"), "a_id", "b_id", "c_id").limit(cap)


def union_edges(strong: DataFrame, weak: DataFrame) -> DataFrame:
    """The strong edges, and the weak ones between other pairs."""
    return strong.unionByName(weak.join(strong.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti"))


def with_strong_edges(found: DataFrame, strong: DataFrame, least: int = 2) -> DataFrame:
    """Triangles with so many strong edges."""
    keys = strong.select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"), F.lit(1).alias("hit")).distinct()
    out = found
    for n, (x, y) in enumerate((("a_id", "b_id"), ("a_id", "c_id"), ("b_id", "c_id"))):
        out = out.join(keys.select(F.col("u").alias(x), F.col("v").alias(y), F.col("hit").alias(f"hit{n}")), [x, y], "left")
    n_strong = sum((F.coalesce(F.col(f"hit{n}"), F.lit(0)) for n in range(3)), F.lit(0))
    return out.withColumn("n_strong", n_strong).filter(F.col("n_strong") >= least).select(*found.columns, "n_strong")
