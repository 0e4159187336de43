"""Organisations of a corpus: buckets, fragments, failures, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.functions.terms import organisation_key, pre_suffix_key


def organisation_buckets(documents: DataFrame, order: Column, *, with_order: bool = False) -> DataFrame:
    """org_key, display (the label seen first), n_docs, with_order also ord (of the first document); documents without a label are the bucket ''."""
    x = documents.select(organisation_key("org_label").alias("org_key"), F.nullif(F.trim("org_label"), F.lit("")).alias("label"), order.alias("ord"))
    first = [F.min("ord").alias("ord")] if with_order else []
    return x.groupBy("org_key").agg(F.coalesce(F.min_by("label", "ord"), F.lit("unknown")).alias("display"), F.count("*").alias("n_docs"), *first)


def organisation_fragments(buckets: DataFrame, order: Column) -> DataFrame:
    """first_key, second_key: the first pair of buckets, in order, that look like one organisation.

    One name before its legal form, or one name the beginning of the other, which share their first word. Buckets are candidates
    only under an equal name or an equal first word, so the join has keys.
    """
    x = buckets.filter("org_key <> ''").select("org_key", pre_suffix_key("display").alias("pre"), F.split("org_key", " ")[0].alias("head"), order.alias("ord"))
    keyed = x.withColumn("probe", F.explode(F.array_distinct(F.array(F.concat(F.lit("p:"), "pre"), F.concat(F.lit("h:"), "head")))))
    a, b = (keyed.select("probe", *(F.col(c).alias(f"{p}_{c}") for c in ("org_key", "pre", "head", "ord"))) for p in "ab")
    prefix = lambda s, t: t.startswith(F.concat(s, F.lit(" ")))
    alike = (F.col("a_pre") == F.col("b_pre")) | ((F.col("a_head") == F.col("b_head")) & (prefix(F.col("a_org_key"), F.col("b_org_key")) | prefix(F.col("b_org_key"), F.col("a_org_key"))))
    found = a.join(b, "probe").filter((F.col("a_ord") < F.col("b_ord")) & alike)
    best = found.agg(F.min(F.struct("a_ord", "b_ord", "a_org_key", "b_org_key")).alias("m")).filter("m is not null")
    return best.select(F.col("m.a_org_key").alias("first_key"), F.col("m.b_org_key").alias("second_key"))


def identification_failures(documents: DataFrame) -> DataFrame:
    """n_failed, n_docs, pct (half to even), notice if over a fifth failed."""
    failed = F.coalesce(F.col("org_reason").isin("llm_error", "truncated"), F.lit(False))
    g = documents.agg(F.count_if(failed).alias("n_failed"), F.count("*").alias("n_docs"))
    share = F.coalesce(F.try_divide(F.col("n_failed").cast("double"), F.col("n_docs")), F.lit(0.0))
    return g.select("n_failed", "n_docs", F.bround(share * 100).cast("int").alias("pct"), (share > 0.20).alias("notice"))


# The sentences of the warning on a corpus of several organisations.
SPANS, UNKNOWN = "⚠ Corpus spans {n} organizations: {names}.", " Plus {n} with no identified organization."
SCOPED = " Cross-org definition pairs are suppressed (--org-scope); pass --no-org-scope to compare across orgs."
UNSCOPED = " Cross-org definition pairs are still compared; pass --org-scope to suppress them. Best results come from one organization's documents at a time."


def corpus_warning(buckets: DataFrame, scoped: bool) -> DataFrame:
    """n_known, message: empty where there is one organisation at most. Names come in the order of column ord, if buckets have it, else of their keys; the first says what is counted."""
    known, n = F.col("org_key") != "", F.col("n_docs").cast("string")
    names = F.array_sort(F.collect_list(F.when(known, F.struct(F.col("ord" if "ord" in buckets.columns else "org_key").alias("o"), "display", n.alias("n")))))  # a bucket a row: organisations, not documents
    g = buckets.agg(F.count_if(known).alias("n_known"), names.alias("names"), F.coalesce(F.sum(F.when(~known, F.col("n_docs"))), F.lit(0)).alias("unknown"))
    listed = F.array_join(F.transform("names", lambda x, i: F.concat(x["display"], F.lit(" ("), x["n"], F.when(i == 0, " docs").otherwise(""), F.lit(")"))), ", ")
    head = F.replace(F.replace(F.lit(SPANS), F.lit("{n}"), F.col("n_known").cast("string")), F.lit("{names}"), listed)
    count = F.concat(F.col("unknown").cast("string"), F.when(F.col("unknown") == 1, " doc").otherwise(" docs"))
    extra = F.when(F.col("unknown") > 0, F.replace(F.lit(UNKNOWN), F.lit("{n}"), count)).otherwise("")
    return g.select("n_known", F.when(F.col("n_known") > 1, F.concat(head, extra, F.lit(SCOPED if scoped else UNSCOPED))).otherwise("").alias("message"))
