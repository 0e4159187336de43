"""Measures of verdicts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def detector_precision(reviewed: DataFrame) -> DataFrame:
    """detector_type, n_confirmed, n_false_positive, n_dismissed, precision: confirmed among confirmed and false positives, null where there are none."""
    v = F.col("reviewer_verdict")
    g = reviewed.groupBy("detector_type").agg(F.count_if(v == "confirmed").alias("n_confirmed"), F.count_if(v == "false_positive").alias("n_false_positive"), F.count_if(v == "dismissed").alias("n_dismissed"))
    return g.withColumn("precision", F.round(_ratio(F.col("n_confirmed"), F.col("n_confirmed") + F.col("n_false_positive")), 6))


def confusion(rows: DataFrame, positive: str) -> DataFrame:
    """tp, fp, fn, tn of columns gold and predicted."""
    g, p = F.col("gold").eqNullSafe(positive), F.col("predicted").eqNullSafe(positive)
    return rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def scores(counts: DataFrame, *, undefined: float | None = None) -> DataFrame:
    """precision, recall, f1 beside the counts; `undefined` where a denominator is zero. With null, f1 is null only if both others are."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    if undefined is not None:
        p, r = F.coalesce(p, F.lit(undefined)), F.coalesce(r, F.lit(undefined))
        f = F.coalesce(_ratio(2 * p * r, p + r), F.lit(undefined))
    else:
        zp, zr = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
        f = F.when(p.isNotNull() | r.isNotNull(), F.coalesce(_ratio(2 * zp * zr, zp + zr), F.lit(0.0)))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def bucket_metrics(rows: DataFrame) -> DataFrame:
    """bucket (null: all), n, accuracy, fp_rate over gold negatives, fn_rate over gold positives, abstain_rate.

    Columns bucket, gold, predicted hold contradiction, not_contradiction or uncertain.
    """
    g, p = F.col("gold") == "contradiction", F.col("predicted") == "contradiction"
    out = rows.groupingSets([[F.col("bucket")], []], F.col("bucket")).agg(
        F.count("*").alias("n"),
        F.round(_ratio(F.count_if(F.col("gold") == F.col("predicted")), F.count("*")), 6).alias("accuracy"),
        F.round(_ratio(F.count_if(~g & p), F.count_if(~g)), 6).alias("fp_rate"),
        F.round(_ratio(F.count_if(g & (F.col("predicted") == "not_contradiction")), F.count_if(g)), 6).alias("fn_rate"),
        F.round(_ratio(F.count_if(F.col("predicted") == "uncertain"), F.count("*")), 6).alias("abstain_rate"),
    )
    return out


def category_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


def collapsed(verdict: Column, positive: str = "contradiction") -> Column:
    """A verdict as a label: shortcuts count as the positive, all others as its opposite."""
    alias = F.when(verdict == "numeric_short_circuit", "contradiction").when(verdict == "definition_divergent", "divergent").otherwise(verdict)
    return F.when(alias == positive, positive).otherwise({"contradiction": "not_contradiction", "divergent": "consistent"}.get(positive, f"not_{positive}"))


def best_label(p_contradiction: Column, p_entailment: Column, p_neutral: Column) -> Column:
    """The likeliest; among equals contradiction, then entailment."""
    return F.when(p_contradiction >= F.greatest(p_entailment, p_neutral), "contradiction").when(p_entailment >= p_neutral, "entailment").otherwise("neutral")


def stronger_direction(forward: Column, backward: Column) -> Column:
    """Of two directions' structs that with the greater p_contradiction, forward among equals."""
    return F.when(forward["p_contradiction"] >= backward["p_contradiction"], forward).otherwise(backward)


def run_union(findings: DataFrame, order: Column) -> DataFrame:
    """One row for each finding_id over all runs, the first."""
    rest = [c for c in findings.columns if c != "finding_id"]
    g = findings.groupBy("finding_id").agg(F.min_by(F.struct(*rest), F.struct(order.alias("o"))).alias("m"))
    return g.select("finding_id", *(F.col("m")[c].alias(c) for c in rest))


def run_intersection(findings: DataFrame, n_runs: int | None = None) -> DataFrame:
    """finding_id of findings that all runs have."""
    by = findings.groupBy("finding_id").agg(F.count_distinct("run_id").alias("n"))
    if n_runs is not None:
        return by.filter(F.col("n") == n_runs).select("finding_id")
    return by.join(F.broadcast(findings.agg(F.count_distinct("run_id").alias("all"))), F.col("n") == F.col("all")).select("finding_id")


def comparison(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """n_total, n_union, n_intersection, agreement, n_real, n_false_positive, n_dismissed, precision over runs; labels (finding_id, label)."""
    per = findings.groupBy("finding_id").agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("rows"))
    x = per.join(labels.select("finding_id", "label"), "finding_id", "left").join(F.broadcast(findings.agg(F.count_distinct("run_id").alias("all"))))
    v = F.col("label")
    g = x.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_total"), F.count("*").alias("n_union"), F.count_if(F.col("runs") == F.col("all")).alias("n_intersection"), F.count_if(v == "real").alias("n_real"), F.count_if(v == "false_positive").alias("n_false_positive"), F.count_if(v == "dismissed").alias("n_dismissed"))
    return g.select("*", F.round(_ratio(F.col("n_intersection"), F.col("n_union")), 6).alias("agreement"), F.round(_ratio(F.col("n_real"), F.col("n_real") + F.col("n_false_positive")), 6).alias("precision"))
