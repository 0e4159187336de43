"""Scoring of judges on labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.functions.ids import unordered_finding_id
from dissona.functions.quantities import extract_quantities, numeric_context, short_circuit, sign_flips, value_disagreements
from dissona.operators import evaluation
from dissona.operators.definitions import comparable_definition
from dissona.runtime import durable
from dissona.sources import readers, sinks

from .plugins import Judge, verdict


def pair_documents(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, text of both sides of labelled pairs, under made-up document names <pair>_a and <pair>_b."""
    side = lambda c, p: pairs.select(F.concat("pair_id", F.lit(f"_{p}")).alias("doc_id"), F.col(c).alias("text"))
    return side(a, "a").unionByName(side(b, "b"))


def definition_sentence(term: Column, definition: Column) -> Column:
    return F.concat(F.lit('"'), term, F.lit('" means '), definition)


def judged(pairs: DataFrame, a: str, b: str, judge: Judge, *, numbers: bool = True) -> DataFrame:
    """pairs with raw, the verdict: by numbers where those flip, else by the judge."""
    x = pairs.withColumn("__a", extract_quantities(a)).withColumn("__b", extract_quantities(b))
    x = x.withColumn("__s", short_circuit(sign_flips("__a", "__b")) if numbers else F.lit(None).cast("struct<verdict:string,rationale:string,evidence_spans:array<string>>")).withColumn("__c", numeric_context(value_disagreements("__a", "__b"))).drop("__a", "__b")
    sure, rest = x.filter("__s is not null"), x.filter("__s is null")
    asked = durable(rest.withColumn("raw", verdict(rest, a, b, "__c", judge)["verdict"]))
    return sure.withColumn("raw", F.col("__s.verdict")).unionByName(asked).drop("__s", "__c")


def document_pairs(pairs: DataFrame, judge: Judge) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 over labelled document pairs; 0 where a denominator is."""
    x = judged(pairs, "document_a", "document_b", judge).select(F.col("label").alias("gold"), evaluation.collapsed(F.col("raw")).alias("predicted"))
    return evaluation.scores(evaluation.confusion(x, "contradiction"), undefined=0.0)


def targeted_pairs(pairs: DataFrame, judge: Judge) -> DataFrame:
    """bucket_metrics of labelled assertion pairs; an uncertain judge abstains."""
    known = F.col("raw").isin("contradiction", "numeric_short_circuit")
    predicted = F.when(known, "contradiction").when(F.col("raw") == "uncertain", "uncertain").otherwise("not_contradiction")
    return evaluation.bucket_metrics(judged(pairs, "assertion_a", "assertion_b", judge).select("bucket", F.col("ground_truth").alias("gold"), predicted.alias("predicted")))


def definition_pairs(pairs: DataFrame, judge: Judge) -> tuple[DataFrame, DataFrame]:
    """Scores over labelled definitions (null where a denominator is zero), and accuracy by category. Equal texts need no judge."""
    x = pairs.withColumn("a", definition_sentence(F.col("term"), F.col("def_a"))).withColumn("b", definition_sentence(F.col("term"), F.col("def_b")))
    same = comparable_definition("a") == comparable_definition("b")
    out = durable(x.filter(same).withColumn("raw", F.lit("definition_consistent_auto")).unionByName(judged(x.filter(~same), "a", "b", judge, numbers=False)))
    rows = out.select("category", F.col("label").alias("gold"), evaluation.collapsed(F.col("raw"), "divergent").alias("predicted"))
    return evaluation.scores(evaluation.confusion(rows, "divergent")), evaluation.category_accuracy(rows)


def with_finding_ids(findings: DataFrame) -> DataFrame:
    """Run findings with ids that don't depend on which side comes first."""
    return findings.withColumn("finding_id", unordered_finding_id(F.col("doc_a"), F.col("span_a"), F.col("doc_b"), F.col("span_b")))


def compare_baseline(spark: SparkSession, runs: str, labels: str | None = None) -> str:
    """Markdown that compares run files (a folder or a pattern) with each other and with a labelled sheet."""
    found = with_finding_ids(readers.baseline_run(spark, runs))
    marks = readers.finding_labels(spark, labels) if labels else spark.createDataFrame([], "finding_id string, label string")
    first = found.agg(F.min("corpus_name").alias("corpus")).first()["corpus"] or ""
    cost = found.groupBy("run_id").agg(F.max("cost_usd").alias("c")).agg(F.sum("c").alias("c")).first()["c"]
    return sinks.comparison_markdown(first, evaluation.comparison(found, marks), cost)
