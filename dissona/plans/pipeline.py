"""The detectors, end to end. What a model has answered is written to the shared folder before anything reads it, so it is asked once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.functions.ids import hash_id
from dissona.functions.quantities import extract_quantities, numeric_context, short_circuit, sign_flips, value_disagreements
from dissona.operators import definitions as defs
from dissona.operators.audit import finding_id, suppressed_findings
from dissona.operators.evaluation import best_label, stronger_direction
from dissona.operators.gate import ann_gate, within_corpus
from dissona.runtime import durable, exists

from .plugins import VERDICT_TYPE, Judge, MultiPartyJudge, NliChecker, multi_verdict, nli_both, verdict


def candidate_rows(pairs: DataFrame, assertions: DataFrame) -> DataFrame:
    """Pairs with both texts, and both texts' quantities if the assertions have a column of them; a pair whose assertion is gone is left out."""
    out = pairs
    for p in "ab":
        more = [F.col("quantities").alias(f"q{p}")] if "quantities" in assertions.columns else []
        out = out.join(assertions.select(F.col("assertion_id").alias(f"{p}_id"), F.col("assertion_text").alias(f"{p}_text"), *more), f"{p}_id")
    return out


def with_quantities(assertions: DataFrame) -> DataFrame:
    """assertion_id, assertion_text, quantities: extracted once for each different text, however many pairs and assertions have it. Null without a number."""
    x = assertions.select("assertion_id", "assertion_text", F.coalesce(F.regexp("assertion_text", F.lit(r"(?U)\d")), F.lit(False)).alias("numbered"))
    spark = assertions.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = x.filter("numbered").select("assertion_text").distinct().repartition(spread)  # extraction takes long, whatever the texts' size
    found = durable(texts.select("assertion_text", extract_quantities("assertion_text").alias("quantities")))  # no filter on them, which would extract before the texts are told apart
    own = x.filter("numbered").drop("numbered").join(found, "assertion_text", "left").select("assertion_id", "assertion_text", "quantities")
    return own.unionByName(x.filter("not numbered").select("assertion_id", "assertion_text"), allowMissingColumns=True)


def pairwise_pass(pairs: DataFrame, assertions: DataFrame, *, run_id: str, checker: NliChecker, judge: Judge, threshold: float = 0.5) -> DataFrame:
    """Findings of candidate pairs (a_id, b_id, score): the stronger of both directions at the threshold, then numbers, then the judge.

    Both directions are scored in one pass, and only pairs at the threshold are kept, with what their numbers say.
    """
    x = candidate_rows(pairs, durable(with_quantities(assertions)))
    scored = x.withColumn("s", nli_both(x, "a_text", "b_text", checker))
    side = lambda d: F.struct(*(F.col(f"s.{d}_{n}").alias(n) for n in ("p_contradiction", "p_entailment", "p_neutral")))
    p = F.col("p")
    kept = scored.withColumn("p", stronger_direction(side("f"), side("g"))).filter(p["p_contradiction"] >= threshold)
    meet = F.col("qa").isNotNull() & F.col("qb").isNotNull()
    said = kept.withColumn("short", F.when(meet, short_circuit(sign_flips("qa", "qb")))).withColumn("context", F.when(meet, numeric_context(value_disagreements("qa", "qb"))))
    numbers = durable(said.select("a_id", "b_id", "score", "a_text", "b_text", "p", "short", "context"))
    columns = ["a_id", "b_id", "score", "p", "v"]
    shorted = numbers.filter("short is not null").withColumn("v", F.col("short")).select(*columns)
    rest = numbers.filter("short is null")
    judged = durable(rest.withColumn("v", verdict(rest, "a_text", "b_text", "context", judge)).select(*columns))
    out = shorted.unionByName(judged).select(F.lit(run_id).alias("run_id"), F.col("a_id").alias("assertion_a_id"), F.col("b_id").alias("assertion_b_id"), F.lit("contradiction").alias("detector_type"), F.col("score").alias("gate_score"), best_label(p["p_contradiction"], p["p_entailment"], p["p_neutral"]).alias("nli_label"), p["p_contradiction"].alias("nli_p_contradiction"), p["p_entailment"].alias("nli_p_entailment"), p["p_neutral"].alias("nli_p_neutral"), F.col("v.verdict").alias("judge_verdict"), F.col("v.rationale").alias("judge_rationale"), F.col("v.evidence_spans").alias("evidence_spans"))
    return out.select(finding_id().alias("finding_id"), "*")


def gated_pairs(assertions: DataFrame, *, members: DataFrame | None = None, k: int = 20, threshold: float = 0.7) -> DataFrame:
    """Candidates of assertions (assertion_id, doc_id, embedding), over all corpora; then those of which both are members.

    The gate's kernel works on numbers, so ids are mapped to longs by hash and back.
    """
    x = durable(assertions.filter("embedding is not null").select(F.xxhash64("assertion_id").alias("id"), "assertion_id", "doc_id", "embedding"))
    found = ann_gate(x, k=k, threshold=threshold)
    for p in "ab":
        found = found.join(x.select(F.col("id").alias(f"{p}_id"), F.col("assertion_id").alias(f"{p}_name")), f"{p}_id").drop(f"{p}_id")
    pairs = found.select(F.least("a_name", "b_name").alias("a_id"), F.greatest("a_name", "b_name").alias("b_id"), "score")
    return pairs if members is None else within_corpus(pairs, members, "assertion_id")


def with_term(term: Column) -> Column:
    """The term that two definitions are judged on; a missing one raises."""
    return F.when(term.isNotNull() & (term != ""), term).otherwise(F.raise_error(F.lit("definitions are judged on a term")))


VERDICTS = "key string, verdict string, rationale string, evidence_spans array<string>"


def judged_once(questions: DataFrame, judge: Judge, folder: str | None = None) -> DataFrame:
    """VERDICTS of questions (key, a_text, b_text, context): each key is asked for once, and not if the folder has it.

    The folder, a Parquet table, keeps verdicts from run to run: new ones are written there before anything reads them. Without one
    they are checkpointed.
    """
    spark = questions.sparkSession
    asked = questions.groupBy("key").agg(F.first(F.struct("a_text", "b_text", "context")).alias("q")).select("key", "q.*")
    have = spark.createDataFrame([], VERDICTS)
    if folder is not None and exists(spark, folder):
        have = spark.read.schema(VERDICTS).parquet(folder).dropDuplicates(["key"])
        asked = asked.join(have, "key", "left_anti")
    spread = asked.repartition(spark.sparkContext.defaultParallelism, "key")  # calls take long, whatever their texts' size
    answers = spread.withColumn("v", verdict(spread, "a_text", "b_text", "context", judge)).select("key", "v.*")
    answers = durable(answers)
    if folder is not None:
        answers.write.mode("append").parquet(folder)
    return have.join(answers, "key", "left_anti").unionByName(answers)


def judged_classes(assertions: DataFrame, documents: DataFrame, *, judge: Judge, scoped: bool = False, verdicts: str | None = None, judge_name: str = "") -> tuple[DataFrame, DataFrame]:
    """What definition_pass says, in size of the different definitions: members (assertion_id, class_id) and class_a, class_b, n_pairs, v, suppressed.

    n_pairs is how many pairs of definitions a row stands for; no pair is made.
    """
    found = defs.with_organisation(defs.definitions(assertions), documents)
    members, classes = defs.definition_classes(found, exact=True)
    classes = durable(classes.withColumn("suppressed", F.lit(scoped) & F.col("cross_org")))
    key = F.sha2(F.to_json(F.struct(F.lit(judge_name).alias("j"), "term_key", "text_a", "text_b")), 256)
    texts = classes.withColumns({"text_a": F.least("text_a", "text_b"), "text_b": F.greatest("text_a", "text_b")})
    open_ = texts.filter("not suppressed and not same_text").withColumn("key", key)
    answers = judged_once(open_.select("key", F.col("text_a").alias("a_text"), F.col("text_b").alias("b_text"), with_term(F.col("term_key")).alias("context")), judge, verdicts)
    auto = F.struct(F.lit("definition_consistent_auto").alias("verdict"), F.lit("Definitions are equal but for case, spaces and marks at the ends.").alias("rationale"), F.array().cast("array<string>").alias("evidence_spans"))
    pair = ["class_a", "class_b", "n_pairs"]
    said = open_.select(*pair, "key").join(answers.select("key", F.struct("verdict", "rationale", "evidence_spans").alias("v")), "key").select(*pair, "v", F.lit(False).alias("suppressed"))
    same = texts.filter("not suppressed and same_text").select(*pair, auto.alias("v"), F.lit(False).alias("suppressed"))
    hidden = texts.filter("suppressed").select(*pair, F.lit(None).cast(VERDICT_TYPE).alias("v"), F.lit(True).alias("suppressed"))
    return members, said.unionByName(same).unionByName(hidden)


def definition_pass(assertions: DataFrame, documents: DataFrame, *, run_id: str, judge: Judge, scoped: bool = False, verdicts: str | None = None, judge_name: str = "") -> DataFrame:
    """Findings of definition pairs: kept apart by organisation, equal in text, or judged.

    The judge is asked once for each two different texts of a term, in their alphabetical order, not for each pair of definitions:
    definitions of one term, organisation and text are a class, classes meet, and what is said of them goes to their members. With a
    folder of verdicts, texts that judge_name has judged in an earlier run aren't asked for again.
    """
    members, judged = judged_classes(assertions, documents, judge=judge, scoped=scoped, verdicts=verdicts, judge_name=judge_name)
    members = durable(members)
    side = lambda p: members.select(F.col("class_id").alias(f"class_{p}"), F.col("assertion_id").alias(f"id_{p}"))
    pairs = judged.join(side("a"), "class_a").join(side("b"), "class_b").filter((F.col("class_a") != F.col("class_b")) | (F.col("id_a") < F.col("id_b")))
    pairs = pairs.withColumn("a_id", F.least("id_a", "id_b")).withColumn("b_id", F.greatest("id_a", "id_b"))
    live = pairs.filter("not suppressed").select(F.lit(run_id).alias("run_id"), F.col("a_id").alias("assertion_a_id"), F.col("b_id").alias("assertion_b_id"), F.lit("definition_inconsistency").alias("detector_type"), F.col("v.verdict").alias("judge_verdict"), F.col("v.rationale").alias("judge_rationale"), F.col("v.evidence_spans").alias("evidence_spans"), F.lit(False).alias("suppressed"))
    return live.select(finding_id("definition_inconsistency").alias("finding_id"), "*").unionByName(suppressed_findings(pairs, run_id), allowMissingColumns=True)


def judged_triangles(found: DataFrame, assertions: DataFrame, run_id: str, judge: MultiPartyJudge) -> DataFrame:
    """triangle_findings with a judge's verdict on the three texts, in order of ids."""
    x = found
    for p in "abc":
        x = x.join(assertions.select(F.col("assertion_id").alias(f"{p}_id"), F.col("assertion_text").alias(f"{p}_text")), f"{p}_id")
    x = x.withColumn("texts", F.array("a_text", "b_text", "c_text"))
    asked = durable(x.withColumn("v", multi_verdict(x, "texts", judge)))
    rows = triangle_findings(asked, run_id)
    verdicts = asked.select(F.array("a_id", "b_id", "c_id").alias("assertion_ids"), F.col("v.verdict").alias("judge_verdict"), F.col("v.rationale").alias("judge_rationale"), F.col("v.evidence_spans").alias("evidence_spans"), F.col("v.contradicting_subset").alias("contradicting_subset"))
    return rows.join(verdicts, "assertion_ids")


def triangle_findings(found: DataFrame, run_id: str) -> DataFrame:
    """Rows of three-party findings, ids sorted, before a judge."""
    ids = F.array("a_id", "b_id", "c_id")
    return found.select(hash_id(F.lit(run_id), F.array_join(F.transform(ids, lambda x: x.cast("string")), "")).alias("finding_id"), F.lit(run_id).alias("run_id"), ids.alias("assertion_ids"), F.array(F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("s_ab").alias("score")), F.struct(F.col("a_id").alias("a"), F.col("c_id").alias("b"), F.col("s_ac").alias("score")), F.struct(F.col("b_id").alias("a"), F.col("c_id").alias("b"), F.col("s_bc").alias("score"))).alias("edge_scores"))
