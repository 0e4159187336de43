"""Findings, reviewer verdicts and runs: append-only rows, and the views that the latest ones give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissona.functions.ids import hash_id, pair_key_of
from dissona.functions.text import doc_label, eta_text, percent

from .store import latest_wins

# States, verdicts, prices of a call.
TERMINAL = ("done", "failed")
REVIEWS = ("confirmed", "false_positive", "dismissed")
DETECTORS = ("contradiction", "definition_inconsistency", "multi_party")
FOUND = ("contradiction", "numeric_short_circuit", "definition_divergent", "multi_party_contradiction", "multi_party_conditional_contradiction")
CALL_COST = {"anthropic": (0.003, 0.010), "openai": (0.003, 0.010), "moonshot": (0.0001, 0.001), "fixture": (0.0, 0.0)}


def finding_id(detector: str = "contradiction", *, run: str = "run_id", a: str = "assertion_a_id", b: str = "assertion_b_id") -> Column:
    """A pair's id in a run; other detectors' names go into the hash."""
    mark = {"contradiction": [], "definition_inconsistency": [F.lit("definition")], "definition_suppressed": [F.lit("definition_suppressed")]}[detector]
    return hash_id(F.col(run), *mark, F.col(a), F.col(b))


def suppressed_findings(pairs: DataFrame, run_id: str) -> DataFrame:
    """Rows for definition pairs that organisations keep apart: no verdict."""
    x = pairs.filter("suppressed").select(F.lit(run_id).alias("run_id"), F.col("a_id").alias("assertion_a_id"), F.col("b_id").alias("assertion_b_id"))
    return x.select(finding_id("definition_suppressed").alias("finding_id"), "*", F.lit("definition_inconsistency").alias("detector_type"), F.lit(None).cast("string").alias("judge_verdict"), F.lit(True).alias("suppressed"))


def member_rows(multi: DataFrame) -> DataFrame:
    """finding_id, position, assertion_id of findings on several assertions, ids sorted. Under three ids or two documents raises."""
    ok = F.assert_true((F.size("assertion_ids") >= 3) & (F.size(F.array_distinct("doc_ids")) >= 2), F.lit("a finding on several assertions needs three ids and two documents"))
    return multi.withColumn("__ok", ok).filter("__ok is null").select("finding_id", F.posexplode(F.array_sort("assertion_ids")).alias("position", "assertion_id"))


def current_reviews(events: DataFrame) -> DataFrame:
    """pair_key, detector_type, verdict, note, set_at: of verdict events the latest each; a null verdict takes it back (undo)."""
    return latest_wins(events, ["pair_key", "detector_type"], "set_at").filter("verdict is not null")


def checked_reviews(events: DataFrame) -> DataFrame:
    """The events; a verdict outside the list raises. Null, written IS NULL, takes a verdict back."""
    return events.filter(F.assert_true(F.col("verdict").isNull() | F.col("verdict").isin(*REVIEWS), F.lit("unknown verdict")).isNull())


def run_states(events: DataFrame) -> DataFrame:
    """run_id, status, started_at, finished_at from events (run_id, status, at, seq): terminal states are written once, the first stays."""
    last = F.col("status").isin(*TERMINAL)
    g = events.groupBy("run_id").agg(
        F.min(F.when(last, F.struct("seq", "status", "at"))).alias("end"),
        F.max(F.struct("seq", "status")).alias("now"),
        F.min("at").alias("started_at"),
    )
    return g.select("run_id", F.coalesce("end.status", "now.status").alias("status"), "started_at", F.col("end.at").alias("finished_at"))


def latest_runs(runs: DataFrame, *, only_checks: bool = False) -> DataFrame:
    """The latest run of each corpus, whatever its kind unless only_checks."""
    rows = runs.filter("run_kind = 'check'") if only_checks else runs
    rest = [c for c in rows.columns if c != "corpus_id"]
    return rows.groupBy("corpus_id").agg(F.max(F.struct(F.col("started_at").alias("__s"), F.col("run_id").alias("__r"), *rest)).alias("m")).select("corpus_id", *(F.col("m")[c].alias(c) for c in rest))


def filtered_findings(findings: DataFrame, *, run_id: str | None = None, verdict: str | None = None, detector: str | None = None, suppressed: bool | None = None) -> DataFrame:
    for name, v in (("run_id", run_id), ("judge_verdict", verdict), ("detector_type", detector), ("suppressed", suppressed)):
        if v is not None:
            findings = findings.filter(F.col(name) == v)
    return findings


def with_reviews(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with the reviewer's verdict on their pair, null where there is none."""
    key = pair_key_of(F.array("assertion_a_id", "assertion_b_id"))
    r = reviews.select("pair_key", "detector_type", F.col("verdict").alias("reviewer_verdict"))
    return findings.withColumn("pair_key", key).withColumn("detector_type", F.coalesce("detector_type", F.lit("contradiction"))).join(r, ["pair_key", "detector_type"], "left")


def multi_party_findings(multi: DataFrame, *, run_id: str | None = None, verdict: str | None = None) -> DataFrame:
    """Findings on several assertions of a run, with a verdict."""
    return filtered_findings(multi, run_id=run_id, verdict=verdict)


def with_multi_reviews(multi: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings on several assertions with the reviewer's verdict on their sorted ids, null where there is none."""
    r = reviews.filter("detector_type = 'multi_party'").select("pair_key", F.col("verdict").alias("reviewer_verdict"))
    return multi.withColumn("pair_key", pair_key_of("assertion_ids")).withColumn("detector_type", F.lit("multi_party")).join(r, "pair_key", "left")


def reviewed_rows(findings: DataFrame, multi: DataFrame, reviews: DataFrame) -> DataFrame:
    """detector_type, judge_verdict, reviewer_verdict of all findings that a reviewer has seen, of pairs and of several assertions."""
    kept = ["detector_type", "judge_verdict", "reviewer_verdict"]
    return with_reviews(findings, reviews).select(*kept).unionByName(with_multi_reviews(multi, reviews).select(*kept)).filter("reviewer_verdict is not null")


def drawer(reviewed: DataFrame, *, show_reviewed: bool = False) -> DataFrame:
    """What is still to be reviewed; everything with show_reviewed."""
    return reviewed if show_reviewed else reviewed.filter("reviewer_verdict is null")


def assertion_detail(assertions: DataFrame, documents: DataFrame, assertion_id) -> DataFrame:
    """One assertion with its document's label; the id stands for a document that is gone."""
    label = documents.select("doc_id", doc_label("title", "source_path", "doc_id").alias("doc_label"))
    return assertions.filter(F.col("assertion_id") == assertion_id).join(label, "doc_id", "left").withColumn("doc_label", F.coalesce("doc_label", F.col("doc_id").cast("string")))


def active_corpus(corpora: DataFrame, runs: DataFrame, requested=None) -> DataFrame:
    """corpus_id: the requested one if there is such a corpus, else that of the run that ended last, else the first by name; none without corpora."""
    asked = corpora.filter(F.col("corpus_id") == F.lit(requested)).select("corpus_id", F.lit(0).alias("rank"), F.lit(None).cast("timestamp").alias("at"), "corpus_name")
    last = runs.filter("finished_at is not null and corpus_id is not null").groupBy("corpus_id").agg(F.max("finished_at").cast("timestamp").alias("at"))
    # a corpus that is gone gives way to the first, not to the next run
    latest = last.orderBy(F.desc("at"), "corpus_id").limit(1).join(corpora.select("corpus_id", "corpus_name"), "corpus_id").select("corpus_id", F.lit(1).alias("rank"), "at", "corpus_name")
    first = corpora.select("corpus_id", F.lit(2).alias("rank"), F.lit(None).cast("timestamp").alias("at"), "corpus_name").orderBy("corpus_name", "corpus_id").limit(1)
    return asked.unionByName(latest).unionByName(first).orderBy("rank").limit(1).select("corpus_id")


def live_counters(run: DataFrame, findings: DataFrame, multi: DataFrame) -> DataFrame:
    """A run's counters with its findings by kind, a percentage and the time that is left; run: run_id, run_status, n_pairs_gated, n_pairs_judged, elapsed (seconds)."""
    own = findings.groupBy("run_id").agg(F.count_if(F.col("detector_type") == "definition_inconsistency").alias("n_definition_pairs_judged"), F.count_if(F.col("judge_verdict") == "definition_divergent").alias("n_definition_findings"))
    more = multi.groupBy("run_id").agg(F.count("*").alias("n_multi_party_findings"))
    counts = ["n_definition_pairs_judged", "n_definition_findings", "n_multi_party_findings"]
    gated, judged = F.coalesce("n_pairs_gated", F.lit(0)), F.coalesce("n_pairs_judged", F.lit(0))
    done = F.when((gated > 0) & (judged > 0), percent(judged, gated)).when(F.col("run_status") == "done", 100).otherwise(0)
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("pending", "Queued", "running", "Running", "done", "Done", "failed", "Failed"))), F.col("run_status")), F.lit("Unknown"))
    x = run.join(own, "run_id", "left").join(more, "run_id", "left")
    return x.select(*run.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), done.alias("percent"), eta_text(gated, judged, F.col("elapsed")).alias("time_left"), label.alias("label"))


def not_false_positive(reviewed: DataFrame) -> DataFrame:
    """Without what reviewers called a false positive; what none has seen stays."""
    return reviewed.filter("reviewer_verdict is distinct from 'false_positive'")


def chip(reviewed: DataFrame, name: str) -> DataFrame:
    """all, open (not reviewed), or one verdict; an unknown name is all."""
    if name == "open":
        return reviewed.filter("reviewer_verdict is null")
    return reviewed.filter(F.col("reviewer_verdict") == name) if name in REVIEWS else reviewed


def chip_counts(reviewed: DataFrame) -> DataFrame:
    v = F.col("reviewer_verdict")
    return reviewed.agg(F.count("*").alias("n_all"), F.count_if(v.isNull()).alias("n_open"), *(F.count_if(v == x).alias(f"n_{x}") for x in REVIEWS))


def hydrated(findings: DataFrame, assertions: DataFrame, documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings with texts and document labels of both sides and the review. A finding whose assertion is gone is left out; a missing document is named by its id."""
    label = documents.select("doc_id", doc_label("title", "source_path", "doc_id").alias("label"))
    out = with_reviews(findings, reviews)
    for p in "ab":
        side = assertions.select(F.col("assertion_id").alias(f"assertion_{p}_id"), F.col("assertion_text").alias(f"{p}_text"), F.col("doc_id").alias(f"doc_{p}_id"))
        named = label.select(F.col("doc_id").alias(f"doc_{p}_id"), F.col("label").alias(f"doc_{p}_label"))
        out = out.join(side, f"assertion_{p}_id").join(named, f"doc_{p}_id", "left").withColumn(f"doc_{p}_label", F.coalesce(f"doc_{p}_label", F.col(f"doc_{p}_id").cast("string")))
    return out


def verdict_counts(reviews: DataFrame, detector: str | None = None) -> DataFrame:
    rows = reviews if detector is None else reviews.filter(F.col("detector_type") == detector)
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def detector_totals(findings: DataFrame, multi: DataFrame) -> DataFrame:
    """detector_type, n: all verdicts count, suppressed rows too."""
    one = findings.select(F.coalesce("detector_type", F.lit("contradiction")).alias("detector_type"))
    return one.unionByName(multi.select(F.lit("multi_party").alias("detector_type"))).groupBy("detector_type").agg(F.count("*").alias("n"))


def run_counters(pairs: DataFrame) -> DataFrame:
    """n_gated, n_judged, n_findings of staged pairs (in_corpus, passed_nli, verdict)."""
    kept = F.col("in_corpus")
    return pairs.agg(F.count_if(kept).alias("n_gated"), F.count_if(kept & F.col("verdict").isNotNull()).alias("n_judged"), F.count_if(kept & F.col("verdict").isin(*FOUND)).alias("n_findings"), F.count_if(~kept).alias("n_dropped"))


def cost_estimate(n_pairs: DataFrame, n_definitions: DataFrame, provider: str = "moonshot") -> DataFrame:
    """n_calls, cost_low, cost_high of one-row counts n; neither the language-inference gate nor triangles are in it."""
    low, high = CALL_COST[provider]
    n = F.col("n") + F.col("m")
    return n_pairs.select("n").join(F.broadcast(n_definitions.select(F.col("n").alias("m")))).select(n.alias("n_calls"), F.round(n * low, 6).alias("cost_low"), F.round(n * high, 6).alias("cost_high"))


def run_cost_bound(counters: DataFrame, provider: str = "moonshot", keys: tuple[str, ...] = ()) -> DataFrame:
    """cost_high of a run, with its keys: its judged pairs (n_judged) and definition findings (n_definitions) at the high price."""
    return counters.select(*keys, F.round((F.col("n_judged") + F.col("n_definitions")) * CALL_COST[provider][1], 6).alias("cost_high"))


class CostCeilingError(RuntimeError):
    """A check would cost more than allowed."""


def guard_cost(estimate: DataFrame, ceiling: float | None) -> None:
    """Raises where the high estimate is above the ceiling, before anything runs."""
    if ceiling is not None and (high := estimate.first()["cost_high"]) > ceiling:
        raise CostCeilingError(f"the estimate, {high:.2f}, is above {ceiling:.2f}")


def last_check(runs: DataFrame) -> DataFrame:
    """The check that began last, of equals that with the greatest run_id: a row, or none."""
    return runs.filter("run_kind = 'check'").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def of_corpora(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings with the corpus_id of their run; those of no known run are left out."""
    return findings.join(runs.select("run_id", "corpus_id"), "run_id")


def sidebar(corpora: DataFrame, documents: DataFrame, assertions: DataFrame, runs: DataFrame) -> DataFrame:
    """corpus_id, corpus_name, n_assertions, n_runs, active: corpora without any stay."""
    a = assertions.join(documents.select("doc_id", "corpus_id"), "doc_id").groupBy("corpus_id").agg(F.count("*").alias("n_assertions"))
    r = runs.groupBy("corpus_id").agg(F.count("*").alias("n_runs"), F.max(F.col("run_status").isin("pending", "running")).alias("active"))
    out = corpora.select("corpus_id", "corpus_name").join(a, "corpus_id", "left").join(r, "corpus_id", "left")
    return out.select("corpus_id", "corpus_name", F.coalesce("n_assertions", F.lit(0)).alias("n_assertions"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("active", F.lit(False)).alias("active"))
