"""Sinks: exports, reports, metrics."""

from __future__ import annotations

import uuid
from collections import Counter
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dissona.functions.text import doc_label, quoted_spans, score_text, slug

ASSERTION_COLUMNS = ("assertion_id", "doc_id", "assertion_text")


def assertion_export(assertions: DataFrame, columns: tuple[str, ...] = ASSERTION_COLUMNS) -> DataFrame:
    """The chosen columns in the export's order; an unknown one raises."""
    if unknown := [c for c in columns if c not in assertions.columns]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return assertions.orderBy("doc_id", "created_at", "assertion_id").select(*columns)


def assertion_lines(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """One JSON line per assertion, nulls kept, with the document's path and date."""
    x = assertions.join(documents.select("doc_id", "source_path", "doc_date"), "doc_id", "left").orderBy("doc_id", "created_at", "assertion_id")
    return x.select(F.to_json(F.struct(*assertions.columns, "source_path", "doc_date"), {"ignoreNullFields": "false"}).alias("value"))


def definition_export(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """Definitions with the document's label; the text itself where a definition has none of its own."""
    label = documents.select("doc_id", doc_label("title", "source_path", "doc_id").alias("document"))
    x = assertions.filter("kind = 'definition'").join(label, "doc_id", "left")
    return x.select("assertion_id", F.coalesce("document", F.col("doc_id").cast("string")).alias("document"), "term", F.coalesce(F.nullif("definition_text", F.lit("")), "assertion_text").alias("definition"))


FINDING_COLUMNS = ("finding_id", "detector_type", "doc_a", "doc_b", "text_a", "text_b", "verdict", "reviewer")


def finding_export(hydrated: DataFrame, chip: str = "all") -> DataFrame:
    """FINDING_COLUMNS of a run's findings under a filter, by document labels."""
    from dissona.operators import audit

    x = audit.chip(hydrated, chip).orderBy("doc_a_label", "doc_b_label", "finding_id")
    return x.select("finding_id", "detector_type", F.col("doc_a_label").alias("doc_a"), F.col("doc_b_label").alias("doc_b"), F.col("a_text").alias("text_a"), F.col("b_text").alias("text_b"), F.col("judge_verdict").alias("verdict"), F.col("reviewer_verdict").alias("reviewer"))


def assertion_table(assertions: DataFrame, documents: DataFrame) -> DataFrame:
    """Seven columns with the document's label."""
    label = documents.select("doc_id", doc_label("title", "source_path", "doc_id").alias("document"))
    x = assertions.join(label, "doc_id", "left").withColumn("document", F.coalesce("document", F.col("doc_id").cast("string")))
    return x.orderBy("document", "assertion_id").select("assertion_id", "document", "assertion_text", "kind", "term", "char_start", "char_end")


def junk_drops(elements: DataFrame, stage: str, reason) -> DataFrame:
    """stage, reason, doc_id, text_snippet (200 characters) of what a junk rule drops; count by reason for the summary."""
    return elements.withColumn("reason", reason).filter("reason is not null").select(F.lit(stage).alias("stage"), "reason", "doc_id", F.substring("text", 1, 200).alias("text_snippet"))


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').option("compression", compression).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def precision_rows(precision: DataFrame) -> DataFrame:
    """For a file: six decimals, empty where there is none."""
    return precision.orderBy("detector_type").select("detector_type", "n_confirmed", "n_false_positive", "n_dismissed", F.coalesce(F.format_number("precision", 6), F.lit("")).alias("precision"))


def stamp(at: datetime) -> str:
    return at.strftime("%Y-%m-%dT%H-%M-%S")


def output_name(kind: str, at: datetime, run_id: str = "") -> str:
    """cc_report_<time>_<run>.md, cc_assertions_<time>.csv or .jsonl, cc_eval_<kind>_<time>.csv."""
    return {"report": f"cc_report_{stamp(at)}_{run_id[:8]}.md", "csv": f"cc_assertions_{stamp(at)}.csv", "jsonl": f"cc_assertions_{stamp(at)}.jsonl"}.get(kind, f"cc_eval_{kind}_{stamp(at)}.csv")


def title_slug(column: str):
    return slug(column)


REVIEW = {"confirmed": "Confirmed", "dismissed": "Dismissed", None: "Pending review"}


def finding_sections(hydrated: DataFrame) -> DataFrame:
    """ord, section: Markdown of each finding that isn't a false positive, grouped by the sorted pair of documents. Made by expressions, so any number of findings can be written in parts."""
    x = hydrated.filter("reviewer_verdict is distinct from 'false_positive'")
    review = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for k in REVIEW.items() if k[0] for v in k)), F.col("reviewer_verdict")), F.lit("Pending review"))
    text = F.concat(
        F.lit("#### Finding `"), "finding_id", F.lit("`\n\n- **NLI p(contradiction):** "), score_text("nli_p_contradiction"), F.lit("\n- **Gate score:** "), score_text("gate_score"),
        F.lit("\n- **Evidence spans:** "), quoted_spans("evidence_spans"), F.lit("\n\n> **A** ("), "doc_a_label", F.lit("): "), "a_text", F.lit("\n\n> **B** ("), "doc_b_label", F.lit("): "), "b_text",
        F.lit("\n\n**Reviewer:** "), review, F.lit("\n\n**Rationale.** "), F.coalesce("judge_rationale", F.lit("")), F.lit("\n"),
    )
    first, second = F.least(F.struct("doc_a_id", "doc_a_label"), F.struct(F.col("doc_b_id").alias("doc_a_id"), F.col("doc_b_label").alias("doc_a_label"))), F.greatest(F.struct("doc_a_id", "doc_a_label"), F.struct(F.col("doc_b_id").alias("doc_a_id"), F.col("doc_b_label").alias("doc_a_label")))
    return x.select(F.struct(first["doc_a_id"].alias("a"), second["doc_a_id"].alias("b"), "finding_id").alias("ord"), F.concat(F.lit("### "), first["doc_a_label"], F.lit(" ⇄ "), second["doc_a_label"]).alias("heading"), text.alias("section"))


#: Findings of a part that a report in one string has at the most.
MOST_SHOWN = 1000
_LINE = "part int, a string, b string, c string, value string"


def _under_headings(sections: DataFrame, part: int) -> DataFrame:
    """Lines of sections (ord, heading, section): the first of a heading, next to each other in their order, has it above."""
    by = ["ord.a", "ord.b"] if "finding_id" in sections.schema["ord"].dataType.names else ["ord.a"]
    first = F.row_number().over(Window.partitionBy(*by, "heading").orderBy("ord")) == 1
    own = F.col("ord.finding_id") if len(by) == 2 else F.lit("")
    value = F.when(first, F.concat("heading", F.lit("\n\n"), "section")).otherwise(F.col("section"))
    return sections.select(F.lit(part).alias("part"), F.col("ord.a").alias("a"), F.col("ord.b").alias("b"), own.alias("c"), value.alias("value"))


def report_lines(run: dict, hydrated: DataFrame, multi: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """part, a, b, c, value: the Markdown report of one run as rows; ordered by the others, a value a line (or more) each, they are the report.

    multi: multi_party_sections, definitions: definition_sections. Nothing comes to the driver but whether a part has rows.
    """
    spark = hydrated.sparkSession
    found = hydrated.filter("judge_verdict = 'contradiction' and reviewer_verdict is distinct from 'false_positive'")
    fixed = [(0, "\n".join(["# Consistency check report", "", f"- Run: `{run['run_id']}`", f"- Assertions scanned: {run['n_assertions']}", f"- Candidate pairs (gated): {run['n_pairs_gated']}", f"- Pairs judged: {run['n_pairs_judged']}", f"- Contradictions found: {run['n_findings']}", "", "## Summary", ""]))]
    parts = []
    if found.isEmpty():
        fixed.append((1, "No contradictions found.\n"))
    else:
        fixed += [(1, "| NLI(p_contradiction) | Doc A | Doc B | Rationale |\n| --- | --- | --- | --- |"), (3, "\n## Findings\n")]
        row = F.concat(F.lit("| "), score_text("nli_p_contradiction"), F.lit(" | "), "doc_a_label", F.lit(" | "), "doc_b_label", F.lit(" | "), F.coalesce("judge_rationale", F.lit("")), F.lit(" |"))
        parts += [found.select(F.lit(2).alias("part"), F.col("finding_id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), row.alias("value")), _under_headings(finding_sections(found), 4)]
    if multi is not None and not multi.isEmpty():
        fixed.append((5, "## Multi-party findings\n"))
        parts.append(multi.select(F.lit(6).alias("part"), F.col("ord").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.col("section").alias("value")))
    if definitions is not None and not definitions.isEmpty():
        fixed.append((7, "## Definition findings\n"))
        parts.append(_under_headings(definitions, 8))
    out = spark.createDataFrame([(part, "", "", "", value) for part, value in fixed], _LINE)
    for p in parts:
        out = out.unionByName(p)
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """report_lines as a folder of text files, which are the report one after the other, in the order of their names. Any number of findings."""
    lines.orderBy("part", "a", "b", "c").select("value").write.mode("overwrite").text(path)


def shown_report(lines: DataFrame, most: int = MOST_SHOWN) -> str:
    """report_lines as one string, for people to read: of each part the first `most` findings, and how many more there are."""
    rank = F.row_number().over(Window.partitionBy("part").orderBy("a", "b", "c"))
    kept = lines.withColumn("rank", rank).filter(F.col("rank") <= most)
    rows = kept.orderBy("part", "a", "b", "c").select("part", "value").collect()  # `most` of each part
    out: list[str] = []
    full = {p for p, n in Counter(r["part"] for r in rows).items() if n == most}
    more = {r["part"]: r["n"] - most for r in lines.filter(F.col("part").isin(list(full))).groupBy("part").agg(F.count("*").alias("n")).collect() if r["n"] > most} if full else {}
    for i, r in enumerate(rows):
        out.append(r["value"])
        if r["part"] in more and (i + 1 == len(rows) or rows[i + 1]["part"] != r["part"]):
            out.append(f"… and {more[r['part']]} more\n")
    return "\n".join(out).rstrip("\n") + "\n"


def render_report(run: dict, hydrated: DataFrame, most: int = MOST_SHOWN) -> str:
    """The Markdown report of one run in one string."""
    return shown_report(report_lines(run, hydrated), most)


def definition_sections(hydrated: DataFrame) -> DataFrame:
    """ord, heading, section of definition findings that aren't consistent, by term without regard to case, then id."""
    x = hydrated.filter("reviewer_verdict is distinct from 'false_positive' and detector_type = 'definition_inconsistency' and judge_verdict = 'definition_divergent'")
    text = F.concat(F.lit("#### Finding `"), "finding_id", F.lit("`\n\n> **A** ("), "doc_a_label", F.lit("): "), "a_text", F.lit("\n\n> **B** ("), "doc_b_label", F.lit("): "), "b_text", F.lit("\n\n**Rationale.** "), F.coalesce("judge_rationale", F.lit("")), F.lit("\n"))
    return x.select(F.struct(F.lower("term").alias("a"), F.col("finding_id").alias("b")).alias("ord"), F.concat(F.lit("### "), "term").alias("heading"), text.alias("section"))


def multi_party_sections(findings: DataFrame, assertions: DataFrame) -> DataFrame:
    """ord, section of findings on several assertions, each with its texts in order of ids."""
    member = findings.select("finding_id", F.posexplode(F.array_sort("assertion_ids")).alias("position", "assertion_id")).join(assertions.select("assertion_id", "assertion_text"), "assertion_id")
    texts = member.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("position", "assertion_text"))).alias("t"))  # three or so
    x = findings.join(texts, "finding_id")
    body = F.array_join(F.transform("t", lambda p: F.concat(F.lit("> "), p["assertion_text"])), "\n\n")
    return x.select(F.col("finding_id").alias("ord"), F.concat(F.lit("#### Finding `"), "finding_id", F.lit("`\n\n"), body, F.lit("\n\n**Rationale.** "), F.coalesce("judge_rationale", F.lit("")), F.lit("\n")).alias("section"))


def metrics_table(metrics: DataFrame) -> str:
    """A Markdown table of a small frame of measures: floats as percentages with one decimal, a dash where there is none."""
    show = lambda v: "—" if v is None else f"{100 * v:.1f}%" if isinstance(v, float) else str(v)
    rows = metrics.collect()
    return "\n".join([f"| {' | '.join(metrics.columns)} |", f"|{' --- |' * len(metrics.columns)}", *(f"| {' | '.join(map(show, r))} |" for r in rows)]) + "\n"


def comparison_markdown(corpus: str, comparison: DataFrame, cost: float | None = None) -> str:
    """Markdown of evaluation.comparison's one row: counts, agreement, labels where there are any, costs where there are any."""
    r = comparison.first().asDict()
    percent = lambda v: "n/a" if v is None else f"{100 * v:.1f}%"
    lines = [f"# Baseline: {corpus}", "", f"- Findings total (with duplicates across runs): **{r['n_total']}**", f"- Findings union: **{r['n_union']}**", f"- Findings intersection: **{r['n_intersection']}**", f"- Cross-run agreement: **{percent(r['agreement'])}**", ""]
    if r["n_real"] or r["n_false_positive"]:
        lines += ["## Labels", "", f"- Real: **{r['n_real']}**", f"- False positive: **{r['n_false_positive']}**", f"- Dismissed: **{r['n_dismissed']}**", f"- Precision on union: **{percent(r['precision'])}**", ""]
    if cost:
        lines += ["## Cost", "", f"- Total cost across runs: **${cost:.2f}**", f"- Cost per real finding: **{'n/a' if not r['n_real'] else f'${cost / r['n_real']:.2f}'}**", ""]
    return "\n".join(lines).rstrip("\n") + "\n"


def append_json(df: DataFrame, path: str) -> None:
    """Adds JSON lines to a folder: events of OCR, drops of junk."""
    df.write.mode("append").json(path)


def rewrite_lines(lines: DataFrame, path: str) -> None:
    """Replaces a folder of lines at once: they are written beside it, then take its place."""
    spark = lines.sparkSession
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    lines.write.text(beside)
    here, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(here, True)
    if not store.rename(new, here):
        raise OSError(f"{beside} can't take the place of {path}")


def labelling_sheet(findings: DataFrame) -> DataFrame:
    """Findings of all runs for people to label, the label empty."""
    x = findings.select("finding_id", "doc_a", "span_a", "doc_b", "span_b", "type", "rationale", F.lit("").alias("label"), F.lit("").alias("notes"))
    return x.dropDuplicates(["finding_id"]).orderBy("finding_id")
