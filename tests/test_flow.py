import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dissona.operators import audit
from dissona.plans import pipeline, plugins
from dissona.sources import readers, sinks
from dissona.streaming import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


def test_corpus_is_read_once_and_only_known_kinds(spark, tmp_path):
    write(tmp_path / "in/a.TXT", "line\r\nnext")
    write(tmp_path / "in/deep/b.md", "other")
    write(tmp_path / "in/c.bin", "no")
    got = {r["title"]: r["text"] for r in readers.load_corpus(spark, str(tmp_path / "in")).collect()}
    assert got == {"a": "line\nnext", "b": "other"}
    with pytest.raises(ValueError):
        readers.load_path(spark, str(tmp_path / "in/c.bin"))
    assert readers.load_path(spark, str(tmp_path / "in/a.TXT")).count() == 1


def test_upload_limits(spark):
    files = spark.createDataFrame([(f"{i:03}.txt", 5 << 20) for i in range(99)] + [("x.exe", 1), ("y.txt", 101 << 20), ("z1.txt", 1), ("z2.txt", 1)], "path string, length long")
    reasons = {r["path"]: r["reason"] for r in readers.upload_decisions(files).collect()}
    assert reasons["x.exe"] == "extension" and reasons["y.txt"] == "file_size" and reasons["z2.txt"] == "file_count" and reasons["z1.txt"] is None and reasons["000.txt"] is None


def test_stream_replay_adds_nothing(spark, tmp_path):
    write(tmp_path / "in/a.txt", "one")
    write(tmp_path / "in/copy.txt", "one")
    out = str(tmp_path / "out")
    for name in ("c1", "c2"):
        ingest.ingest(spark, str(tmp_path / "in"), out, str(tmp_path / name), "corpus").awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == 1
    write(tmp_path / "in/b.txt", "two")
    ingest.ingest(spark, str(tmp_path / "in"), out, str(tmp_path / "c2"), "corpus").awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == 2


def test_label_files(spark, tmp_path):
    write(tmp_path / "t.jsonl", "// note\n\n" + json.dumps({"pair_id": "1", "bucket": "rule_exception", "assertion_a": "a", "assertion_b": "b", "ground_truth": "uncertain", "relation": "override"}) + "\n")
    assert readers.targeted_pairs(spark, str(tmp_path / "t.jsonl")).count() == 1
    write(tmp_path / "u.jsonl", 2 * (json.dumps({"pair_id": "1", "bucket": "rule_exception", "assertion_a": "a", "assertion_b": "b", "ground_truth": "uncertain", "relation": "override"}) + "\n"))
    with pytest.raises(ValueError):
        readers.targeted_pairs(spark, str(tmp_path / "u.jsonl"))
    write(tmp_path / "r.json", json.dumps({"run_id": "r", "model": "m", "corpus_name": "c", "findings": '```json\n[{"doc_a":"a","span_a":"s","doc_b":"b","span_b":"t"}]\n```'}))
    assert [(r["run_id"], r["doc_a"], r["span_b"]) for r in readers.baseline_run(spark, str(tmp_path / "r.json")).collect()] == [("r", "a", "t")]
    write(tmp_path / "l.csv", "finding_id,doc_a,span_a,doc_b,span_b,type,rationale,label,notes\nf1,a,s,b,t,,,real,\nf2,a,s,b,t,,,,\n")
    assert readers.finding_labels(spark, str(tmp_path / "l.csv")).count() == 1


def test_config():
    c = readers.Config.read("gate_top_k: 5 # few\ndeep: yes\nmax_cost: 2.5", {"CC_GATE_TOP_K": "7"})
    assert (c.gate_top_k, c.deep, c.max_cost) == (7, True, 2.5)
    with pytest.raises(ValueError):
        readers.Config.read("nonsense: 1", {})
    assert readers.load_environment("A=1\nexport B='2'\n# C=3", {"A": "0"}) == {"A": "0", "B": "2"}


def test_pairwise_end_to_end(spark):
    texts = {"a": ("d1", "Revenue grew 12% in fiscal 2025."), "b": ("d2", "Revenue declined 5% in fiscal 2025."), "c": ("d3", "The plan began in 2024."), "e": ("d4", "The plan began in 2023."), "f": ("d5", "Nothing else.")}
    a = spark.createDataFrame([(k, d, t) for k, (d, t) in texts.items()], "assertion_id string, doc_id string, assertion_text string")
    a = a.withColumn("embedding", plugins.embedding(a, "assertion_text", plugins.HashEmbedder()))
    pairs = pipeline.gated_pairs(a, k=10, threshold=-1.0)
    assert pairs.count() == 10
    nli = plugins.FixtureNli({(texts["b"][1], texts["a"][1]): (0.9, 0.05, 0.05), (texts["c"][1], texts["e"][1]): (0.7, 0.2, 0.1)})
    judge = plugins.FixtureJudge({(texts["c"][1], texts["e"][1]): ("contradiction", "years differ", ["2024", "2023"])})
    found = {(r["assertion_a_id"], r["assertion_b_id"]): r for r in pipeline.pairwise_pass(pairs, a, run_id="r", checker=nli, judge=judge).collect()}
    assert set(found) == {("a", "b"), ("c", "e")}
    assert found["a", "b"]["judge_verdict"] == "numeric_short_circuit" and found["a", "b"]["nli_p_contradiction"] == 0.9
    assert found["c", "e"]["judge_verdict"] == "contradiction" and found["c", "e"]["nli_label"] == "contradiction"


def test_judge_that_fails_is_uncertain(spark):
    class Bad:
        def judge(self, a, b, c):
            raise ValueError("no")

    df = spark.createDataFrame([("x", "y", None)], "a string, b string, c string")
    assert df.select(plugins.verdict(df, "a", "b", "c", Bad()).alias("v")).first()["v"]["verdict"] == "uncertain"
    with pytest.raises(ValueError):
        plugins.make_judge("fixture", {})


def test_definition_pass(spark):
    a = spark.createDataFrame([("1", "d1", "Loan", '"Loan" means x.', "definition"), ("2", "d2", "Loans", '"LOANS" means x', "definition"), ("3", "d3", "Loan", '"Loan" means x', "definition")], "assertion_id string, doc_id string, term string, assertion_text string, kind string")
    d = spark.createDataFrame([("d1", "Acme"), ("d2", "Other"), ("d3", None)], "doc_id string, org_label string")
    judge = plugins.FixtureJudge({}, ("definition_divergent", "", []))
    got = {(r["assertion_a_id"], r["assertion_b_id"]): (r["judge_verdict"], r["suppressed"]) for r in pipeline.definition_pass(a, d, run_id="r", judge=judge, scoped=True).collect()}
    assert got == {("1", "2"): (None, True), ("1", "3"): ("definition_consistent_auto", False), ("2", "3"): ("definition_divergent", False)}


GOLDEN = """# Consistency check report

- Run: `run`
- Assertions scanned: 2
- Candidate pairs (gated): 1
- Pairs judged: 1
- Contradictions found: 1

## Summary

| NLI(p_contradiction) | Doc A | Doc B | Rationale |
| --- | --- | --- | --- |
| 0.83 | Second | d1 | Opposite signs. |

## Findings

### d1 ⇄ Second

#### Finding `f`

- **NLI p(contradiction):** 0.83
- **Gate score:** —
- **Evidence spans:** `grew`, `fell`

> **A** (Second): It grew.

> **B** (d1): It fell.

**Reviewer:** Pending review

**Rationale.** Opposite signs.
"""


def test_report(spark):
    f = spark.createDataFrame([("f", "run", "a2", "a1", None, "contradiction", 0.83, None, "Opposite signs.", ["grew", "fell"])], "finding_id string, run_id string, assertion_a_id string, assertion_b_id string, detector_type string, judge_verdict string, nli_p_contradiction double, gate_score double, judge_rationale string, evidence_spans array<string>")
    a = spark.createDataFrame([("a1", "d1", "It fell."), ("a2", "d2", "It grew.")], "assertion_id string, doc_id string, assertion_text string")
    d = spark.createDataFrame([("d2", "Second", "")], "doc_id string, title string, source_path string")
    none = spark.createDataFrame([], "pair_key string, detector_type string, verdict string")
    assert sinks.render_report({"run_id": "run", "n_assertions": 2, "n_pairs_gated": 1, "n_pairs_judged": 1, "n_findings": 1}, audit.hydrated(f, a, d, none)) == GOLDEN


def test_report_of_many_findings(spark, tmp_path):
    """Written by sorted partitions it is the string's text; the string shows the first of each part and counts the others."""
    rows = [(f"f{i:03}", "contradiction", f"d{i % 7}", f"d{i % 5 + 3}", f"D{i % 7}", f"D{i % 5 + 3}") for i in range(60)]
    f = spark.createDataFrame(rows, "finding_id string, judge_verdict string, doc_a_id string, doc_b_id string, doc_a_label string, doc_b_label string").select("*", F.lit(0.5).alias("nli_p_contradiction"), F.lit(0.5).alias("gate_score"), F.array().cast("array<string>").alias("evidence_spans"), F.lit("a").alias("a_text"), F.lit("b").alias("b_text"), F.lit(None).cast("string").alias("reviewer_verdict"), F.lit("r").alias("judge_rationale")).repartition(5)
    run = {"run_id": "run", "n_assertions": 2, "n_pairs_gated": 1, "n_pairs_judged": 1, "n_findings": 60}
    lines = sinks.report_lines(run, f)
    sinks.write_report(lines, f"{tmp_path}/report")
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    whole = sinks.render_report(run, f)
    assert text.rstrip("\n") == whole.rstrip("\n") and whole.count("#### Finding") == 60
    pairs = [tuple(sorted(r[2:4])) for r in rows]
    assert whole.count("\n### ") == len(set(pairs))
    want = [r[0] for _, r in sorted(zip(pairs, rows, strict=True), key=lambda x: (x[0], x[1][0]))]
    assert [x.split("`")[0] for x in whole.split("#### Finding `")[1:]] == want
    few = sinks.render_report(run, f, most=4)
    assert few.count("#### Finding") == 4 and few.count("… and 56 more") == 2


def test_exports(spark):
    a = spark.createDataFrame([("a1", "d", "t", "definition", "T", ""), ("a0", "d", "u", "claim", None, None)], "assertion_id string, doc_id string, assertion_text string, kind string, term string, definition_text string").withColumn("created_at", F.lit(1))
    d = spark.createDataFrame([("d", "", "p.md", None)], "doc_id string, title string, source_path string, doc_date string")
    assert [r[0] for r in sinks.assertion_export(a).collect()] == ["a0", "a1"]
    with pytest.raises(ValueError):
        sinks.assertion_export(a, ("nope",))
    assert json.loads(sinks.assertion_lines(a, d).first()["value"])["doc_date"] is None
    assert [tuple(r) for r in sinks.definition_export(a, d).collect()] == [("a1", "p.md", "T", "t")]
    assert sinks.output_name("report", datetime(2026, 1, 2, 3, 4, 5), "0123456789") == "cc_report_2026-01-02T03-04-05_01234567.md"
