"""Structured answers, models as plug-ins, settings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dissona import runtime
from dissona.functions import ids, responses
from dissona.plans import logs, pipeline, plugins
from dissona.sources import readers, sinks


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "j string").select(f(F.col("j")).alias("r")).first()["r"]


def test_the_named_tool_is_found(spark):
    answer = json.dumps({"content": [{"type": "text", "text": "some words"}, {"type": "tool_use", "name": "t", "input": {"assertions": ["One.", "Two."], "definitions": []}}]})
    got = one(spark, lambda c: responses.extraction_payload(responses.tool_payload(c, "t")), answer)
    assert got["assertions"] == ["One.", "Two."] and got["definitions"] == []
    for text in (answer.replace('"t"', '"other"'), '{"content": []}', "{}", "no json"):
        with pytest.raises(Exception, match="no tool_use block"):
            one(spark, lambda c: responses.tool_payload(c, "t"), text)


def test_extraction_payloads(spark):
    full = {"term": "T", "definition_text": "d", "containing_sentence": "c"}
    assert one(spark, responses.extraction_payload, json.dumps({"definitions": [full]}))["definitions"][0].asDict() == full
    assert one(spark, responses.extraction_payload, "{}").asDict() == {"assertions": [], "definitions": []}
    for bad in ({"assertions": [1, 2]}, {"assertions": ["a", 1]}, {"assertions": "a"}, {"definitions": [full | {"term": ""}]}, {"definitions": [{"term": "x"}]}, {"definitions": {"a": 1}}, []):
        with pytest.raises(Exception, match="not a payload"):
            one(spark, responses.extraction_payload, json.dumps(bad))


def test_verdict_payloads(spark):
    good = {"verdict": "contradiction", "rationale": "r", "evidence_spans": ["x"]}
    assert one(spark, responses.verdict_payload, json.dumps(good)).asDict() == good
    multi = {"verdict": "multi_party_contradiction", "rationale": "r", "contradicting_subset": ["A", "C"]}
    f = lambda c: responses.verdict_payload(c, responses.MULTI_VERDICTS, subset=True)
    assert one(spark, f, json.dumps(multi))["contradicting_subset"] == ["A", "C"]
    for bad in (good | {"verdict": "other"}, good | {"rationale": ""}, good | {"rationale": 5}, good | {"more": 1}, good | {"evidence_spans": [1]}):
        with pytest.raises(Exception, match="not a payload"):
            one(spark, responses.verdict_payload, json.dumps(bad))
        with pytest.raises(ValueError):
            plugins.checked_answer(json.dumps(bad), responses.JUDGE_VERDICTS)
    with pytest.raises(Exception, match="not a payload"):
        one(spark, f, json.dumps(multi | {"contradicting_subset": ["D"]}))
    assert one(spark, responses.organisation_payload, '{"label": null, "reason": "no_org"}').asDict() == {"label": None, "reason": "no_org"}
    with pytest.raises(Exception, match="not a payload"):
        one(spark, responses.organisation_payload, '{"reason": "org_found"}')


class Vendor:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def request_payload(self, system, user):
        self.asked.append(user)
        return self.answers.pop(0)


def test_a_judge_by_a_vendor_is_asked_again():
    good = json.dumps({"verdict": "contradiction", "rationale": "r"})
    v = Vendor("no json", json.dumps({"verdict": "maybe", "rationale": "r"}), good)
    assert plugins.asked(plugins.ProviderJudge(v, "s", "{a} / {b} ({context})"), "x", "y", None) == ("contradiction", "r", [])
    assert v.asked == ["x / y ()"] * 3
    assert plugins.asked(plugins.ProviderJudge(Vendor(*["?"] * 3), "s", ""), "x", "y", None)[0] == "uncertain"


def test_models_by_name():
    models = {("judge", "fixture"): lambda: plugins.FixtureJudge({}), ("embedder", "hash"): plugins.HashEmbedder}
    assert plugins.make("embedder", "hash", models).width == 64
    for kind, provider, said in (("judge", "openai", "no judge for openai"), ("oracle", "x", "no such kind")):
        with pytest.raises(ValueError, match=said):
            plugins.make(kind, provider, models)


def test_extraction_and_organisations(spark):
    model = plugins.FixtureExtractor({"a": (["A."], [{"term": "t", "definition_text": "d", "containing_sentence": "s"}])}, {"x": ("Acme", "org_found")})
    chunks = spark.createDataFrame([("d", "1", "a"), ("d", "2", " b ")], "doc_id string, chunk_id string, text string")
    got = {r["chunk_id"]: (r["claims"], len(r["definitions"])) for r in plugins.extracted(chunks, model).collect()}
    assert got == {"1": (["A."], 1), "2": (["b"], 0)}
    docs = spark.createDataFrame([("1", "x", "text"), ("2", None, "y" * 3000), ("3", "z", None)], "doc_id string, title string, text string")
    got = {r["doc_id"]: (r["org_label"], r["org_reason"]) for r in plugins.identified(docs, model).collect()}
    assert got == {"1": ("Acme", "org_found"), "2": (None, "truncated"), "3": (None, "no_org")}


def test_contradicting_subset(spark):
    class Three:
        def judge(self, texts):
            return "multi_party_contradiction", "r", [], ["A", "C"]

    df = spark.createDataFrame([(["x", "y", "z"],)], "t array<string>")
    got = df.select(plugins.multi_verdict(df, "t", Three()).alias("v")).first()["v"]
    assert got["contradicting_subset"] == ["A", "C"] and got["verdict"] == "multi_party_contradiction"


def test_a_missing_term_raises(spark):
    df = spark.createDataFrame([("t",), ("",)], "t string")
    assert df.filter("t = 't'").select(pipeline.with_term(F.col("t"))).first()[0] == "t"
    with pytest.raises(Exception, match="judged on a term"):
        df.select(pipeline.with_term(F.col("t"))).collect()


def test_pair_keys_are_checked(spark):
    df = spark.createDataFrame([("0" * 16 + ":" + "a" * 16,), ("nope",)], "k string")
    assert df.filter("k <> 'nope'").select(ids.checked_pair_key("k")).first()[0].startswith("000")
    with pytest.raises(Exception, match="not a pair key"):
        df.select(ids.checked_pair_key("k")).collect()


def test_settings_are_yaml(monkeypatch):
    text = "judge_provider: fixture   # a comment\ngate:\n  top_k: 7\n  similarity_threshold: 0.5\ndeep: true\nmax_cost: null\n"
    for hide in (False, True):
        if hide:
            monkeypatch.setitem(__import__("sys").modules, "yaml", None)
        c = readers.Config.read(text, {"CC_GATE_TOP_K": "9"})
        assert (c.judge_provider, c.gate_top_k, c.gate_similarity_threshold, c.deep, c.max_cost) == ("fixture", 9, 0.5, True, None)
    with pytest.raises(ValueError, match="max_memory_mb"):
        readers.Config.read("max_memory_mb: 128")
    with pytest.raises(ValueError, match="unknown"):
        readers.Config.read("gate:\n  nope: 1")


def test_memory_preflight(monkeypatch):
    for left, least, said in ((8000, None, None), (8000, 2000, None), (None, 4000, None)):
        monkeypatch.setattr(runtime, "available_memory_mb", lambda left=left: left)
        assert runtime.preflight_memory(least) is said
    monkeypatch.setattr(runtime, "available_memory_mb", lambda: 1000)
    assert "1000 MB" in runtime.preflight_memory()
    with pytest.raises(ValueError, match="below max_memory_mb=4000"):
        runtime.preflight_memory(4000)


def test_log_file_rotates(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "LOG_BYTES", 200)
    log = logs.configure(str(tmp_path), name="dissona.test")
    assert logs.configure(str(tmp_path), name="dissona.test") is log and len(log.handlers) == 2
    for i in range(20):
        log.info("line %d of the log", i)
    assert {"dissona.test.log", "dissona.test.log.1"} <= {p.name for p in tmp_path.iterdir()}


def test_lines_are_replaced_at_once(spark, tmp_path):
    path = str(tmp_path / "labels")
    for n in (3, 1):
        sinks.rewrite_lines(spark.range(n).select(F.to_json(F.struct("id")).alias("value")), path)
        assert spark.read.json(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["labels"]
    sinks.append_json(spark.range(2), path)
    assert spark.read.json(path).count() == 3


def test_candidate_lines(spark):
    from dissona.operators import definitions

    d = spark.createDataFrame([("a", 1, "The Terms", '"The Terms" means A', "definition", " A"), ("b", 2, "term", '"term" means B', "definition", "B "), ("c", 3, "term", '"term" means B', "definition", None), ("d", 4, "term", '"term" has B', "definition", "B"), ("e", 5, "term", '"term" means B', "claim", "B")], "assertion_id string, doc_id long, term string, assertion_text string, kind string, definition_text string")
    lines = definitions.candidate_lines(definitions.mined_pairs(d, 5)).collect()
    got = json.loads(lines[0]["value"])
    assert len(lines) == 1 and got.pop("pair_id").startswith("term_") and got == {"category": "review", "term": "The Terms", "def_a": "A", "def_b": "B", "doc_a": "1", "doc_b": "2", "label": ""}


@pytest.mark.parametrize(("text", "points"), [
    ("has the meaning assigned in Section 3", True), ("Shall  have the meanings\nset forth herein", True), ("having the meaning referred to", True), ("the meaning given", True), ("as set  forth in A", True), ("As defined", True), ("", False), (None, False),
    ("the amounts set forth in Schedule A", False), ("has the meaning intended", False), ("the meaning referred to", False), ("as definedly", False), ("it has the meaning assigned in Section 3", False),
])
def test_cross_references(spark, text, points):
    from dissona.operators import definitions

    assert spark.createDataFrame([(text,)], "t string").select(definitions.is_cross_reference("t")).first()[0] == points


@pytest.mark.parametrize("seed", range(6))
def test_mined_pairs_against_all_pairs(spark, seed):
    """Few and many texts and documents, hot ones among them: the first pairs are those of the whole list."""
    from dissona.operators import definitions

    rng = random.Random(seed)
    hot = lambda n: 0 if rng.random() < 0.6 else rng.randrange(n)
    texts, docs = rng.choice([(1, 1), (1, 50), (50, 1), (4, 4), (60, 60)])
    rows = [(f"{i:03}", f"d{hot(docs)}", f"term{hot(3)}", f"text {hot(texts)}") for i in range(120)]
    df = spark.createDataFrame([(i, d, t, f'"{t}" means', "definition", x) for i, d, t, x in rows], "assertion_id string, doc_id string, term string, assertion_text string, kind string, definition_text string")
    pairs = sorted((a[1] == b[1], a[3] == b[3], a[2], a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[2] == b[2])
    for cap in (1, 3, 10):
        got = [(r.doc_a == r.doc_b, r.category == "identical", r.term, r.a_id, r.b_id) for r in definitions.mined_pairs(df, cap).collect()]
        assert got == pairs[:cap]
        assert definitions._first_rows(df.select("assertion_id", "doc_id", F.col("term").alias("term_key"), F.col("definition_text").alias("body")), cap).count() <= 15 * (cap + 1)


def test_comparison_markdown(spark, tmp_path):
    from dissona.plans import harness

    finding = {"doc_a": "x", "span_a": "1", "doc_b": "y", "span_b": "2", "type": "t", "rationale": "r"}
    for i, found in enumerate(([finding], [finding, finding | {"span_a": "9"}])):
        (tmp_path / f"run{i}.json").write_text(json.dumps({"run_id": f"r{i}", "model": "m", "corpus_name": "main", "findings": found, "cost_usd": 1.5}))
    text = harness.compare_baseline(spark, str(tmp_path / "run*.json"))
    assert "# Baseline: main" in text and "union: **2**" in text and "intersection: **1**" in text and "agreement: **50.0%**" in text and "$3.00" in text
