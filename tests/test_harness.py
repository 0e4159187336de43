import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from dissona.functions import responses
from dissona.operators import audit
from dissona.plans import harness, pipeline, plugins


def test_document_and_targeted_pairs(spark):
    judge = plugins.FixtureJudge({("a", "b"): ("contradiction", "", []), ("u", "v"): ("uncertain", "", [])})
    d = spark.createDataFrame([("1", "a", "b", "contradiction"), ("2", "c", "d", "contradiction"), ("3", "Sales rose 5%", "Sales fell 5%", "contradiction"), ("4", "e", "f", "not_contradiction")], "pair_id string, document_a string, document_b string, label string")
    assert tuple(harness.document_pairs(d, judge).first()) == (2, 0, 1, 1, 1.0, round(2 / 3, 6), 0.8)
    assert harness.pair_documents(d, "document_a", "document_b").count() == 8
    t = spark.createDataFrame([("1", "x", "a", "b", "contradiction"), ("2", "x", "u", "v", "contradiction"), ("3", "y", "c", "d", "not_contradiction")], "pair_id string, bucket string, assertion_a string, assertion_b string, ground_truth string")
    got = {r["bucket"]: r for r in harness.targeted_pairs(t, judge).collect()}
    assert got["x"]["accuracy"] == 0.5 and got["x"]["abstain_rate"] == 0.5 and got["x"]["fn_rate"] == 0.0 and got["y"]["fn_rate"] is None and got[None]["n"] == 3


def test_definition_pairs(spark):
    judge = plugins.FixtureJudge({}, ("definition_divergent", "", []))
    d = spark.createDataFrame([("1", "same", "Loan", "x.", "X", "consistent"), ("2", "other", "Loan", "x", "y", "divergent")], "pair_id string, category string, term string, def_a string, def_b string, label string")
    scores, by = harness.definition_pairs(d, judge)
    assert tuple(scores.first())[4:] == (1.0, 1.0, 1.0) and {r["category"]: r["accuracy"] for r in by.collect()} == {"same": 1.0, "other": 1.0}


def test_long_premises(spark):
    """Only a premise that doesn't fit is split; the sentence that contradicts most counts, the first of several; batches go by length."""
    table = {("Two two!", "h"): (0.8, 0.1, 0.1), ("Three.", "h"): (0.8, 0.0, 0.2), ("One. Two two!", "h"): (0.3, 0.3, 0.4), ("One. Two two! Three.", "h"): (0.99, 0.0, 0.0)}
    seen = []

    class Checker(plugins.FixtureNli):
        max_tokens = 7

        def count_tokens(self, texts):
            return [len(t.split()) for t in texts]

        def score(self, pairs):
            seen.append([len(p) + len(h) for p, h in pairs])
            return super().score(pairs)

    pairs = [("One. Two two! Three.", "h"), ("One. Two two!", "h"), ("one sentence that alone is much longer than it may be", "h"), ("", "")]
    assert plugins.split_scores(Checker(table), pairs) == [(0.8, 0.1, 0.1), (0.3, 0.3, 0.4), (0.0, 0.0, 1.0), (0.0, 0.0, 1.0)]
    assert seen == [sorted(seen[0])] and len(seen[0]) == 6
    df = spark.createDataFrame([(1, *pairs[0]), (2, *pairs[1]), (3, None, "h")], "k int, p string, h string")
    plain = type("Plain", (plugins.FixtureNli,), {"max_tokens": 7, "count_tokens": lambda self, texts: [len(t.split()) for t in texts]})
    got = {r["k"]: r["p"]["p_contradiction"] for r in df.select("k", plugins.nli(df, "p", "h", plain(table)).alias("p")).collect()}
    assert got == {1: 0.8, 2: 0.3, 3: 0.0}
    assert plugins.split_scores(plugins.FixtureNli(table), pairs)[0] == (0.99, 0.0, 0.0)  # without a limit nothing is split


def test_calls_at_once_keep_their_order(spark):
    """200 calls of 50 ms by one task, with answers that must be asked for again, in the order of the rows."""

    class Vendor:
        def __init__(self):
            self.tries = {}

        def request_payload(self, system, user):
            time.sleep(0.05)
            n = self.tries[user] = self.tries.get(user, 0) + 1
            if user.endswith("9") and n == 1:
                return "not json"
            return json.dumps({"verdict": "contradiction", "rationale": f"{user} {n}"})

    judge = plugins.ProviderJudge(Vendor(), "s", "{a}", concurrency=20)
    df = spark.range(0, 200, 1, 1).selectExpr("id", "cast(id as string) a", "'' b", "'' c")
    calls = [str(i) for i in range(200)]
    began = time.perf_counter()
    answers = plugins.in_order(judge, lambda a: plugins.asked(judge, a, "", None), calls)
    assert time.perf_counter() - began < 2
    want = [f"{i} {2 if i.endswith('9') else 1}" for i in calls]
    assert [a[1] for a in answers] == want
    fresh = plugins.ProviderJudge(Vendor(), "s", "{a}", concurrency=20)
    assert [r["v"]["rationale"] for r in df.select("id", plugins.verdict(df, "a", "b", "c", fresh).alias("v")).orderBy("id").collect()] == want


def test_a_busy_vendor_is_waited_for(monkeypatch):
    waits = []
    monkeypatch.setattr(plugins.time, "sleep", waits.append)
    left = [plugins.Busy(seconds=7), ConnectionError(), TimeoutError()]

    def call():
        if left:
            raise left.pop(0)
        return "there"

    assert plugins.patient(call) == "there" and waits[0] == 7 and plugins.FIRST_WAIT <= waits[1] <= 2 * plugins.FIRST_WAIT and waits[2] <= 4 * plugins.FIRST_WAIT
    left += [ConnectionError("gone")] * (plugins.WAITS + 1)
    with pytest.raises(ConnectionError):
        plugins.patient(call)
    assert max(waits) <= plugins.LONGEST_WAIT

    class Broken:
        concurrency = 4

    with pytest.raises(KeyError):
        plugins.in_order(Broken(), {1: 1}.__getitem__, [1, 1, 2, 1])


def test_vendors_of_triangles_and_extraction():
    class Vendor:
        def __init__(self, **answer):
            self.answer, self.asked = json.dumps(answer), []

        def request_payload(self, system, user):
            self.asked.append(user)
            return self.answer

    v = Vendor(verdict="multi_party_contradiction", rationale="r", contradicting_subset=["A", "C"])
    assert plugins.ProviderMultiJudge(v, "s", "{a}|{b}|{c}").judge(["x", "y", "z"]) == ("multi_party_contradiction", "r", [], ["A", "C"]) and v.asked == ["x|y|z"]
    d = {"term": "t", "definition_text": "d", "containing_sentence": "s"}
    assert plugins.ProviderExtractor(Vendor(assertions=["A."], definitions=[d]), "s", "{text}").extract("text") == (["A."], [d])
    assert plugins.ProviderExtractor(Vendor(label="Acme", reason="org_found"), "s", "").identify(None, "text") == ("Acme", "org_found")
    definition = plugins.ProviderJudge(Vendor(verdict="definition_divergent", rationale="r"), "s", "", responses.DEFINITION_VERDICTS)
    assert definition.judge("a", "b", "t")[0] == "definition_divergent"
    for bad in ({"verdict": "not_contradiction", "rationale": "r", "contradicting_subset": ["A"]}, {"verdict": "multi_party_contradiction", "rationale": "r", "contradicting_subset": ["D"]}, {"verdict": "contradiction", "rationale": "r"}):
        with pytest.raises(ValueError):
            plugins.ProviderMultiJudge(Vendor(**bad), "s", "").judge(["x", "y", "z"])
    for bad in ({"assertions": "A"}, {"definitions": [d | {"term": ""}]}, {"definitions": [1]}):
        with pytest.raises(ValueError):
            plugins.ProviderExtractor(Vendor(**bad), "s", "").extract("")


def test_texts_are_judged_once_and_remembered(spark, tmp_path):
    class Stamp:
        """Each call has a number of its own."""

        def judge(self, a, b, context):
            assert a < b
            return "definition_divergent", f"{uuid.uuid4()}", []

    rows = [(f"{i:02}", i, "Fee", f'"Fee" means {["x", "X", "y", "z"][i % 4]}', "definition") for i in range(24)]
    a = spark.createDataFrame(rows, "assertion_id string, doc_id int, term string, assertion_text string, kind string")
    d = spark.createDataFrame([(i, ["Acme Ltd", "Blue", None][i % 3]) for i in range(24)], "doc_id int, org_label string")
    folder = f"{tmp_path}/verdicts"
    calls = lambda df: {r["judge_rationale"] for r in df.collect() if r["judge_verdict"] == "definition_divergent"}
    first = pipeline.definition_pass(a, d, run_id="r", judge=Stamp(), verdicts=folder, judge_name="one")
    once = calls(first)
    assert first.count() == 24 * 23 // 2 and len(once) == 5  # x and X are equal, the other pairs of four texts are not
    assert calls(pipeline.definition_pass(a, d, run_id="s", judge=Stamp(), verdicts=folder, judge_name="one")) == once
    assert not calls(pipeline.definition_pass(a, d, run_id="s", judge=Stamp(), verdicts=folder, judge_name="two")) & once
    more = a.unionByName(a.limit(1).withColumn("assertion_id", F.lit("zz")).withColumn("assertion_text", F.lit('"Fee" means new')))
    assert len(calls(pipeline.definition_pass(more, d, run_id="t", judge=Stamp(), verdicts=folder, judge_name="one")) - once) == 4
    assert len(calls(pipeline.definition_pass(a, d, run_id="r", judge=Stamp()))) == 5


def test_triangle_verdicts(spark):
    class All:
        def judge(self, texts):
            return "multi_party_contradiction", "|".join(texts), []

    found = spark.createDataFrame([("a", "b", "c", 0.5, 0.6, 0.7)], "a_id string, b_id string, c_id string, s_ab double, s_ac double, s_bc double")
    a = spark.createDataFrame([(x, x.upper()) for x in "abc"], "assertion_id string, assertion_text string")
    r = pipeline.judged_triangles(found, a, "run", All()).first()
    assert r["judge_rationale"] == "A|B|C" and r["assertion_ids"] == ["a", "b", "c"]


def test_run_cost(spark):
    c = spark.range(1).select(F.lit(10).alias("n_judged"), F.lit(5).alias("n_definitions"))
    assert audit.run_cost_bound(c, "anthropic").first()[0] == 0.15
