"""What reviewers of round 3 found, on small tables."""

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from dissona.llm import mlm
from dissona.operators import gate
from dissona.operators.chunking import sentence_spans
from dissona.plans import detector_queries, pipeline, plugins, queries, round_trips  # noqa: F401
from dissona.runtime import durable

DATA = "/root/testdata/sf0.001"


def against_sql(spark, name, folder, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = c.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    return sorted(map(tuple, got.select(*names).collect())), sorted(want.fetchall())


def test_metrics_of_a_detector_without_reviews(spark, tmp_path):
    """events of one detector only; the other's findings make no row."""
    spark.read.parquet(f"{DATA}/events.parquet").filter("event_id % 2 = 0").write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("l_suppkey", F.col("l_suppkey") % 10).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = against_sql(spark, "metrics_json", str(tmp_path), ("events", "lineitem"))
    assert got == want and len(want) == 1


def test_intersection_by_whole_texts(spark, tmp_path):
    """texts with one beginning are different findings; only what all three runs say is in the result."""
    rows = [(0, 0, "user", "alpha one"), (1, 0, "user", "alpha two"), (2, 0, "user", "alpha three")] + [(c, 1, "user", "the same") for c in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = against_sql(spark, "runs_intersection", str(tmp_path), ("conversations",))
    assert got == want and len(want) == 1


def test_only_pairs_at_the_threshold_are_written(spark, monkeypatch):
    """a hundred pairs of which one is kept; texts are extracted once each, and what is written doesn't grow with the pairs."""
    a = spark.createDataFrame([(f"a{i:02}", "Revenue rose $5 million in 2020." if i == 0 else "Revenue fell $4 million in 2020." if i == 1 else f"Text of {i % 3}") for i in range(100)], "assertion_id string, assertion_text string")
    pairs = spark.createDataFrame([("a00", f"a{i:02}", 1.0) for i in range(1, 100)], "a_id string, b_id string, score double")
    counts = []
    monkeypatch.setattr(pipeline, "durable", lambda df: (counts.append((df.columns[0], df.count())), durable(df))[1])
    nli = plugins.FunctionNli(lambda p, h: (0.9, 0.05, 0.05) if "fell" in p else (0.1, 0.2, 0.7))
    found = pipeline.pairwise_pass(pairs, a, run_id="r", checker=nli, judge=plugins.FixtureJudge({})).collect()
    assert [(r["assertion_b_id"], r["judge_verdict"]) for r in found] == [("a01", "numeric_short_circuit")]
    assert max(n for first, n in counts if first != "assertion_id") == 5


def test_repeated_premises_are_split_once(monkeypatch):
    """a premise that a batch has ten times."""
    calls = []
    monkeypatch.setattr(plugins, "sentence_spans", lambda p: (calls.append(p), sentence_spans(p))[1])
    model = plugins.FunctionNli(lambda p, h: (0.9, 0.05, 0.05) if "back" in p else (0.1, 0.2, 0.7), max_tokens=8)
    got = plugins.split_scores(model, [("It stayed there for long. It came back.", f"No {i}") for i in range(10)])
    assert got == [(0.9, 0.05, 0.05)] * 10 and len(calls) == 1


def test_calls_are_counted_without_pairs(spark, tmp_path, monkeypatch):
    """a term with 300 definitions in each of a few forms; nothing that is written is as long as the pairs."""
    p = spark.range(300).select(F.col("id").alias("p_partkey"), F.lit("hot bolt").alias("p_name"), F.lit("Brand#7").alias("p_brand"), F.lit("LARGE").alias("p_type"), (F.col("id") % 7).cast("int").alias("p_size"))
    p.write.parquet(f"{tmp_path}/part.parquet")
    counts = []
    monkeypatch.setattr(pipeline, "durable", lambda df: (counts.append(df.count()), durable(df))[1])
    for name in ("judge_calls", "definition_pass_counts"):
        got, want = against_sql(spark, name, str(tmp_path), ("part",))
        assert got == want
    n_pairs = against_sql(spark, "judge_calls", str(tmp_path), ("part",))[0][0][0]
    assert n_pairs > 30_000 and max(counts) < 5_000


def test_model_learns_from_every_position(spark):
    """without a word about shares, training masks each position of each text."""
    docs = spark.createDataFrame([(f"w{i % 7} x{i % 5} y{i % 3}",) for i in range(60)], "text string").coalesce(1)
    start = mlm.untrained(*mlm.word_counts(docs))
    whole, own = mlm.train(docs, start, share=1.0, mixers=1), mlm.train(docs, start, mixers=1)
    assert all(np.array_equal(a, b) for a, b in zip(whole.parts, own.parts, strict=True))


def test_export_of_findings_stays_small(spark, tmp_path):
    """what the export writes and keeps is less than half of its plain lines, and reviews go to the findings without a shuffle of them."""
    shared = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(shared) for f in files)
    before = size()
    rows = queries.QUERIES["findings_csv"](spark, DATA).collect()
    plain = sum(sum(len(v) + 1 for v in r) for r in rows)
    assert len(rows) == spark.read.parquet(f"{DATA}/lineitem.parquet").count() and size() - before < plain / 2
    plan = queries._reviewed(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_streamed_gate_with_a_threshold(spark):
    """F7, F8: many small files, each with pivots of its own; what a threshold passes over has no neighbour, by brute force."""
    m = np.random.default_rng(4).normal(size=(300, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    got = gate.top_neighbours(df, 5, least=0.8, matrix_bytes=0, block_bytes=1 << 10, held_bytes=1 << 11).filter("src <> dst and score >= 0.8")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(300) for j in sorted(range(300), key=lambda j: (-s[i, j], j))[:6] if j != i and s[i, j] >= 0.8}
    assert {(r["src"], r["dst"]) for r in got.collect()} == want and want
