import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dissona.operators import audit, chunking, definitions, evaluation, gate, organisations, store, triangles


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("whole", [True, False])
def test_gate_against_brute_force(spark, whole):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    m[7], m[9] = m[8], 0
    docs = (np.arange(60) // 3).tolist()
    df = spark.createDataFrame([(i, docs[i], [float(x) for x in m[i]]) for i in range(60)], "id long, doc_id int, embedding array<float>")
    near = gate.top_neighbours(df, 5, **({} if whole else {"matrix_bytes": 0, "block_bytes": 1 << 10, "held_bytes": 1 << 11}))
    pairs = near.filter("src <> dst and score >= 0.2")
    n = np.sqrt((m.astype(np.float32).astype(float) ** 2).sum(1))
    u = m.astype(np.float32).astype(float) / np.where(n == 0, 1, n)[:, None]
    s = np.round(u @ u.T, 9)
    want = set()
    for i in range(60):
        for j in sorted(range(60), key=lambda j: (-s[i, j], j))[:6]:
            if j != i and s[i, j] >= 0.2:
                want.add((i, j))
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == want
    if whole:
        got = {(r["a_id"], r["b_id"]) for r in gate.ann_gate(df, k=5, threshold=0.2).collect()}
        assert got == {(min(p), max(p)) for p in want if docs[p[0]] != docs[p[1]]}


def test_gate_of_nothing(spark):
    assert gate.ann_gate(spark.createDataFrame([], "id long, doc_id int, embedding array<float>")).count() == 0


def test_four_clique_has_four_triangles(spark):
    edges = spark.createDataFrame([(a, b, 0.5 + (a + b) / 100) for a in range(4) for b in range(4) if a < b] + [(0, 1, 0.9), (1, 0, 0.1)], "a_id int, b_id int, score double")
    docs = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "id int, doc_id int")
    found = triangles.triangles(edges, docs)
    assert [r[:3] for r in rows(found)] == [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    one_doc = spark.createDataFrame([(i, 0) for i in range(4)], "id int, doc_id int")
    assert triangles.triangles(edges, one_doc).count() == 0
    assert triangles.top_triangles(found, 0).count() == 0
    assert [tuple(r)[:3] for r in triangles.top_triangles(found, 2).collect()] == [(1, 2, 3), (0, 1, 3)] or triangles.top_triangles(found, 2).count() == 2
    with pytest.raises(ValueError):
        triangles.top_triangles(found, -1)
    strong = edges.filter("a_id = 0 and b_id in (1, 2)").distinct()
    assert [r[:3] for r in rows(triangles.with_strong_edges(found, strong))] == [(0, 1, 2)]


@pytest.mark.parametrize("text_ids", [False, True])
def test_triangles_against_brute_force(spark, text_ids):
    """Scores with ties, documents, ids of either type; the best are the first of all, from whatever shares."""
    rng = np.random.default_rng(5)
    name = (lambda i: f"n{i:02}") if text_ids else int
    kind = "string" if text_ids else "long"
    score = {(a, b): round(float(rng.random()), 1) for a in range(30) for b in range(a + 1, 30) if a == 0 or rng.random() < 0.4}
    doc = {i: int(rng.integers(0, 3)) for i in range(30)}
    edges = spark.createDataFrame([(name(b), name(a), s) if rng.random() < 0.5 else (name(a), name(b), s) for (a, b), s in score.items()], f"a_id {kind}, b_id {kind}, score double")
    docs = spark.createDataFrame([(name(i), d) for i, d in doc.items()], f"id {kind}, doc_id int")
    want = [(name(a), name(b), name(c), score[a, b], score[a, c], score[b, c], min(score[a, b], score[a, c], score[b, c])) for a in range(30) for b in range(a + 1, 30) for c in range(b + 1, 30) if {(a, b), (a, c), (b, c)} <= set(score) and len({doc[a], doc[b], doc[c]}) > 1]
    assert rows(triangles.triangles(edges, docs)) == sorted(want)
    ranked = sorted(want, key=lambda r: (-r[6], *r[:3]))
    for cap in (0, 1, 7, 100, 10**6):
        for shares in ((), (0.05, 0.3), (0.5,)):
            assert [tuple(r) for r in triangles.best_triangles(edges, docs, cap, shares=shares).collect()] == ranked[:cap]
    assert triangles.best_triangles(edges.limit(0), docs, 5).count() == 0
    with pytest.raises(ValueError):
        triangles.best_triangles(edges, docs, -1)


def test_a_hub_makes_few_wedges(spark):
    """A star of 20,000 leaves whose centre has the least id, and one triangle at it."""
    edges = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("a_id"), F.col("id").alias("b_id"), F.lit(0.5).alias("score")).unionByName(spark.createDataFrame([(1, 2, 0.9)], "a_id long, b_id long, score double"))
    out = triangles._directed(triangles.canonical_edges(edges))
    assert out.groupBy("x").count().agg(F.max("count")).first()[0] <= 2
    docs = spark.range(0, 20_001).select("id", F.col("id").alias("doc_id"))
    assert [tuple(r)[:3] for r in triangles.triangles(edges, docs).collect()] == [(0, 1, 2)]


def test_definition_pairs_and_counts(spark):
    a = spark.createDataFrame(
        [("1", "d1", "Loan", '"Loan" means x.', "definition"), ("2", "d2", "the Loans", '"the Loans" means x', "definition"), ("3", "d3", "Loan", '"Loan" shall mean y', "definition"), ("4", "d4", "Loan", "repay the Loan", "definition"), ("5", "d4", "Loan", '"Loan" means z', "claim"), ("6", "d4", "Loan", '"LOAN" MEANS X', "definition")],
        "assertion_id string, doc_id string, term string, assertion_text string, kind string",
    )
    d = spark.createDataFrame([("d1", "Acme Inc"), ("d2", "Acme"), ("d3", "Other LLC"), ("d4", None)], "doc_id string, org_label string")
    x = definitions.with_organisation(definitions.definitions(a), d)
    pairs = definitions.definition_pairs(x, across_organisations=False)
    assert {(r["a_id"], r["b_id"]): (r["suppressed"], r["same_text"]) for r in pairs.collect()} == {("1", "2"): (False, False), ("1", "3"): (True, False), ("1", "6"): (False, True), ("2", "3"): (True, False), ("2", "6"): (False, False), ("3", "6"): (False, False)}
    for across in (True, False):
        p = definitions.definition_pairs(x, across_organisations=across)
        want = p.agg(F.count_if(~F.col("suppressed")), F.count_if("suppressed"), F.count_if(~F.col("suppressed") & F.col("same_text")), F.count_if(~F.col("suppressed") & ~F.col("same_text"))).first()
        assert tuple(definitions.definition_pair_counts(x, across_organisations=across).first()) == tuple(want)


def test_store_changes(spark):
    there = spark.createDataFrame([("a", "c1", "x")], "doc_id string, corpus_id string, title string")
    new = spark.createDataFrame([("a", "c1", "y"), ("b", "c1", "1"), ("b", "c1", "0")], "doc_id string, corpus_id string, title string")
    assert rows(store.insert_documents(there, new, ["title"])) == [("a", "c1", "x"), ("b", "c1", "0")]
    with pytest.raises(store.CrossCorpusDocumentError):
        store.insert_documents(there, new.withColumn("corpus_id", F.lit("c2")), ["title"])
    with pytest.raises(ValueError):
        store.insert_documents(there, new.withColumn("corpus_id", F.lit(None).cast("string")), ["title"])
    assert rows(store.latest_wins(spark.createDataFrame([("k", 1, "a"), ("k", 2, None)], "k string, o int, v string"), ["k"], "o")) == [("k", 2, None)]


def test_safe_where(spark):
    d = spark.createDataFrame([("1", "it's"), ("2", "Alpha"), ("3", "beta")], "doc_id string, title string")
    keep = lambda w: [r[0] for r in rows(d.filter(store.safe_where(w, ["doc_id", "title"])))]
    assert keep("title = 'it''s'") == ["1"]
    assert keep("title LIKE 'a%'") == ["2"]
    assert keep("doc_id = '3' OR title LIKE 'A%' AND doc_id = '9'") == ["3"]
    for bad in ("1=1", "title = 'x'; drop", "title > 'x'", "other = 'x'", "title = 'x' OR", "", "title = 'a' title = 'b'"):
        with pytest.raises(ValueError):
            store.safe_where(bad, ["doc_id", "title"])


def test_payload_claim_before_definition(spark):
    kind = "doc_id string, chunk_id string, claims array<string>, definitions array<struct<term:string,definition_text:string,containing_sentence:string>>"
    got = store.payload_assertions(spark.createDataFrame([("d", "c", ["S", " "], [("T", "t", "S"), ("U", "u", "V")])], kind))
    assert sorted((r["assertion_text"], r["kind"]) for r in got.collect()) == [("S", "claim"), ("V", "definition")]


def test_elements(spark):
    e = spark.createDataFrame([("d", 0, " One "), ("d", 1, "Page 2"), ("d", 2, ""), ("d", 3, "Two words")], "doc_id string, idx int, text string")
    assert [(r["text"], r["char_start"], r["char_end"]) for r in store.element_text(e).orderBy("idx").collect()] == [("One", 0, 3), ("Two words", 5, 14)]


def _windows(spans, limit, overlap):
    """The same by hand."""
    out, held = [], []
    overlap = min(overlap, limit - 1)
    for s, e in spans:
        if held and e - held[0][0] > limit:
            out.append((held[0][0], held[-1][1]))
            tail = [h for h in held if overlap and h[0] >= held[-1][1] - overlap]
            held = [] if len(tail) == len(held) else tail
        held.append((s, e))
    return out + ([(held[0][0], held[-1][1])] if held else [])


@pytest.mark.parametrize("overlap", [0, 12, 500])
def test_chunks(spark, overlap):
    texts = ["One two. Three four! Five?  Six seven eight nine ten.\nNext line here. " * 3, "x" * 90 + ". Short.", "no end", "", None, "a.b c.d", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["s"]] for r in df.select("doc_id", chunking.sentences(df, F.col("text")).alias("s")).collect()}
    got = chunking.chunk_documents(df, max_chars=40, overlap_chars=overlap).collect()
    for i, t in enumerate(texts):
        own = sorted((r["char_start"], r["char_end"]) for r in got if r["doc_id"] == str(i))
        if t:
            assert spans[i][0][0] == 0 and spans[i][-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(spans[i], spans[i][1:], strict=False))
            assert own == _windows(spans[i], 40, overlap)
        else:
            assert own == []
    assert all(texts[int(r["doc_id"])][r["char_start"] : r["char_end"]] == r["text"] for r in got)
    with pytest.raises(ValueError):
        chunking.chunk_documents(df, max_chars=0)


def test_sentences():
    cut = lambda t: [t[s:e] for s, e in chunking.sentence_spans(t)]
    assert cut("One." + " " * 500 + "Two.  ") == ["One." + " " * 500, "Two.  "]
    assert cut("Dr. Roe met J. Doe, e.g. at 3.5 p.m. in Rome. He left.") == ["Dr. Roe met J. Doe, e.g. at 3.5 p.m. ", "in Rome. ", "He left."]
    assert cut('He said "no." Then\nnext line no.\nlast') == ['He said "no." ', "Then\n", "next line no.\n", "last"]
    assert cut("") == [] and cut(" \n ") == [" \n "]
    assert len(cut("a.\n" + "\n" * 200_000)) == 1


def test_a_very_long_text_has_chunks(spark):
    df = spark.createDataFrame([(0, "word " * 40_000)], "doc_id int, text string")
    assert chunking.chunk_documents(df).count() == 1


def test_organisations(spark):
    d = spark.createDataFrame([(1, "Acme Inc", "ok"), (2, "ACME", "llm_error"), (3, " ", None), (4, "Acme Holdings", "ok")], "doc_id int, org_label string, org_reason string")
    b = organisations.organisation_buckets(d, F.col("doc_id"))
    assert rows(b) == [("", "unknown", 1), ("acme", "Acme Inc", 2), ("acme holdings", "Acme Holdings", 1)]
    assert rows(organisations.organisation_fragments(b, F.col("org_key"))) == [("acme", "acme holdings")]
    assert rows(organisations.identification_failures(d)) == [(1, 4, 25, True)]
    assert organisations.corpus_warning(b.filter("org_key = ''"), False).first()["message"] == ""
    said = organisations.corpus_warning(organisations.organisation_buckets(d, -F.col("doc_id"), with_order=True), False).first()["message"]
    assert said.startswith("⚠ Corpus spans 2 organizations: Acme Holdings (1 docs), ACME (2). Plus 1 doc with no identified organization. Cross-org")


def test_runs_reviews_and_precision(spark):
    e = spark.createDataFrame([("r", "pending", 1, 1), ("r", "done", 2, 2), ("r", "failed", 3, 3), ("q", "running", 5, 1)], "run_id string, status string, at int, seq int")
    assert rows(audit.run_states(e)) == [("q", "running", 5, None), ("r", "done", 1, 2)]
    v = spark.createDataFrame([("a:b", "contradiction", "confirmed", None, 1), ("a:b", "contradiction", None, None, 2), ("a:c", "contradiction", "false_positive", "n", 1)], "pair_key string, detector_type string, verdict string, note string, set_at int")
    now = audit.current_reviews(audit.checked_reviews(v))
    assert [(r["pair_key"], r["verdict"]) for r in now.collect()] == [("a:c", "false_positive")]
    with pytest.raises(Exception, match="unknown verdict"):
        audit.checked_reviews(v.withColumn("verdict", F.lit("maybe"))).collect()
    f = spark.createDataFrame([("f1", "b", "a", None), ("f2", "c", "a", "contradiction")], "finding_id string, assertion_a_id string, assertion_b_id string, detector_type string")
    r = audit.with_reviews(f, now)
    assert [x["finding_id"] for x in audit.not_false_positive(r).collect()] == ["f1"]
    assert rows(evaluation.detector_precision(r)) == [("contradiction", 0, 1, 0, 0.0)]
    assert audit.chip(r, "open").count() == 1 and audit.chip(r, "anything").count() == 2


def test_members_need_three_and_two(spark):
    m = spark.createDataFrame([("f", ["b", "a", "c"], ["x", "y"])], "finding_id string, assertion_ids array<string>, doc_ids array<string>")
    assert rows(audit.member_rows(m)) == [("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c")]
    with pytest.raises(Exception, match="three ids"):
        audit.member_rows(m.withColumn("doc_ids", F.array(F.lit("x")))).collect()


def test_zero_denominators(spark):
    c = spark.createDataFrame([(0, 0, 0, 5)], "tp int, fp int, fn int, tn int")
    assert tuple(evaluation.scores(c, undefined=0.0).first())[4:] == (0.0, 0.0, 0.0)
    assert tuple(evaluation.scores(c).first())[4:] == (None, None, None)
    c = spark.createDataFrame([(0, 0, 3, 5)], "tp int, fp int, fn int, tn int")
    assert tuple(evaluation.scores(c).first())[4:] == (None, 0.0, 0.0)


def test_cost_guard(spark):
    n = spark.createDataFrame([(1000,)], "n long")
    e = audit.cost_estimate(n, n, "anthropic")
    audit.guard_cost(e, None)
    with pytest.raises(audit.CostCeilingError):
        audit.guard_cost(e, 1.0)


@pytest.mark.parametrize("least", [None, 0.8])
def test_neighbours_from_streamed_blocks(spark, least):
    """Small blocks and a hot direction, against the whole matrix."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    v = np.concatenate([centres[rng.integers(0, 6, 120)] + 0.3 * rng.normal(size=(120, 8)), np.tile(centres[0], (60, 1)), np.zeros((2, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    k = 200  # more than there are, so that ties at the edge don't matter
    key = lambda d: sorted((r["src"], r["dst"], round(r["score"], 6)) for r in d.collect() if r["score"] >= (least if least is not None else -2))
    whole = key(gate.top_neighbours(df, k, least=least))
    assert key(gate.top_neighbours(df, k, least=least, matrix_bytes=0, block_bytes=1 << 10, held_bytes=1 << 11)) == whole and len(whole) > 3000
    few = gate.top_neighbours(df, 3, least=least, matrix_bytes=0, block_bytes=1 << 10, held_bytes=1 << 11).groupBy("src").count().agg(F.max("count")).first()[0]
    assert few == 4
    assert not [p for p in os.listdir(spark.conf.get("spark.checkpoint.dir")) if p.startswith("vectors-")]


def test_blocks_of_similarities_are_bounded():
    """However many targets there are, a worker lays out SIMS_BYTES of them at a time."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    ids = np.arange(gate.MATRIX_BYTES // (8 * 16))
    whole = gate._unit(rng.normal(size=(len(ids), 16)))
    tracemalloc.start()
    source, target, value = gate.nearest(whole[:512], ids, whole, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * gate.SIMS_BYTES and len(source) == 2048 and (target[::4] == np.arange(512)).all() and (value[::4] == 1).all()
    exact = np.round(whole[:512] @ whole.T, 9)
    assert (np.sort(exact, 1)[:, :-5:-1].ravel() == value).all()


def test_far_blocks_change_nothing(spark):
    """Two bundles of directions: with a threshold, rows of one pass over the files of the other, and find what they find without."""
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.concatenate([[1, 0, 0, 0] + 0.01 * rng.normal(size=(200, 4)), [0, 1, 0, 0] + 0.01 * rng.normal(size=(200, 4))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    got = gate.top_neighbours(df, 3, least=0.7, matrix_bytes=0, block_bytes=64 * 32)
    assert got.filter("(src < 200) <> (dst < 200)").count() == 0 and got.count() == 1600
    whole = gate.top_neighbours(df, 3, least=0.7)
    key = lambda d: sorted((r["src"], round(r["score"], 6)) for r in d.collect())
    assert key(got) == key(whole)


def test_definition_classes(spark):
    rows_ = [(i, "t", ["acme", "", "blue"][i % 3], f'"T" means {i % 2}') for i in range(12)] + [(20, "u", "", '"U" means x'), (21, "", "", "no")]
    d = spark.createDataFrame(rows_, "assertion_id long, term_key string, org_key string, assertion_text string")
    members, classes = definitions.definition_classes(d)
    member = members.collect()
    by = {}
    for r in member:
        by.setdefault(r["class_id"], []).append(r["assertion_id"])
    made = set()
    for r in classes.collect():
        a, b = by[r["class_a"]], by[r["class_b"]]
        own = {(min(x, y), max(x, y), r["same_text"], r["cross_org"]) for x in a for y in b if x != y}
        assert len(own) == r["n_pairs"]
        made |= own
    want = {(r["a_id"], r["b_id"], r["same_text"], r["suppressed"]) for r in definitions.definition_pairs(d, across_organisations=False).collect()}
    assert made == want and len(member) == 13


def test_meeting_quantities(spark):
    from dissona.functions import quantities
    from dissona.operators import numeric

    texts = ["Revenue grew 12% in fiscal 2025. Costs fell $3 million.", "Revenue declined 5% in fiscal 2025.", "Revenue grew 20% in fiscal 2025.", "Costs rose $4 million.", "Nothing here."]
    df = spark.createDataFrame([(g, i + 10 * g, t) for g in (1, 2) for i, t in enumerate(texts)], "g long, i long, t string").withColumn("q", quantities.extract_quantities("t"))
    a, b = df.select("g", F.col("i").alias("a_key"), F.col("q").alias("qa")), df.select("g", F.col("i").alias("b_key"), F.col("q").alias("qb"))
    pairs = a.join(b, "g").filter("a_key < b_key")
    for got, want in ((numeric.flipping(df, "g", "i", "q"), quantities.sign_flips("qa", "qb")), (numeric.disagreeing(df, "g", "i", "q"), quantities.value_disagreements("qa", "qb"))):
        full = pairs.withColumn("d", want).filter("size(d) > 0").select("g", "a_key", "b_key", "d")
        assert sorted(map(str, got.select("g", "a_key", "b_key", "d").collect())) == sorted(map(str, full.collect())) and got.count()


def test_reviewed_rows_of_pairs_and_triangles(spark):
    from dissona.operators import audit, evaluation

    f = spark.createDataFrame([("f1", "r", "contradiction", "a", "b", "contradiction"), ("f2", "r", None, "a", "c", "uncertain")], "finding_id string, run_id string, detector_type string, assertion_a_id string, assertion_b_id string, judge_verdict string")
    m = spark.createDataFrame([("m1", "r", ["c", "a", "b"], "multi_party_contradiction"), ("m2", "r", ["a", "b", "d"], "uncertain")], "finding_id string, run_id string, assertion_ids array<string>, judge_verdict string")
    reviews = spark.createDataFrame([("a:b", "contradiction", "confirmed"), ("a:b:c", "multi_party", "false_positive"), ("a:b:d", "contradiction", "confirmed")], "pair_key string, detector_type string, verdict string")
    got = audit.reviewed_rows(f, m, reviews)
    assert rows(got) == [("contradiction", "contradiction", "confirmed"), ("multi_party", "multi_party_contradiction", "false_positive")]
    assert {(r["detector_type"], r["precision"]) for r in evaluation.detector_precision(got).collect()} == {("contradiction", 1.0), ("multi_party", 0.0)}
    assert audit.multi_party_findings(m, run_id="r", verdict="uncertain").count() == 1
    both = audit.with_multi_reviews(m, reviews)
    assert audit.drawer(both).count() == 1 and audit.drawer(both, show_reviewed=True).count() == 2


def test_active_corpus(spark):
    from dissona.operators import audit

    c = spark.createDataFrame([("1", "beta"), ("2", "alpha"), ("3", "gamma")], "corpus_id string, corpus_name string")
    runs = lambda *x: spark.createDataFrame(list(x), "corpus_id string, finished_at string").withColumn("finished_at", F.to_timestamp("finished_at"))
    one = lambda *a: [r["corpus_id"] for r in audit.active_corpus(*a).collect()]
    some = runs(("1", "2024-01-01"), ("3", "2024-03-01"), ("2", None))
    assert one(c, some, "2") == ["2"] and one(c, some, "nope") == ["3"] and one(c, some) == ["3"]
    assert one(c, runs(("2", None))) == ["2"] and one(c, runs(("gone", "2025-01-01"), ("1", "2024-01-01"))) == ["2"]
    assert one(c.limit(0), some) == []


def test_probes_and_orphans(spark):
    a, b = spark.range(3), spark.range(2).withColumnRenamed("id", "k")
    assert store.any_rows(a.limit(0), b).first()["there"] and not store.any_rows(a.limit(0), b.limit(0)).first()["there"]
    assert [r["id"] for r in store.orphans(a, b, "id", "k").collect()] == [2]
    v = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0])], "assertion_id string, embedding array<float>")
    assert store.vector_of(v, "x").first()["embedding"] == [1.0, 2.0]
    assert store.checked_vectors(v.limit(1), 2).count() == 1
    with pytest.raises(Exception, match="2 numbers"):
        store.checked_vectors(v, 2).collect()
