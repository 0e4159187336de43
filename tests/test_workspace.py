import io
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from dissona import cli
from dissona.plans import plugins
from dissona.plans.workspace import ActiveRunError, Workspace
from dissona.sources import documents, readers


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Heading", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("First part.") + p("Page 3") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(lines, pages=1, size=0):
    text = b"BT /F1 12 Tf " + b" ".join(b"0 -14 Td (%s) Tj" % s.replace("(", r"\(").replace(")", r"\)").encode() for s in lines) + b" ET"
    data = zlib.compress(text)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj << /Type /Page >> endobj\n" % i for i in range(pages)) + b"9 0 obj << /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(data), data) + b"%" * size


def test_docx_and_pdf(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.pdf").write_bytes(pdf(["One line", "A (second) line"]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {r["title"]: r["text"] for r in readers.load_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a": "Heading\n\nFirst part.\n\na b", "b": "One line\n\nA (second) line", "c": ""}
    spans = documents.load_elements(spark.read.format("binaryFile").load(str(tmp_path / "a.docx")), ".docx").first()
    assert [spans["text"][s["char_start"] : s["char_end"]] for s in spans["spans"]] == ["Heading", "First part.", "a b"]


def test_pdf_with_mapped_fonts_and_compressed_objects():
    cmap = b"begincmap 1 beginbfchar <0003> <0020> endbfchar 1 beginbfrange <0024> <0026> <0041> endbfrange endcmap"
    text = b"BT /F1 12 Tf <0024 0025> Tj [<0003> -250 <0026>] TJ 0 -14 Td /F2 9 Tf (plain \\(one\\)) Tj <21> Tj ET"
    inner = b"<< /Type /Page /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >> << /Type /Font /ToUnicode 5 0 R >>"
    index = b"2 0 3 %d " % inner.index(b"<< /Type /Font")
    packed = zlib.compress(index + inner)
    stream = lambda n, head, data: b"%d 0 obj << %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, head, len(data), data)
    whole = b"%PDF-1.5\n" + stream(7, b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % len(index), packed) + stream(5, b"", cmap) + stream(6, b"/Filter /FlateDecode", zlib.compress(text))
    assert documents.pdf_elements(whole) == [("NarrativeText", "AB C"), ("NarrativeText", "plain (one)!")]
    assert documents.pdf_pages(whole) == 1 and documents.pdf_pages(b"no") == 0
    with pytest.raises(ValueError, match="encrypted"):
        documents.pdf_elements(whole + b"trailer << /Encrypt 9 0 R >>")


def test_ocr_states(spark, tmp_path):
    for name, lines, pages, size in (("good", ["x" * 200], 2, 200_000), ("poor", ["x"], 2, 200_000), ("bad", ["y"], 2, 200_000), ("short", ["z"], 1, 10), ("error", ["w"], 2, 200_000)):
        (tmp_path / f"{name}.pdf").write_bytes(pdf(lines, pages, size))

    def ocr(content):
        text = documents.pdf_elements(content)[0][1]
        if text == "w":
            raise RuntimeError("no engine")
        return [("NarrativeText", text * (300 if text == "x" else 1))]

    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in documents.load_elements(files, ".pdf", ocr).collect()}
    records = documents.ocr_records(documents.load_elements(files, ".pdf", ocr)).collect()
    assert sorted(r["event"] for r in records) == ["escalated", "ocr_error", "ocr_failed"]
    assert got == {"good.pdf": "ok", "poor.pdf": "escalated", "bad.pdf": "ocr_failed", "short.pdf": "ok", "error.pdf": "ocr_error"}


@pytest.fixture
def place(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text('Terms follow. "Loan" means any advance. Revenue grew 12% in fiscal 2025.')
    (folder / "b.md").write_text('Terms follow. "Loan" means any credit. Revenue declined 5% in fiscal 2025.')
    w = Workspace(spark, str(tmp_path / "w"))
    assert w.migrate() == list(range(1, 11)) and w.migrate() == []
    return w, str(folder)


def test_ingest_check_review_report(place):
    w, folder = place
    small = readers.Config(max_chunk_chars=45)
    got = w.ingest(folder, "main", config=small)
    assert got["documents"] == 2 and got["assertions"] == got["embedded"] >= 4
    before = w.stats().first()
    w.ingest(folder, "main", config=small)
    assert w.stats().first() == before
    judge = plugins.FixtureJudge({}, ("definition_divergent", "They differ.", []))
    config = readers.Config(pairwise_enabled=True, gate_similarity_threshold=-1.0, nli_contradiction_threshold=0.0, deep=True, judge_provider="fixture")
    assert w.estimate("main", config).first()["n_calls"] > 0
    run = w.check("main", judge=judge, config=config)
    found = w.findings(run)
    assert found.filter("judge_verdict = 'numeric_short_circuit'").count() == 1
    d = found.filter("detector_type = 'definition_inconsistency'").first()
    assert d["judge_verdict"] == "definition_divergent"
    whole = w.report()
    assert "### Loan" in whole and w.latest_run("main") == run
    w.write_report(f"{w.folder}-report")
    parts = sorted(p for p in os.listdir(f"{w.folder}-report") if p.startswith("part-"))
    assert "".join(open(f"{w.folder}-report/{p}", encoding="utf-8").read() for p in parts).rstrip("\n") == whole.rstrip("\n")
    w.review(d["assertion_a_id"], d["assertion_b_id"], "definition_inconsistency", "false_positive")
    assert "### Loan" not in w.report()
    assert {r["detector_type"]: r["precision"] for r in w.precision("main").collect()}["definition_inconsistency"] == 0.0
    w.review(d["assertion_a_id"], d["assertion_b_id"], "definition_inconsistency", None)
    assert "### Loan" in w.report()
    with pytest.raises(ValueError):
        w.check("main", judge=judge, config=readers.Config(deep=True))
    with pytest.raises(ValueError):
        w.review("a", "b", "contradiction", "maybe")
    with pytest.raises(ValueError):
        w.embed_pending(plugins.HashEmbedder(8))
    assert w.rebuild_index(plugins.HashEmbedder(8)) == before["n_assertions"]


def test_corpora_and_runs(place):
    w, folder = place
    w.ingest(folder, "main")
    other = w.create_corpus("other", provider="unheard-of")
    assert w.read("corpora").filter(F.col("corpus_id") == other).first()["judge_provider"] == "moonshot"
    with pytest.raises(ValueError):
        w.create_corpus("other", reuse=False)
    with pytest.raises(ValueError):
        w.corpus_id("missing")
    w.reassign("title = 'a'", "other")
    assert {r["corpus_name"]: r["n_assertions"] > 0 for r in w.sidebar().collect()} == {"main": True, "other": True}
    run = w.begin(other, "check")
    with pytest.raises(ActiveRunError):
        w.begin(other, "check")
    assert w.clear_stuck("other") == 1
    w.event(run, other, "check", "done")
    assert w.runs().filter(F.col("run_id") == run).first()["run_status"] == "failed"
    with pytest.raises(ValueError):
        w.delete_corpus("other", sure=False)
    w.rename_corpus("other", "gone")
    w.delete_corpus("gone", sure=True)
    assert [r["corpus_name"] for r in w.read("corpora").collect()] == ["main"] and w.read("documents").count() == 1


def test_commands(spark, place, tmp_path, capsys):
    w, folder = place
    go = lambda *a: cli.main(["--workspace", w.folder, *a], spark)
    assert go("ingest", folder, "main") == 0 and go("corpora") == 0
    assert "'corpus_name': 'main'" in capsys.readouterr().out
    assert go("estimate-cost", "main") == 0 and go("stats") == 0
    assert go("check", "nowhere") == 2
    assert go("export", "csv", str(tmp_path / "out")) == 0 and go("export", "xml", str(tmp_path / "o")) == 2
    assert go("delete", "main") == 2 and go("delete", "main", "--yes-i-mean-it") == 0


def test_appends_add_folders_and_writers_do_not_lose_updates(spark, tmp_path):
    from dissona.plans.workspace import FOLDERS, ConflictError

    w = Workspace(spark, str(tmp_path / "w"))
    w.migrate()
    row = lambda i: spark.createDataFrame([(f"c{i}", f"n{i}")], "corpus_id string, corpus_name string")
    for i in range(3):
        w.append("corpora", row(i))
    version = w._version("corpora")
    assert len(w._folders("corpora", version)) == 4 and w.read("corpora").count() == 3
    w.append("corpora", row(1), "corpus_id")
    assert w.read("corpora").count() == 3
    with pytest.raises(ConflictError):
        w._commit("corpora", version, [])
    before = w._version("corpora")
    w._commit("corpora", before, w._folders("corpora", before) * (FOLDERS // 4))
    w.append("corpora", row(9))
    assert len(w._folders("corpora", w._version("corpora"))) == 1
    assert w.orphans().count() == 0
    w.append("documents", spark.createDataFrame([("d", "gone")], "doc_id string, corpus_id string"))
    assert [(r["table_name"], r["n"]) for r in w.orphans().collect()] == [("documents", 1)]


def test_runs_in_the_background(place):
    w, folder = place
    thread = w.add_files(folder, "later", new=True, config=readers.Config(max_chunk_chars=45))
    thread.join(120)
    run = w.runs().filter("run_kind = 'ingest'").first()["run_id"]
    assert w.counters(run)["n_files_done"] == 2 and w.active_corpus() == w.corpus_id("later")
    seen = list(w.events(run, poll=0, tail=0))
    assert seen[-1]["closed"] and seen[-1]["run_status"] == "done" and seen[-1]["label"] == "Done" and seen[-1]["percent"] == 100
    with pytest.raises(ValueError):
        w.add_files(folder, "later", new=True)
    w.begin(w.corpus_id("later"), "check")
    with pytest.raises(ActiveRunError):
        w.add_files(folder, "later")
    w.clear_stuck("later")
    done = w.check("later", judge=plugins.FixtureJudge({}), config=readers.Config(pairwise_enabled=True, gate_similarity_threshold=-1.0, nli_contradiction_threshold=0.0))
    c = w.counters(done)
    assert c["n_pairs_judged"] <= c["n_pairs_gated"] and c["n_assertions"] > 0
    report = w.report(done)
    assert f"Candidate pairs (gated): {c['n_pairs_gated']}" in report and f"Pairs judged: {c['n_pairs_judged']}" in report and f"Assertions scanned: {c['n_assertions']}" in report
    some = w.read("assertions").first()
    assert w.assertion(some["assertion_id"]).first()["doc_label"] and len(w.vector(some["assertion_id"]).first()["embedding"]) == 64


def test_progress_and_warning(place):
    w, folder = place
    seen = []
    identify = lambda loaded: loaded.select("doc_id", F.regexp_replace("title", "^", "Maker ").alias("org_label"), F.lit("org_found").alias("org_reason"))
    w.ingest(folder, "two", progress=lambda *x: seen.append(x), identify=identify)
    assert seen == [(0, 2), (2, 2)]
    assert w.warning("two").startswith("⚠ Corpus spans 2 organizations: Maker a (1 docs), Maker b (1). Cross-org definition pairs are still compared")
    assert "suppressed" in w.warning("two", readers.Config(scope_definitions_by_org=True))
