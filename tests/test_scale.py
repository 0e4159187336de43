"""What spreads one large document or upload over tasks, and writes that take all of a batch or nothing."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissona.operators import chunking, store
from dissona.plans import plugins
from dissona.sources import readers
from dissona.streaming import ingest


def test_offsets_of_one_large_document(spark):
    """Places with gaps, blank and junk lines among them; no window holds more than a slice."""
    rng = random.Random(1)
    rows = [("d", 3 * i, rng.choice(["some words here", "  x y z  ", "", "Page 7", "längere Zeile"])) for i in range(9000)] + [("e", 0, "other"), ("f", 5, " ")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id string, idx int, text string").repartition(4)
    want, at = [], {}
    for d, i, t in sorted(rows, key=lambda r: r[:2]):
        if (t := t.strip()) and t != "Page 7":
            s = at.get(d, 0)
            want.append((d, i, t, s, s + len(t)))
            at[d] = s + len(t) + 2
    assert sorted(tuple(r) for r in store.element_text(df).collect()) == want
    assert df.groupBy("doc_id", F.floor(F.col("idx") / store.SLICE)).count().agg(F.max("count")).first()[0] <= store.SLICE


def test_uploads_beyond_the_caps(spark):
    rng = random.Random(2)
    files = [(f"{i:04}.{rng.choice(['txt', 'txt', 'exe'])}", rng.choice([1, 8 << 20, readers.UPLOAD_FILE + 1])) for i in range(400)]
    want, n, total = [], 0, 0
    for path, length in files:
        kind, fits = path.endswith(".txt"), length <= readers.UPLOAD_FILE
        n, total = n + (kind and fits), total + length * (kind and fits)
        want.append((path, length, "extension" if not kind else "file_size" if not fits else "file_count" if n > readers.UPLOAD_COUNT else "total_size" if total > readers.UPLOAD_TOTAL else None))
    rng.shuffle(files)
    got = readers.upload_decisions(spark.createDataFrame(files, "path string, length long").repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda r: r[0]) and {r[2] for r in want} >= {"extension", "file_size", "file_count", None}


def test_a_batch_is_written_whole_or_not_at_all(spark, tmp_path):
    target, allowed = f"{tmp_path}/table", {"v": ("a", "b"), "w": ("x",)}
    rows = lambda *r: spark.createDataFrame(r, "v string, w string, n int").repartition(3)
    assert store.write_checked(rows(("a", "x", 1), ("b", "x", 2)), target, allowed) == 2
    with pytest.raises(store.RefusedError, match="refused: 2 in v, 1 in w") as e:
        store.write_checked(rows(*[("a", "x", i) for i in range(50)], ("c", "x", 1), (None, None, 1)), target, allowed)
    assert e.value.counts == {"v": 2, "w": 1}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.write_checked(rows(("a", "x", 0)).withColumn("n", F.expr("1 div n")), target, allowed)
    assert store.write_checked(rows(("a", None, 3)), target, allowed, nullable=("w",)) == 1
    assert store.write_checked(rows(("a", "x", 1)).limit(0), target, allowed) == 0
    assert sorted(r["n"] for r in store.read_checked(spark, target).collect()) == [1, 2, 3]
    assert all(p.startswith("batch=") for p in os.listdir(target))


@pytest.mark.parametrize("broken", [None, *ingest.STAGES])
def test_a_stream_that_breaks_off_is_taken_up(spark, tmp_path, broken):
    """After any stage: no row twice, none missing, and the extractor isn't asked again for what it has answered."""
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("".join(f"Sentence {k} {i}.\n" for i in range(4)) + "The same.\n")
    asked = spark.sparkContext.accumulator(0)

    def extract(chunks):
        many = chunks.count()
        asked.add(many)
        return plugins.extracted(chunks, plugins.FixtureExtractor())

    steps = ingest.Steps(extract, lambda a: a.select("assertion_id", plugins.embedding(a, "assertion_text", plugins.HashEmbedder(4)).alias("embedding")), max_chars=1)
    left = [broken] if broken else []

    def after(stage, batch):
        if left and (stage, batch) == (left[0], 1):
            left.pop()
            raise RuntimeError("broken off")

    run = lambda checkpoint: ingest.ingest_corpus(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", "main", steps, files_per_batch=1, slices=2, after=after).awaitTermination()
    if broken:
        with pytest.raises(Exception, match="broken off"):
            run("a")
    run("a")
    run("b")  # replays all files
    t = {name: spark.read.parquet(f"{tmp_path}/out/{name}") for name in ingest.STAGES}
    assert [t[n].count() for n in ingest.STAGES] == [3, 15, 15, 15] and asked.value == 15
    assert t["assertions"].join(t["vectors"], "assertion_id").count() == 15


# Sentence boundaries that a window must not miss or make, one text each.
BOUNDARIES = {
    "One. Two.": ["One. ", "Two."],
    "Dr. Low met J. Smith. He left.": ["Dr. Low met J. Smith. ", "He left."],
    "See fig. 3 and sec. 4.\nNext line": ["See fig. 3 and sec. 4.\n", "Next line"],
    "It ended etc.\nThen on.": ["It ended etc.\n", "Then on."],
    'He said "stop." Then left!  Why?': ['He said "stop." ', "Then left!  ", "Why?"],
    "No mark\n\n\nbut lines\n": ["No mark\n\n\n", "but lines\n"],
    "Version 1.2.3 of the U.S. law. Done": ["Version 1.2.3 of the U.S. law. ", "Done"],
    "What?! Yes... so. (Really.) no. 5": ["What?! ", "Yes... ", "so. ", "(Really.) ", "no. 5"],
    "Ends in a single A. Then": ["Ends in a single A. Then"],
    "  leading. x": ["  leading. ", "x"],
}


@pytest.mark.parametrize("text", sorted(BOUNDARIES))
def test_sentence_boundaries(text):
    spans = chunking.sentence_spans(text)
    assert [text[s:e] for s, e in spans] == BOUNDARIES[text]


def test_checked_write_keeps_types(spark, tmp_path):
    df = spark.createDataFrame([("a", [1], None)], T.StructType.fromDDL("v string, xs array<int>, at timestamp"))
    store.write_checked(df, f"{tmp_path}/t", {"v": ("a",)})
    assert store.read_checked(spark, f"{tmp_path}/t").dtypes == df.dtypes
