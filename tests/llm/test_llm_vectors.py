"""Hard negatives, whitening and shards: against brute force, and on awkward, empty and skewed tables."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dissona.llm import negatives, sharding, whitening
from dissona.llm.vectors import largest_inner, packed, scaled, unpacked

DATA = "/root/testdata"
SCHEMA = "vec_id long, embedding array<double>, label int, id long, row string, score double"


def frame(spark, rows):
    """Rows with further columns whose names operators use."""
    return spark.createDataFrame([(*r, 1, "r", 0.5) for r in rows], SCHEMA)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def integers(v, width):
    return [math.floor(256 * c) for c in v] + [0] * (width - len(v))


AWKWARD = [
    (0, [0.5, 0.25], 1), (50, [0.5, -0.25], 1), (50, [0.5, -0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.25], 2), (3, [0.25, 0.25], 2), (3, [0.25, 0.25], 2),
    (4, None, 1), (5, [0.1, None], 1), (6, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 2), (None, [0.3, 0.3], 2), (9, [0.3, 0.3], None), (100, [], 1),
    (11, [0.25], 3), (12, [0.3, 0.1, 0.2], 2), (14, [0.3, 0.2], 0), (21, [0.3, 0.2], 1), (-50, [0.0, 0.0], 1), (150, [-0.5, -0.5], 4), (13, [-0.5, -0.25], 1),
]


def brute_negatives(rows):
    width = max((len(r[1]) for r in rows if usable(r[1])), default=0)
    x = [(i, integers(v, width), (lab + 1) % 10 if i % 7 == 0 else lab) for i, v, lab in rows if i is not None and lab is not None and usable(v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for n, (i, a, lab) in enumerate(x):
        if i % 50:
            continue
        rest = sorted(((-dot(a, b), j, k) for k, (j, b, _) in enumerate(x) if k != n))
        for s, p, _ in [r for r in rest if x[r[2]][2] == lab][:5]:
            fit = [r for r in rest if x[r[2]][2] != lab and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(i, p, k, j, -s, -t) for k, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_negatives_of_an_awkward_table(spark):
    want = brute_negatives(AWKWARD)
    assert len(want) > 20 and mined(frame(spark, AWKWARD)) == want
    assert mined(frame(spark, AWKWARD).limit(0)) == []
    assert mined(frame(spark, [r for r in AWKWARD if r[0] not in (0, 50, 100, -50, 150)])) == []


@pytest.mark.parametrize("options", [{}, {"pivots": 12, "block": 2, "slice_rows": 16}])
def test_negatives_against_all_pairs(spark, options):
    """Clusters of several norms, one vector in a third of the rows; blocks and slices of a few rows."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, s) for _ in range(6)] for s in (0.1, 0.5, 1, 3)]
    kinds = [rng.randrange(4) for _ in range(400)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[k]], rng.choice([k, k, k, 7])) for i, k in enumerate(kinds)]
    rows += [(i, centres[1], rng.choice([1, 2])) for i in range(400, 600)]
    want = brute_negatives(rows)
    assert len(want) > 50 and mined(frame(spark, rows), **options) == want


def test_far_groups_are_not_served(spark):
    """Two clusters far from each other: bounds keep the rows of one from the other's anchors."""
    rng = random.Random(2)
    rows = [(i, [(9.0 if i // 50 % 2 else -9.0) + rng.gauss(0, 0.1), rng.gauss(0, 0.1), 9.0], i % 3) for i in range(600)]
    sent = []
    plain = negatives._serve

    def counting(*args):
        sent.append(plain(*args))
        return sent[-1]

    negatives._serve = counting
    try:
        got = mined(frame(spark, rows), pivots=8, block=6)
    finally:
        negatives._serve = plain
    assert got == brute_negatives(rows)
    groups = sent[0].filter("asks").select("g").distinct().count()
    assert groups > 1 and sent[0].filter("not asks").count() < 0.7 * len(rows) * groups


def test_large_components_stay_exact(spark):
    rows = [(50 * i, [3e5 + i, -2e5 + 3 * i, 1e5], 1) for i in range(8)] + [(7 * i + 1, [2.4e5 + i, -2e5, 1.0 * i], 2) for i in range(8)]
    want = brute_negatives(rows)
    assert want and max(r[4] for r in want) > 1 << 53 and mined(frame(spark, rows)) == want
    assert largest_inner(64) ** 2 * 64 <= 1 << 62
    assert mined(frame(spark, [(0, [1e300], 1), (1, [1e300], 1), (2, [1e299], 2)])) == []  # all are cut to one size, so no score is within the window


def test_packed_vectors():
    lists = pa.array([[1.0, -0.001], None, [], [2.5, None], [float("nan")], [0.5]], pa.list_(pa.float64()))
    good, x = scaled(lists.slice(0), 256, 2)
    assert good.tolist() == [True, False, True, False, False, True] and x[good].tolist() == [[256, -1], [0, 0], [128, 0]]
    again = unpacked(packed(x.astype("<i2")).slice(1, 4), "<i2", 2)
    assert (again == x[1:5]).all()


def brute_whitening(rows):
    width = max((len(r[1]) for r in rows if usable(r[1])), default=0)
    x = np.array([integers(r[1], width) for r in rows if usable(r[1])], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def check_whitening(found, rows, k=4):
    x, n, sums, values, vectors = brute_whitening(rows)
    k = min(k, len(values))
    assert found["n"].eq(n).all() and len(found) == k * len(x)
    by = {c: found[found["component"] == c].reset_index(drop=True) for c in range(1, k + 1)}
    want_deviation = sorted(sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums, strict=True)) for r in x)
    for c, own in by.items():
        assert sorted(own["deviation"].tolist()) == want_deviation
        assert own["explained"].sub(values[c - 1] / values.sum()).abs().max() < 1e-9
        want = np.sort((x - sums / n) @ vectors[:, c - 1] / values[c - 1] ** 0.5)
        got = np.sort(own["whitened"].to_numpy())
        assert min(np.abs(got - want).max(), np.abs(got + want[::-1]).max()) < 1e-8
    assert found["identity_error"].max() < 1e-9


def test_whitening_against_plain_moments(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(5, 1, (300, 5)) * [3, 2, 1, 0.5, 0.2] @ rng.normal(size=(5, 5))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist(), 2) for i in range(150)]
    df = frame(spark, rows).repartition(7)
    check_whitening(whitening.whiten(df).toPandas(), rows)
    check_whitening(whitening.whiten(df, components=9).toPandas(), rows, 9)
    assert whitening.whiten(df).select("n").first()[0] == 300


def test_whitening_of_awkward_tables(spark):
    found = whitening.whiten(frame(spark, AWKWARD)).toPandas()
    check_whitening(found, AWKWARD)
    assert found["vec_id"].isna().sum() == 3 and found.columns.tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame(spark, AWKWARD).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 1.0], 1)] * 3)).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    line = whitening.whiten(frame(spark, [(i, [i * 1.0, 2.0 * i, 0.0], 1) for i in range(5)])).collect()  # rank one
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)} and max(r.identity_error for r in line) < 1e-9
    far = whitening.whiten(frame(spark, [(i, [1e9 * i, 1.0], 1) for i in range(3)])).collect()
    assert all(r.deviation is None or r.deviation < 1 << 63 for r in far) and any(r.deviation is None for r in far)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**6), 10**6, (100, 3)) + 10**9
    parts = [whitening.moments(p) for p in np.split(x, [1, 7, 50, 51])]
    for order in (range(5), (4, 2, 0, 3, 1)):
        whole = None
        for i in order:
            whole = parts[i] if whole is None else whitening.merged(whole, parts[i])
        centred = x - x.mean(0)
        assert whole[0] == 100 and [int(s) for s in whole[1]] == x.sum(0).tolist()
        assert np.allclose(whole[2], x.mean(0), rtol=1e-14) and np.allclose(whole[3], centred.T @ centred, rtol=1e-9, atol=1)


def check_shards(found, rows, shards=8):
    """Slots are gapless, sizes and checksums right, all rows there; gives the bytes of each shard and the shards of each text."""
    size, texts, at = [0] * shards, {}, [[] for _ in range(shards)]
    want = sorted(((d is not None, d or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.size, r.text_crc32) for r in found) == want
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r.size
        at[r.shard].append(r.slot)
        texts.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in at)
    return size, texts


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    size, texts = check_shards(sharding.assign_shards(docs).collect(), rows)
    assert max(size) < 1.03 * sum(size) / 8 and min(size) > 0.97 * sum(size) / 8
    assert all(len(s) == 1 for s in texts.values())


def test_a_hot_text_is_cut_and_others_stay_whole(spark):
    rng = random.Random(1)
    rows = [(i, "the same text " * 3) for i in range(1000)] + [(i, str(rng.random()) * rng.randrange(1, 6)) for i in range(1000, 2000) for _ in range(rng.choice([1, 1, 2]))] + [(7, "one row many times")] * 900
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    size, texts = check_shards(sharding.assign_shards(df, ranges=64).collect(), rows)
    assert max(size) - min(size) < 0.05 * sum(size) / 8
    hot = {zlib.crc32(t.encode()) for t in ("the same text " * 3, "one row many times")}
    assert all(len(texts[h]) > 1 for h in hot) and all(len(s) == 1 for h, s in texts.items() if h not in hot)
    splitters, counts = sharding._split(sharding._records(df, "doc_id", "text", False), 64)
    assert max(r[1] for r in counts) <= sharding.OVERFULL * sum(size) / 64 * 1.01 and len(counts) < 256


def test_a_heavy_document_has_a_range_of_its_own(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(1000, "x" * 50_000)]
    splitters, counts = sharding._split(sharding._records(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", False), 64)
    assert [r[2] for r in counts if r[1] > 50_000] == [1]


def test_shards_of_awkward_tables(spark, awkward, tmp_path):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check_shards(sharding.assign_shards(awkward).collect(), rows)
    check_shards(sharding.assign_shards(awkward, 3).collect(), rows, 3)
    empty = sharding.assign_shards(awkward.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sharding.write_shards(awkward, f"{tmp_path}/out", 2)
    back = spark.read.parquet(f"{tmp_path}/out").orderBy("shard", "slot").select("row.*")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(back) == key(awkward.select(*back.columns)) and back.columns == awkward.columns
    one = sharding.assign_shards(awkward).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, sharding.assign_shards(awkward).select("doc_id", "shard", "slot").collect()), key=repr)
