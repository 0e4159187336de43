"""Operators on awkward and empty tables, and against brute force."""

import hashlib
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from dissona.llm import decon, langid, mlm, packing, pii, quality, secrets, simhash, sstable, suffixdedup
from dissona.llm.runs import LoserTree, common, decoded, equal_places, front_code
from dissona.llm.tokens import Coder, default_path

DATA = "/root/testdata"
LEAST_TOLD_APART = 0.85  # of held-out documents of 20 words or more, true order against shuffled words


@pytest.fixture(scope="session")
def coder():
    return Coder(default_path())


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


def run_all(spark, docs, labels, benchmark, folder):
    """Row count of each operator's result."""
    shards = sstable.write_shards(docs, folder)
    model = langid.learn(docs)
    return {
        "packing": packing.pack_documents(docs).select("doc_id", "start").distinct().count(),
        "shards": sstable.read_shards(spark, folder, shards).count(),
        "simhash": simhash.near_duplicates(docs).count(),
        "scores": mlm.score_documents(docs).count(),
        "secrets": secrets.digest(secrets.scan_secrets(docs)).count(),
        "repeats": suffixdedup.remove_repeats(docs).count(),
        "language": langid.predict_languages(docs, model).count(),
        "quality": quality.judge_quality(docs, quality.train(docs, labels)).count(),
        "pii": pii.digest(pii.scan_pii(docs)).count(),
        "leaks": decon.find_leaks(docs, benchmark).count(),
    }


def test_awkward_table(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta"), (None, "never here at all, never"), (2, None), (3, " ")], "item_id long, text string")
    got = run_all(spark, awkward, labels, benchmark, f"file://{tmp_path}/s")
    n = awkward.count()
    assert got.pop("packing") >= 8
    assert set(got.values()) == {n}


def test_awkward_values(spark, awkward):
    """What each operator says of nulls, empty and long texts, ties and repeated rows, row by row."""
    rows = awkward.collect()
    of = lambda df, *columns: sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    want = lambda f: sorted(map(str, ((r["doc_id"], *f(r["text"] or "")) for r in rows)))
    assert of(secrets.digest(secrets.scan_secrets(awkward)), "doc_id", "n_assign", "spans") == want(lambda t: (brute_secrets(t).count("assign:"), brute_secrets(t)))
    assert of(pii.digest(pii.scan_pii(awkward)), "doc_id", "n_email", "spans") == want(lambda t: (0, ""))
    repeats = brute_repeats_of_texts([r["text"] for r in rows], 400)
    assert of(suffixdedup.remove_repeats(awkward), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(str((r["doc_id"], *x)) for r, x in zip(rows, repeats, strict=True))
    said = langid.predict_languages(awkward, langid.learn(awkward), keep=("doc_id", "text")).collect()
    assert all((r["lang_pred"] == "und" and r["score"] == 0) != any(map(str.isalpha, r["text"] or "")) for r in said) and {r["lang_pred"] for r in said} <= {"en", "fr", "und"}
    counts = lambda t: (len(t.split()), len(re.sub(r"[ \t\n\v\f\r]", "", t)), len(t.split()) < 20 or 100 * brute_repeats(t.split()) > 30 * len(t.split()))
    short = [r for r in rows if len(r["text"] or "") < 5000]  # brute_repeats is quadratic
    got = quality.judge_quality(awkward, None).filter("n_words < 1000")
    assert of(got, "doc_id", "n_words", "word_chars", "base_failed") == sorted(str((r["doc_id"], *counts(r["text"] or ""))) for r in short)
    scored = mlm.score_documents(awkward).collect()
    assert sorted(str((r["doc_id"], r["n_tokens"])) for r in scored) == sorted(str((r["doc_id"], len((r["text"] or "").split()))) for r in rows)
    assert all((r["mean_log_likelihood"] is None) == (r["n_tokens"] == 0) and r["log_likelihood"] <= 0 for r in scored)
    assert len({r["log_likelihood"] for r in scored if r["doc_id"] == 1}) == 1
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "naïve straße été on")], "item_id long, text string")
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert of(decon.find_leaks(awkward, benchmark), "doc_id", "item_ids") == want(lambda t: (sorted(brute_leaks(t, items)),))


def test_empty_table(spark, awkward, tmp_path):
    none = awkward.limit(0)
    got = run_all(spark, none, spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string"), f"file://{tmp_path}/s")
    assert set(got.values()) == {0}


def test_ids_are_those_of_whole_texts(coder, library):
    assert coder.regular and coder.added
    assert library("a <|endoftext|> b") == np.array([64, 220, 50256, 275], "<u4").tobytes() == coder.ids("a <|endoftext|> b")
    rng = random.Random(1)
    bits = [*"ab \n\t  'sé1_-%$€", " ", "　", "᠎", "\x1c", "\x85", "​", "日本", "<|endoftext|>", "'ll", "don't", " the", " 12", " ..", "Word,", "<|endof", "text|>", "½", "²", "Ⅷ", "x²", "\u0301"]
    for _ in range(4000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert coder.ids(t) == library(t), t


def test_a_tokenizer_of_another_kind_gets_whole_texts(tmp_path):
    import json

    known = json.load(open(default_path()))
    known["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(known))
    other = Coder(str(tmp_path / "t.json"))
    assert not other.regular and other.ids("two words") == other.whole("two words") == Coder(default_path()).ids(" two words")


def test_packing(spark, awkward, library):
    rows = packing.pack_documents(awkward.repartition(3)).collect()
    whole = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        whole.setdefault(r["doc_id"], []).append(r)
    texts = awkward.collect()
    for doc, parts in whole.items():
        if sum(t["doc_id"] == doc for t in texts) == 1:
            parts.sort(key=lambda r: r["start"])
            text = next(t["text"] for t in texts if t["doc_id"] == doc)
            assert b"".join(p["ids"] for p in parts) == library(text or "") + bytes(4)
            assert [p["start"] for p in parts] == list(np.cumsum([0] + [p["length"] for p in parts[:-1]]))
            assert {p["doc_tokens"] for p in parts} == {sum(p["length"] for p in parts)}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for s in by.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == list(np.cumsum([0] + [r["length"] for r in s[:-1]]))
        n = sum(r["length"] for r in s)
        assert n <= 1024 and {r["padded_to"] for r in s} == {n if n & (n - 1) == 0 else 1024}


def test_packing_is_tight_and_groups_are_even(spark, docs):
    rows = packing.pack_documents(docs, with_ids=False).toPandas()
    s = rows.groupby("sequence_id").agg(n=("length", "sum"), room=("padded_to", "first"), g=("step_group", "first"))
    assert s.n.sum() / s.room.sum() > 0.98
    for _, own in s.groupby("n"):
        sizes = own.groupby("g").n.sum()
        assert sizes.max() <= packing.GROUP_TOKENS and sizes.max() - sizes.min() <= own.n.iloc[0]


def test_shards(spark, awkward, library, tmp_path):
    folder = f"file://{tmp_path}/s"
    made = sstable.write_shards(awkward, folder, shard_bytes=2000)
    got = sstable.read_shards(spark, folder, made).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    want = sorted((t["doc_id"] is not None, t["doc_id"] or 0, library(t["text"] or "") + (2).to_bytes(4, "little")) for t in awkward.collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    for r in made:
        reader = sstable.open_shard(f"{folder}/{r['shard']}")
        there = {}
        for k, v in reader.entries():
            there.setdefault(sstable.id_of(k), []).append(v)
        assert reader.entries_n == r["entries"] and reader.ids_n == r["ids"]
        assert all(reader.get(k) == v for k, v in there.items())
        assert reader.get(10**12) == []


def test_a_damaged_shard_is_noticed(spark, docs, tmp_path):
    made = sstable.write_shards(docs.limit(5), f"file://{tmp_path}/s")
    path = tmp_path / "s" / made[0]["shard"]
    data = bytearray(path.read_bytes())
    data[20] ^= 255
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.open_shard(f"file://{path}").entries())


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(awkward, docs):
    for t in [r["text"] for r in awkward.collect()] + [r["text"] for r in docs.limit(40).collect()] + ["A b", "ÀB c\x0bd e", "a b c d"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def brute_components(rows):
    """doc_id to least id, by comparing all."""
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("tile", "k"), [(4, 1), (1024, 1), (4, 3), (1024, 2)])
def test_links_and_components(spark, tile, k):
    """Small tiles lay hot groups out in pairs; finer groups lose no link."""
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):
        f = rng.choice(fps)
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "fp long").repartition(3)
    from dissona.llm.graph import components

    found = {r["node"]: r["root"] for r in components(simhash.links(df, 3, tile, k)).collect()}
    numbers = [int(np.uint64(f).view(np.int64)) for f in set(fps)]
    want = brute_components([(n, int(np.int64(n).view(np.uint64))) for n in numbers])
    assert sorted(((n, found.get(n, n)) for n in numbers), key=str) == want


def test_near_duplicates(spark, awkward):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect()]
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in awkward.collect()])
    assert sorted(got, key=str) == want


def test_a_long_chain_is_one_component(spark):
    from dissona.llm.graph import components

    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "a long, b long")
    assert {r["root"] for r in components(df).collect() if r["node"] < 400} == {0}


def test_pseudo_likelihood_by_hand():
    """Each token from both sides only, and the sum of it over a text, as written out; probabilities of all tokens add up to one."""
    net = mlm.untrained([("a", 5), ("b", 3), ("c", 2)], np.array([1, 1]), width=4)
    shares = np.array([5, 3, 2, 1, 1]) + 0.5
    _, alone = mlm.score_texts(net, ["a", "b", "c"])
    assert np.allclose(np.exp(alone), (shares / shares.sum())[:3], atol=1e-6)
    net.out[:] = np.random.default_rng(2).normal(size=net.out.shape)
    text = "a b zz A c"
    ids = [0, 1, 3 + zlib.crc32(b"zz") % 2, 0, 2]
    padded = [5, 5, *ids, 5, 5]

    def probability(token, h):
        p = 1.0
        for k in range(net.first[token], net.first[token] + net.steps[token]):
            p /= 1 + np.exp(-net.sides[k] * (h @ net.out[net.nodes[k]] + net.bias[net.nodes[k]]))
        return p

    total = 0.0
    for i, own in enumerate(ids):
        h = np.tanh(sum(net.embed[padded[i + 2 + o]] * net.scale[k] for k, o in enumerate(mlm.OFFSETS)))
        assert abs(sum(probability(t, h) for t in range(5)) - 1) < 1e-5
        total += np.log(probability(own, h))
    counts, got = mlm.score_texts(net, [text, None, ""], rows=3)
    assert counts.tolist() == [5, 0, 0] and abs(got[0] - total) < 1e-4 and got[1] == got[2] == 0


def test_a_step_follows_the_gradient():
    """One step's gradient, taken from the sums of squares, against differences of the loss."""
    rng = np.random.default_rng(1)
    net = mlm.untrained([(w, 20 - i) for i, w in enumerate("abcdefgh")], np.array([3, 2, 2, 1, 1, 1, 1, 1]), width=3)
    net.out[:] = rng.normal(size=net.out.shape)
    flat, counts = net.tokens([" ".join(rng.choice(list("abcdefghxyz"), 40)) for _ in range(6)])
    at = mlm.positions(counts)
    loss = lambda: -float(net.log_probabilities(flat, 2, len(flat) - 2)[at - 2].sum(dtype=float)) / len(at)
    slope = {}
    for name, i in (("embed", (2, 1)), ("scale", (3, 0)), ("out", (4, 2)), ("bias", (5,))):
        w = getattr(net, name)
        w[i] += 0.01
        up = loss()
        w[i] -= 0.02
        slope[name, i] = (up - loss()) / 0.02
        w[i] += 0.01
    sums = [np.zeros(p.shape, np.float32) for p in net.parts]
    net.learn(flat, at, sums, 0.0)
    for (name, i), d in slope.items():
        assert abs(np.sqrt(sums[mlm.PARTS.index(name)][i]) - abs(d)) < 2e-3, name


def test_every_position_is_masked_once():
    texts = ["a b c d e f g", None, "", "h i j", "a b c d e f g"]
    counts = np.array([7, 0, 0, 3, 7])
    got = mlm.masked(texts, counts, 3)
    assert len(got) == 17 and set(got.tolist()) <= {0, 1, 2}
    assert got[:7].tolist() == got[10:].tolist() == mlm.masked(texts[:1], counts[:1], 3).tolist()
    many = mlm.masked(["x " * 30_000], np.array([30_000]), 3)
    assert all(abs((many == r).mean() - 1 / 3) < 0.02 for r in range(3))


def test_words_are_numbered_a_batch_at_a_time():
    """F1 of round 3's second list: no call of Python for a word, be it rare or not, and the numbers are those of single words."""
    rng = random.Random(3)
    texts = [" ".join(f"Wört{int(10 ** rng.uniform(0, 6))}" for _ in range(200)) for _ in range(50)] + [None, ""]
    kept = [f"wört{i}" for i in range(1, 20)]
    net = mlm.untrained([(w, 100 - i) for i, w in enumerate(kept)], np.ones(19, int))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        flat, counts = net.tokens(texts)
    finally:
        sys.setprofile(None)
    own = [w for t in texts[:50] for w in t.lower().split()]
    assert counts.tolist() == [200] * 50 + [0, 0]
    assert flat[mlm.positions(counts)].tolist() == [kept.index(w) if w in kept else 19 + zlib.crc32(w.encode()) % 19 for w in own]
    assert len(set(own)) > 1000 and len(calls) < 1000


def test_words_are_those_of_python():
    """Every character within a word, white space of all kinds, letters lowered by context, long words, parts of arrays."""
    texts = [f"x{chr(i)}Y" for i in range(0x110000) if not 0xD800 <= i < 0xE000] + ["ΟΔΟΣ ΣΑΣ a", "İi", "  a\u2003b \x1c\x85", None, "", " ", "É" * 500 + " é", "a" * 257]
    for part in (pa.array(texts), pa.array(texts)[-7:]):
        words, counts = mlm.split(part)
        want = [t.lower().split() if t else [] for t in part.to_pylist()]
        assert counts.tolist() == [*map(len, want)] and words.to_pylist() == [w for own in want for w in own]
        assert mlm.crc32(words).tolist() == [zlib.crc32(w.encode()) for own in want for w in own]
        assert mlm.crc32(words[3:5]).tolist() == mlm.crc32(words)[3:5].tolist()
    assert len(mlm.crc32(pa.array([], pa.string()))) == 0 and mlm.crc32(pa.array([""])).tolist() == [0]


def test_ways_beyond_the_first_nodes():
    """Probabilities and a step's gradient of tokens with long ways, as written out node by node."""
    rng = np.random.default_rng(5)
    net = mlm.untrained([(f"w{i}", 2000 // (i + 1)) for i in range(150)], np.ones(150, int), width=3)
    net.out[:] = rng.normal(size=net.out.shape)
    flat, counts = net.tokens([" ".join(f"w{int(x)}" for x in rng.pareto(0.7, 80) % 400) for _ in range(3)])
    at = mlm.positions(counts)
    assert net.low[flat[at]].max() > 3 and (net.low[flat[at]] == 0).any()
    loss, out, bias, embed, scale = 0.0, *(np.zeros(getattr(net, n).shape) for n in ("out", "bias", "embed", "scale"))
    each = []
    for i in at.tolist():
        e = net.embed[[flat[i + o] for o in mlm.OFFSETS]].astype(float)
        h = np.tanh((e * net.scale).sum(0))
        back, p = np.zeros(3), 0.0
        for k in range(net.first[flat[i]], net.first[flat[i]] + net.steps[flat[i]]):
            n, s = net.nodes[k], net.sides[k]
            z = s * (h @ net.out[n] + net.bias[n])
            p -= np.log1p(np.exp(-z))
            g = -s / (1 + np.exp(z)) / len(at)
            out[n] += g * h
            bias[n] += g
            back += g * net.out[n]
        each.append(p)
        back *= 1 - h * h
        scale += back * e
        for k, o in enumerate(mlm.OFFSETS):
            embed[flat[i + o]] += back * net.scale[k]
    embed[-1] = 0
    assert np.allclose(net.log_probabilities(flat, 2, len(flat) - 2)[at - 2], each, atol=1e-4)
    sums = [np.zeros(p.shape, np.float32) for p in net.parts]
    net.learn(flat, at, sums, 0.0)
    for name, want in (("embed", embed), ("scale", scale), ("out", out), ("bias", bias)):
        assert np.allclose(np.sqrt(sums[mlm.PARTS.index(name)]), np.abs(want), atol=1e-5), name


def test_word_counts(spark, docs):
    x = docs.select("doc_id", "text")
    words, by = mlm.word_counts(x)
    want = Counter(w for r in x.collect() for w in r["text"].lower().split())
    assert dict(words[:50]) == {w: want[w] for w, _ in words[:50]} and sum(n for _, n in words) + by.sum() == sum(want.values())


def test_true_order_beats_shuffled_words(spark):
    """Held-out documents against their own words in another order, by a network of width 16 trained on every position of the others."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").select("doc_id", "text")
    held = [r["text"] for r in docs.filter("doc_id % 25 = 0").collect() if len(r["text"].split()) >= 20]
    others = docs.filter("doc_id % 25 <> 0").repartition(2)
    start = mlm.untrained(*mlm.word_counts(others), width=16)
    net = mlm.train(others, start, rounds=2, share=1.0)
    rng = random.Random(8)
    mixed = []
    for t in held:
        w = t.split()
        rng.shuffle(w)
        mixed.append(" ".join(w))
    (n, own), (_, other), (_, before) = (mlm.score_texts(m, t) for m, t in ((net, held), (net, mixed), (start, held)))
    assert own.sum() / n.sum() > before.sum() / n.sum() + 0.4
    assert (own > other).mean() > LEAST_TOLD_APART


def test_vocabulary_grows_and_a_word_is_told_from_its_like(spark):
    """Two words of one frequency, each in its own surroundings; exchanged, they are less likely."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red fox runs", "blue owl flies"]) for _ in range(40)) + f" rare{i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    net = mlm.train(df, mlm.untrained(*mlm.word_counts(df)), rounds=4, share=1.0, mixers=1)
    _, (own, other) = mlm.score_texts(net, ["red fox runs", "red owl runs"])
    assert own > other + 0.5
    more = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 10**6}" for _ in range(100))) for i in range(4000)], "doc_id long, text string")
    few, many = mlm.word_counts(more.limit(100)), mlm.word_counts(more)
    assert len(many[0]) > 2 * len(few[0]) and len(many[1]) > 2 * len(few[1])


def test_secrets():
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    blob = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    base, more = secrets.scan_text(f"id = {key}\n{blob}\nhost: db.example.com:5432\n\nelsewhere {blob}")
    assert secrets.written(base) == "access:5:25"
    assert [secrets.KINDS[k] for _, k, _ in more] == ["blob", "endpoint"]
    assert secrets.scan_text(f"just {blob} and host: db.example.com")[1] == []
    assert secrets.redact_text("é password: hunter22 x") == "é <secret> x"
    assert secrets.redact_text(None) is None


def test_credentials_are_linked_over_a_whole_paragraph():
    far = " filler" * 300
    rng = random.Random(4)
    for n in (24, 32, 40, 44, 64, 88):
        blob = "aB3" + "".join(rng.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_" * 2, n - 3))
        text = f"client_id: jane77{far} {blob}{far} host: db.example.com"
        assert [secrets.KINDS[k] for _, k, _ in secrets.scan_text(text)[1]] == ["ident", "blob", "endpoint"], n
        assert blob in text and blob not in secrets.redact_text(text)
        assert secrets.scan_text(text.replace(far, f"{far}\n\n"))[1] == []
        assert secrets.scan_text(f"client_id: {blob} host: db.example.com")[1] == []


def brute_secrets(text):
    """The contract's expressions, written out anew."""
    rules = (
        ("assign", "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + r"""|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m))
    return ",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in found)


def brute_links(text):
    """Which weak candidates are linked, by looking at every other candidate of the paragraph."""
    base = secrets.base_spans(text)
    weak = secrets.weak_spans(text, base)
    paragraph = lambda x: len(re.findall(r"\n[ \t\r]*\n", text[: x[0]]))
    role = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "blob": "secret", "endpoint": "endpoint"}
    out = []
    for x in weak:
        beside = {role[secrets.KINDS[y[1]]] for y in base + weak if y != x and paragraph(y) == paragraph(x)}
        if {"ident": {"secret"}, "blob": {"identifier"}, "endpoint": {"identifier", "secret"}}[secrets.KINDS[x[1]]] <= beside:
            out.append(x)
    return out


def test_links_against_all_pairs():
    rng = random.Random(12)
    blob = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    bits = [blob, "aB3" + blob[::-1], "client_id: jane77", "user=bob", "host: db.example.com", "https://x.example.com/a", "password = hunter22", "AKIA" + "A1B2C3D4E5F6G7H8", "0f" * 16, "and", "so on", "\n", "\n\n", "\n \t\n"]
    linked = 0
    for _ in range(3000):
        t = " ".join(rng.choices(bits, k=rng.randint(0, 9)))
        got = secrets.scan_text(t)[1]
        assert got == brute_links(t), t
        linked += len(got)
    assert linked > 1000


def test_secret_base_against_the_contract():
    rng = random.Random(3)
    bits = ["token", "Secret", "api_key", "apikey", "passwd", " ", "=", ":", '"', "'", "abc", "0123456789abcdef" * 2, "AKIA", "ABCD1234" * 2, "é", "\n", "x", "/+-._", "ſecret", "toKen"]
    for _ in range(5000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        base, more = secrets.scan_text(t)
        assert secrets.written(base) == brute_secrets(t), t


def test_runs_and_loser_tree():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 7))]
        out = list(LoserTree([decoded(*front_code(r)) for r in runs]))
        assert [s for _, s, _ in out] == sorted(sum(runs, []))
        assert all(n == common(a, b) for (_, a, _), (_, b, n) in zip(out, out[1:], strict=False))


@pytest.mark.parametrize(("strings", "size"), [(10**6, 1024), (50, 7)])
def test_equal_places_of_runs(spark, strings, size):
    """Strings by the thousand, some very common, in small runs, blocks and ranges, against a count."""
    rng = random.Random(strings)
    rows = [(rng.choice(["hot", "hotter", f"k{rng.randint(0, 900):04d}", f"common beginning {rng.randint(0, 4000)}", ""]), i) for i in range(5000)]

    def strings_of(batches):
        for b in batches:
            for s, i in zip(b["s"].to_pylist(), b["i"].to_pylist(), strict=True):
                yield s.encode(), b"key", i

    got = equal_places(spark.createDataFrame(rows, "s string, i long").repartition(5), strings_of, lambda df: df.collect(), 300, size, strings)
    count = Counter(s for s, _ in rows)
    assert sorted(r["first"] for r in got) == [i for s, i in rows if count[s] > 1]


def brute_repeats_of_texts(texts, length):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by counting all strings."""
    datas = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        n = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), n, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "length", "gram", "block"), [(1, 40, 8, 4), (2, 30, 6, 16), (3, 50, 12, 8)])
def test_repeats_against_brute_force(spark, seed, length, gram, block):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    texts = [" ".join(rng.choice([word(), word(), word(), rng.choice(passages)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += [None, "", texts[3], texts[3], "ab" * 60, "ab" * 61, "x" * 200, "q" * (length - 1), texts[5][5:] + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixdedup.remove_repeats(df, length=length, gram=gram, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats_of_texts(texts, length)


def brute_passages_of_texts(texts, length):
    """n_passages, passage_words of each text, by looking up all strings of words in all other texts."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    strings = [{tuple(w[i : i + length]) for i in range(len(w) - length + 1)} for w in words]
    count = Counter(s for x in strings for s in x)
    out = []
    for w in words:
        there = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                there[i : i + length] = b"\1" * length
        out.append((len(re.findall(b"\1+", bytes(there))), sum(there)))
    return out


@pytest.mark.parametrize(("seed", "passage"), [(1, 12), (2, 5), (3, 51)])
def test_passages_against_brute_force(spark, seed, passage):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(passage - 3, 2 * passage))] for _ in range(8)]
    some = lambda: rng.choice([[word()], [word(), word()], rng.choice(passages), rng.choice(passages)[rng.randint(0, 4) :]])
    texts = ["".join(w + rng.choice([" ", " ", "\n", "\t "]) for _ in range(rng.randint(0, 12)) for w in some()) for _ in range(60)]
    texts += [None, "", texts[3], texts[3], "the " * 200, "a b " * 90, "b a " * 90, " ".join(passages[0]), "x" * 900, "x" * 900, "\u00a0 ".join("abcdefgh") * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_passages"], r["passage_words"]) for r in suffixdedup.remove_repeats(df, passage=passage).collect()}
    want = brute_passages_of_texts(texts, passage)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(n > 0 for n, _ in want) > 10


def test_short_passages_are_seen_but_stay(spark):
    """60 words of 239 bytes in two documents: no string of 400 bytes is repeated, so all stays."""
    words = [f"w{i:02d}" for i in range(60)]
    texts = [" ".join([*(f"a{i:02d}" for i in range(90)), *words]), "\n".join([*words, *(f"b{i:02d}" for i in range(90))]), " ".join(words[:50]), " ".join(f"c{i:02d}" for i in range(150))]
    got = suffixdedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_passages"], r["passage_words"]) for r in got) == [(0, 0, 1, 60), (1, 0, 1, 60), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_words_of_a_long_text_are_hashed_by_stretches():
    data = " ".join(random.Random(5).choices(["a", "bc", "déf", "\n", "x" * 70], k=3000)).encode()
    assert suffixdedup.word_hashes(data, 64).tolist() == suffixdedup.word_hashes(data).tolist()


def test_stretches_of_a_long_text_have_the_same_segments():
    data = bytes(np.random.default_rng(4).integers(97, 100, 5000, dtype=np.uint8))
    whole = {(int(a), int(h)) for x in suffixdedup.segments(data, 60, 10) for a, h in zip(x[0], x[1], strict=True)}
    parts = {(int(a), int(h)) for x in suffixdedup.segments(data, 60, 10, 700) for a, h in zip(x[0], x[1], strict=True)}
    assert whole == parts


def test_languages_held_out(spark, docs):
    d = docs.collect()
    learnt = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in d if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict_languages(docs, langid.learn(learnt)).collect()}
    held = [r for r in d if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixture_finds_both_languages(spark, docs):
    model = langid.learn(docs)
    by = {}
    for r in docs.filter("n_chars between 600 and 3000").collect():
        by.setdefault(r["lang"], r["text"][:600])
    a, b, *_ = sorted(by)
    df = spark.createDataFrame([(1, by[a] + " " + by[b]), (2, by[a]), (3, None), (4, "12 !?")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict_languages(df, model).collect()}
    assert {x["lang"] for x in got[1]["languages"]} == {a, b} and abs(got[1]["score"] - 0.5) < 0.2
    assert [x["lang"] for x in got[2]["languages"]] == [a]
    assert (got[3]["lang_pred"], got[3]["score"], got[4]["lang_pred"]) == ("und", 0.0, "und")
    signs = spark.createDataFrame([(1, "½ ² Ⅷ ① ٣"), (2, "Ⅷ é"), (3, " 1_0")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in sorted(langid.predict_languages(signs, model).collect())] == [True, False, True]


def test_a_column_without_languages_is_refused(spark):
    rows = spark.range(langid.MOST_LANGUAGES + 1).selectExpr("cast(id as string) lang", "'text' text")
    with pytest.raises(ValueError, match="different values"):
        langid.learn(rows)
    assert len(langid.learn(rows.limit(5)).names) == 5


def test_mixture_of_all_languages(spark, docs):
    model = langid.learn(docs)
    by = {}
    for r in docs.filter("n_chars between 600 and 3000").collect():
        by.setdefault(r["lang"], r["text"][:600])
    names = sorted(by)
    assert len(names) == 4
    df = spark.createDataFrame([(1, " ".join(by.values())), (2, " ".join(by[n] for n in names[:3]))], "doc_id long, text string")
    got = {r["doc_id"]: [x["lang"] for x in r["languages"]] for r in langid.predict_languages(df, model).collect()}
    assert sorted(got[1]) == names and sorted(got[2]) == names[:3]


def test_mixture_against_plain_expectation_maximisation():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(30), 3)
    c = rng.multinomial(200, [0.2, 0.5, 0.3] @ p)[None].astype(float)
    pi = np.full(3, 1 / 3)
    for _ in range(10):
        r = pi[:, None] * p / (pi @ p)
        pi = (r * c[0]).sum(1) / c.sum()
    got, ll = langid.mixtures(c, p, np.ones((1, 3)), 10)
    assert np.allclose(got[0], pi, atol=1e-6) and np.isclose(ll[0], (c[0] * np.log(pi @ p)).sum())


def test_the_set_of_languages_is_that_of_the_best_penalised_likelihood():
    """All sizes written out, without the bound that leaves some of them out."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(60) * 0.4, 4) + 1e-4
    p /= p.sum(1, keepdims=True)
    shares = [rng.dirichlet(np.ones(4) * a) for a in (0.1, 0.3, 1, 5) for _ in range(25)]
    c = np.stack([rng.multinomial(rng.integers(20, 900), x @ p) for x in shares])
    model = langid.Languages(list("abcd"), p)
    _, _, got = langid.predict_counts(c, model)
    sizes = set()
    for row, found in zip(c.astype(float), got, strict=True):
        full = langid.mixtures(row[None], p, np.ones((1, 4)), 10)[0][0]
        order = np.argsort(-full, kind="stable")
        single = row @ np.log(p).T / 3
        best, chosen = single.max(), {int(single.argmax())}
        for size in (2, 3, 4):
            allowed = np.zeros((1, 4))
            allowed[0, order[:size]] = 1
            value = langid.mixtures(row[None], p, allowed, 10)[1][0] / 3 - (size - 1) * 0.5 * np.log(row.sum())
            if value > best + 1e-3:
                best, chosen = value, set(order[:size].tolist())
            elif abs(value - best) <= 1e-3:
                break  # too near to call
        else:
            assert set(np.flatnonzero(found > 0).tolist()) == chosen
            sizes.add(len(chosen))
    assert sizes == {1, 2, 3, 4}


def brute_repeats(words):
    n = len(words) - 7
    windows = [tuple(words[i : i + 8]) for i in range(max(n, 0))]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(hit)


def test_statistics(awkward):
    rng = random.Random(2)
    texts = [r["text"] for r in awkward.collect() if len(r["text"] or "") < 2000] + ["\n".join(" ".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(12)) for _ in range(60)] + ["#a b c\n#a b c\n \n \n$%"]
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(words)]
        assert quality.statistics(t)[0] == want, t


def test_trees_are_monotone_and_flat_nodes_agree():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(600) > 0.8).astype(float)
    m = quality.fit(x, y, monotone=(1, 0, -1), trees=20)
    grid = np.repeat(rng.random((50, 3)), 40, 0)
    for j, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(m.scores(g).reshape(50, 40), axis=1) >= -1e-12).all()

    def walk(row):
        total = m.start
        for at in m.roots:
            for _ in range(m.depth):
                at = m.left[at] if row[m.feature[at]] <= m.threshold[at] else m.right[at]
            total += m.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.scores(x[:40]), [walk(r) for r in x[:40]])
    assert ((m.scores(x) > 0.5) == y).mean() > 0.85


def test_repeated_documents_and_labels_train_once(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    once = quality.train(docs, labels)
    again = quality.train(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels))
    assert all(np.array_equal(getattr(once, f), getattr(again, f)) for f in ("feature", "threshold", "left", "right", "value", "roots"))
    assert quality.train(docs, labels, fit_rows=60) is not None


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.judge_quality(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.2


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(re.sub("[ -]", "", t)) <= 19 and pii.luhn(re.sub("[ -]", "", t))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
)


def test_pii_base_against_the_contract():
    rng = random.Random(8)
    bits = ["a@b.co", "@", ".", "x", "1.2.3.4", "256", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "+", "0", "99", " ", "-", "é", "..", "a.b@", "12345678901234567890", "\n", "007"]
    for _ in range(6000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        want = [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t) if ok(m[0])]
        assert pii.scan_text(t)[0] == want, t


def test_disguised_pii_maps_back():
    for text, kind, part in (
        ("write to jane (at) mail [dot] example [dot] com today", "email", "jane (at) mail [dot] example [dot] com"),
        ("write to jane at mail dot example dot com today", "email", "jane at mail dot example dot com"),
        ("ip is １９２.168.0.1 ok", "ip", "１９２.168.0.1"),
        ("jаne@example.com", "email", "jаne@example.com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
    ):
        _, more = pii.scan_text(text)
        assert [(pii.KINDS[k], text[s:e]) for k, s, e in more] == [(kind, part)], text
    for clean in ("look at the dot on the map", "meet me at noon. dot the i", "one two three", "Страна и мир", "at dot at dot"):
        assert pii.scan_text(clean) == ([], []), clean


@pytest.mark.parametrize(("text", "part"), [
    ("call plus four four two zero six nine four six zero one two", "plus four four two zero six nine four six zero one two"),
    ("call Plus-four-four-two-oh-six-nine-four-six-oh-one now", "Plus-four-four-two-oh-six-nine-four-six-oh-one"),
    ("call plus 44 20 69 46 01 22 now", "plus 44 20 69 46 01 22"),
    ("card four one one one one one one one one one one one one one one one", None),
])
def test_numbers_spelled_without_three_seven_eight(text, part):
    base, more = pii.scan_text(text)
    assert base == [] and [text[s:e] for _, s, e in more] == [part or text[5:]]


@pytest.mark.parametrize("part", [
    "192 dot 168 dot 10 dot 1", "one nine two dot one six eight dot zero dot one", "192[.]168 dot 1 (dot) 1", "192.168 dot 10.7", "one nine two dot 168[dot]zero dot 1",
    "１９２ dot 168 point 1 punto ¹", "One-nine-two dot one six 8 Dot 0 dot oh", "192\u200b dot 168 dot 1 dot 1", "10 dot 0 dot 0 dot 1 dot 9",
])
def test_spelled_dots_between_numbers(part):
    text = f"host 7.8, {part}, and 1.2.3.4 dot"
    base, more = pii.scan_text(text)
    assert [text[s:e] for _, s, e in base] == ["1.2.3.4"] and base == pii.detect(text)
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in more] == [("ip", part.removesuffix(" dot 9"))]


def test_words_between_numbers_that_are_no_address():
    for clean in ("1 dot 2 dot 3", "256 dot 1 dot 1 dot 1", "one dot, two dot, three dot, four", "a1 dot 2 dot 3 dot 4", "1 dot 2 dot 3 dot 4th", "x² + y²", "six point five of ten points"):
        assert pii.scan_text(clean) == ([], []), clean
    for long in ("one " * 30_000, "one dot " * 20_000, "1 dot " * 20_000, "9" * 50_000 + " dot 1"):
        began = time.perf_counter()
        pii.scan_text(long)
        assert time.perf_counter() - began < 10  # linear: a fraction of a second


def test_each_disguise_of_an_address_alone_and_with_others():
    for at in ("@", " at ", " (at) ", "[at]"):
        for dots in [(a, b) for a in (".", " dot ", " [dot] ", "(.)") for b in (".", " dot ", " [dot] ", "(.)")]:
            part = f"jane{at}mail{dots[0]}example{dots[1]}gr"
            text = f"write to {part}, today"
            base, more = pii.scan_text(text)
            want = [] if dots == (".", ".") and at in ("@", " at ") else [part]  # the first is plain, and "at" before a plain host is prose
            assert [text[s:e] for _, s, e in more] == want, text
    for part in ("jane@exam\u200bple.com", "192.168.\u200b0.1", "ja\xadne@example.com", "jane@exam\u2060ple dot hu", "jane at example dot xyz"):
        assert [f"to {part} now"[s:e] for _, s, e in pii.scan_text(f"to {part} now")[1]] == [part], part
    for clean in ("jane@example.com dot the i", "\u200bjane@example.com\u200b", "see us at example.com"):
        assert pii.scan_text(clean)[1] == [], clean


def brute_leaks(text, items):
    """Items whose best match in the text is within a tenth of edits, by full dynamic programming over plainly lowered texts."""
    out, flat = set(), re.sub(r"\s", " ", text.lower())
    for i, t in items:
        t = re.sub(r"\s", " ", t.lower())
        e = int(0.10 * len(t))
        row = [0] * (len(flat) + 1)
        for a, c in enumerate(t, 1):
            before, row = row, [a] + [0] * len(flat)
            for b, d in enumerate(flat, 1):
                row[b] = min(before[b - 1] + (c != d), before[b] + 1, row[b - 1] + 1)
        if min(row) <= e:
            out.add(i)
    return out


@pytest.mark.parametrize("work", [decon.WORK, 40])
def test_leaks_against_full_alignment(monkeypatch, work):
    """With little work allowed, q-grams are given up and passages aligned along all diagonals; the finds are the same."""
    monkeypatch.setattr(decon, "WORK", work)
    rng = random.Random(2)
    words = "tion er the and of re on ing al en th".split()
    prose = lambda n: "".join(rng.choice(words) + rng.choice(["", "", " "]) for _ in range(n))
    items = [(i, prose(rng.randint(2, 40))) for i in range(20)] + [(99, "ab"), (98, "-" * 30), (97, "x" + " " * 14 + "return value"), (96, "- " * 20)]
    assert {10, 20, 30} <= {len(t) // 10 * 10 for _, t in items}  # passages of every short length
    table = decon.Passages(items)

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            i, o = rng.randrange(len(t)), rng.random()
            if o < 0.4:
                t[i] = rng.choice("abcxyz ")
            elif o < 0.7 and len(t) > 1:
                del t[i]
            else:
                t.insert(i, rng.choice("abc"))
        return "".join(t)

    for _ in range(150):
        i, x = rng.choice(items)
        t = prose(20) + " " * rng.choice([0, 0, 30]) + "-" * rng.choice([0, 0, 40]) + " " + edited(x.upper() if rng.random() < 0.2 else x, rng.randint(0, len(x) // 10 + 1)) + prose(10)
        assert {table.ids[n] for n, *_ in table.find(t)} == brute_leaks(t, items), (t, x)


def test_budget_is_whole_for_every_length():
    for m in range(1, 400):
        e, q, least = decon.budget(m, decon.Q, 0.10)
        assert e == int(0.10 * m) and 1 <= q <= decon.Q and least >= 1


def test_spans_in_long_texts(monkeypatch):
    """Passages across the borders of stretches are found where they stand, once."""
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    items = [(i, prose(60)) for i in range(5)]
    text, want = "", []
    for i in rng.choices(range(5), k=60):
        text += prose(rng.randrange(20, 70))
        want.append((i, len(text), len(text) + 60))
        text += items[i][1]
    whole = decon.Passages(items)
    cut = decon.Passages(items, stretch=10)
    assert cut.stretch < len(text) // 10
    assert [x[:3] for x in whole.find(text)] == want and cut.find(text) == whole.find(text)


@pytest.mark.parametrize("piece", [" ", "-", "- ", "=-+"])
def test_a_q_gram_that_is_everywhere(piece):
    """Blanks and rules in a text against passages with some of them: the work stays bounded, and a passage among them is found."""
    rng = random.Random(3)
    prose = lambda: "".join(rng.choices("abcdefgh", k=30))
    items = [(i, prose() + piece * 12 + prose()) for i in range(200)]
    table = decon.Passages(items)
    text = "abc " + piece * (20_000 // len(piece)) + items[7][1][:40] + "X" + items[7][1][41:] + piece * 500
    began = time.perf_counter()
    assert [(table.ids[n], text[s:e].count("X"), d) for n, s, e, d in table.find(text)] == [(7, 1, 1)]
    assert time.perf_counter() - began < 20  # some seconds at the most, where hours were


def test_many_copies_of_a_short_passage():
    table = decon.Passages([(1, "ab"), (2, "zz zz zz zz")])
    found = table.find("ab" * 20_000)
    assert len(found) == 20_000 and found[-1] == (0, 39_998, 40_000, 0)


def test_leaks_in_blocks(spark, docs):
    b = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    key = lambda df: sorted((r["doc_id"], r["contaminated"], tuple(r["item_ids"])) for r in df.collect())
    item = b.first()
    planted = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, f"Before {item['text']} after")], "doc_id long, text string"))
    one = key(decon.find_leaks(planted, b))
    assert one[-1] == (10**6, True, (item["item_id"],)) and one == key(decon.find_leaks(planted, b, block_chars=3000))
    left = sorted(d for d, hit, _ in one if not hit)
    for chars in (decon.BLOCK_CHARS, 3000):
        assert sorted(r["doc_id"] for r in decon.drop_leaks(planted, b, block_chars=chars).collect()) == left
