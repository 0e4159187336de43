"""Language-model scoring by masked pseudo-likelihood.

A network predicts every token from the tokens on both sides of it, never from itself: embeddings of the `window` tokens before
and after, each scaled by weights of its offset, are summed and squashed, and read out by a hierarchical softmax: the tokens are the
leaves of a Huffman tree, at each inner node on the way to a token a logistic unit of the context decides between the two sides, and
the token's probability is the product of the decisions (Morin and Bengio, 2005). All tokens' probabilities add up to one; before
training they are the tokens' shares, whatever the context. A document's score is the sum of the logarithms of its tokens'
conditional probabilities (its pseudo-log-likelihood), and the mean of them.

Tokens are lowered words, split and hashed by columns of Arrow and numpy as Python would one by one. Their number follows from
the corpus: with n words in all, each that is there `rarest(n)` times (an eighth of the square root of n) or more stands by itself,
the others by one of as many hash buckets.

Training is numpy on the executors, over every document: each round masks other positions of it, chosen by a hash of the text and the
place, so that no choice depends on where a document lies; all rounds together mask `share` of the positions, all of them
unless a caller asks for less. A task descends along the gradient of the losses by Adagrad, and sends its weights; they are averaged by tokens (iterative
parameter mixing), from a task for each MIXER_BYTES of text, whatever the cluster, unless `mixers` says otherwise. Word counts and
weights are summed by shuffles; what reaches the driver is as long as the vocabulary, which grows more slowly than the corpus. Tasks
read the network from the shared folder, once for each Python worker.

Defined cases: a null or empty text has no tokens, sum 0 and a null mean; a null doc_id stays null; repeated rows count as often as
they are there; an empty table gives an empty result; other columns are ignored; long texts are scored in stretches. The order of
steps, and so the trained weights, depends on how the input is cut into partitions, as in any descent.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissona.runtime import durable, remove, shared_dir, ship, stored

from .common import id_and_text, map_rows

WIDTH, WINDOW = 8, 2
ROUNDS, SHARE, RATE, BATCH, DAMPING = 1, 1.0, 0.2, 4096, 1e-6
ROW, CHUNK, TOP = 16, 8192, 16
MIXER_BYTES, COUNTED_BYTES = 128 << 20, 64 << 20
#: Letters that Arrow may lower in another way than Python, by context or by the version of Unicode.
ODD = "[\u0130\u03a3\u1c80-\u1cff\ua640-\ua7ff\U00010000-\U0010ffff]"
#: Words beyond so many bytes are hashed one by one.
LONG = 256


def rarest(n: int) -> int:
    """The least count of a word that stands by itself, in a corpus of n words."""
    return max(1, math.isqrt(n) // 8)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as Python lowers and splits them, and each text's count."""
    texts = texts.fill_null("")
    odd, low = pc.match_substring_regex(texts, ODD), pc.utf8_lower(texts)
    if pc.any(odd).as_py():
        low = pc.replace_with_mask(low, odd, pa.array([t.lower() for t in texts.filter(odd).to_pylist()], pa.string()))
    parts = pc.utf8_split_whitespace(low)
    words, lengths = parts.flatten(), pc.list_value_length(parts).to_numpy()
    there = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(texts)), lengths)
    return words.filter(there), np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32(words: pa.Array) -> np.ndarray:
    """zlib's crc32 of each word's bytes, a byte of all words at a time."""
    if not len(words):
        return np.empty(0, np.uint32)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    length = np.diff(ends)
    order = np.argsort(-np.minimum(length, LONG), kind="stable")
    at, left = ends[:-1][order], length[order]
    more = len(words) - np.searchsorted(left[::-1], np.arange(min(left.max(), LONG)), "right")  # words that have such a byte
    state = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k, m in enumerate(more.tolist()):
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    got = np.empty_like(state)
    got[order] = ~state
    for i in np.flatnonzero(length > LONG).tolist():
        got[i] = zlib.crc32(data[ends[i] : ends[i + 1]])
    return got


@dataclass
class Vocabulary:
    """Token numbers of words: kept words have their own, others a bucket by hash."""

    words: pa.Array
    buckets: int

    def numbers(self, words: pa.Array) -> np.ndarray:
        own = pc.index_in(words, value_set=self.words)
        got = own.fill_null(0).to_numpy().astype(np.int64)
        if own.null_count:
            other = own.is_null()
            got[other.to_numpy(zero_copy_only=False)] = len(self.words) + crc32(words.filter(other)) % np.uint32(self.buckets)
        return got


@dataclass
class Network:
    words: Vocabulary
    first: np.ndarray  # of each token, where its way from the leaf to the root begins in nodes and sides
    steps: np.ndarray  # and its length
    nodes: np.ndarray
    sides: np.ndarray  # 1 or -1
    embed: np.ndarray  # token x width; the last row is the edge of a text, zero
    scale: np.ndarray  # offset x width
    out: np.ndarray  # node x width
    bias: np.ndarray  # of each node
    high: np.ndarray = field(init=False, repr=False)  # token x TOP first nodes: the side where it is on the token's way, or else 0
    low: np.ndarray = field(init=False, repr=False)  # of each token, how many steps of its way, all at its beginning, are beyond those

    def __post_init__(self) -> None:
        beyond = self.nodes >= TOP
        self.low = np.add.reduceat(beyond, self.first, dtype=np.int64).astype(np.uint8 if self.steps.max() < 1 << 8 else np.int64)
        self.high = np.zeros((len(self.steps), len(self.bias[:TOP])), np.int8)
        at = np.flatnonzero(~beyond)
        self.high[np.repeat(np.arange(len(self.steps)), self.steps)[at], self.nodes[at]] = self.sides[at]

    @property
    def parts(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in PARTS]

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts with `window` edges between, and each text's count."""
        words, counts = split(pa.array(texts, pa.string()))
        flat = np.full(len(words) + WINDOW * (len(texts) + 1), len(self.embed) - 1, np.uint16 if len(self.embed) < 1 << 16 else np.int32)
        flat[positions(counts)] = self.words.numbers(words)
        return flat, counts

    def hidden(self, near: list[np.ndarray]) -> np.ndarray:
        """What both sides of some places say, by their embeddings."""
        total = near[0] * self.scale[0]
        for e, s in zip(near[1:], self.scale[1:], strict=True):
            total += e * s
        return np.tanh(total, out=total)

    def top(self, h: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the TOP first nodes, half of all steps: sides (0 where a node isn't on the way), and log odds of the side taken."""
        side = self.high.take(token, axis=0).astype(np.float32)
        z = h @ self.out[:TOP].T
        z += self.bias[:TOP]
        z *= side
        return side, np.clip(z, -30, 30, out=z)

    def levels(self, h: np.ndarray, token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The other steps, one of each token at a time: nodes, their rows of out, sides, log odds. Tokens come by falling number of these steps, so those of a level are the first ones."""
        low = self.low[token]
        first = self.first[token]
        for k, m in enumerate((len(low) - np.searchsorted(low[::-1], np.arange(low[0] if len(low) else 0), "right")).tolist()):
            at = first[:m] + k
            node, side = self.nodes.take(at), self.sides.take(at)
            row = self.out.take(node, axis=0)
            z = np.einsum("ij,ij->i", h[:m], row)
            z += self.bias.take(node)
            z *= side
            yield node, row, side, np.clip(z, -30, 30, out=z)

    def falling(self, token: np.ndarray) -> np.ndarray:
        """The order that `levels` asks for."""
        return np.argsort(self.low[token], kind="stable")[::-1]

    def log_probabilities(self, flat: np.ndarray, start: int, end: int) -> np.ndarray:
        """Of the tokens at all places from start to end, edges among them."""
        got = np.empty(end - start, np.float32)
        for i in range(start, end, CHUNK):
            j = min(i + CHUNK, end)
            token = np.minimum(flat[i:j], len(self.steps) - 1)
            e = self.embed.take(flat[i - WINDOW : j + WINDOW], axis=0)
            order = self.falling(token)
            h, token = self.hidden([e[WINDOW + o : WINDOW + o + j - i] for o in OFFSETS]).take(order, axis=0), token[order]
            side, z = self.top(h, token)
            np.exp(np.negative(z, out=z), out=z)
            z *= np.abs(side, out=side)
            z += 1
            loss = np.log(z, out=z).sum(1)
            for *_, z in self.levels(h, token):
                loss[: len(z)] += np.log1p(np.exp(-z))
            got[order + (i - start)] = -loss
        return got

    def learn(self, flat: np.ndarray, at: np.ndarray, sums: list[np.ndarray], rate: float) -> None:
        """One step of Adagrad on the masked positions."""
        if not len(at):
            return
        at = at[self.falling(flat[at])]
        token = flat[at]
        near = [self.embed.take(flat[at + o], axis=0) for o in OFFSETS]
        h = self.hidden(near)
        top, z = self.top(h, token)
        np.exp(z, out=z)
        z += 1
        z *= -len(at)
        top /= z
        rows = np.arange(top.shape[1])
        back = top @ self.out[:TOP]
        nodes, slopes, rises = [], [], []
        for node, row, side, z in self.levels(h, token):
            g = -side / (1 + np.exp(z))
            g /= len(at)
            back[: len(g)] += row * g[:, None]
            nodes.append(node)
            slopes.append(g)
            rises.append(h[: len(g)] * g[:, None])
        descend(self.bias, rows, top.sum(0), sums[3], rate)
        descend(self.out, rows, top.T @ h, sums[2], rate)
        if nodes:
            there, group = grouped(np.concatenate(nodes), len(self.bias))
            descend(self.out, there, summed(np.concatenate(rises), group, len(there)), sums[2], rate)
            descend(self.bias, there, summed(np.concatenate(slopes)[:, None], group, len(there))[:, 0], sums[3], rate)
        h *= h
        back *= 1 - h
        there, group = grouped(np.concatenate([flat[at + o] for o in OFFSETS]), len(self.embed))
        scale = np.stack([np.einsum("ij,ij->j", back, e) for e in near])
        embed = summed(np.concatenate([back * s for s in self.scale]), group, len(there))
        embed[there == len(self.embed) - 1] = 0
        descend(self.embed, there, embed, sums[0], rate)
        descend(self.scale, np.arange(len(scale)), scale, sums[1], rate)


def grouped(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values, all below size, and the place of each entry's among them; without sorting."""
    at = np.arange(len(x), dtype=np.int32)
    one = np.empty(size, np.int32)
    one[x] = at
    own = one[x]
    new = own == at
    return x[new].astype(np.int64), (np.cumsum(new) - 1)[own]


def summed(x: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each group."""
    return np.stack([np.bincount(group, c, n) for c in x.T], 1).astype(np.float32)


def descend(w: np.ndarray, at: np.ndarray, g: np.ndarray, sums: np.ndarray, rate: float) -> None:
    """Adagrad, in place, for the rows that have a gradient: weights, the rows, their gradient, the sums of its squares."""
    s = sums.take(at, axis=0)
    s += g * g
    sums[at] = s
    np.sqrt(s, out=s)
    s += np.float32(1e-6)
    np.divide(g, s, out=s)
    s *= np.float32(rate)
    w[at] = w.take(at, axis=0) - s


def tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree of two leaves or more: first, steps, nodes and sides of the leaves' ways, and the log odds of each node."""
    n = len(counts)
    heap = [(c, i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    parent, side, odds = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.float32), np.zeros(n - 1)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        side[i], side[j], odds[node - n] = 1, -1, math.log(a / b)
        heapq.heappush(heap, (a + b, node))
    at, ways, sides = np.arange(n), [], []
    while (parent[at] >= 0).any():
        there = parent[at] >= 0
        ways.append(np.where(there, 2 * n - 2 - parent[at], -1))  # from the root, which is 0, nodes get rarer
        sides.append(side[at])
        at = np.where(there, parent[at], at)
    ways, sides = np.stack(ways, 1), np.stack(sides, 1)
    there = ways >= 0
    steps = there.sum(1)
    return np.cumsum(steps) - steps, steps, ways[there].astype(np.uint16 if n < 1 << 16 else np.int32), sides[there], odds[::-1].astype(np.float32)


PARTS = ("embed", "scale", "out", "bias")
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]


def word_counts(docs: DataFrame) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The words that stand by themselves, by falling count, and each bucket's count of the others, over all documents."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.Array]) -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            held.append(split(batch.column(0))[0])
            size += held[-1].nbytes
            if size > COUNTED_BYTES:
                yield rows(held)
                held, size = [], 0
        yield rows(held)

    with stored(docs.select("text").filter("text is not null").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))) as sums:
        least = rarest(sums.agg(F.sum("n")).first()[0] or 0)
        words = sorted(((r["word"], r["n"]) for r in sums.filter(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))
        by = np.zeros(max(len(words), 2), np.int64)
        for r in sums.filter(F.col("n") < least).groupBy((F.crc32("word") % len(by)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
            by[r["bucket"]] = r["n"]
    return words, by


def untrained(words: list[tuple[str, int]], by: np.ndarray, width: int = WIDTH, seed: int = 7) -> Network:
    """The network that gives each token its share."""
    counts = np.array([n for _, n in words] + by.tolist(), float) + 0.5
    first, steps, nodes, sides, odds = tree(counts)
    embed = np.random.default_rng(seed).normal(0, 0.3, (len(counts) + 1, width)).astype(np.float32)
    embed[-1] = 0
    return Network(Vocabulary(pa.array([w for w, _ in words], pa.string()), len(by)), first, steps, nodes, sides, embed, np.ones((2 * WINDOW, width), np.float32), np.zeros((len(counts) - 1, width), np.float32), odds)


def positions(counts: np.ndarray) -> np.ndarray:
    """Places of the texts' tokens in the flat array."""
    starts = WINDOW + np.cumsum(counts + WINDOW) - (counts + WINDOW)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def masked(texts: list[str | None], counts: np.ndarray, rounds: int) -> np.ndarray:
    """Of so many rounds, that which masks each position of the texts."""
    seed = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.uint32)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    x = (np.repeat(seed, counts) + place.astype(np.uint32)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return (x >> np.uint32(16)) % np.uint32(rounds)


_fetched: dict[str, Network] = {}


def kept(spark: SparkSession, net: Network) -> str:
    """The network as a file in the shared folder; its address."""
    address = f"{shared_dir(spark).rstrip('/')}/network-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(address)
    with store.open_output_stream(path) as out:
        pickle.dump(net, out)
    return address


def fetched(address: str) -> Network:
    """The network of a file, read once; a worker holds the last one."""
    if address not in _fetched:
        _fetched.clear()
        store, path = fs.FileSystem.from_uri(address)
        with store.open_input_file(path) as f:
            _fetched[address] = pickle.loads(f.read())
    return _fetched[address]


def train(docs: DataFrame, net: Network, *, rounds: int = ROUNDS, share: float = SHARE, rate: float = RATE, mixers: int | None = None) -> Network:
    """Rounds of mixing over all documents."""
    shapes, every = [p.shape for p in net.parts], max(rounds, round(rounds / share))
    rows = docs.select("text").filter("text is not null")
    if mixers is None:
        mixers = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // MIXER_BYTES
    rows = rows.coalesce(mixers)
    columns = [f"v{i}" for i in range(ROW)]
    for r in range(rounds):
        address = kept(docs.sparkSession, net)

        def mix(batches: Iterator[pa.RecordBatch], address: str = address, r: int = r) -> Iterator[pa.RecordBatch]:
            net = fetched(address)
            own = replace(net, **{name: getattr(net, name).copy() for name in PARTS})
            sums, seen = [np.full(p.shape, DAMPING, np.float32) for p in own.parts], 0
            rng = np.random.default_rng(r)
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for start in range(0, len(texts), 512):
                    part = texts[start : start + 512]
                    flat, counts = own.tokens(part)
                    at = positions(counts)[masked(part, counts, every) == r]
                    rng.shuffle(at)
                    for i in range(0, len(at), BATCH):
                        own.learn(flat, at[i : i + BATCH], sums, rate)
                    seen += len(at)
            if seen:
                flat = np.concatenate([p.ravel() for p in own.parts])
                flat = np.append(flat, np.zeros(-len(flat) % ROW, np.float32)).reshape(-1, ROW) * np.float32(seen)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat)), pa.int32()), *(pa.array(np.append(np.float32(seen), x)) for x in flat.T)], ["at", *columns])

        sums = rows.mapInArrow(mix, f"at int, {', '.join(f'{c} float' for c in columns)}").groupBy("at").agg(*(F.sum(c).alias(c) for c in columns))
        got = sums.toArrow()  # as long as the network's weights
        remove(docs.sparkSession, address)
        if not got.num_rows:
            return net
        v = np.empty((got.num_rows, ROW))
        v[got["at"].to_numpy() + 1] = np.column_stack([got[c].to_numpy() for c in columns])  # the first: the tokens
        v = (v[1:] / v[0]).astype(np.float32).ravel()
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        net = replace(net, **dict(zip(PARTS, (x.reshape(s) for x, s in zip(np.split(v, cuts)[:-1], shapes, strict=True)), strict=True)))
    return net


def score_texts(net: Network, texts: list[str | None], rows: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Token counts and pseudo-log-likelihoods."""
    flat, counts = net.tokens(texts)
    owner = np.full(len(flat), len(texts))
    owner[positions(counts)] = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros(len(texts) + 1)
    for i in range(WINDOW, len(flat) - WINDOW, rows):
        end = min(i + rows, len(flat) - WINDOW)
        total += np.bincount(owner[i:end], net.log_probabilities(flat, i, end), len(texts) + 1)
    return counts, total[:-1]


def score_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood, by a network trained on the same documents."""
    rows = id_and_text(docs, id_column, text_column)
    spark = docs.sparkSession
    address = kept(spark, train(rows, untrained(*word_counts(rows)), rounds=rounds, share=share))

    def run(columns: list[list]) -> list[list]:
        counts, total = score_texts(fetched(address), columns[1])
        total = np.round(total, 6)
        return [columns[0], counts, total, [t / n if n else None for t, n in zip(total.tolist(), counts.tolist(), strict=True)]]

    out = durable(map_rows(rows, run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double", [pa.int64(), pa.int64(), pa.float64(), pa.float64()], 128))
    remove(spark, address)
    return out
