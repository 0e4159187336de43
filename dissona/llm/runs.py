"""Front-coded sorted runs, and their merge by loser trees that know common prefixes.

A distributed merge sort of byte strings. Each task sorts what it holds, a bounded run at a time, and writes the run as front-coded
blocks (of each string the number of bytes it shares with the one before, and the rest), with a sample of their strings, by hash: a
bounded part of the samples gives the borders of ranges. Each block goes to its range, cut where it meets more than one; a
receiving task merges the blocks of its range by a loser tree. Equal strings of a run are one from the start,
so a string that a third of all places hold is sent once a run, and ranges are cut by whole strings, so many strings with a common
beginning spread over ranges like any others. The number of ranges follows the number of strings.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.runtime import stored

RUN, BLOCK, RANGE, SAMPLE, SAMPLES = 200_000, 1024, 1 << 20, 32, 200_000


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes two strings share, the first `at` of which are known to be."""
    n = min(len(a), len(b))
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Of sorted strings: the bytes shared with the one before, and of the rest its length (both 16 bits each) and bytes."""
    shared, rest, before = [], [], b""
    for s in strings:
        n = min(common(before, s), 65535)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return np.array(shared, "<u2").tobytes(), np.array([len(r) for r in rest], "<u2").tobytes(), b"".join(rest)


def decoded(shared: bytes, sizes: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """Each string, and the bytes it shares with the one before."""
    before, at = b"", 0
    for n, size in zip(np.frombuffer(shared, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist(), strict=True):
        before = before[:n] + rest[at : at + size]
        at += size
        yield before, n


class LoserTree:
    """Merges sorted runs of (string, shared with the one before in its run).

    Every head that lost carries how many bytes it shares with the string that beat it. Along the path of the last winner, two
    heads' numbers are against the same string, the last winner: the larger number is the smaller string, without a look at
    a byte; only for equal numbers are bytes compared, beyond the number. Yields run, string, shared with the last winner.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int]]]):
        self.runs = runs
        self.k = k = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[bytes | None] = [None] * k
        self.known = [0] * k
        for i, r in enumerate(runs):
            if (x := next(r, None)) is not None:
                self.heads[i] = x[0]
        self.tree = [0] * max(k, 1)
        self.first = self.build(1) if k > 1 else 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's number becomes what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.known[a] != self.known[b]:  # the loser shares with the winner what it shared with the last winner
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        n = common(x, y, self.known[a])
        less = x[n : n + 1] <= y[n : n + 1]
        winner, loser = (a, b) if less else (b, a)
        self.known[loser] = n
        return winner, loser

    def build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        winner, self.tree[node] = self.play(self.build(2 * node), self.build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        w = self.first
        while (s := self.heads[w]) is not None:
            yield w, s, self.known[w]
            x = next(self.runs[w], None)
            self.heads[w], self.known[w] = x if x is not None else (None, 0)
            node = (w + self.k) >> 1
            while node:
                w, self.tree[node] = self.play(w, self.tree[node])
                node >>= 1


_NAMES = ["run", "number", "n", "head", "last", "shared", "sizes", "rest", "twice", "keys", "firsts", "samples"]
_KINDS = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.binary())]
_SCHEMA = "run long, number int, n int, head binary, last binary, shared binary, sizes binary, rest binary, twice binary, keys array<binary>, firsts array<long>, samples array<binary>"


def sorted_runs(rows: DataFrame, suffixes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[bytes, bytes, int]]], run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Blocks of runs: run, number (in it), n strings, the first and last of them, shared, sizes, rest (front-coded), twice (a byte each: seen at two places already), keys and firsts of the places, samples of the strings.

    suffixes gives string, key, first. Equal strings of a run are one; their further places come out in blocks without strings,
    as they are known to be repeated.
    """

    def made(held: list[tuple[bytes, bytes, int]], name: int) -> Iterator[pa.RecordBatch]:
        held.sort()
        strings, twice, keys, firsts = [], bytearray(), [], []
        more: tuple[list, list] = ([], [])
        for s, own in groupby(held, key=lambda x: x[0]):
            _, *others = places = list(dict.fromkeys(x[1:] for x in own))
            strings.append(s)
            twice.append(bool(others))
            keys.append(places[0][0])
            firsts.append(places[0][1])
            if others:
                more[0].extend(k for k, _ in others)
                more[1].extend(f for _, f in others)
        out = []
        for number, i in enumerate(range(0, len(strings), block)):
            own = strings[i : i + block]
            out.append([name, number, len(own), own[0], own[-1], *front_code(own), bytes(twice[i : i + block]), keys[i : i + block], firsts[i : i + block], [s for s in own if zlib.crc32(s) % SAMPLE == 0]])
        out += [[name, -1, 0, b"", b"", b"", b"", b"", b"", more[0][i : i + block], more[1][i : i + block], []] for i in range(0, len(more[0]), block)]
        for i in range(0, len(out), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 16], strict=True), _KINDS, strict=True)], _NAMES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []
        name = TaskContext.get().partitionId() << 32
        for x in suffixes(batches):
            held.append(x)
            if len(held) >= run:
                yield from made(held, name)
                held, name = [], name + 1
        if held:
            yield from made(held, name)

    return rows.mapInArrow(send, _SCHEMA)


def _run(blocks: list[dict], places: list[tuple[bytes, int, int]]) -> Iterator[tuple[bytes, int]]:
    """The strings of one run, each with what it shares with the one before; places gets the place and mark of the string given last."""
    before = b""
    for b in blocks:
        for i, (s, n) in enumerate(decoded(b["shared"], b["sizes"], b["rest"])):
            if i == 0:
                n = common(before, s)
            before = s
            places[0] = b["keys"][i], b["firsts"][i], b["twice"][i]
            yield s, n


def _cut(block: dict, edges: list[bytes]) -> Iterator[tuple[int, dict]]:
    """The range and the strings of a block in it, for each range that the block meets."""
    strings = [s for s, _ in decoded(block["shared"], block["sizes"], block["rest"])]
    at = 0
    while at < len(strings):
        part = bisect_right(edges, strings[at])
        end = bisect_left(strings, edges[part], at) if part < len(edges) else len(strings)
        shared, sizes, rest = front_code(strings[at:end])
        yield part, block | {"n": end - at, "head": strings[at], "last": strings[end - 1], "shared": shared, "sizes": sizes, "rest": rest} | {k: block[k][at:end] for k in ("twice", "keys", "firsts")}
        at = end


def merge_equal(runs: DataFrame, strings: int = RANGE, rows: int = 1 << 14) -> DataFrame:
    """key, first: the places of strings that have another place. runs: from sorted_runs(), in a table that reads alike each time. A range has about `strings` strings."""
    spark = runs.sparkSession
    total, found = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("samples")), F.lit(0))).first()
    samples = runs.select("run", F.explode("samples").alias("s")).filter(F.pmod(F.xxhash64("run", "s"), F.lit(1 + found // SAMPLES)) == 0)
    heads = sorted(r["s"] for r in samples.select("s").collect())  # about SAMPLES at most
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // strings))
    edges = sorted({bytes(heads[i * len(heads) // parts]) for i in range(1, parts)}) if heads else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block to its range, cut where it meets more."""
        for batch in batches:
            to, last = ([bisect_right(edges, s) for s in batch[c].to_pylist()] for c in ("head", "last"))
            within = [i for i, (t, e) in enumerate(zip(to, last, strict=True)) if t == e]
            yield pa.RecordBatch.from_arrays([pa.array([to[i] for i in within], pa.int32()), *batch.take(pa.array(within, pa.int32())).columns], ["part", *_NAMES])
            for i in sorted(set(range(len(to))) - set(within)):
                cut = [[part, *(b[c] for c in _NAMES)] for part, b in _cut(batch.slice(i, 1).to_pylist()[0], edges)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut, strict=True), [pa.int32(), *_KINDS], strict=True)], ["part", *_NAMES])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, dict[int, list[dict]]] = {}
        keys: list[bytes] = []
        firsts: list[int] = []

        def full(least: int) -> Iterator[pa.RecordBatch]:
            if len(keys) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64())], ["key", "first"])
                keys.clear()
                firsts.clear()

        def settle(held: list[tuple[bytes, int, int]]) -> None:
            """Places of one string: more than one, or one that was marked."""
            if any(twice for *_, twice in held) or len({x[:2] for x in held}) > 1:
                keys.extend(k for k, _, _ in held)
                firsts.extend(f for _, f, _ in held)

        for batch in batches:
            for r in batch.to_pylist():
                by.setdefault(r["part"], {}).setdefault(r["run"], []).append(r)
        for own in by.values():
            places = [[(b"", 0, 0)] for _ in own]
            held: list[tuple[bytes, int, int]] = []
            size = -1
            for i, s, shared in LoserTree([_run(sorted(b, key=lambda r: r["number"]), p) for b, p in zip(own.values(), places, strict=True)]):
                if not (shared == len(s) == size):
                    settle(held)
                    yield from full(rows)
                    held, size = [], len(s)
                held.append(places[i][0])
            settle(held)
        yield from full(1)

    bare = runs.filter("n > 0").withColumn("samples", F.array().cast("array<binary>"))
    dealt = bare.mapInArrow(deal, f"part int, {_SCHEMA}").repartitionById(parts, "part")
    known = runs.filter("n = 0").select(F.explode(F.arrays_zip("keys", "firsts")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.firsts").alias("first"))
    return dealt.mapInArrow(merge, "key binary, first long").unionByName(known)


def equal_places(rows: DataFrame, suffixes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[bytes, bytes, int]]], keep: Callable[[DataFrame], DataFrame], run: int = RUN, block: int = BLOCK, strings: int = RANGE) -> DataFrame:
    """key, first of all strings that have another place, kept by `keep` before the runs go."""
    with stored(sorted_runs(rows, suffixes, run, block)) as runs:
        return keep(merge_equal(runs, strings))
