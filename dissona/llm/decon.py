"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that a text holds with at most e edits shares at least m + 1 - q - q * e of its q-grams with it, all on
diagonals (place in the text less place in the passage) at most e apart. Each text's q-grams are looked up in a table of the
passages' q-grams; places of a passage are counted by diagonal band, each place once. Bands are 2e + 1 wide and count with their
neighbour, so some pair holds all hits of a match. The diagonals of bands that meet the bound are verified by banded alignment (least
edits of the passage against any stretch of the text), which also gives the span.

The budget e is a share of m, rounded down, for passages of every length: one too short for its bound to be positive with q is looked
up by the largest smaller q for which it is.

The work is bounded where a q-gram is everywhere (blanks, rules, indentation). A run of one q-gram in the text is laid out once for
each band, not for each place. A passage that would still fill more than WORK cells in a stretch of the text gives up the q-grams
laid out most often, and its bound falls by as many, so nothing is lost; if none is left, it is aligned along all diagonals of the
stretch, of which those beyond the budget are dropped as the alignment goes. Cells are made WORK at a time, whole passages together.

Text and passages are compared with letters lowered and each white-space character as a space.
Passages are the query set: they go to all tasks, in blocks of bounded size if they are many (a block holds one passage at least,
however long); the texts are scanned once.

Defined cases: a null or empty text has no hits; a null or blank passage is left out; a passage too short for an edit (below 10
characters) is found if it stands verbatim; a null identifier stays null; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import bisect
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissona.runtime import durable, remove, shared_dir, ship

from .common import id_and_text

Q, RATE, BLOCK_CHARS, STRETCH = 8, 0.10, 4 << 20, 32 << 20
#: Characters of a text that are looked at in one go, and cells (passages' places by bands) laid out in one go.
STRETCH_CHARS, WORK = 1 << 16, 1 << 20
_M1, _M2, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
BITS = 20


def plain(text: str) -> np.ndarray:
    """Code points, lowered, white space and controls as spaces; as many as the text has, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    c[c < 33] = 32
    if not low.isascii():
        c[(c == 0x85) | (c == 0xA0) | ((c >= 0x2000) & (c <= 0x200A)) | (c == 0x3000)] = 32
    return c


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram, by doubling where q is a power of two."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    if q & (q - 1) == 0:
        h, n, m = c.astype(np.uint64), 1, iter((_M1, _M2, _M4, *[_M1] * 8))
        while n < q:
            h = h[:-n] * next(m) + h[n:]
            h ^= h >> np.uint64(31)
            n *= 2
    else:
        h = np.zeros(len(c) - q + 1, np.uint64)
        for i in range(q):
            h = h * _M1 + c[i : i + len(h)]
            h ^= h >> np.uint64(31)
    return h * _M2


def budget(m: int, q: int, rate: float) -> tuple[int, int, int]:
    """Edits allowed in a passage of m characters, the q that it is looked up by (q at most), and the q-grams that are then shared at least."""
    e = int(rate * m)
    q = min(q, m // (e + 1))
    return e, q, m + 1 - q - q * e


def expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the number of each count's owner, once for each, and 0, 1, ... within the owner."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def verbatim(item: np.ndarray, region: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places at which the item stands in the region."""
    at, done = at[(at >= 0) & (at + len(item) <= len(region))], 0
    while len(at) and done < len(item):
        piece = item[done : done + max(1, WORK // len(at))]
        at = at[(region[at[:, None] + np.arange(done, done + len(piece))] == piece).all(1)]
        done += len(piece)
    return at


def align(item: np.ndarray, region: np.ndarray, at: np.ndarray, e: int) -> list[tuple[int, int, int]]:
    """Stretches of the region within e edits of the item, by dynamic programming along ascending diagonals: edits, start, end for each end.

    A diagonal that is beyond e, with all that it could reach, is left out for the rest.
    """
    m, n, far = len(item), len(region), np.int64(1 << 30)
    at = at[(at >= -e) & (at <= n)]
    cost, start = np.where(at >= 0, 0, far), at.copy()
    for i in range(m):
        if not i % 4 and i:
            alive = at[cost <= e]
            if not len(alive):
                return []
            if 4 * len(alive) < len(at):
                near = np.searchsorted(alive, at - e)
                keep = alive[np.minimum(near, len(alive) - 1)] - at <= e
                keep &= near < len(alive)
                at, cost, start = at[keep], cost[keep], start[keep]
        j = at + i  # the region's character that a diagonal step would take
        inside = (j >= 0) & (j < n)
        step = np.where(inside, cost + (region[np.where(inside, j, 0)] != item[i]) if n else far, far)
        next_to = np.append(np.diff(at) == 1, False)
        drop = np.where(next_to, np.append(cost[1:], far) + 1, far)  # the item's character is left out: the next diagonal down
        lifted = np.minimum(step, drop) - at
        begun = np.where(step <= drop, start, np.append(start[1:], 0))
        run = np.minimum.accumulate(lifted)  # characters of the region left out, along the row
        source = np.maximum.accumulate(np.where((lifted == run) & np.append(True, run[1:] < run[:-1])[: len(run)], np.arange(len(at)), 0))
        cost, start = np.where((j >= -1) & (j < n), run + at, far), begun[source]
        cost = np.where(cost > e, far, cost)
    good = cost <= e
    return list(zip(cost[good].tolist(), start[good].tolist(), (at[good] + m).tolist(), strict=True))


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of edits, start, end the best of those that overlap: fewer edits, then the earlier start, then the earlier end."""
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for x in sorted(set(found)):
        k = bisect.bisect_left(starts, x[2])  # those before begin before its end
        if k == 0 or ends[k - 1] <= x[1]:
            starts.insert(k, x[1])
            ends.insert(k, x[2])
            out.append(x)
    return out


class _Table:
    """The q-grams of passages that are looked up by one q. An entry is a place of a passage; entries are sorted by q-gram."""

    def __init__(self, q: int, items: list[int], codes: list[np.ndarray], edits: np.ndarray, bounds: np.ndarray):
        self.q, self.items, self.codes, self.edits, self.bounds = q, items, codes, edits, bounds
        parts = [grams(c, q) for c in codes]
        h = np.concatenate(parts)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place = np.concatenate([np.arange(len(p)) for p in parts])
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.key = np.repeat(np.arange(len(self.keys)), self.count)
        self.unit = 2 * edits + 1
        self.map = np.zeros(1 << BITS, bool)
        self.map[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def find(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """item number, edits, start, end of what a stretch holds."""
        h = grams(c, self.q)
        at = np.flatnonzero(self.map[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return []
        begins = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)))
        by_key = np.argsort(k[begins], kind="stable")  # runs of one q-gram, as of blanks: one for all its places
        begins, lasts = begins[by_key], (np.append(begins[1:], len(at)) - 1)[by_key]
        low, high, k = at[begins], at[lasts], k[begins]
        own, run0, runs = np.unique(k, return_index=True, return_counts=True)
        longer = np.add.reduceat(high - low, run0)
        of, inner = expanded(self.count[own])  # the entries whose q-gram is there, by passage
        entry, order = self.first[own][of] + inner, None
        order = np.argsort(self.item[entry], kind="stable")
        entry, of = entry[order], of[order]
        item = self.item[entry]
        items, item0, there = np.unique(item, return_index=True, return_counts=True)
        work = runs[of] + longer[of] // self.unit[item] + 1
        total = np.add.reduceat(work, item0)
        enough = there >= self.bounds[items]
        need, out = self.bounds[items].copy(), []
        laid = np.repeat(enough, there)
        whole = []
        for x in np.flatnonzero(enough & (total > WORK)).tolist():  # leave out the q-grams that would be laid out most often, if the bound allows it
            mine = np.arange(item0[x], item0[x] + there[x])
            by_work = mine[np.argsort(-work[mine], kind="stable")]
            left = total[x] - np.cumsum(work[by_work])
            drop = int(np.argmax(left <= WORK)) + 1
            laid[by_work[:drop]] = False
            need[x] -= drop
            if need[x] < 1:
                laid[mine] = False
                whole.append(x)
        chosen = np.flatnonzero(laid)
        bands: dict[int, np.ndarray] = {x: np.arange(-int(self.edits[items[x]]), len(c) + 1) for x in whole}
        number = np.repeat(np.arange(len(items)), there)
        chunk = (np.cumsum(work[chosen]) - 1) // WORK
        chunk = chunk[np.searchsorted(number[chosen], number[chosen])]  # a passage's entries stay together
        for part in np.split(chosen, np.flatnonzero(np.diff(chunk)) + 1) if len(chosen) else []:
            for x, diagonals in self._bands(part, entry, of, number, items, need, low, high, run0, runs, len(c)):
                bands[x] = diagonals
        for x, diagonals in bands.items():
            i, e = int(items[x]), int(self.edits[items[x]])
            code = self.codes[i]
            same = np.empty(0, np.int64)
            if there[x] == len(code) + 1 - self.q:  # all its q-grams are there, so it may stand verbatim: seek it from the rarest
                mine = np.arange(item0[x], item0[x] + there[x])
                rare = mine[np.argmin((runs + longer)[of[mine]])]
                r = slice(run0[of[rare]], run0[of[rare]] + runs[of[rare]])
                owner, inner = expanded(high[r] - low[r] + 1)
                same = verbatim(code, c, np.sort(low[r][owner] + inner - self.place[entry[rare]]))
            out += [(i, 0, s, s + len(code)) for s in same.tolist()]
            if not e:
                continue
            if len(same):  # what overlaps a verbatim passage by all means is no better
                after = np.searchsorted(same, diagonals, side="right")
                before, behind = same[np.maximum(after - 1, 0)], same[np.minimum(after, len(same) - 1)]
                m = len(code)
                covered = ((after > 0) & (diagonals - before < m - 4 * e - 1)) | ((after < len(same)) & (behind - diagonals < m - 4 * e - 1))
                diagonals = diagonals[~covered]
            out += [(i, *x) for x in align(code, c, diagonals, e)] if len(diagonals) else []
        return out

    def _bands(self, part: np.ndarray, entry: np.ndarray, of: np.ndarray, number: np.ndarray, items: np.ndarray, need: np.ndarray, low: np.ndarray, high: np.ndarray, run0: np.ndarray, runs: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Passages' numbers and the diagonals of their bands with enough q-grams, for some entries: whole passages."""
        who, inner = expanded(runs[of[part]])
        run = run0[of[part]][who] + inner
        place = self.place[entry[part]][who]
        unit = self.unit[items[number[part]]][who]
        first = (low[run] - place) // unit
        again, inner = expanded((high[run] - place) // unit - first + 1)
        band = first[again] + inner
        base = int(band.min())
        span = int(band.max()) - base + 2  # a gap between passages
        cell = (number[part][who][again] - number[part[0]]) * span + band - base
        cell = np.unique(cell * len(part) + who[again]) // len(part)  # a place counts once for a band
        cells, counts = np.unique(cell, return_counts=True)
        nth, band = cells // span + number[part[0]], cells % span + base
        both = counts + np.where(np.append(np.diff(cells) == 1, False), np.append(counts[1:], 0), 0)  # a match's q-grams lie in two neighbouring bands
        alone = np.append(True, np.diff(cells) > 1)  # the band before has none, so its pair with this one is not in the list
        good = both >= need[nth]
        nth = np.concatenate([nth[good], nth[alone & (counts >= need[nth])]])
        band = np.concatenate([band[good], band[alone & (counts >= need[cells // span + number[part[0]]])] - 1])
        for x in np.unique(nth).tolist():
            e, unit = int(self.edits[items[x]]), int(self.unit[items[x]])
            starts = np.unique(band[nth == x]) * unit - e  # a path with a hit in the band may leave it by as many diagonals as edits
            yield x, np.unique((starts[:, None] + np.arange(2 * unit + 2 * e)).ravel())


class Passages:
    """The tables of a block of passages, one for each q that some are looked up by."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, rate: float = RATE, stretch: int = STRETCH_CHARS):
        if not 0 <= rate < 1:
            raise ValueError("the edit budget is a share of a passage, below 1")
        codes = [(i, c) for i, c in ((i, plain(t)) for i, t in items) if (c != 32).any()]
        self.ids, self.codes = [i for i, _ in codes], [c for _, c in codes]
        limits = np.array([budget(len(c), q, rate) for c in self.codes], np.int64).reshape(-1, 3)
        self.tables = []
        for own in np.unique(limits[:, 1]).tolist():
            mine = np.flatnonzero(limits[:, 1] == own)
            self.tables.append(_Table(own, mine.tolist(), [self.codes[i] for i in mine], limits[mine, 0], limits[mine, 2]))
        self.overlap = max((len(c) + int(e) for c, e in zip(self.codes, limits[:, 0], strict=True)), default=0)
        self.stretch = max(stretch, 2 * self.overlap)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """item number, start, end, edits of each match; the best of those that overlap. Long texts go by stretches, which overlap by the longest passage."""
        if not text:
            return []
        c = plain(text)
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for at in range(0, len(c), self.stretch):
            part = c[at : at + self.stretch + self.overlap]
            for t in self.tables:
                for i, edits, s, e in t.find(part):
                    by_item.setdefault(t.items[i], []).append((edits, s + at, e + at))
        return sorted(((i, s, e, d) for i, own in by_item.items() for d, s, e in apart(own)), key=lambda x: (x[1], x[0], x[2]))


class _Blocks:
    """Passages in blocks of bounded size: one block travels with the code, more are files in a shared folder, read one at a time."""

    def __init__(self, benchmark: DataFrame, item_column: str, passage_column: str, q: int, rate: float, block_chars: int):
        self.q, self.rate, self.folder = q, rate, None
        spark = benchmark.sparkSession
        passages = benchmark.select(F.col(f"`{item_column}`").cast("long").alias("i"), F.col(f"`{passage_column}`").cast("string").alias("t")).filter("t is not null and trim(t) <> ''")
        self.n = 1 + int(passages.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // block_chars
        if self.n == 1:
            self.only = Passages(self.items(passages), q, rate)
            return
        self.folder = f"{shared_dir(spark).rstrip('/')}/passages-{uuid.uuid4().hex}"
        store, base = fs.FileSystem.from_uri(self.folder)
        store.create_dir(base)
        folder, ordered = self.folder, self.ordered

        def write(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
            """A block's file, by the task that has the block."""
            store, base = fs.FileSystem.from_uri(folder)
            with store.open_output_stream(f"{base}/{key[0].as_py()}") as out:
                out.write(pickle.dumps(ordered(zip(group.column("i").to_pylist(), group.column("t").to_pylist(), strict=True))))
            return pa.table({"n": pa.array([group.num_rows], pa.int64())})

        ship(spark)
        passages.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(self.n))).groupBy("b").applyInArrow(write, "n long").agg(F.sum("n")).collect()

    @staticmethod
    def ordered(items: Iterator[tuple[int | None, str]]) -> list[tuple[int | None, str]]:
        return sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    def items(self, passages: DataFrame) -> list[tuple[int | None, str]]:
        return self.ordered((r["i"], r["t"]) for r in passages.select("i", "t").collect())  # about block_chars

    def tables(self) -> Iterator[Passages]:
        for b in range(self.n):
            if self.folder is None:
                yield self.only
            else:
                store, base = fs.FileSystem.from_uri(self.folder)
                if store.get_file_info(f"{base}/{b}").type == fs.FileType.NotFound:
                    continue  # no passage has this hash
                with store.open_input_file(f"{base}/{b}") as f:
                    yield Passages(pickle.loads(f.read()), self.q, self.rate)

    def hits(self, texts: list[str | None]) -> list[list[dict]]:
        """Of each text, by place."""
        found: list[list[dict]] = [[] for _ in texts]
        for table in self.tables():
            for own, t in zip(found, texts, strict=True):
                own += [{"item_id": table.ids[i], "start": s, "end": e, "edits": d} for i, s, e, d in table.find(t)]
        order = lambda h: (h["start"], h["item_id"] is not None, h["item_id"] or 0, h["end"])
        return [sorted(own, key=order) for own in found]


def _stretches(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.Table]:
    """Batches together, until their texts have `limit` bytes: what a block of passages is looked for in at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _scan(docs: DataFrame, blocks: _Blocks, column: int, function: Callable[[pa.RecordBatch, list[list[dict]]], pa.RecordBatch], schema: str | T.StructType, rows: int = 1024) -> DataFrame:
    """One pass over docs: function gets some rows and their texts' hits. With several blocks of passages the texts of STRETCH bytes are held while each block is read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if blocks.n == 1:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield function(part, blocks.hits(part.column(column).to_pylist()))
        else:
            for table in _stretches(batches, column, STRETCH):
                found, at = blocks.hits(table.column(column).to_pylist()), 0
                for part in table.to_batches(rows):
                    yield function(part, found[at : at + part.num_rows])
                    at += part.num_rows

    out = docs.mapInArrow(run, schema)
    if blocks.folder is None:
        return out
    out = durable(out)
    remove(docs.sparkSession, blocks.folder)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", passage_column: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, contaminated, item_ids (distinct, ascending), hits ARRAY<STRUCT<item_id, start, end, edits>> by start. One scan, no shuffle."""
    hit = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    function = lambda batch, hits: pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, hit)], ["doc_id", "hits"])
    blocks = _Blocks(benchmark, item_column, passage_column, q, rate, block_chars)
    found = _scan(id_and_text(docs, id_column, text_column), blocks, 1, function, "doc_id long, hits array<struct<item_id:long,start:long,end:long,edits:long>>")
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.col("hits.item_id"))).alias("item_ids"), "hits")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", passage_column: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all their columns, whose text holds no passage; each row is judged by its own text, whatever its identifier. One scan, no shuffle."""
    blocks = _Blocks(benchmark, item_column, passage_column, q, rate, block_chars)
    function = lambda batch, hits: batch.filter(pa.array([not h for h in hits], pa.bool_()))
    return _scan(docs, blocks, docs.columns.index(text_column), function, docs.schema)
