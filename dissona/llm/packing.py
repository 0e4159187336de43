"""Hierarchical multi-length packing.

Each document's ids (with an end id) are cut into whole windows of the longest context size and a rest. A rest is routed to the
smallest context size (tier, a power of two) that holds it. The longest waiting rest opens a window of its tier; the gap is filled
with the longest rests of shorter tiers that fit, and what is still open with the head of a cut rest, whose tail is routed anew.
So each window but a partition's last is exactly as long as its tier. Windows of a tier are dealt to step groups of equal token
counts, boustrophedon by attention cost, so that the groups of a tier take equally long.

Packing is done within each input partition, in blocks of bounded size, without a shuffle: a task's state is one block. A
partition's last open window is cut into tiers, and under one shortest tier of tokens is padded.

Defined cases: a null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed one by one; an empty
table gives no rows; other columns are ignored; texts are encoded whole and cut into as many windows as they need.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dissona.runtime import ship

from .common import id_and_text
from .tokens import coder, default_path

TIERS = (128, 256, 512, 1024)
GROUP_TOKENS = 16 * 1024
BLOCK_PIECES, BLOCK_BYTES = 4096, 32 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long, step_group long, ids binary"

Piece = tuple[int, int, int]  # length, document number, start


class Packer:
    """Takes documents' lengths; windows() gives lists of pieces, each list one window."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.pool: list[Piece] = []
        self.ready: list[list[Piece]] = []

    def add(self, number: int, n: int) -> None:
        top = self.tiers[-1]
        for s in range(0, n - top + 1, top):
            self.ready.append([(top, number, s)])
        if n % top:
            self.pool.append((n % top, number, n - n % top))

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if t >= n)

    def windows(self, last: bool = False) -> list[list[Piece]]:
        out, self.ready = self.ready, []
        pool = sorted(self.pool)
        self.pool = []
        while pool:
            window = [pool.pop()]
            gap = self.tier(window[0][0]) - window[0][0]
            while gap and pool:
                i = bisect_right(pool, gap, key=lambda p: p[0]) - 1
                if i >= 0:
                    window.append(pool.pop(i))
                else:
                    n, number, start = pool.pop(0)
                    window.append((gap, number, start))
                    insort(pool, (n - gap, number, start + gap))
                gap -= window[-1][0]
            if gap and last:
                out += self.tail(window)
            elif gap:
                self.pool = window
            else:
                out.append(window)
        return out

    def tail(self, pieces: list[Piece]) -> list[list[Piece]]:
        """Cuts an open window into tiers; the rest, shorter than the shortest, is the one that gets padding."""
        out, left = [], sum(p[0] for p in pieces)
        queue = list(pieces)
        while left:
            room = max((t for t in self.tiers if t <= left), default=left)
            left -= room
            window = []
            while room:
                n, number, start = queue.pop(0)
                take = min(n, room)
                window.append((take, number, start))
                if n > take:
                    queue.insert(0, (n - take, number, start + take))
                room -= take
            out.append(window)
        return out


def dealt(windows: list[list[Piece]], group_tokens: int) -> list[int]:
    """A step group for each window, from 0: windows of one length, equal in number, balanced by the sum of squared piece lengths."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by.setdefault(sum(p[0] for p in w), []).append(i)
    out, first = [0] * len(windows), 0
    for n, rows in sorted(by.items()):
        groups = -(-len(rows) * n // group_tokens)
        rows.sort(key=lambda i: -sum(p[0] ** 2 for p in windows[i]))
        for k, i in enumerate(rows):
            turn, at = divmod(k, groups)
            out[i] = first + (groups - 1 - at if turn % 2 else at)
        first += groups
    return out


def pack_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = 0, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: SCHEMA's columns; ids are its little-endian unsigned 32-bit ids (null without with_ids)."""
    ship(docs.sparkSession)
    path, end = tokenizer or default_path(), end_id.to_bytes(4, "little")
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 10 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).ids
        packer, top = Packer(tiers), max(tiers)
        kept: dict[int, tuple[int | None, bytes]] = {}
        at = TaskContext.get().partitionId() << 33
        sequence = group = at
        number = held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group, held, kept
            windows = packer.windows(last)
            groups = dealt(windows, group_tokens)
            rows: list[list] = [[] for _ in names]
            for w, g in zip(windows, groups, strict=True):
                n, offset = sum(p[0] for p in w), 0
                for size, k, start in w:
                    doc, ids = kept[k]
                    part = ids[4 * start : 4 * (start + size)]
                    for c, v in zip(rows, (doc, start, size, zlib.crc32(part), len(ids) // 4, sequence, offset, n, n if n & (n - 1) == 0 else top, group + g, part if with_ids else None), strict=True):
                        c.append(v)
                    offset += size
                sequence += 1
            group += max(groups, default=-1) + 1
            kept = {k: kept[k] for _, k, _ in packer.pool}
            held = sum(len(x[1]) for x in kept.values())
            for i in range(0, len(rows[0]), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 8192], t) for c, t in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                kept[number] = (doc, ids)
                packer.add(number, len(ids) // 4)
                number += 1
                held += len(ids)
                if len(packer.pool) >= BLOCK_PIECES or held >= BLOCK_BYTES:
                    yield from flush(False)
        yield from flush(True)

    return id_and_text(docs, id_column, text_column).mapInArrow(run, SCHEMA)
