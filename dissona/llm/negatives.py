"""Hard negatives by a Voronoi-partitioned nearest-neighbour join (after Lu et al., 2012), exact.

Inner products become distances by one more component: a row gets sqrt(m - |x|^2), with m the largest squared norm, an anchor gets 0;
then |a - x|^2 = |a|^2 + m - 2 a.x, so the highest score is the nearest row. Pivots are a bounded sample of rows. Each row belongs to
its nearest pivot (its cell), each anchor too; cells next to each other make up anchor groups, which are cut into blocks if they are
large.

An anchor needs rows between two distances (low, high). By the triangle inequality a row of cell p at distance d of its pivot can lie there
only if |d(a, p) - d| <= high and d(a, p) + d >= low. The least and greatest d that any anchor of a group allows are the partition
bounds: a table by group and cell, of bounded size. A row is sent to the groups whose bounds it meets, and to no others. What goes to a
group is counted first and cut into slices by hash, so that a task holds one block of anchors and one slice of rows, compares them
exactly, and keeps the best; these meet in a rank by anchor.

This is done twice. For positives, high comes from the best scores that an anchor has among the sampled rows of its label; only rows of
labels of the same class (by hash) as some anchor's go. For negatives, the window of scores that each positive allows gives both
distances, and sampled rows within it narrow them.

Scores are exact: products are made in doubles while they fit 53 bits, else in longs. Bounds have a margin for rounding.

Defined cases: a row with a null identifier, label or vector, or a null or non-finite component takes no part; shorter vectors count as
if they ended in zeros, also empty ones; components are cut where an inner product could leave a long. Each row stands for itself:
repeated rows are other rows, an anchor that is there twice gives its results twice; rows with equal scores and identifiers come in the
order of the table. Positives with a negative score have no negatives, as their window is empty. Fewer rows than asked for give
fewer; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dissona.runtime import durable

from .vectors import integer_vectors, largest_inner, packed, unpacked

#: Pivots at the most, sampled rows for each. Anchors of a group and a block, rows of a slice, about. Classes of labels.
PIVOTS, SEEDS, ANCHORS, SLICE, CLASSES, SCALE = 256, 16, 512, 4096, 16, 256
GROUP = ("g", "class", "block", "slice")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.uint64) * _MIX
    return h ^ (h >> np.uint64(29))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exactly, as longs."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.sqrt((x * x).sum(1).max(initial=0) * (y * y).sum(1).max(initial=0)) < 1 << 52:  # so are all sums on the way
        return (x @ y.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the first n allowed entries of each row, by falling score, then id, then row."""
    lowest = np.iinfo(np.int64).min
    held = np.where(allowed, scores, lowest)
    if n < held.shape[1]:
        edge = np.partition(held, held.shape[1] - n, axis=1)[:, held.shape[1] - n]
        source, target = np.nonzero(allowed & (held >= edge[:, None]))
    else:
        source, target = np.nonzero(allowed)
    order = np.lexsort([rows[target], ids[target], -held[source, target], source])
    source, target = source[order], target[order]
    first = np.searchsorted(source, np.arange(len(held)))
    keep = np.arange(len(source)) - first[source] < n
    return source[keep], target[keep]


@dataclass(frozen=True)
class Space:
    """What all tasks know: sampled rows (vectors, labels, row numbers), pivots among them, and the largest squared norm."""

    kind: str
    width: int
    sample: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    pivots: np.ndarray
    m: float

    @property
    def margin(self) -> float:
        return 4e-6 * self.m**0.5 + 1e-9

    def _far(self, x: np.ndarray, own: np.ndarray | float) -> np.ndarray:
        """Distances to the pivots of rows whose last component is `own`."""
        v, p = x.astype(np.float64), self.pivots.astype(np.float64)
        last = np.sqrt(np.maximum(self.m - (p * p).sum(1), 0))
        square = (v * v).sum(1)[:, None] + np.square(own) + self.m - 2 * (v @ p.T + own * last)
        return np.sqrt(np.maximum(square, 0))

    def row_distances(self, x: np.ndarray) -> np.ndarray:
        v = x.astype(np.float64)
        return self._far(x, np.sqrt(np.maximum(self.m - (v * v).sum(1), 0))[:, None])

    def anchor_distances(self, x: np.ndarray) -> np.ndarray:
        return self._far(x, 0.0)

    def at_score(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance of anchors x from rows with such scores; -inf and inf stay."""
        v = x.astype(np.float64)
        return np.sqrt(np.maximum((v * v).sum(1) + self.m - 2 * score, 0))


@dataclass(frozen=True)
class Groups:
    """Anchor groups: the group of each cell, blocks of each group, least and greatest distance from its pivot that a row of a cell may have to serve it, classes it wants."""

    of_cell: np.ndarray
    blocks: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    wants: np.ndarray


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots' numbers in an order in which each is the nearest of those left to the one before."""
    v = pivots.astype(np.float64)
    far = (v * v).sum(1)[:, None] + (v * v).sum(1) - 2 * v @ v.T
    at, order, left = 0, [0], np.ones(len(v), bool)
    left[0] = False
    while left.any():
        at = int(np.where(left, far[at], np.inf).argmin())
        order.append(at)
        left[at] = False
    return np.array(order)


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


_ROW = "row long, id long, label long, x binary"


def _space(base: DataFrame, kind: str, width: int, n: int, pivots: int) -> Space:
    """Pivots are as many rows, by hash, as the square root of all says, at most `pivots`; the sample, for first bounds, SEEDS times as many."""
    top = base.select(F.max("norm")).first()[0]
    own = int(min(pivots, max(1, round(n**0.5))))
    drawn = base.orderBy(F.xxhash64("row"), "row").limit(own * SEEDS).select("row", "label", "x").toArrow()
    x = unpacked(drawn.column(2), kind, width)
    return Space(kind, width, x, drawn.column(1).to_numpy(), drawn.column(0).to_numpy(), np.unique(x[:own], axis=0), float(top))


def _serve(base: DataFrame, asking: DataFrame, space: Space, by_class: bool, anchors: int, rows: int) -> DataFrame:
    """Groups of a block of anchors and a slice of the rows that may serve them: group, class, block, slice, part, and the columns of both.

    asking: row, id, label, x, low, high (distances), and further longs and lists, which go along.
    """
    kind, width, cells = space.kind, space.width, len(space.pivots)
    class_of = lambda label: (_hash(label) % np.uint64(CLASSES)).astype(np.int64) if by_class else np.zeros(len(label), np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, label = unpacked(b.column(3), kind, width), b.column(2).to_numpy()
            yield _batch([*b.columns, space.anchor_distances(x).argmin(1).astype(np.int32) if len(x) else pa.array([], pa.int32()), pa.array(class_of(label), pa.int32())], [*b.schema.names, "cell", "class"])

    asking = durable(asking.mapInArrow(placed, ", ".join(f"{f} {t}" for f, t in asking.dtypes) + ", cell int, class int"))
    sizes = np.zeros(cells, np.int64)
    classes: dict[int, set[int]] = {}
    for r in asking.groupBy("cell", "class").agg(F.count("*").alias("n")).collect():  # at most pivots times classes
        sizes[r["cell"]] += r["n"]
        classes.setdefault(r["cell"], set()).add(r["class"])
    of_cell, number, held, counts = np.zeros(cells, np.int64), -1, anchors, []
    for cell in _chain(space.pivots):
        if not sizes[cell]:
            continue
        if held + sizes[cell] > anchors:
            number, held = number + 1, 0
            counts.append(0)
        of_cell[cell] = number
        held += sizes[cell]
        counts[number] += sizes[cell]
    groups_n = len(counts)
    wants = np.zeros((groups_n, CLASSES if by_class else 1), bool)
    for cell, own in classes.items():
        wants[of_cell[cell], list(own)] = True

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, greatest = np.full((groups_n, cells), np.inf), np.full((groups_n, cells), -np.inf)
        for b in batches:
            x = unpacked(b.column(0), kind, width)
            low, high, own = (b.column(i).to_numpy() for i in (1, 2, 3))
            far, group = space.anchor_distances(x), of_cell[own]
            np.minimum.at(least, group, np.maximum(far - high[:, None], low[:, None] - far))
            np.maximum.at(greatest, group, far + high[:, None])
        group, cell = np.nonzero(greatest > -np.inf)
        yield _batch([pa.array(group, pa.int32()), pa.array(cell, pa.int32()), least[group, cell], greatest[group, cell]], ["g", "c", "least", "greatest"])

    least, greatest = np.full((groups_n, cells), np.inf), np.full((groups_n, cells), -np.inf)
    found = asking.select("x", "low", "high", "cell").mapInArrow(bounds, "g int, c int, least double, greatest double").groupBy("g", "c").agg(F.min("least"), F.max("greatest"))
    for g, c, a, b in found.collect():  # at most pivots squared
        least[g, c], greatest[g, c] = a - space.margin, b + space.margin
    groups = Groups(of_cell, np.array([-(-n // anchors) for n in counts], np.int64), least, greatest, wants)

    def served(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the batch and groups of what goes where; classes of the batch's rows, and their numbers."""
        x, label, row = unpacked(b.column(3), kind, width), b.column(2).to_numpy(), b.column(0).to_numpy()
        far = space.row_distances(x)
        cell = far.argmin(1) if len(x) else np.zeros(0, np.int64)
        d = far[np.arange(len(x)), cell]
        own = class_of(label)
        at, g = np.nonzero(groups.wants[:, own].T & (d[:, None] >= groups.least[:, cell].T) & (d[:, None] <= groups.greatest[:, cell].T))
        return at, g, own, row

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(groups.wants.shape, np.int64)
        for b in batches:
            at, g, own, _ = served(b)
            np.add.at(n, (g, own[at]), 1)
        g, c = np.nonzero(n)
        yield _batch([pa.array(g, pa.int32()), pa.array(c, pa.int32()), n[g, c]], ["g", "c", "n"])

    slices = np.ones(groups.wants.shape, np.int64)
    given = base.select("row", "id", "label", "x")
    for g, c, n in given.mapInArrow(counted, "g int, c int, n long").groupBy("g", "c").agg(F.sum("n")).collect():  # at most pivots times classes
        slices[g, c] = -(-n // rows)

    def spread(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each entry as often as `times` says, and the number of the copy."""
        again = np.repeat(np.arange(len(times)), times)
        return again, np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)

    def dealt(b: pa.RecordBatch, at: np.ndarray, *to: np.ndarray) -> pa.RecordBatch:
        """Rows of a batch, each with its group, class, block and slice."""
        return _batch([*(pa.array(v, pa.int32()) for v in to), *b.take(pa.array(at)).columns], [*GROUP, *b.schema.names])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, g, own, row = served(b)
            c, part = own[at], _hash(row[at])
            again, block = spread(groups.blocks[g])
            yield dealt(b, at[again], g[again], c[again], block, (part % slices[g, c].astype(np.uint64))[again])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, c = of_cell[b.column(b.num_columns - 2).to_numpy()], b.column(b.num_columns - 1).to_numpy()
            again, part = spread(slices[g, c])
            block = _hash(b.column(0).to_numpy()) % groups.blocks[g].astype(np.uint64)
            yield dealt(b.select(range(b.num_columns - 2)), again, g[again], c[again], block[again], part)

    further = ", ".join(f"{f} {t}" for f, t in asking.dtypes[:-2])
    key = ", ".join(f"{c} int" for c in GROUP)
    left = asking.mapInArrow(asked, f"{key}, {further}").withColumn("asks", F.lit(True))
    right = given.mapInArrow(sent, f"{key}, {_ROW}").withColumn("asks", F.lit(False))
    return left.unionByName(right, allowMissingColumns=True)


def _sides(group: pa.Table, kind: str, width: int) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Anchors, rows, and their scores."""
    group = group.combine_chunks()
    asks = group.column("asks")
    a, b = group.filter(asks), group.filter(pa.compute.invert(asks))
    return a, b, inner(unpacked(a.column("x"), kind, width), unpacked(b.column("x"), kind, width))


def _ranked(found: DataFrame, keys: list[str], id_column: str, row_column: str, n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), id_column, row_column)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, *, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), pivots: int = PIVOTS, block: int = ANCHORS, slice_rows: int = SLICE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its first positives of the same label, and for each of these the first negatives of another label whose score is
    within the window, in hundredths of the positive's score.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    there = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(f"`{vector_column}`").alias("v")).filter("id is not null and label is not null")
    rows, kind, width = integer_vectors(there, "v", scale, [F.col("id"), F.col("label"), F.col("anchor")], largest_inner)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column(3), kind, width).astype(np.float64)
            yield _batch([*b.columns, (x * x).sum(1)], ["id", "label", "anchor", "x", "norm"])

    base = durable(rows.mapInArrow(norms, "id long, label long, anchor boolean, x binary, norm double").withColumn("row", F.monotonically_increasing_id()))
    n, asking_n = base.agg(F.count("*"), F.count_if("anchor")).first()
    if not asking_n:
        return spark.createDataFrame([], schema)
    space = _space(base, kind, width, n, pivots)
    no, yes = -np.inf, np.inf

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """high: the distance of an anchor's last needed positive among the sampled rows of its label."""
        for b in batches:
            x, label, row = unpacked(b.column(3), kind, width), b.column(2).to_numpy(), b.column(0).to_numpy()
            s = np.where((label[:, None] == space.labels) & (row[:, None] != space.rows), inner(x, space.sample).astype(np.float64), no)
            last = np.sort(s, axis=1)[:, -positives] if s.shape[1] >= positives else np.full(len(x), no)
            yield _batch([*b.columns, np.zeros(len(x)), space.at_score(x, last)], ["row", "id", "label", "x", "low", "high"])

    asking = base.filter("anchor").select("row", "id", "label", "x").mapInArrow(seeded, f"{_ROW}, low double, high double")

    def meet_positives(group: pa.Table) -> pa.Table:
        a, b, s = _sides(group, kind, width)
        rows = b.column("row").to_numpy()
        allowed = (a.column("label").to_numpy()[:, None] == b.column("label").to_numpy()) & (a.column("row").to_numpy()[:, None] != rows)
        source, target = first_of(s, allowed, b.column("id").to_numpy(), rows, positives)
        return pa.table({"a_row": a.column("row").to_numpy()[source], "p_id": b.column("id").to_numpy()[target], "p_row": rows[target], "score": s[source, target]})

    met = _serve(base, asking, space, True, block, slice_rows).groupBy(*GROUP).applyInArrow(meet_positives, "a_row long, p_id long, p_row long, score long")
    best = _ranked(met, ["a_row"], "p_id", "p_row", positives)
    listed = best.groupBy("a_row").agg(F.array_sort(F.collect_list(F.struct("rank", "p_id", "score"))).alias("p"))  # a few each
    wanted = base.filter("anchor").select("row", "id", "label", "x").join(listed, F.col("row") == F.col("a_row")).select("row", "id", "label", "x", F.col("p.p_id").alias("p_ids"), F.col("p.score").alias("p_scores"))

    def windows(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """least, most, there of each anchor's positives' windows, a column each; exact in longs while a hundred scores are."""
        lists = b.column(at).to_pylist()
        low, high, ok = np.zeros((len(lists), positives), np.int64), np.zeros((len(lists), positives), np.int64), np.zeros((len(lists), positives), bool)
        for i, scores in enumerate(lists):
            for j, p in enumerate(scores):
                low[i, j], high[i, j] = -(-window[0] * p // 100), window[1] * p // 100
                ok[i, j] = low[i, j] <= high[i, j]
        return low, high, ok

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """low, high: the distances between which the needed negatives of an anchor's positives lie; anchors that need none are left out."""
        for b in batches:
            x, label = unpacked(b.column(3), kind, width), b.column(2).to_numpy()
            low, high, ok = windows(b, 5)
            s = np.where(label[:, None] != space.labels, inner(x, space.sample).astype(np.float64), np.nan)
            near, far = np.full(len(x), yes), np.full(len(x), no)
            for j in range(positives):
                within = np.where((s >= low[:, j, None]) & (s <= high[:, j, None]), s, no)
                last = np.sort(within, axis=1)[:, -negatives] if s.shape[1] >= negatives else np.full(len(x), no)
                far = np.where(ok[:, j], np.maximum(far, space.at_score(x, np.maximum(last, low[:, j]))), far)
                near = np.where(ok[:, j], np.minimum(near, space.at_score(x, high[:, j])), near)
            keep = pa.array(ok.any(1))
            yield _batch([*b.columns, near - space.margin, far + space.margin], [*b.schema.names, "low", "high"]).filter(keep)

    needing = wanted.mapInArrow(narrowed, f"{_ROW}, p_ids array<long>, p_scores array<long>, low double, high double")

    def meet_negatives(group: pa.Table) -> pa.Table:
        a, b, s = _sides(group, kind, width)
        rows, ids = b.column("row").to_numpy(), b.column("id").to_numpy()
        low, high, ok = windows(a.select(["p_scores"]).combine_chunks(), 0)
        p_ids, p_scores = a.column("p_ids").to_pylist(), a.column("p_scores").to_pylist()
        other = a.column("label").to_numpy()[:, None] != b.column("label").to_numpy()
        out: list[list] = [[] for _ in range(8)]
        for j in range(positives):
            source, target = first_of(s, other & ok[:, j, None] & (s >= low[:, j, None]) & (s <= high[:, j, None]), ids, rows, negatives)
            for own, v in zip(out, (a.column("row").to_numpy()[source], np.full(len(source), j), a.column("id").to_numpy()[source], [p_ids[i][j] for i in source], [p_scores[i][j] for i in source], ids[target], rows[target], s[source, target]), strict=True):
                own.extend(np.asarray(v).tolist())
        return pa.table({f: pa.array(v, pa.int64()) for f, v in zip(("a_row", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "n_row", "score"), out, strict=True)})

    met = _serve(base, needing, space, False, block, slice_rows).groupBy(*GROUP).applyInArrow(meet_negatives, "a_row long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, n_row long, score long")
    out = _ranked(met, ["a_row", "place"], "negative_id", "n_row", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
