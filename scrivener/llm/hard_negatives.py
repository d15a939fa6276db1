"""Hard negatives by vantage-point trees over norm-augmented vectors.

A further component lifts every vector to the same norm, so that the inner product with
an anchor falls as the distance to the (equally long) anchor grows, and a window of scores
is an annulus of distances around it.

The upper levels of a vantage-point tree, fitted on a bounded sample, divide all vectors
into cells; a cell knows the nearest and farthest distance of its members to each vantage
point above it, which bounds their distance to any anchor.  Requests visit the nearest cell
that meets their annulus first.  What they find there shrinks the annulus, and only cells
that still meet it are visited then.  A cell is dealt on shelves of bounded size, to which a
request travels once.  A shelf is divided into blocks, each with a tree of its own whose
leaves are taken nearest first until the next cannot do better; what a request finds in one
block shortens its search of the next.

Positives are found in the same way, as the nearest rows of the anchor's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Percent of the positive's score that a negative's may have.
LOW, HIGH = 50, 95
#: Rows of a block, rows of a leaf, and requests to a shelf in one task.
BLOCK, LEAF, REQUESTS = 1024, 64, 20_000
#: Shelves at least, where they hold more than a block each, and components on a shelf at most.
SHELVES, SHELF = 64, 2**20
#: Entries of a table of distances that a task computes at once, rows that it passes on and requests that it searches for at once.
AT_ONCE, ROWS, ASKS = 2**19, 4096, 4096
#: Vectors that the upper tree is fitted on at most, and its levels at most.
SAMPLE, LEVELS = 16_384, 12
#: Below this, sums of products are exact in double precision.
EXACT = 2**53
#: What rounding of distances may lose, in parts of the squared radius.
SLOP = 1e-9


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label and v, floor(scale * x) of each component, without rows that take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    known = known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
    return known.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows are vectors; shorter ones end in zeros."""
    ends = np.asarray(column.offsets)
    flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    out = np.zeros((len(column), size))
    at = np.arange(size)[None, :] < lengths[:, None]
    out[at] = flat[ends[0] : ends[-1]]
    return out


def lifted(v: np.ndarray, square: float) -> np.ndarray:
    """Vectors with a further component, all of squared norm ``square``."""
    return np.concatenate([v, np.sqrt(np.maximum(0, square - (v * v).sum(axis=1)))[:, None]], axis=1)


def stretched(q: np.ndarray, square: float) -> np.ndarray:
    """Anchors on the same sphere: longer or shorter, with nothing in the further component."""
    norm = np.sqrt((q * q).sum(axis=1))
    return np.concatenate([q * np.where(norm > 0, np.sqrt(square) / np.where(norm > 0, norm, 1), 0)[:, None], np.zeros((len(q), 1))], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def radius(score: np.ndarray, q: np.ndarray, square: float) -> np.ndarray:
    """The distance to stretched anchors at which lifted vectors have a score."""
    norm = np.sqrt((q * q).sum(axis=1))
    anchor = np.where(norm > 0, square, 0.0)
    factor = np.where(norm > 0, np.sqrt(square) / np.where(norm > 0, norm, 1), 0)
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(0, square + anchor - 2 * np.where(factor > 0, score * factor, 0)))


@dataclass
class Tree:
    """Vantage points, and for each leaf the points above it with the nearest and farthest of its members."""

    points: np.ndarray
    paths: list[list[int]]
    near: list[list[float]]
    far: list[list[float]]

    def bounds(self, to_points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most distance to each leaf's members, from distances to the vantage points."""
        low, high = np.zeros((len(to_points), len(self.paths))), np.full((len(to_points), len(self.paths)), np.inf)
        for leaf, path in enumerate(self.paths):
            for p, a, b in zip(path, self.near[leaf], self.far[leaf]):
                d = to_points[:, p]
                low[:, leaf] = np.maximum(low[:, leaf], np.maximum(d - b, a - d))
                high[:, leaf] = np.minimum(high[:, leaf], d + b)
        return low, high


def grow(x: np.ndarray, leaf: int, levels: int = 64) -> tuple[Tree, list[np.ndarray]]:
    """A tree over the rows of ``x`` and each leaf's rows; splits at the median distance to the vantage point."""
    points: list[np.ndarray] = []
    tree, leaves = Tree(np.zeros((0, x.shape[1])), [], [], []), []

    def split(rows: np.ndarray, path: list[int], near: list[float], far: list[float], level: int) -> None:
        if len(rows) > leaf and level < levels:
            vantage = x[rows[int(((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1).argmax())]]  # from the rim distances spread most
            d = distances(x[rows], vantage[None])[:, 0]
            order = np.argsort(d, kind="stable")
            if d[order[0]] < d[order[-1]]:
                points.append(vantage)
                half, here = len(rows) // 2, len(points) - 1
                for own in (order[:half], order[half:]):
                    split(rows[own], [*path, here], [*near, float(d[own].min())], [*far, float(d[own].max())], level + 1)
                return
        tree.paths.append(path)
        tree.near.append(near)
        tree.far.append(far)
        leaves.append(rows)

    split(np.arange(len(x)), [], [], [], 0)
    tree.points = np.array(points) if points else np.zeros((0, x.shape[1]))
    return tree, leaves


@dataclass
class Cells:
    """The upper tree: inner nodes as (vantage point, median, inner child, outer child), a cell as its number below zero."""

    nodes: list[tuple[int, float, int, int]]
    points: np.ndarray
    paths: list[list[int]]
    square: float
    size: int

    def of(self, to_points: np.ndarray) -> np.ndarray:
        """Each row's cell, from its distances to the vantage points."""
        at = np.zeros(len(to_points), np.int64) if self.nodes else np.full(len(to_points), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]).tolist():
                point, median, near, far = self.nodes[node]
                rows = inner[at[inner] == node]
                at[rows] = np.where(to_points[rows, point] <= median, near, far)
        return -1 - at


def fit_cells(sample: np.ndarray, square: float, levels: int) -> Cells:
    x = lifted(sample, square)
    cells = Cells([], np.zeros((0, x.shape[1])), [], square, sample.shape[1])
    points: list[np.ndarray] = []

    def split(rows: np.ndarray, path: list[int], level: int) -> int:
        if level < levels and len(rows) > 1:
            vantage = x[rows[int(((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1).argmax())]]
            d = distances(x[rows], vantage[None])[:, 0]
            median = float(np.median(d))
            inner = d <= median
            if inner.any() and not inner.all():
                points.append(vantage)
                cells.nodes.append((len(points) - 1, median, 0, 0))
                here = len(cells.nodes) - 1
                own = [*path, len(points) - 1]
                cells.nodes[here] = (own[-1], median, split(rows[inner], own, level + 1), split(rows[~inner], own, level + 1))
                return here
        cells.paths.append(path)
        return -len(cells.paths)

    split(np.arange(len(x)), [], 0)
    cells.points = np.array(points) if points else cells.points
    return cells


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose tables with ``width`` columns stay within AT_ONCE entries."""
    step = max(1, AT_ONCE // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def assign(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    """Adds to rows (row, vec_id, label, v) their cell and the distances to the vantage points above it."""
    for batch in slices(batches, len(cells.points)):
        d = distances(lifted(matrix(batch.column("v"), cells.size), cells.square), cells.points)
        cell = cells.of(d)
        above = [d[i, cells.paths[c]].tolist() for i, c in enumerate(cell.tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(above, pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "above"])


REQUEST = "request long, row long, label long, v array<long>, same boolean, lo long, hi long, reached long"


def reach(q: np.ndarray, batch: pa.RecordBatch, square: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and most distance that each request asks for, with room for rounding; ``reached`` shortens the most."""
    get = lambda c, none: batch.column(c).cast(pa.float64(), safe=False).fill_null(none).to_numpy(zero_copy_only=False)
    lo, hi, reached = get("lo", -np.inf), get("hi", np.inf), get("reached", -np.inf)
    slop = SLOP * np.sqrt(square) + 1e-9
    return radius(hi, q, square) - slop, radius(np.maximum(lo, reached), q, square) + slop


def route(batches: Iterator[pa.RecordBatch], tree: Tree, cells: Cells, members: np.ndarray, first: bool) -> Iterator[pa.RecordBatch]:
    """Requests to the nearest cell that meets their annulus (``first``), or to all others that do; ``members``: cells that have any."""
    for batch in slices(batches, len(cells.paths)):
        q = matrix(batch.column("v"), cells.size)
        low, high = tree.bounds(distances(stretched(q, cells.square), cells.points))
        least, most = reach(q, batch, cells.square)
        slop = SLOP * np.sqrt(cells.square)
        meets = (low - slop <= most[:, None]) & (high + slop >= least[:, None]) & members[None, :]
        blank = np.where((high + slop >= least[:, None]) & members[None, :], low, np.inf)
        nearest = blank.argmin(axis=1)
        home = np.zeros_like(meets)
        home[np.arange(len(home)), nearest] = True
        home &= np.isfinite(blank)
        rows, cell = np.nonzero(home if first else meets & ~home)
        for at in range(0, len(rows), ROWS):  # a request may meet all cells, so its copies leave as they are made
            copies = batch.take(pa.array(rows[at : at + ROWS]))
            yield pa.RecordBatch.from_arrays([*copies.columns, pa.array(cell[at : at + ROWS].astype(np.int32))], names=[*batch.schema.names, "cell"])


def best_of(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of each ``at``, in order: by score, then vec_id, then row."""
    rank = np.lexsort((rows, ids, ~scores, at))  # ~ turns the order of all integers
    own = at[rank]
    return rank[np.arange(len(own)) - np.searchsorted(own, own) < k]


HITS = "request long, row long, vec_id long, score long"


@dataclass
class Block:
    """The rows of one block and their tree."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray

    def search(self, batch: pa.RecordBatch, k: int, square: float) -> tuple[list[np.ndarray], int]:
        """request, row, vec_id and score of each request's k best here, and how many scores were computed.

        Every round takes each request's next nearest leaf, all requests of a leaf at once;
        a request is done when its next leaf cannot hold a score as good as its k-th so far.
        """
        if not hasattr(self, "tree"):
            self.tree, self.leaves = grow(lifted(self.v, square), LEAF)
            self.parts = [np.ascontiguousarray(self.v[own].T) for own in self.leaves]
            self.largest = max(1.0, np.abs(self.v).max(initial=0))
        q = matrix(batch.column("v"), self.v.shape[1])
        request, row, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("request", "row", "label"))
        same = batch.column("same").to_numpy(zero_copy_only=False).astype(bool)
        if self.v.shape[1] * max(self.largest, np.abs(q).max(initial=0)) ** 2 >= EXACT:
            return self.search_wide(batch, k), len(q) * len(self.v)
        number = lambda c, none: batch.column(c).cast(pa.float64(), safe=False).fill_null(none).to_numpy(zero_copy_only=False)
        low, high = self.tree.bounds(distances(stretched(q, square), self.tree.points))
        least, most = reach(q, batch, square)
        slop = SLOP * np.sqrt(square) + 1e-9
        first, last = np.maximum(number("lo", -np.inf), number("reached", -np.inf)), number("hi", np.inf)
        low = np.where(high + slop < least[:, None], np.inf, low)
        order = np.argsort(low, axis=1, kind="stable")
        best = np.full((len(q), k), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen, going = 0, np.arange(len(q))
        for turn in range(order.shape[1]):
            leaf = order[going, turn]
            alive = low[going, leaf] - slop <= most[going]
            going, leaf = going[alive], leaf[alive]
            if not len(going):
                break
            by = np.argsort(leaf, kind="stable")
            for asks in np.split(going[by], np.flatnonzero(np.diff(leaf[by])) + 1):
                n = order[asks[0], turn]
                own, step = self.leaves[n], max(1, AT_ONCE // len(self.leaves[n]))
                for part in (asks[x : x + step] for x in range(0, len(asks), step)):
                    scores = q[part] @ self.parts[n]
                    seen += scores.size
                    i, j = np.nonzero(scores >= np.maximum(first[part], best[part, 0])[:, None])  # few are left for the other tests
                    at, rows, score = part[i], own[j], scores[i, j]
                    fits = ((self.labels[rows] == label[at]) == same[at]) & (self.rows[rows] != row[at]) & (score <= last[at])
                    if not fits.any():
                        continue
                    i, j, score = i[fits], j[fits], score[fits]
                    kept.append((at[fits], rows[fits], score))
                    of, place = np.unique(i, return_inverse=True)
                    better = np.full((len(of), len(own) + k), -np.inf)
                    better[place, j], better[:, len(own) :] = score, best[part[of]]
                    best[part[of]] = np.partition(better, -k, axis=1)[:, -k:]  # the worst of them stands first
            if sum(len(x[0]) for x in kept) > AT_ONCE:  # many ties
                at, own, scores = (np.concatenate(x) for x in zip(*kept))
                top = best_of(at, scores.astype(np.int64), self.ids[own], self.rows[own], k)
                kept = [(at[top], own[top], scores[top])]
            most[going] = np.minimum(most[going], radius(np.maximum(first[going], best[going, 0]), q[going], square) + slop)
        at, own, scores = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 3
        good = scores >= best[at, 0]
        at, own, scores = at[good], own[good], scores[good].astype(np.int64)
        top = best_of(at, scores, self.ids[own], self.rows[own], k)
        at, own, scores = at[top], own[top], scores[top]
        return [request[at], self.rows[own], self.ids[own], scores], seen

    def search_wide(self, batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
        """As :meth:`search`, in Python's integers, for components so large that doubles would round; scores beyond 64 bits stop at the limit."""
        low, high, found = -(2**63), 2**63 - 1, []
        rows = list(zip(self.rows.tolist(), self.ids.tolist(), self.labels.tolist(), [[int(x) for x in v] for v in self.v]))
        for request, row, label, v, same, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("request", "row", "label", "v", "same", "lo", "hi"))):
            scored = [(-min(max(sum(a * b for a, b in zip(v, w)), low), high), i, r) for r, i, other, w in rows if (other == label) == same and r != row]
            found += [(request, r, i, -s) for s, i, r in sorted(x for x in scored if (lo is None or -x[0] >= lo) and (hi is None or -x[0] <= hi))[:k]]
        return [np.array(c, np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4


class Shelf:
    """Blocks of near rows, and the tree above them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, square: float) -> None:
        self.tree, members = grow(lifted(v, square), 2 * BLOCK)
        self.blocks = [Block(rows[own], ids[own], labels[own], v[own]) for own in members]

    def search(self, batch: pa.RecordBatch, k: int, square: float) -> list[np.ndarray]:
        """request, row, vec_id and score of each request's k best here, from one block after the other."""
        q, request = matrix(batch.column("v"), self.blocks[0].v.shape[1]), batch.column("request").to_numpy(zero_copy_only=False)
        low, high = self.tree.bounds(distances(stretched(q, square), self.tree.points))
        slop, order = SLOP * np.sqrt(square) + 1e-9, np.argsort(request, kind="stable")
        reached = batch.column("reached").fill_null(-(2**63)).to_numpy(zero_copy_only=False).copy()
        at, row, ids, score = (np.zeros(0, np.int64) for _ in range(4))
        for n in np.argsort(low.mean(axis=0), kind="stable").tolist():
            batch = batch.set_column(batch.schema.names.index("reached"), "reached", pa.array(reached))
            least, most = reach(q, batch, square)
            asks = np.flatnonzero((low[:, n] - slop <= most) & (high[:, n] + slop >= least))
            found, _ = self.blocks[n].search(batch.take(pa.array(asks)), k, square) if len(asks) else ([[]], 0)
            if not len(found[0]):
                continue
            place = order[np.searchsorted(request[order], found[0])]
            at, row, ids, score = (np.concatenate(x) for x in zip((at, row, ids, score), (place, *found[1:])))
            top = best_of(at, score, ids, row, k)
            at, row, ids, score = at[top], row[top], ids[top], score[top]
            full = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)  # the k-th of those who have k
            reached[at[full]] = np.maximum(reached[at[full]], score[full])
        return [request[at], row, ids, score]


def search_shelves(batches: Iterator[pa.RecordBatch], k: int, square: float, size: int) -> Iterator[pa.RecordBatch]:
    """Each shelf's rows, then its requests, as they stream by; a shelf's rows are all that is held."""
    key, parts, shelf = None, [], None
    for batch in batches:
        cell, number, part, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "shelf", "part", "asks"))
        change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if a == b:
                continue
            own = (int(cell[a]), int(number[a]), int(part[a]))
            if own != key:
                key, parts, shelf = own, [], None
            piece = batch.slice(a, b - a)
            if not asks[a]:
                parts.append((*(piece.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")), matrix(piece.column("v"), size)))
            elif parts or shelf:
                if parts:
                    shelf, parts = Shelf(*(np.concatenate(x) for x in zip(*parts)), square), []
                for at in range(0, piece.num_rows, ASKS):
                    found = shelf.search(piece.slice(at, ASKS), k, square)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["request", "row", "vec_id", "score"])


@dataclass
class Index:
    """All rows by cell and shelf."""

    rows: DataFrame
    cells: Cells
    tree: Tree
    members: np.ndarray
    shelves: DataFrame

    def visit(self, routed: DataFrame, k: int) -> DataFrame:
        """The k best of each request on each shelf of the cells it was routed to."""
        # Where a cell has very many requests, they are dealt to several tasks, and its rows go to each.
        parts = routed.groupBy("cell").agg((F.floor(F.count("*") / REQUESTS) + 1).cast("int").alias("parts"))
        dealt = F.broadcast(self.shelves.join(parts, "cell"))  # at most 2 ** LEVELS rows
        shelf, part = F.explode(F.sequence(F.lit(0), F.col("shelves") - 1)).alias("shelf"), F.pmod(F.xxhash64("request"), F.col("parts")).cast("int").alias("part")
        names = ("cell", "shelf", "part", "asks", "request", "row", "vec_id", "label", "v", "same", "lo", "hi", "reached")
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        asks = routed.join(dealt, "cell").select("cell", shelf, part, F.lit(1).alias("asks"), "request", "row", none("vec_id", "long"), "label", "v", "same", "lo", "hi", "reached")
        given = self.rows.join(dealt, "cell").select(
            "cell", "shelf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asks"), none("request", "long"), "row", "vec_id", "label", "v",
            none("same", "boolean"), none("lo", "long"), none("hi", "long"), none("reached", "long"),
        )
        square, size = self.cells.square, self.cells.size
        both = given.select(*names).unionByName(asks.select(*names)).repartition("cell", "shelf", "part").sortWithinPartitions("cell", "shelf", "part", "asks")
        return both.mapInArrow(lambda it: search_shelves(it, k, square, size), HITS)

    def search(self, requests: DataFrame, k: int) -> DataFrame:
        """request, row, vec_id, score, rank: the k best rows of each request, by score, then vec_id, then row."""
        order = Window.partitionBy("request").orderBy(F.col("score").desc(), "vec_id", "row")
        shape = f"{REQUEST}, cell int"
        to = lambda df, first: df.mapInArrow(lambda it, t=self.tree, c=self.cells, m=self.members: route(it, t, c, m, first), shape)
        near = staged(self.visit(to(requests, True), k), "near")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("request", F.col("score").alias("so_far"))
        narrowed = requests.join(best, "request", "left").withColumn("reached", F.col("so_far")).select(*requests.columns)
        found = near.unionByName(self.visit(to(narrowed, False), k))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def index(rows: DataFrame) -> Index:
    """Deals ``rows`` (row, vec_id, label, v) into cells and shelves."""
    mass = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    about = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(mass), F.lit(0.0)).alias("square"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("size")).first()
    square, size = about["square"] * (1 + 1e-12), max(1, about["size"])
    shelf = max(BLOCK, min(about["n"] // SHELVES, SHELF // size))  # rows
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, about["n"]) / shelf)))))
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v").collect() if levels else []
    fitted = np.zeros((len(sample), size))
    for i, r in enumerate(sample):
        fitted[i, : len(r["v"])] = r["v"]
    cells = fit_cells(fitted, square, levels)
    dealt = rows.mapInArrow(lambda it: assign(it, cells), "row long, vec_id long, label long, v array<long>, cell int, above array<double>")
    dealt = staged(dealt, "cells")
    depth = max(map(len, cells.paths))
    spans = [f(F.get("above", F.lit(d))).alias(f"{what}{d}") for d in range(depth) for f, what in ((F.min, "near"), (F.max, "far"))]
    known = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), *spans).collect()}  # at most 2 ** LEVELS rows
    near, far = ([[known[c][f"{what}{d}"] for d in range(len(path))] if c in known else [0.0] * len(path) for c, path in enumerate(cells.paths)] for what in ("near", "far"))
    shelves = rows.sparkSession.createDataFrame([(c, -(-r["n"] // shelf)) for c, r in known.items()], "cell int, shelves int")
    placed = dealt.join(F.broadcast(shelves), "cell").select("row", "vec_id", "label", "v", "cell", F.pmod(F.xxhash64(F.lit("shelf"), "row"), F.col("shelves")).cast("int").alias("shelf"))
    members = np.array([c in known for c in range(len(cells.paths))])
    return Index(placed, cells, Tree(cells.points, cells.paths, near, far), members, F.broadcast(shelves))


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``; an anchor's positives are its
    best ``positives`` other rows of the same label; a pair's negatives are the best
    ``negatives`` rows of other labels with a score of ``low`` to ``high`` percent of the
    positive's.  Ties go to the smaller vec_id.  Rows with a null vec_id, label, vector or
    component, or a component that is not finite, take no part; missing components of
    shorter vectors count zero; rows that repeat a vec_id are rows of their own, each with
    pairs of its own; a pair without any such row, and an empty table, give no rows; other
    columns are ignored.  Scores beyond 64 bits stop at the limit.
    """
    rows = staged(integers(vectors, scale), "vectors")
    made = index(rows)
    none = F.lit(None).cast("long")
    anchors = rows.where(F.col("vec_id") % every == 0)
    asked = anchors.select(F.col("row").alias("request"), "row", "label", "v", F.lit(True).alias("same"), none.alias("lo"), none.alias("hi"), none.alias("reached"))
    found = made.search(asked, positives).select("request", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth"))
    pairs = staged(found, "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    window = pairs.select(
        F.col("request").alias("row"), (F.col("request") * positives + F.col("nth") - 1).alias("request"),
        F.ceil(score * low / 100).cast("decimal(20,0)").alias("lo"), F.floor(score * high / 100).cast("decimal(20,0)").alias("hi"),
    ).where(F.col("lo") <= F.col("hi"))
    wanted = anchors.join(window, "row").select("request", "row", "label", "v", F.lit(False).alias("same"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), none.alias("reached"))
    hits = made.search(wanted, negatives).select("request", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    named = pairs.join(anchors.select(F.col("row").alias("request"), F.col("vec_id").alias("anchor_id")), "request")
    named = named.select("anchor_id", "positive_id", "positive_score", (F.col("request") * positives + F.col("nth") - 1).alias("request"))
    return named.join(hits, "request").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """Labels one class on where vec_id is divisible by ``every``: rows that are near their old class and not of it."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))
