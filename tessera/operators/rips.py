"""First Betti number of the flag (Rips) complex of graphs at a scale (T1), over Z2.

1. Collapse: a vertex v is dominated by its neighbour w where every neighbour of v is w or a
   neighbour of w, that is, where the edge (v, w) lies in degree(v) - 1 triangles.  Taking a
   dominated vertex away keeps the homotopy type.  Domination is transitive, so of all vertices
   with a dominator that comes after them by (degree, id), each has a last one that stays, and
   all of them go in one round.  Rounds go on while they take a fair part of the edges; what
   they leave is exact at any point.
2. Null edges: beta1 is the number of independent functions on the edges over Z2 that add up to
   null around every triangle, less those that come from functions on the vertices, that is, of
   those functions that are null on a spanning forest.  Where two edges of a triangle are null so is
   the third (``open_edges``), and in a group of many triangles this leaves few edges or none.  The
   forest takes edges of vertices of many edges first, as their triangles have two edges of it.
3. Rank: beta1 is the number of open edges less the rank of the triangles' boundaries without null
   edges.  Open edges are numbered within their group by length; a triangle is the column of its
   numbers and its pivot the largest; triangles that others of shorter edges span are left out
   (``spanning_columns``).  Columns are reduced where the block of their pivot is: a task
   keeps one column for each pivot of a block and adds it to the others with that pivot, until
   they vanish, get a new pivot of the block, or a pivot of a lower block, which the next round
   takes on.  After i rounds the highest i blocks of a group are final.  A group whose rank has
   reached its number of open edges is complete, and its other columns vanish unread.

A task holds the kept columns of one block, at most ``block`` of them, and one batch of rows.
Equal points of a group have the same neighbours, so one of them stands for all
(``distinct_points``).  Triangles are never listed: a task holds the edges that end in one block of
vertices (``dealt``) as rows of bits, or as a matrix of numbers for the columns, and its share of the
group's edges, and gives only what it finds.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.training import numbered
from tessera.session import checked_broadcast, cut_lineage

#: edges whose columns one task keeps
BLOCK = 20_000
#: cells of the matrix of numbers that a task looks for third corners in, and comparisons of one task; of bits, likewise
CELLS, WORK = 1 << 25, 1 << 33
BITS, BIT_WORK = 1 << 29, 1 << 36
#: vertices or edges sent to every task, of a few numbers each
PLACES = 400_000
#: no edge there
NONE = (1 << 31) - 1
#: a round of collapses that takes less than this part of the edges is the last one
WORTH = 0.05

COLUMN_SCHEMA = "grp bigint, block bigint, settled boolean, col array<bigint>"


def distinct_points(points: DataFrame) -> DataFrame:
    """(grp, id, vec): of equal points of a group the one with the smallest id; points without a
    group, an id or coordinates are left out."""
    known = points.filter("grp is not null and id is not null and vec is not null")
    return known.groupBy("grp", "vec").agg(F.min("id").alias("id")).select("grp", "id", "vec")


def placed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices): ``edges`` (grp, u, v, ...) with ``x`` < ``y``, the places of their ends among the ``n`` vertices
    of their group, from 0 and by falling (degree, id); vertices (grp, id, p, d: place and degree, n)."""
    ends = edges.select("grp", F.col("u").alias("id")).unionByName(edges.select("grp", F.col("v").alias("id")))
    ranked = cut_lineage(numbered(ends.groupBy("grp", "id").agg(F.count("*").alias("d")), [], [F.col("grp"), F.desc("d"), F.desc("id")], "p"))
    first = checked_broadcast(ranked.groupBy("grp").agg(F.min("p").alias("p0"), F.count("*").cast("int").alias("n")))
    vertices = cut_lineage(ranked.join(first, "grp").select("grp", "id", (F.col("p") - F.col("p0")).cast("int").alias("p"), "d", "n"))
    own = checked_broadcast(vertices.select("grp", "id", "p", "n"), PLACES)
    at = edges.join(own.select("grp", F.col("id").alias("u"), F.col("p").alias("_u"), "n"), ["grp", "u"]).join(own.select("grp", F.col("id").alias("v"), F.col("p").alias("_v")), ["grp", "v"])
    return cut_lineage(at.select(*edges.columns, F.least("_u", "_v").alias("x"), F.greatest("_u", "_v").alias("y"), "n")), vertices


def dealt(rows: DataFrame, cells: int, work: int) -> DataFrame:
    """Rows (grp, x, y, n, held, top, and e where columns are asked for) of ``placed`` edges dealt to tasks (grp, c, part) that look for third
    corners of triangles.

    A group's vertices are cut into blocks, and those of block ``c`` are the corners of its tasks.  A task
    holds as its matrix the ``held`` edges that end there, at most ``cells`` places, and has its share
    of all ``top`` edges of the group.  So an edge is copied for its blocks and the parts of their
    work, a triangle never.
    """
    n = F.col("n").cast("bigint")
    width = F.greatest(F.lit(1), F.least(n, F.floor(F.lit(cells) / n)))
    sizes = rows.groupBy("grp").agg(F.count_if("top").alias("m"), F.max("n").alias("n")).select("grp", "m", width.alias("width"), F.ceil(n / width).alias("blocks"))
    sizes = cut_lineage(sizes.select("grp", "width", "blocks", F.greatest(F.lit(1), F.ceil(F.col("m") * F.col("width") / work)).alias("parts")))
    each = rows.join(checked_broadcast(sizes), "grp").withColumn("several", F.col("blocks") * F.col("parts") > 1)
    zero = F.lit(0).cast("bigint")
    out = each.filter("not several").withColumns({"c": zero, "part": zero})
    if not sizes.filter("blocks * parts > 1").isEmpty():
        copies = each.filter("several")
        for c, of in (("c", "blocks"), ("part", "parts")):
            copies = copies.withColumn(c, F.explode(F.sequence(zero, F.col(of) - 1)))
        ends_here = (F.floor(F.col("x") / F.col("width")) == F.col("c")) | (F.floor(F.col("y") / F.col("width")) == F.col("c"))
        own = F.pmod(F.xxhash64("x", "y"), F.col("parts")) == F.col("part")
        out = out.unionByName(copies.withColumns({"held": F.col("held") & ends_here, "top": F.col("top") & own}).filter("held or top"))
    # few columns, as each costs time a row on its way to Python
    packed = lambda *of: functools.reduce(Column.bitwiseOR, [F.shiftleft(F.col(c).cast("bigint"), by) for c, by in of])
    out = out.select("grp", packed(("c", 32), ("part", 0)).alias("task"), packed(("x", 33), ("y", 2), ("held", 1), ("top", 0)).alias("edge"),
                     packed(("n", 33), ("width", 2), ("several", 0)).alias("shape"), *(["e"] if "e" in rows.columns else []))
    return out.repartition("grp", "task").sortWithinPartitions("grp", "task")


def _in_tasks(step):
    """Arrow batches of ``dealt`` -> those that ``step`` makes of a task's place (grp, first place of its block, n, width,
    whether the group has several tasks) and its held and its top edges (x, y, e, the last one only where there are numbers)."""
    def done(key: tuple[int, ...], parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        edge, *e = (np.concatenate(p) for p in zip(*parts))
        grp, task, shape = key
        n, width = shape >> 33, shape >> 2 & NONE
        cols = [(edge >> 33).astype(np.int32), (edge >> 2 & NONE).astype(np.int32), *[c.astype(np.int32) for c in e]]
        held, top = edge & 2 > 0, edge & 1 > 0
        if top.any():
            yield from step((grp, (task >> 32) * width, n, width, shape & 1), tuple(c[held] for c in cols), tuple(c[top] for c in cols))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, task, edge, shape, *e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            if e and np.abs(e[0]).max() >= NONE:
                raise ValueError("a group has too many edges")
            new = np.flatnonzero(np.diff(grp) | np.diff(task)) + 1
            for start, end in zip([0, *new], [*new, batch.num_rows]):
                key = int(grp[start]), int(task[start]), int(shape[start])
                if key != here:
                    if parts:
                        yield from done(here, parts)
                    here, parts = key, []
                parts.append([c[start:end] for c in (edge, *e)])
        if parts:
            yield from done(here, parts)
    return run


class _Bits:
    """The neighbours in the places from ``start`` on of each of ``n`` vertices, as rows of bits."""

    def __init__(self, n: int, start: int, width: int, x: np.ndarray, y: np.ndarray):
        self.start, self.width = start, width
        self.rows = np.zeros((n, -(-width // 64)), np.uint64)
        self.add(x, y)
        self.step = max(1, (1 << 20) // self.rows.shape[1])

    def here(self, x: np.ndarray) -> np.ndarray:
        return (x >= self.start) & (x < self.start + self.width)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        for a, b in ((x, y), (y, x)):
            here = self.here(b)
            a, b = a[here], b[here] - self.start
            np.bitwise_or.at(self.rows, (a, b >> 6), np.uint64(1) << (b & 63).astype(np.uint64))


def _table(grp: int, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"grp": pa.array(np.full(len(columns["x"]), grp), pa.int64()), **{k: pa.array(c.astype(np.int64)) for k, c in columns.items()}})


def _contained(at: tuple[int, ...], held: tuple[np.ndarray, ...], top: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """(grp, x, y, n) of top edges whose y has neighbours in the block, all of them but x neighbours of x too: how many."""
    grp, start, n, width, _ = at
    bits = _Bits(n, start, width, *held[:2])
    count = np.bitwise_count(bits.rows).sum(axis=1, dtype=np.int64)
    for i in range(0, len(top[0]), bits.step):
        x, y = (t[i:i + bits.step] for t in top[:2])
        common = np.bitwise_count(bits.rows[x] & bits.rows[y]).sum(axis=1, dtype=np.int64)
        found = (count[y] > 0) & (count[y] - bits.here(x) == common)
        if found.any():
            yield _table(grp, x=x[found], y=y[found], n=common[found])


def _open(at: tuple[int, ...], held: tuple[np.ndarray, ...], top: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """(grp, x, y, blocks, several) of the top edges that are not found to be null: held ones are null, and so is an edge
    with a third corner in the block whose edges to both ends are null."""
    grp, start, n, width, several = at
    bits = _Bits(n, start, width, *held[:2])
    x, y = top[:2]
    while len(x):
        left = np.ones(len(x), bool)
        for i in range(0, len(x), bits.step):
            a, b = x[i:i + bits.step], y[i:i + bits.step]
            found = (bits.rows[a] & bits.rows[b]).any(axis=1)
            left[i:i + bits.step] = ~found
            bits.add(a[found], b[found])
        if left.all():
            yield _table(grp, x=x, y=y, blocks=np.full(len(x), -(-n // width)), several=np.full(len(x), several))
            return
        x, y = x[left], y[left]


def _columns(at: tuple[int, ...], held: tuple[np.ndarray, ...], tops: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """(grp, col) of triangles whose longest edge is a top edge and third corner in the block, without null edges."""
    grp, start, n, width, _ = at
    matrix = np.full((n, width), NONE, np.int32)
    for a, b in ((held[0], held[1]), (held[1], held[0])):
        here = (b >= start) & (b < start + width)
        matrix[a[here], b[here] - start] = held[2][here]
    x, y, e = tops
    step = max(1, (1 << 18) // width)
    found = []
    for i in range(0, len(x), step):
        xs, ys, top = x[i:i + step], y[i:i + step], e[i:i + step]
        second = np.maximum(matrix[xs], matrix[ys])
        second[second >= top[:, None]] = NONE
        while len(top):
            w = second.argmin(axis=1)
            mid = second[np.arange(len(w)), w]
            left = np.flatnonzero(mid != NONE)
            xs, ys, top, w, mid, second = xs[left], ys[left], top[left], w[left], mid[left], second[left]
            found.append(np.stack([np.minimum(matrix[xs, w], matrix[ys, w]), mid, top], axis=1).astype(np.int64))
            second[matrix[start + w] < top[:, None]] = NONE
            second[np.arange(len(w)), w] = NONE
    cols = np.concatenate(found)
    real = cols > 0
    ends = np.concatenate([[0], np.cumsum(real.sum(axis=1))])
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), grp), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cols[real]))], names=["grp", "col"])


def dominated(edges: DataFrame, cells: int = BITS, work: int = BIT_WORK) -> DataFrame:
    """(grp, id): vertices of (grp, u, v) with a dominator after them by (degree, id)."""
    at, vertices = placed(edges)
    every = at.withColumns({"held": F.lit(True), "top": F.lit(True)})
    shared = dealt(every, cells, work).mapInArrow(_in_tasks(_contained), "grp bigint, x bigint, y bigint, n bigint").groupBy("grp", "x", "y").agg(F.sum("n").alias("common"))
    return shared.withColumn("p", F.col("y").cast("int")).join(vertices, ["grp", "p"]).filter("common = d - 1").select("grp", "id").distinct()


def collapsed(edges: DataFrame, worth: float = WORTH) -> DataFrame:
    """The edges (grp, u, v, ...) left by rounds of collapses; groups that shrink to points vanish."""
    edges = cut_lineage(edges)
    n = edges.count()
    while n:
        gone = checked_broadcast(cut_lineage(dominated(edges.select("grp", "u", "v"))))
        left = edges
        for end in ("u", "v"):
            left = left.join(gone.select("grp", F.col("id").alias(end)), ["grp", end], "left_anti")
        edges = cut_lineage(left)
        before, n = n, edges.count()
        if before - n < worth * before:
            break
    return edges


def _bits(x: int) -> np.ndarray:
    """The places of the ones of ``x``."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-x.bit_length() // 8), "little"), np.uint8), bitorder="little"))


class _Block:
    """The columns kept for the edges from ``base`` on.  A column is two integers of bits, the block's edges
    in their order and edges below it in the order in which they came; kept ones hold no
    pivot of those kept before them, so that a column of three edges is reduced in a few steps."""

    def __init__(self, base: int):
        self.base, self.kept, self.pivots, self.passed = base, {}, 0, {}
        self.place: dict[int, int] = {}
        self.below: list[int] = []

    def reduced(self, col: list[int], own: int = 0) -> tuple[int, int]:
        """``col`` less the kept columns of its edges other than ``own``."""
        high = low = 0
        for e in col:
            if e >= self.base:
                high |= 1 << (e - self.base)
                continue
            if (at := self.place.setdefault(e, len(self.below))) == len(self.below):
                self.below.append(e)
            low |= 1 << at
        while some := high & self.pivots & ~own:
            x, y = self.kept[some.bit_length()]
            high, low = high ^ x, low ^ y
        return high, low

    def keep(self, high: int, low: int) -> None:
        self.kept[high.bit_length()] = high, low
        self.pivots |= 1 << (high.bit_length() - 1)

    def add(self, col: list[int], settled: bool) -> list[int] | None:
        """What is left of ``col``: kept where it has edges of the block, else to be passed on; None if it
        depends on the columns before it."""
        if settled:
            self.keep(*self.reduced(col, 1 << (col[-1] - self.base)))
            return None
        high, low = self.reduced(col)
        if high:
            self.keep(high, low)
            if high.bit_length() - 1 == col[-1] - self.base:
                return col
        else:
            while low and (other := self.passed.get(low.bit_length())):
                low ^= other
            if not low:
                return None
            self.passed[low.bit_length()] = low
        return sorted(self.below[i] for i in _bits(low)) + [int(i) + self.base for i in _bits(high)]


def _reduce(block: int):
    """Arrow batches of columns, of each (grp, block) the settled ones first, by their pivots -> the others, reduced."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, None
        for batch in batches:
            rows: list[tuple[int, int, bool, list[int]]] = []
            for grp, at, settled, col in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if here != (grp, at):
                    here, held = (grp, at), _Block(at * block)
                if left := held.add(col, settled):
                    rows.append((grp, left[-1] // block, left[-1] // block == at, left))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                                                 names=["grp", "block", "settled", "col"])
    return run


def spanning_columns(edges: DataFrame, cells: int = CELLS, work: int = WORK) -> DataFrame:
    """(grp, col): boundaries of triangles of the numbered edges (grp, u, v, e) that span all of them.

    Of the triangles with one longest edge and a third corner in one block, the first (by its second
    longest edge) is taken.  Where another's third corner and the first's are joined by an edge that is shorter
    too, both differ by the other two sides of their tetrahedron, whose longest edges are shorter, so it
    is left out; of the others again the first is taken, until none is left.  Numbers are above 0; edges
    numbered 0 are null, shorter than all others and left out of the columns.
    """
    rows = placed(edges)[0].withColumns({"held": F.lit(True), "top": F.col("e") > 0})
    return dealt(rows, cells, work).mapInArrow(_in_tasks(_columns), "grp bigint, col array<bigint>")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b: numbers of vertices), the first of them first, are in the spanning forest."""
    n, m = max(a.max(), b.max()) + 1, len(a)
    every = np.arange(n)
    comp, keep, left = every, np.zeros(m, bool), np.arange(m)
    while len(left):
        ca, cb = comp[a[left]], comp[b[left]]
        cross = ca != cb
        left, ca, cb = left[cross], ca[cross], cb[cross]
        best, other = np.full(n, m), np.full(n, m)
        best[ca[::-1]], other[cb[::-1]] = left[::-1], left[::-1]  # the first edge is written last
        best = np.minimum(best, other)
        roots = np.flatnonzero(best < m)
        keep[best[roots]] = True
        parent = every.copy()
        ends = comp[a[best[roots]]], comp[b[best[roots]]]
        parent[roots] = np.where(ends[0] == roots, ends[1], ends[0])
        parent = np.where((parent[parent] == every) & (every < parent), every, parent)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]
    return keep


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (grp, u, v) -> those in the forest of a task's edges, the smallest (u, v) first."""
    kept, more = [np.zeros(0, np.int64)] * 3, []

    def thinner() -> list[np.ndarray]:
        grp, u, v = (np.concatenate(c) for c in zip(kept, *more))
        more.clear()
        order = np.lexsort((v, u))
        grp, u, v = grp[order], u[order], v[order]
        ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        _, ends = np.unique(np.tile(np.unique(grp, return_inverse=True)[1], 2) * len(ids) + ends, return_inverse=True)
        on = _forest(ends[:len(u)], ends[len(u):])
        return [grp[on], u[on], v[on]]

    for batch in batches:
        if batch.num_rows:
            more.append([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("grp", "u", "v")])
        if sum(len(m[0]) for m in more) >= max(1 << 20, len(kept[0])):
            kept = thinner()
    if more:
        kept = thinner()
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["grp", "u", "v"])


def forest(edges: DataFrame) -> DataFrame:
    """(grp, u, v): a spanning forest of each group's edges, small u and then small v first.  Tasks thin out what they
    read (no edge of the forest is lost: it closes no circle of edges before it) before a group's rests meet."""
    schema = "grp bigint, u bigint, v bigint"
    thin = edges.select(*[F.col(c).cast("bigint").alias(c) for c in ("grp", "u", "v")]).filter("u != v").mapInArrow(_forests, schema)
    return thin.repartition("grp").mapInArrow(_forests, schema)


def open_edges(at: DataFrame, cells: int = BITS, work: int = BIT_WORK) -> DataFrame:
    """(grp, x, y) of the ``placed`` edges that are not null for a function on edges whose values add up to
    null around every triangle and that is null on the group's ``forest``, by triangles with two null edges."""
    grown = forest(at.select("grp", F.col("x").alias("u"), F.col("y").alias("v")))
    null = cut_lineage(grown.select("grp", F.col("u").cast("int").alias("x"), F.col("v").cast("int").alias("y")))
    sizes = checked_broadcast(cut_lineage(at.groupBy("grp").agg(F.max("n").alias("n"))))
    rows = at.select("grp", "x", "y")
    left = rows.join(checked_broadcast(null, PLACES), ["grp", "x", "y"], "left_anti")
    done = None
    while True:
        both = null.withColumns({"held": F.lit(True), "top": F.lit(False)}).unionByName(left.withColumns({"held": F.lit(False), "top": F.lit(True)}))
        tasks = dealt(both.join(sizes, "grp"), cells, work)
        now = cut_lineage(tasks.mapInArrow(_in_tasks(_open), "grp bigint, x bigint, y bigint, blocks bigint, several bigint")
                          .groupBy("grp", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
                          .agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"), F.max("several").alias("several")).filter("n = blocks"))
        found = now.select("grp", "x", "y")
        # what several tasks have found meets in the next round; groups of one task, or without news, are done
        before = left.groupBy("grp").agg(F.count("*").alias("before"))
        again = now.groupBy("grp").agg(F.count("*").alias("n"), F.max("several").alias("several")).filter("several = 1").join(before, "grp").filter("n < before").select("grp")
        again = checked_broadcast(cut_lineage(again))
        closed = found.join(again, "grp", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        if again.isEmpty():
            return done
        left = cut_lineage(found.join(again, "grp", "left_semi"))
        null = rows.join(again, "grp", "left_semi").join(checked_broadcast(left, PLACES), ["grp", "x", "y"], "left_anti")


def boundary_rank(columns: DataFrame, most: DataFrame, block: int = BLOCK) -> DataFrame:
    """(grp, rank): rank over Z2 of the columns (grp, col: edge numbers in ascending order) of
    each group, which is no more than its ``most`` (grp, most)."""
    open_ = columns.select("grp", F.floor(F.element_at("col", -1) / block).cast("bigint").alias("block"), F.lit(False).alias("settled"), "col")
    settled = open_.limit(0)
    while True:
        kept = settled.join(open_.select("grp", "block").distinct(), ["grp", "block"], "left_semi")
        dealt = kept.unionByName(open_).repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("settled"), F.element_at("col", -1), F.size("col"))
        now = cut_lineage(dealt.mapInArrow(_reduce(block), COLUMN_SCHEMA))
        settled = settled.unionByName(now.filter("settled"))
        rank = settled.groupBy("grp").agg(F.count("*").alias("rank"))
        complete = rank.join(most, "grp").filter("rank >= most").select("grp")
        open_ = cut_lineage(now.filter("not settled").join(complete, "grp", "left_anti"))
        if open_.isEmpty():
            return rank


def betti1(edges: DataFrame, block: int = BLOCK, worth: float = WORTH) -> DataFrame:
    """(grp, beta1 long > 0) of the flag complexes of the graphs ``edges`` (grp, u < v, w); groups
    without a hole have no row.  Rows of null groups or ends are left out, repeated edges count
    once; an empty table gives an empty result."""
    simple = edges.filter("grp is not null and u < v").groupBy("grp", "u", "v").agg(F.min("w").alias("w"))
    at, _ = placed(collapsed(simple, worth))
    left = cut_lineage(open_edges(at))
    some = checked_broadcast(left, PLACES)
    ordered = numbered(at.join(some, ["grp", "x", "y"], "left_semi"), ["grp"], [F.col("w"), F.col("x"), F.col("y")], "e")
    null = at.join(checked_broadcast(left.select("grp").distinct()), "grp", "left_semi").join(some, ["grp", "x", "y"], "left_anti")
    most = left.groupBy("grp").agg(F.count("*").alias("most"))
    columns = spanning_columns(cut_lineage(ordered.select("grp", "u", "v", F.col("e").cast("bigint")).unionByName(null.select("grp", "u", "v", F.lit(0).cast("bigint").alias("e")))))
    rest = most.join(boundary_rank(columns, most, block), "grp", "left").select("grp", (F.col("most") - F.coalesce("rank", F.lit(0))).alias("beta1"))
    return rest.filter("beta1 > 0")
