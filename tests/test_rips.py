import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import rips, topology
from tessera.operators.rips import betti1


def z2_rank(rows):
    """Rank of a 0/1 matrix given as integers of bits."""
    basis = {}
    for r in rows:
        while r and r.bit_length() in basis:
            r ^= basis[r.bit_length()]
        if r:
            basis[r.bit_length()] = r
    return len(basis)


def brute(edges):
    """beta1 of the flag complex from the ranks of both boundary matrices."""
    edges = sorted(edges)
    at = {e: i for i, e in enumerate(edges)}
    points = sorted({p for e in edges for p in e})
    place = {p: i for i, p in enumerate(points)}
    one = z2_rank([1 << place[u] | 1 << place[v] for u, v in edges])
    near = {p: set() for p in points}
    for u, v in edges:
        near[u].add(v)
    two = z2_rank([1 << at[u, v] | 1 << at[u, w] | 1 << at[v, w] for u, v in edges for w in near[u] & near[v]])
    return len(edges) - one - two


def cycle(ids):
    return [tuple(sorted((ids[i], ids[(i + 1) % len(ids)]))) for i in range(len(ids))]


SHAPES = {
    0: [(0, 1), (0, 2), (1, 2)],                                                     # full triangle: no hole
    1: cycle([0, 1, 2, 3]),                                                          # square
    2: cycle([0, 1, 2, 3]) + cycle([2, 7, 8, 9]),                                    # two squares with a common corner
    3: [e for e in itertools.combinations(range(6), 2) if e not in ((0, 1), (2, 3), (4, 5))],  # octahedron: a sphere
    4: [(i, i + 1) for i in range(12)],                                              # a path
    5: cycle(list(range(12))),
    6: cycle([0, 1, 2, 3]) + [(i, 10) for i in range(4)],                            # a cone over the square
    7: cycle([0, 1, 2, 3]) + cycle([20, 21, 22, 23, 24]) + [(40, 41)],               # three components
}


def frame(spark, shapes, weight=lambda g, u, v: 1.0):
    return spark.createDataFrame([(g, u, v, float(weight(g, u, v))) for g, edges in shapes.items() for u, v in set(edges)], "grp long, u long, v long, w double")


def found(df):
    return {x.grp: x.beta1 for x in df.collect()}


def test_known_shapes(spark):
    want = {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 1, 6: 0, 7: 2}
    assert {g: brute(set(e)) for g, e in SHAPES.items()} == want
    edges = frame(spark, SHAPES)
    assert found(betti1(edges)) == {g: n for g, n in want.items() if n}
    extra = spark.createDataFrame([(None, 1, 2, 1.0), (1, None, 2, 1.0), (1, 0, 1, 5.0)], edges.schema)  # nulls, a repeated edge
    assert found(betti1(edges.unionByName(extra))) == {g: n for g, n in want.items() if n}
    assert betti1(edges.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "worth"), [(3, 2.0), (20_000, 0.05)])
def test_random_graphs_against_brute_force(spark, block, worth):
    """Many small blocks and a single round of collapses; then as by default."""
    r = random.Random(8)
    shapes = {}
    for g in range(8):
        n, p = r.choice([(9, .4), (12, .3), (14, .5), (25, .25), (25, .12)])
        shapes[g] = [e for e in itertools.combinations(range(n), 2) if r.random() < p]
    # a projective plane holds a class of order two, which counts over Z2
    faces = [(0, 1, 4), (0, 1, 5), (0, 2, 3), (0, 2, 5), (0, 3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 5), (2, 4, 5), (3, 4, 5)]
    cells = [frozenset(c) for f in faces for k in (1, 2, 3) for c in itertools.combinations(f, k)]
    cells = sorted(set(cells), key=lambda c: (len(c), sorted(c)))
    shapes[8] = [(i, j) for i, j in itertools.combinations(range(len(cells)), 2) if cells[i] < cells[j] or cells[j] < cells[i]]
    want = {g: brute(set(e)) for g, e in shapes.items()}
    assert want[8] == 1 and max(want.values()) > 3
    got = found(betti1(frame(spark, shapes, lambda g, u, v: (u * 7 + v * 3 + g) % 5), block, worth))
    assert got == {g: n for g, n in want.items() if n}


def test_points_on_circles(spark):
    """Noisy circles of points, one point repeated; holes at a scale between spacing and diameter."""
    rng = np.random.default_rng(4)
    rows = []
    for grp, circles in ((0, 1), (1, 3)):
        for c in range(circles):
            angle = np.linspace(0, 2 * np.pi, 24, endpoint=False)
            ring = np.column_stack([np.cos(angle), np.sin(angle)]) + rng.normal(0, .02, (24, 2)) + [5 * c, 0]
            rows += [(grp, len(rows) + i, [float(x) for x in p]) for i, p in enumerate(ring)]
        rows += [(grp, len(rows) + i, rows[-1][2]) for i in range(30)]
    rows.append((0, 10_000, None))
    points = spark.createDataFrame(rows, "grp long, id long, vec array<double>")
    single = rips.distinct_points(points)
    assert {x.grp: x["count"] for x in single.groupBy("grp").count().collect()} == {0: 24, 1: 72}
    assert found(betti1(topology.eps_edges(single, 0.4))) == {0: 1, 1: 3}
    assert betti1(topology.eps_edges(single, 0.1)).count() == 0
    got = {x.grp: x for x in topology.rips_signature(points, 0.4).collect()}
    assert {g: (x.n_points, x.beta0, x.beta1) for g, x in got.items()} == {0: (54, 1, 1), 1: (102, 3, 3)}


def test_dominated_vertices(spark):
    """A removed vertex always has a dominator that stays."""
    edges = frame(spark, {1: list(itertools.combinations(range(5), 2)), 2: [(0, 1)]})
    gone = {(x.grp, x.id) for x in rips.dominated(edges.select("grp", "u", "v")).collect()}
    assert gone == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    assert rips.collapsed(edges).filter(F.col("grp") < 3).count() == 0


def test_whole_table_against_brute_force(spark):
    """Every group of the embeddings table against the ranks of its whole boundary matrices."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    points = table.select(F.col("label").cast("bigint").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    groups = {}
    for x in points.collect():
        groups.setdefault(x.grp, []).append((x.id, np.asarray(x.vec, np.float64)))
    want = {}
    for g, members in groups.items():
        members.sort(key=lambda m: m[0])
        want[g] = brute({(a, b) for i, (a, x) in enumerate(members) for b, y in members[i + 1:] if np.linalg.norm(x - y) <= 1.25})
    assert max(want.values()) > 10
    assert {x.grp: x.beta1 for x in topology.rips_signature(points, 1.25).collect()} == want


def test_triangles_are_not_listed(spark, monkeypatch):
    """No table written on the way has many more rows than there are edges: 766 of them, 9,120 triangles, no dominated vertex."""
    rows, real = [], rips.cut_lineage

    def counting(df):
        out = real(df)
        rows.append(out.count())
        return out
    monkeypatch.setattr(rips, "cut_lineage", counting)
    sphere = [(u, v) for u, v in itertools.combinations(range(40), 2) if u % 2 or v != u + 1]
    edges = frame(spark, {1: sphere + cycle(list(range(100, 106)))}, lambda g, u, v: (u * 31 + v * 17) % 101)
    assert found(betti1(edges, worth=2.0)) == {1: 1}
    assert max(rows) <= 2 * 766


@pytest.mark.parametrize(("cells", "work"), [(1 << 25, 1 << 33), (60, 50), (1, 7)])
def test_spanning_columns_in_blocks(spark, cells, work):
    """However the corners are dealt, the columns have the rank of all triangles."""
    r = random.Random(5)
    shapes = {g: [e for e in itertools.combinations(range(n), 2) if r.random() < p] for g, (n, p) in enumerate([(9, .5), (20, .4), (14, .9)])}
    numbers = {g: r.sample(range(100, 100 + len(edges)), len(edges)) for g, edges in shapes.items()}
    numbered = [(g, u, v, e) for g, edges in shapes.items() for (u, v), e in zip(edges, numbers[g])]
    got = {g: [] for g in shapes}
    for x in rips.spanning_columns(spark.createDataFrame(numbered, "grp long, u long, v long, e long"), cells, work).collect():
        got[x.grp].append(x.col)
    for g, edges in shapes.items():
        at = dict(zip(edges, numbers[g]))
        every = {tuple(sorted((at[a, b], at[a, c], at[b, c]))) for a, b, c in itertools.combinations(range(20), 3) if {(a, b), (a, c), (b, c)} <= at.keys()}
        assert {tuple(c) for c in got[g]} <= every
        rank = lambda cols: z2_rank([sum(1 << e for e in c) for c in cols])
        assert rank(got[g]) == rank(every)


def closure(edges, null):
    """The edges left when an edge of a triangle with two null edges is null too."""
    near, edges = {}, set(edges)
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    null, is_null = set(null), lambda a, b: (min(a, b), max(a, b)) in null
    while more := {(u, v) for u, v in edges - null if any(is_null(u, w) and is_null(v, w) for w in near[u] & near[v])}:
        null |= more
    return edges - null


@pytest.mark.parametrize(("cells", "work"), [(1 << 29, 1 << 36), (300, 900)])
def test_null_edges_in_blocks(spark, cells, work):
    """Forests span and open edges are those of the whole group, whatever the tasks hold; so are dominated vertices."""
    r = random.Random(11)
    shapes = {g: [e for e in itertools.combinations(range(n), 2) if r.random() < p] for g, (n, p) in enumerate([(30, .15), (40, .2), (25, .5)])}
    at, vertices = rips.placed(frame(spark, shapes))
    grown = {(x.grp, x.u, x.v) for x in rips.forest(at.select("grp", F.col("x").alias("u"), F.col("y").alias("v"))).collect()}
    left = {(x.grp, x.x, x.y) for x in rips.open_edges(at, cells, work).collect()}
    gone = {(x.grp, x.id) for x in rips.dominated(frame(spark, shapes).select("grp", "u", "v"), cells, work).collect()}
    rows = at.collect()
    for g, edges in shapes.items():
        own = [(x.x, x.y) for x in rows if x.grp == g]
        tree = [(u, v) for h, u, v in grown if h == g]
        assert len(tree) == len(edges) - brute_circles(edges) and set(tree) <= set(own)
        assert {(x, y) for h, x, y in left if h == g} == closure(own, tree)
        near = {p: {q for e in edges if p in e for q in e} for e in edges for p in e}
        assert {i for h, i in gone if h == g} == {p for p in near if any(near[p] <= near[q] and (len(near[q]), q) > (len(near[p]), p) for q in near[p] - {p})}
    assert any(h == 0 for h, _, _ in left) and not any(h == 2 for h, _, _ in left)


def brute_circles(edges):
    """Edges less a spanning forest."""
    place = {p: i for i, p in enumerate(sorted({p for e in edges for p in e}))}
    return len(edges) - z2_rank([1 << place[u] | 1 << place[v] for u, v in edges])


def test_columns_of_open_edges_only(spark, monkeypatch):
    """Edges that triangles join to the forest one by one give no columns: here all but those of a square that hangs on."""
    seen, real = [], rips.boundary_rank

    def counting(columns, most, block):
        seen.append(columns.count())
        return real(columns, most, block)
    monkeypatch.setattr(rips, "boundary_rank", counting)
    r = random.Random(3)
    dense = [e for e in itertools.combinations(range(40), 2) if r.random() < .6] + cycle([0, 100, 101, 102])
    assert found(betti1(frame(spark, {1: dense, 2: cycle(list(range(9)))}, lambda g, u, v: (u * 31 + v * 17) % 101), worth=2.0)) == {1: 1, 2: 1} and brute(set(dense)) == 1
    assert seen == [0]
