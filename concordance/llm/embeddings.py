"""Embedding near-duplicates: cover trees and a dual traversal.

A cover tree of unit vectors has nested levels: each level's centres are at least its
radius apart, every vector lies within the radius of its centre, and the radius is
halved from level to level.  Two trees are walked together: a pair of nodes is dropped
when the distance of the centres minus both covering radii exceeds the threshold, taken
as a whole when distance plus radii stays below it, and opened otherwise.  So all
pairs over the threshold are found and none below it, without listing pairs of groups
that are close as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, prepare, staged
from .components import components

#: Vectors of a block, about: one task holds two blocks.
BLOCK = 2048
#: Cells with a centre of their own, about, of all labels together.
MOST_CELLS = 512
#: Rows of a matrix of distances that is computed at once.
ROWS = 512
#: Slack for rounding in bounds; what lies nearer to a bound is opened or computed exactly.
SLACK = 1e-7


@dataclass
class Node:
    """A ball: ``centre`` is a row index, ``radius`` covers all ``members``."""

    centre: int
    radius: float
    members: np.ndarray
    children: list[Node]


def cover_tree(x: np.ndarray, least_radius: float) -> Node:
    """The tree of the rows of x (unit vectors); below ``least_radius`` a node's children are single rows."""

    def grown(members: np.ndarray, centre: int, level: float) -> Node:
        d = _distance(x[members], x[centre])
        node = Node(centre, float(d.max()), members, [])
        if len(members) == 1 or node.radius == 0:
            return node
        while level >= node.radius:
            level /= 2
        if node.radius <= least_radius:
            node.children = [Node(int(m), 0.0, np.array([m]), []) for m in members]
            return node
        left, at = members, centre
        while True:
            near = _distance(x[left], x[at]) <= level
            node.children.append(grown(left[near], int(at), level))
            left = left[~near]
            if not len(left):
                return node
            at = left[0]

    return grown(np.arange(len(x)), 0, 2.0)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors ``a`` to one; by their products, so right to about 1e-8, within SLACK."""
    return np.sqrt(np.maximum(2 - 2 * a @ b, 0))


def at_scale(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to 0.5 to 1: no square is lost or too large."""
    return np.ldexp(vectors, -np.frexp(abs(vectors).max(1))[1][:, None])


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    vectors = at_scale(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


class Linked:
    """What a traversal gathers: links by row and a union of rows."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.root = np.arange(n)
        self.joined: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, rows: np.ndarray, to: int) -> None:
        for i in rows.tolist():
            a, b = self.top(i), self.top(to)
            if a != b:
                self.root[a] = b
                self.joined.append((i, to))


def traverse(x: np.ndarray, weight: np.ndarray, a: Node, b: Node, least_cosine: float, linked: Linked, exact) -> None:
    """Add to ``linked`` the links between the members of a and b (those within a if b is a).

    ``weight``: vectors that a row stands for.  ``exact(i, rows)``: which rows have a
    cosine of at least ``least_cosine`` with row i.  A pair of nodes is opened on both sides
    at once: all distances between their children come from one product of matrices.
    """
    most = np.sqrt(2 - 2 * least_cosine)
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if p is q and 2 * p.radius < most - SLACK:
            linked.count[p.members] += weight[p.members].sum() - weight[p.members]
            linked.join(p.members, p.centre)
            continue
        if p is q:
            stack += [(c, c) for c in p.children]
        left, right = p.children or [p], q.children or [q]
        own, other = _balls(x, left), _balls(x, right)
        for begin in range(0, len(left), ROWS):
            at = slice(begin, begin + ROWS)
            d = np.sqrt(np.maximum(2 - 2 * own[0][at] @ other[0].T, 0))
            r = own[1][at, None] + other[1]
            near = d - r <= most + SLACK
            if p is q:  # each pair of children once
                near &= np.arange(begin, begin + len(near))[:, None] < np.arange(len(right))
            i, j = np.nonzero(near)
            inside = (d + r)[i, j] < most - SLACK
            singles = own[2][i + begin] & other[2][j]
            for k, m in zip((i[inside] + begin).tolist(), j[inside].tolist(), strict=True):
                _link(linked, weight, left[k].members, right[m].members)
            for k, m in zip((i[~inside & ~singles] + begin).tolist(), j[~inside & ~singles].tolist(), strict=True):
                stack.append((left[k], right[m]))
            i, j = i[~inside & singles] + begin, j[~inside & singles]
            for k in np.unique(i).tolist():
                rows = other[3][j[i == k]]
                found = rows[exact(left[k].centre, rows)]
                if len(found):
                    _link(linked, weight, left[k].members, found)


def _balls(x: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centres, radii, whether a node is a single row, and the centres' rows."""
    rows = np.array([n.centre for n in nodes])
    return x[rows], np.array([n.radius for n in nodes]), np.array([len(n.members) == 1 for n in nodes]), rows


def _link(linked: Linked, weight: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    linked.count[a] += weight[b].sum()
    linked.count[b] += weight[a].sum()
    linked.join(b, int(a[0]))
    linked.join(a, int(b[0]))


def block_links(ids: np.ndarray, vectors: np.ndarray, weight: np.ndarray, side: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one task: within the rows of side 0 if there is no side 1, else between the sides.

    Gives the number of linked vectors by row, and links (ids) that connect them.
    """
    vectors = at_scale(vectors)
    norm = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / norm[:, None]
    linked = Linked(len(ids))

    def exact(i: int, rows: np.ndarray) -> np.ndarray:
        return vectors[rows] @ vectors[i] / (norm[rows] * norm[i]) >= least_cosine

    trees, begin = [], np.sqrt(2 - 2 * least_cosine) / 4
    for s in np.unique(side):
        rows = np.flatnonzero(side == s)
        trees.append(_moved(cover_tree(unit[rows], begin), rows))
    traverse(unit, weight, trees[0], trees[-1], least_cosine, linked, exact)
    pairs = np.array(linked.joined, np.int64).reshape(-1, 2)
    return linked.count, ids[pairs[:, 0]], ids[pairs[:, 1]]


def _moved(node: Node, rows: np.ndarray) -> Node:
    return Node(int(rows[node.centre]), node.radius, rows[node.members], [_moved(c, rows) for c in node.children])


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1)


def _tasks(least_cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (task, side, id, vector, copies) sorted by task; a task waits for all its rows."""
        held: list[pa.RecordBatch] = []

        def links():
            rows = pa.Table.from_batches(held)
            ids = rows["id"].to_numpy()
            vectors = matrix(rows["vector"].combine_chunks())
            count, a, b = block_links(ids, vectors, rows["copies"].to_numpy().astype(np.int64), rows["side"].to_numpy(), least_cosine)
            some = np.flatnonzero(count)
            zero = lambda n: np.zeros(n, np.int64)
            yield pa.RecordBatch.from_pydict({"a": np.concatenate([ids[some], a]), "b": np.concatenate([zero(len(some)), b]), "n": np.concatenate([count[some], zero(len(a))])})

        for batch in batches:
            task = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if held and held[0].column("task")[0].as_py() != task[begin]:
                    yield from links()
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from links()

    return run


def _cells(groups: DataFrame, least_cosine: float) -> DataFrame:
    """``groups`` dealt to pairs of blocks: (task, side, id, vector, copies).

    Labels of over BLOCK vectors get centres, about one a block and MOST_CELLS together,
    drawn by a hash; a vector belongs to the cell of the nearest centre, a cell is dealt
    into blocks of about BLOCK by a hash.  Cells are the trees' top nodes: two of them are
    compared only if the centres' distance minus both covering radii reaches the threshold.
    The driver has the centres and the cells' radii, and nothing of single vectors.
    """
    spark = groups.sparkSession
    sizes = groups.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > BLOCK).orderBy(F.desc("n"), "part").limit(MOST_CELLS // 2).collect()
    wanted = {r.part: max(2, round(r.n / BLOCK)) for r in large}
    scale = min(1.0, MOST_CELLS / max(1, sum(wanted.values())))
    steps = [(r.part, -(-r.n // max(2, int(wanted[r.part] * scale)))) for r in large]
    drawn = groups.join(F.broadcast(spark.createDataFrame(steps, "part string, step long")), "part").filter(F.pmod(F.xxhash64("id", F.lit("centre")), F.col("step")) == 0)
    centres: dict[str, list] = {}
    for r in drawn.select("part", "id", "vector").orderBy("part", "id").limit(2 * MOST_CELLS).collect():
        centres.setdefault(r.part, []).append(r.vector)
    unit = {k: unit_vectors(np.array(v, float)) for k, v in centres.items()}
    sent = spark.sparkContext.broadcast(unit)
    prepare(spark)

    @F.arrow_udf("cell int, far double")
    def nearest(parts: pa.Array, vectors: pa.Array) -> pa.Array:
        cell, far = np.zeros(len(parts), np.int32), np.zeros(len(parts))
        names = np.array(parts.to_pylist(), object)
        for name in set(names) & sent.value.keys():
            rows = np.flatnonzero(names == name)
            x = unit_vectors(matrix(vectors.take(pa.array(rows))))
            cell[rows] = (x @ sent.value[name].T).argmax(1)
            far[rows] = np.sqrt(((x - sent.value[name][cell[rows]]) ** 2).sum(1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(far)], names=["cell", "far"])

    rows = groups.select("part", "id", "vector", "copies", nearest("part", "vector").alias("at")).select("part", "id", "vector", "copies", "at.cell", "at.far")
    rows = staged(rows, "cells")
    cells = rows.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    cells = staged(cells.select("part", "cell", F.greatest(F.lit(1), F.round(F.col("n") / BLOCK)).cast("int").alias("blocks"), "radius"), "radii")
    most, pairs = np.sqrt(2 - 2 * least_cosine), []
    radii: dict[str, dict[int, float]] = {}
    if unit:
        for r in cells.join(F.broadcast(spark.createDataFrame([(k,) for k in unit], "part string")), "part").collect():
            radii.setdefault(r.part, {})[r.cell] = r.radius
    for name, found in radii.items():
        ids = np.array(sorted(found))
        radius = np.array([found[i] for i in ids])
        for i, k in enumerate(ids):
            near = _distance(unit[name][ids], unit[name][k]) - radius - radius[i] <= most + SLACK
            pairs += [(name, int(k), int(o)) for o in ids[near | (ids == k)]]
    listed = spark.createDataFrame(pairs, "part string, cell int, other int")
    others = cells.select("part", F.col("cell").alias("other"), F.col("blocks").alias("other_blocks"))
    plain = cells.filter(~F.col("part").isin(list(radii))) if radii else cells
    partners = listed.unionByName(plain.select("part", "cell", F.col("cell").alias("other"))).join(others, ["part", "other"]).join(cells.select("part", "cell", "blocks"), ["part", "cell"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.select("part", "cell", "id", "vector", "copies").join(partners, ["part", "cell"]).withColumn("own", own)
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("block"))
    here, there = F.struct(F.col("cell").alias("c"), F.col("own").alias("b")), F.struct(F.col("other").alias("c"), F.col("block").alias("b"))
    return dealt.select(F.xxhash64("part", F.least(here, there), F.greatest(here, there)).alias("task"), F.when(here > there, 1).otherwise(0).cast("long").alias("side"), "id", "vector", "copies")


def near_duplicates(vectors: DataFrame, least_cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared if their labels are equal and not null; they are linked if their
    cosine in double precision is at least ``least_cosine``.  ``n_links`` counts other
    vectors linked directly, ``component_id`` is the least id reachable by links (its own
    included) and ``kept`` says whether it is the vector's own.

    Equal vectors of a label are first made one row with its number of copies (partial
    aggregation).  The rows of a label are dealt into cells around centres and cells into
    blocks of about BLOCK; each pair of blocks whose cells may hold a link is a task with a
    cover tree for each block (``_cells``).  A task hands on a count per row and links that
    connect its rows, fewer than rows, never pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; so do vectors of different lengths.  Rows with a null id count as copies but
    have component_id null where no id is known.  Repeated rows count as vectors of their
    own.  An empty table gives an empty result.
    """
    doubles = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), doubles.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    clean = F.transform("vector", lambda v: v + F.lit(0.0))
    rows = staged(rows.select("id", "label", F.when(whole, clean).alias("vector")), "vectors")
    valid = rows.filter("vector IS NOT NULL")
    part = F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string"))
    groups = valid.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = staged(groups.withColumn("part", part).withColumn("id", F.monotonically_increasing_id()), "groups")
    tasks = _cells(groups, least_cosine)
    found = in_arrow(tasks.repartition("task").sortWithinPartitions("task"), _tasks(least_cosine), "a long, b long, n long")
    found = staged(found, "links")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("n = 0").select("a", "b"))
    named = groups.select("id", "label", "vector", "least", "copies").join(counts, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = staged(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    on = rows.join(named, ["label", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return on.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
