"""Hard negatives by inner product, from cover trees over the candidates.

Vectors become exact integers floor(scale * x).  For a bound on inner products
each candidate x of norm at most M is lifted to (x, sqrt(M^2 - |x|^2)): all lie
on one sphere, and an anchor (q, 0) has with it the inner product of q and x.
Candidates are sorted by length, label and nearest pivot, cut into blocks of
equal size, and every block becomes a cover tree: each level halves the covering
radius, the centres of a level are further apart than it, and a node knows the
largest distance to anything below it, which bounds the angle to the anchor and
so the inner products below from both sides.

A search keeps the nodes in a heap, largest bound first.  A node is left out if
no window of wanted scores meets its bounds, if its bound is below the k-th
score found so far, or if its labels cannot match; what hangs below small nodes
that are not left out is verified by exact inner products.  The first search
finds each anchor's positives (same label, no window), the second the negatives
in the windows that the positives' scores set.

Anchors are the stated query set: blocks of ``UNIT`` anchors meet stretches of
``STRETCH`` tree blocks, so a task holds some thousand rows whatever the label;
each emits its best few per anchor and window, which a ranked window merges.
Every row is indexed; pivots only choose the order of rows (farthest points of
a sample of ``PIVOT_SAMPLE`` rows by hash), the result does not depend on them.

Defined edge results: rows without id or label, with a null or empty vector or
a component that is null or not finite (also after scaling) take no part; rows
equal in id, label and vector count once; a row with the anchor's id is not
another row; vectors of different length do not meet; equal scores are ordered
by id; scores beyond 64 bits are the largest or smallest long; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airwell.llm._common import _ship, global_position, map_arrow, materialize

BLOCK = 2048            # rows of a cover tree
STRETCH = 8             # trees searched together
UNIT = 512              # anchors searched together
LEAF = 256              # subtrees of at most this size are verified as a whole
PIVOT_SAMPLE = 2048
PIVOTS = 64
LONG = np.iinfo(np.int64)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column without nulls, and where each list starts and the last one stops."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])


def _usable(scale: float):
    """(id, label, dim, q, norm2) of the rows that take part."""
    def run(batches):
        for batch in batches:
            vector = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.fill_null(batch.column(2).flatten(), np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(scale * values)
            owner = np.repeat(np.arange(len(vector)), vector)
            bad = np.bincount(owner, ~np.isfinite(values), minlength=len(vector)) > 0
            known = pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()).to_numpy(zero_copy_only=False)
            keep = known & ~bad & (vector > 0)
            values, dims = values[keep[owner]], vector[keep]
            with np.errstate(over="ignore"):
                norm2 = np.bincount(owner[keep[owner]], values * values, minlength=len(vector))[keep]
            offsets = pa.array(np.concatenate([[0], np.cumsum(dims)]).astype(np.int32))
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(dims.astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(norm2)],
                names=["id", "label", "dim", "q", "norm2"])
    return run


def _lifted(x: np.ndarray, top2: float) -> np.ndarray:
    """Rows with the coordinate that puts them on the sphere."""
    return np.column_stack([x, np.sqrt(np.maximum(0, top2 - np.einsum("ij,ij->i", x, x)))])


def pivots_of(x: np.ndarray, top2: float, n: int = PIVOTS) -> np.ndarray:
    """Farthest points of a sample, one after the other."""
    x = _lifted(x, top2)
    chosen, far = [], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _cells(pivots: np.ndarray, top2: float):
    """The nearest pivot of every row (0 for vectors of another length)."""
    def run(batches):
        for batch in batches:
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            values, edge = _flat(batch.column("q"))
            dims = batch.column("dim").to_numpy()
            at = np.flatnonzero(dims == pivots.shape[1] - 1) if len(pivots) else []
            for low in range(0, len(at), 1024):
                rows = at[low:low + 1024]
                x = _lifted(np.stack([values[edge[i]:edge[i + 1]] for i in rows]), top2)
                cell[rows] = (x @ pivots.T).argmax(axis=1)      # on a sphere the largest product is the nearest
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])
    return run


# -- cover trees ---------------------------------------------------------------

def cover_tree(x: np.ndarray, top2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, stop, radius, parent) of a cover tree over the rows of ``x``: row order[i] is node i, the nodes
    below it are i + 1 ... stop[i] - 1, none farther from it than radius[i]; parents come before their children."""
    n = len(x)
    with np.errstate(over="ignore", invalid="ignore"):
        y = _lifted(x, top2)
        apart = 2 * top2 - 2 * (y @ y.T)
        apart[apart < 1e-9 * top2] = 0      # below the rounding of the products
        apart = np.sqrt(np.nan_to_num(apart, nan=np.inf))
    radius, children = np.zeros(n), [[] for _ in range(n)]
    todo = [(0, np.arange(1, n))]
    while todo:
        node, below = todo.pop()
        if not len(below):
            continue
        d = apart[node, below]
        widest = d.max()
        radius[node] = max(radius[node], np.sqrt(widest ** 2 + 2e-9 * top2))
        if widest == 0 or not np.isfinite(widest):
            children[node] += below.tolist()
            continue
        far = below[d > widest / 2]
        todo.append((node, below[d <= widest / 2]))     # the node's own next level
        while len(far):
            centre = far[0]
            near = apart[centre, far] <= widest / 2
            children[node].append(int(centre))
            todo.append((int(centre), far[near][1:]))
            far = far[~near]
    order, parent, todo = [], [], [(0, -1)]
    while todo:
        node, above = todo.pop()
        todo += [(c, len(order)) for c in reversed(children[node])]
        order.append(node)
        parent.append(above)
    stop = np.arange(1, n + 1)
    for i in range(n - 1, 0, -1):
        stop[parent[i]] = max(stop[parent[i]], stop[i])
    order = np.array(order)
    return order, stop, radius[order], np.array(parent)


def _build(top2: float):
    """The cover trees of one block, one per vector length: its rows with their place in the tree."""
    names = ["block", "tree", "slot", "stop", "radius", "low", "high", "id", "label", "q"]

    def run(key, table):
        parts = []
        values, edge = _flat(table.column("q"))
        dims = table.column("dim").to_numpy()
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            rows = rows[np.argsort(table.column("pos").to_numpy()[rows])]
            x = np.stack([values[edge[i]:edge[i + 1]] for i in rows])
            order, stop, radius, parent = cover_tree(x, top2)
            part = table.take(pa.array(rows[order]))
            low = part.column("label").to_numpy().copy()
            high = low.copy()
            for i in range(len(rows) - 1, 0, -1):
                low[parent[i]], high[parent[i]] = min(low[parent[i]], low[i]), max(high[parent[i]], high[i])
            n = len(rows)
            parts.append(pa.table([part.column("block"), pa.array(np.full(n, d, dtype=np.int32)), pa.array(np.arange(n)),
                                   pa.array(stop), pa.array(radius), pa.array(low), pa.array(high), part.column("id"),
                                   part.column("label"), part.column("q")], names=names))
        return pa.concat_tables(parts)
    return run


class _Forest:
    """The trees of a stretch of blocks for one vector length, as arrays in order."""

    def __init__(self, table: pa.Table, dim: int, top2: float):
        slot, stop = (table.column(c).to_numpy() for c in ("slot", "stop"))
        start = np.arange(len(slot)) - slot
        self.roots = np.flatnonzero(slot == 0)
        self.stop = start + stop
        self.low, self.high, self.id, self.label = (table.column(c).to_numpy() for c in ("low", "high", "id", "label"))
        self.x = _flat(table.column("q"))[0].reshape(-1, dim)
        self.top = np.sqrt(top2)
        with np.errstate(divide="ignore", invalid="ignore"):
            half = np.nan_to_num(table.column("radius").to_numpy() / (2 * self.top), nan=1.0)
        self.angle = 2 * np.arcsin(np.minimum(1, half))
        self.widest = np.abs(self.x).max(initial=0)
        self._kids: dict[int, np.ndarray] = {}

    def kids(self, node: int) -> np.ndarray:
        if node not in self._kids:
            found, at = [], node + 1
            while at < self.stop[node]:
                found.append(at)
                at = self.stop[at]
            self._kids[node] = np.array(found, dtype=np.int64)
        return self._kids[node]

    def scores(self, rows, q: np.ndarray) -> np.ndarray:
        """Exact inner products: doubles hold the sums below 2**53, whole numbers of any size the others."""
        if self.widest * np.abs(q).max() * len(q) < 1 << 53:
            return (self.x[rows] @ q).astype(np.int64)
        whole = [int(v) for v in q]
        return np.array([min(LONG.max, max(LONG.min, sum(int(a) * b for a, b in zip(row, whole)))) for row in self.x[rows]],
                        dtype=np.int64)


def descend(forest: _Forest, q, own: int, label: int, same: bool, low, high, k: int):
    """For each window low[w] ... high[w] of scores, the first ``k`` rows (score, id) of the same or of other
    labels, by descending score and ascending id."""
    need, high = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
    best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)) for _ in need]
    with np.errstate(over="ignore", invalid="ignore"):
        reach = float(np.sqrt(q @ q)) * forest.top
    slack = 1e-6 * reach + 1e-6

    def verify(rows, scores):
        fits = (forest.label[rows] == label) == same
        fits &= forest.id[rows] != own
        for w in range(len(need)):
            hit = fits & (scores >= need[w]) & (scores <= high[w])
            if hit.any():
                s, i = np.concatenate([best[w][0], scores[hit]]), np.concatenate([best[w][1], forest.id[rows[hit]]])
                first = np.lexsort((i, -s if s.min() > LONG.min else -s.astype(object)))[:k]
                best[w] = s[first], i[first]
                if len(first) == k:
                    need[w] = max(need[w], s[first[-1]])

    def bounds(nodes, scores):
        """The largest inner product below each node, and whether anything below it is wanted."""
        with np.errstate(invalid="ignore", divide="ignore"):
            at = np.arccos(np.clip(np.nan_to_num(scores / reach), -1, 1))
            up = reach * np.cos(np.maximum(0, at - forest.angle[nodes])) + slack
            down = reach * np.cos(np.minimum(np.pi, at + forest.angle[nodes])) - slack
        up, down = np.nan_to_num(up, nan=np.inf), np.nan_to_num(down, nan=-np.inf)
        wanted = ((up[:, None] >= need) & (down[:, None] <= high)).any(axis=1) & (forest.stop[nodes] > nodes + 1)
        one = (forest.low[nodes] == label) & (forest.high[nodes] == label)
        wanted &= (forest.low[nodes] <= label) & (forest.high[nodes] >= label) if same else ~one
        return up, down, wanted

    heap, number = [], 0
    nodes = forest.roots
    while True:
        scores = forest.scores(nodes, q)
        verify(nodes, scores)
        up, down, wanted = bounds(nodes, scores)
        size = forest.stop[nodes] - nodes - 1
        small = wanted & (size <= LEAF)
        if small.any():
            n = size[small]
            rows = np.repeat(nodes[small] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
            verify(rows, forest.scores(rows, q))
        for i in np.flatnonzero(wanted & ~small).tolist():
            heapq.heappush(heap, (-min(up[i], float(high.max())), number, up[i], down[i], int(nodes[i])))
            number += 1
        while heap:
            _, _, most, least, node = heapq.heappop(heap)
            if ((most >= need) & (least <= high)).any():
                nodes = forest.kids(node)
                break
        else:
            return best


def _windows(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _forests(table: pa.Table, top2: float) -> dict[int, _Forest]:
    table = table.sort_by([("block", "ascending"), ("tree", "ascending"), ("slot", "ascending")])
    trees = table.column("tree").to_numpy()
    return {int(d): _Forest(table.filter(pa.array(trees == d)), int(d), top2) for d in np.unique(trees)}


def _positives(top2: float, k: int):
    """The best rows of the anchor's label in one stretch."""
    def run(key, anchors, rows):
        out = [[], [], []]
        forests = _forests(rows, top2)
        values, edge = _flat(anchors.column("q"))
        for i, (own, label, dim) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("id", "label", "dim")))):
            if dim in forests:
                (s, found), = descend(forests[dim], values[edge[i]:edge[i + 1]], own, label, True, [LONG.min], [LONG.max], k)
                for column, part in zip(out, (np.full(len(s), own), found, s)):
                    column.append(part)
        flat = [pa.array(np.concatenate([np.empty(0, dtype=np.int64), *c])) for c in out]
        return pa.table(flat, names=["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(top2: float, k: int, low: int, high: int):
    """The best rows of other labels in one stretch, in the window of each positive of an anchor."""
    def run(key, anchors, rows):
        out = [[] for _ in range(5)]
        forests = _forests(rows, top2)
        values, edge = _flat(anchors.column("q"))
        columns = (anchors.column(c).to_pylist() for c in ("id", "label", "dim", "positives"))
        for i, (own, label, dim, positives) in enumerate(zip(*columns)):
            spans = [(p["positive_id"], p["positive_score"], *_windows(p["positive_score"], low, high)) for p in positives]
            spans = [s for s in spans if s[2] <= s[3]]
            if dim not in forests or not spans:
                continue
            best = descend(forests[dim], values[edge[i]:edge[i + 1]], own, label, False, [s[2] for s in spans], [s[3] for s in spans], k)
            for (name, score, *_), (s, found) in zip(spans, best):
                for column, part in zip(out, (np.full(len(s), own), np.full(len(s), name), found, np.full(len(s), score), s)):
                    column.append(part)
        flat = [pa.array(np.concatenate([np.empty(0, dtype=np.int64), *c])) for c in out]
        return pa.table(flat, names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])
    return run


def index(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: float) -> tuple[DataFrame, float]:
    """The cover trees over all rows that take part, as a written table of nodes, and the largest squared norm."""
    src = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                         F.col(embedding).cast("array<double>").alias("v"))
    rows = map_arrow(src, _usable(scale), "id long, label long, dim int, q array<double>, norm2 double")
    rows = materialize(rows.dropDuplicates(["id", "label", "q"]), "negatives-rows")
    top2 = rows.agg(F.max("norm2")).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("dim", "q").collect()
    dims = [r["dim"] for r in sample]
    common = max(set(dims), key=dims.count, default=0)
    pivots = pivots_of(np.array([r["q"] for r in sample if r["dim"] == common]), top2) if sample and np.isfinite(top2) else np.empty((0, 1))
    placed = global_position(map_arrow(rows, _cells(pivots, top2), "id long, label long, dim int, q array<double>, norm2 double, cell int"),
                             ["dim", "label", "cell", "id", "norm2"], "negatives-sorted", "pos")
    placed = placed.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    trees = placed.select("block", "pos", "dim", "id", "label", "q").groupBy("block").applyInArrow(
        _build(top2), "block long, tree int, slot long, stop long, radius double, low long, high long, id long, label long, q array<double>")
    trees = trees.withColumn("stretch", F.floor(F.col("block") / STRETCH).cast("long"))
    return materialize(trees, "negatives-trees"), top2


def mine(vectors: DataFrame, is_anchor, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
         scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id satisfies ``is_anchor`` (Column -> Column).  Labels are whole numbers.  A negative's score lies
    between ``low`` and ``high`` hundredths of the positive's."""
    _ship(vectors.sparkSession)
    trees, top2 = index(vectors, vec_id, embedding, label, scale)
    anchors = trees.filter(is_anchor(F.col("id"))).select("id", "label", F.col("tree").alias("dim"), "q")
    anchors = global_position(anchors, ["dim", "label", "id", F.xxhash64("q")], "negatives-anchors", "pos")
    anchors = anchors.withColumn("unit", F.floor(F.col("pos") / UNIT).cast("long")).drop("pos")
    stretches = trees.select(F.col("stretch"), F.col("tree").alias("__dim"), F.col("label").alias("__label")).distinct()
    nodes = trees.toDF(*[f"n_{c}" if c == "stretch" else c for c in trees.columns])

    def meet(queries: DataFrame, pairs: DataFrame, fn, schema: str) -> DataFrame:
        """``queries`` (unit, stretch, ...) with the trees of their stretches; ``pairs`` are the distinct (unit, stretch)."""
        pairs = pairs.select(F.col("unit").alias("n_unit"), F.col("stretch").alias("__stretch"))
        rows = nodes.join(pairs, F.col("n_stretch") == F.col("__stretch")).drop("__stretch")
        return queries.groupBy("unit", "stretch").cogroup(rows.groupBy("n_unit", "n_stretch")).applyInArrow(fn, schema)

    to_label = anchors.join(stretches, (F.col("label") == F.col("__label")) & (F.col("dim") == F.col("__dim"))).drop("__label", "__dim")
    found = meet(to_label, to_label.select("unit", "stretch").distinct(), _positives(top2, positives),
                 "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = found.distinct().withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= positives)
    known = found.groupBy(F.col("anchor_id").alias("__anchor")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    ready = materialize(anchors.join(known, F.col("id") == F.col("__anchor")).drop("__anchor"), "negatives-ready")

    last = trees.agg(F.max("stretch")).first()[0]
    every = ready.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last if last is not None else 0).cast("long"))))
    units = every.select("unit", "stretch").distinct()
    bad = meet(every, units, _negatives(top2, negatives, low, high),
               "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    by_score = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return bad.distinct().withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
