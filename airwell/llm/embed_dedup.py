"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to the signs of random projections, concatenated to
one key, and orders the vectors of a label lexicographically by it.  Every
vector is compared with the next ``window`` ones in that order; pairs that the
cosine confirms are united across passes.  The order is cut into blocks of
equal size by position (with the first rows of the next block added), so a
label or a run of equal keys with very many rows is many blocks.

Vectors that are equal in every component form one class first and stand for
all their copies.  A pair counts as met in a pass if it agrees in the leading
bits of the key: vectors that do are a cell, and a cell with more than
``window`` vectors is compared whole, tile against tile.  The passes follow
from the leading bits, so that a pair at the threshold is missed with a
probability below ``miss`` however the vectors of a label lie.  How many bits
lead is chosen per label by the least work at the measured sizes of its cells;
where no number of bits splits a label well enough (a narrow cone), none do,
and the label is one cell.  Inside the components so found, links are counted
by comparing all members block against block; nothing is emitted per pair.

Defined edge results: null or zero vectors, vectors with a null or non-finite
component, and rows without label or id link with nothing, are their own
component and are kept; vectors of different length link with nothing; rows
that share an id are one vertex; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import _ship, global_position, map_arrow, materialize
from airwell.llm._graph import components

WINDOW = 32
MISS = 1e-6
BLOCK = 2048        # rows of a window block, and of a tile of a cell
TILE = 512          # rows of a counting tile
BITS = 62           # bits of a key
MEASURED = 2        # passes in which cells are measured
FURTHER = (4, 8, 12, 16, 24, 32, 40, 50)    # leading bits tried above those of evenly spread vectors


def passes_at(lead: int, threshold: float, miss: float = MISS) -> int:
    """A pair at the threshold agrees in one sign with probability 1 - angle / pi:
    the passes after which it has agreed in ``lead`` bits at least once."""
    agree = (1 - math.acos(threshold) / math.pi) ** lead
    return 1 if agree >= 1 else max(4, math.ceil(math.log(miss) / math.log1p(-agree)))


def passes_for(rows: int, threshold: float, window: int = WINDOW, miss: float = MISS) -> tuple[int, int]:
    """(passes, leading bits) that leave less than ``window`` of ``rows`` evenly spread vectors in a cell."""
    lead = min(BITS, max(1, math.ceil(math.log2(max(2, rows / window))) + 1))
    return passes_at(lead, threshold, miss), lead


def _flat(column):
    """(components of all rows in a row, their start per row and the end) of a list column; null components are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):     # no chunk at all
            column = pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False), starts


def _matrix(column) -> np.ndarray:
    """The vectors of a list column as rows, filled up with zeros to the longest one."""
    flat, starts = _flat(column)
    lengths = np.diff(starts)
    if not len(lengths):
        return np.zeros((0, 0))
    width = int(lengths.max())
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _classes(batches):
    """id, label, length, vector and a hash of (label, vector) of the usable rows; a vector keeps its type."""
    for batch in batches:
        flat, starts = _flat(batch.column(1))
        kind = batch.schema.field(1).type.value_type
        lengths = np.diff(starts)
        row_of = np.repeat(np.arange(len(lengths)), lengths)
        odd = np.bincount(row_of, ~np.isfinite(flat), minlength=len(lengths)) > 0
        some = np.bincount(row_of, flat != 0, minlength=len(lengths)) > 0
        good = ~odd & some & batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        at = pa.array(np.flatnonzero(good))
        labels = batch.column(2).take(at)
        keys = [hashlib.blake2b(label.encode() + b"\0" + flat[starts[i]:starts[i + 1]].tobytes(), digest_size=16).digest()
                for i, label in zip(np.flatnonzero(good).tolist(), labels.to_pylist())]
        kept = flat[good[row_of]]
        ends = np.concatenate([[0], np.cumsum(lengths[good])]).astype(np.int32)
        vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept).cast(kind, safe=False))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), labels, pa.array(lengths[good].astype(np.int32)), vectors, pa.array(keys, pa.binary())],
            names=["id", "label", "dim", "v", "fp"])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, against overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(batches):
    """One key per pass, for as many passes as the row asks for."""
    powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        dims, passes = (np.asarray(batch.column(i).to_pylist(), dtype=int) for i in (2, 5))
        for low in range(0, len(dims), 1024):
            part = slice(low, low + 1024)
            vectors = _matrix(batch.column(3).slice(low, 1024))
            out = np.zeros((len(vectors), passes[part].max()), dtype=np.int64)
            for d in np.unique(dims[part]):
                at = np.flatnonzero(dims[part] == d)
                x = _unit(vectors[at, :d])
                for k in range(passes[part][at].max()):
                    sign = x @ np.random.default_rng([977, d, k]).standard_normal((d, BITS)) > 0
                    out[at, k] = sign @ powers
            keys = [row[:n] for row, n in zip(out, passes[part])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(low, 1024) for i in (0, 1, 2, 4)), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "label", "dim", "lead", "keys"])


def _cell(key, lead):
    return F.shiftright(key, BITS - lead) if isinstance(lead, int) else F.expr(f"shiftright({key}, {BITS} - {lead})")


def _window_pairs(window: int, threshold: float):
    """Per block: confirmed neighbours, as a spanning forest (what the union needs)."""
    def run(key, table):
        order = np.argsort(table.column("pos").to_numpy())
        t = table.take(pa.array(order))
        ids = t.column("id").to_numpy()
        label = pc.dictionary_encode(t.column("label").combine_chunks()).indices.to_numpy(zero_copy_only=False)
        group = np.unique(np.stack([t.column("pass").to_numpy(), t.column("dim").to_numpy(), label], axis=1), axis=0, return_inverse=True)[1].ravel()
        inside = t.column("pos").to_numpy() // BLOCK == key[0].as_py()
        parent = {}

        def find(i):
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        a, b = [], []
        x = _matrix(t.column("v"))
        if len(x):
            x = _unit(x)
        for step in range(1, min(window, len(x) - 1) + 1):
            hit = inside[:-step] & (group[:-step] == group[step:]) \
                & (np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold)
            for i in np.flatnonzero(hit).tolist():
                p, q = find(int(ids[i])), find(int(ids[i + step]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(int(ids[i]))
                    b.append(int(ids[i + step]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _cell_pairs(threshold: float):
    """Per pair of tiles of a cell: a spanning forest of the confirmed pairs (what the union needs)."""
    def run(key, table):
        a, b = [], []
        cell, tile, names = (table.column(c).to_numpy() for c in ("low", "tile", "id"))
        vectors = _matrix(table.column("v"))
        for c in np.unique(cell):
            rows, cols = (np.flatnonzero((cell == c) & (tile == key[i].as_py())) for i in (1, 2))
            if not len(rows) or not len(cols):
                continue
            nodes = np.unique(np.concatenate([rows, cols]))
            x = _unit(vectors[nodes])
            own, met = np.searchsorted(nodes, rows), np.searchsorted(nodes, cols)
            y, tree = x[met].T, np.arange(len(nodes))
            for low in range(0, len(own), 256):
                hit = x[own[low:low + 256]] @ y >= threshold
                for i, line in zip(own[low:low + 256], hit):
                    found = met[line]
                    trees, at = np.unique(tree[found], return_index=True)
                    new = trees != tree[i]
                    if new.any():
                        a += [int(names[nodes[i]])] * int(new.sum())
                        b += names[nodes[found[at[new]]]].tolist()
                        tree[np.isin(tree, trees[new])] = tree[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _tile_counts(threshold: float):
    """Per pair of tiles of a component: links of each member of the one with members of the other."""
    def run(key, table):
        ids, total = [], []
        comp = table.column("component").to_numpy()
        tile = table.column("tile").to_numpy()
        one, two = key[1].as_py(), key[2].as_py()
        names = table.column("id").to_numpy()
        copies = table.column("copies").to_numpy()
        labels = np.array([f"{d}/{x}" for d, x in zip(table.column("dim").to_pylist(), table.column("label").to_pylist())])
        vectors = _matrix(table.column("v"))
        for c in np.unique(comp):
            for side, other in {(one, two), (two, one)}:
                rows, cols = (np.flatnonzero((comp == c) & (tile == s)) for s in (side, other))
                for kind in np.unique(labels[rows]):
                    r, k = rows[labels[rows] == kind], cols[labels[cols] == kind]
                    if len(k) == 0:
                        continue
                    x, y = (_unit(vectors[s]) for s in (r, k))
                    hit = (x @ y.T >= threshold) & (r[:, None] != k[None, :])
                    ids.append(names[r])
                    total.append(hit @ copies[k])
        flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        return pa.table({"id": pa.array(flat(ids), pa.int64()), "links": pa.array(flat(total).astype(np.int64))})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label", window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    _ship(spark)
    # float vectors are shuffled as floats (half the bytes); all arithmetic is in double precision
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    src = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v"),
                         F.col(label).cast("string").alias("label"))
    usable = materialize(map_arrow(src, _classes, f"id long, label string, dim int, v {kind}, fp binary"), "vec-usable")
    classes = usable.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "vec-classes")
    first = usable.join(classes.withColumnRenamed("fp", "__fp"),
                        (F.col("fp") == F.col("__fp")) & (F.col("id") == F.col("rep"))) \
        .dropDuplicates(["id", "fp"]).select("id", "label", "dim", "v", "copies")
    first = materialize(first, "vec-first")
    largest = first.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    even = passes_for(largest, threshold, window, miss)[1]

    # the leading bits of each label: the least work over all passes at the measured cells
    leads = sorted({0, even // 2, even, *(min(BITS, even + x) for x in FURTHER)})
    key_type = "id long, label string, dim int, lead int, keys array<long>"
    tried = map_arrow(first.select("id", "label", "dim", "v", F.lit(0).alias("lead"), F.lit(MEASURED).alias("passes")), _keys, key_type) \
        .select("label", "dim", F.posexplode("keys").alias("pass", "key"))
    tried = tried.select("label", "dim", "pass", F.explode(F.array(*[
        F.struct(F.lit(x).alias("lead"), F.lit(passes_at(x, threshold, miss)).alias("passes"), _cell("key", x).alias("cell"))
        for x in leads])).alias("t")).select("label", "dim", "pass", "t.*")
    sizes = tried.groupBy("label", "dim", "pass", "lead", "passes", "cell").count()
    work = sizes.groupBy("label", "dim", "lead", "passes").agg(
        (F.sum(F.col("count").cast("double") * F.greatest(F.col("count"), F.lit(window))) * F.col("passes")).alias("work"))
    chosen = materialize(work.groupBy(F.col("label").alias("__label"), F.col("dim").alias("__dim")).agg(
        F.min(F.struct("work", "lead", "passes")).alias("p")).select("__label", "__dim", "p.lead", "p.passes"), "vec-leads")

    # sort keys only; vectors join their blocks afterwards
    keys = first.join(chosen, (F.col("label") == F.col("__label")) & (F.col("dim") == F.col("__dim")))
    keys = map_arrow(keys.select("id", "label", "dim", "v", "lead", "passes"), _keys, key_type) \
        .select("id", "label", "dim", "lead", F.posexplode("keys").alias("pass", "key"))
    placed = global_position(keys, ["pass", "label", "dim", "key", "id"], "vec-sorted", "pos")
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    near_start = F.col("pos") % BLOCK < window
    blocks = placed.select("id", "pos", "pass", F.explode(
        F.when(near_start & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))
    rows = blocks.join(first.select(F.col("id").alias("__id"), "label", "dim", "v"), F.col("id") == F.col("__id")).drop("__id")
    pairs = rows.groupBy("block").applyInArrow(_window_pairs(window, threshold), "a long, b long")

    # cells above the window, tile against tile; those of one tile are handled together, by where they lie
    named_cells = placed.withColumn("cell", _cell("key", "lead"))
    wide = named_cells.groupBy(*[F.col(c).alias(f"__{c}") for c in ("pass", "label", "dim", "cell")]).agg(
        F.min("pos").alias("low"), F.max("pos").alias("high")).filter(F.col("high") - F.col("low") > window)
    in_wide = named_cells.join(wide, (F.col("pass") == F.col("__pass")) & (F.col("label") == F.col("__label"))
                               & (F.col("dim") == F.col("__dim")) & (F.col("cell") == F.col("__cell"))) \
        .select(F.col("id").alias("__id"), F.col("label").alias("__l"), F.col("dim").alias("__d"), "low",
                F.floor((F.col("pos") - F.col("low")) / BLOCK).cast("int").alias("tile"),
                (F.floor((F.col("high") - F.col("low")) / BLOCK) + 1).cast("int").alias("n_tiles")) \
        .withColumn("unit", F.when(F.col("n_tiles") == 1, -1 - F.floor(F.col("low") / BLOCK)).otherwise(F.col("low")))
    in_wide = in_wide.join(first.select("id", "label", "dim", "v"), (F.col("id") == F.col("__id")) & (F.col("label") == F.col("__l"))
                           & (F.col("dim") == F.col("__d"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))) \
        .select("unit", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "low", "tile", "id", "v")
    pairs = pairs.union(in_wide.groupBy("unit", "one", "two").applyInArrow(_cell_pairs(threshold), "a long, b long"))
    comp = materialize(components(materialize(pairs.distinct(), "vec-pairs"), "vec-comp"), "vec-comp")

    # links inside components, tile against tile
    member = first.join(comp, F.col("id") == F.col("node")).select("id", "label", "dim", "v", "copies", "component")
    order = global_position(member.select("id", "component"), ["component", "id"], "vec-members", "pos")
    span = order.groupBy("component").agg(F.min("pos").alias("low"), F.max("pos").alias("high")) \
        .withColumnRenamed("component", "__c")
    tiles = order.join(span, F.col("component") == F.col("__c")).select(
        F.col("id").alias("__id"), F.floor((F.col("pos") - F.col("low")) / TILE).cast("int").alias("tile"),
        (F.floor((F.col("high") - F.col("low")) / TILE) + 1).cast("int").alias("n_tiles"),
        F.floor(F.col("low") / TILE).cast("long").alias("bundle"))
    # components of one tile are handled together, by where they lie; larger ones pair their tiles
    member = member.join(tiles, F.col("id") == F.col("__id")).drop("__id").withColumn(
        "unit", F.when(F.col("n_tiles") == 1, -1 - F.col("bundle")).otherwise(F.col("component")))
    met = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))) \
        .withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other"))
    counts = met.groupBy("unit", "one", "two").applyInArrow(_tile_counts(threshold), "id long, links long") \
        .groupBy("id").agg(F.sum("links").alias("links"))
    done = first.select(F.col("id").alias("rep"), "copies").join(comp, F.col("rep") == F.col("node"), "left") \
        .join(counts, F.col("rep") == F.col("id"), "left") \
        .select(F.col("rep").alias("__rep"), F.coalesce("component", "rep").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    done = done.groupBy("__rep").agg(F.min("component").alias("component"), F.max("links").alias("links"))
    named = usable.join(classes.select(F.col("fp").alias("__fp"), "rep"), F.col("fp") == F.col("__fp")) \
        .join(done, F.col("rep") == F.col("__rep")).select(F.col("id").alias("__v"), "component", "links")
    named = named.groupBy("__v").agg(F.min("component").alias("component"), F.max("links").alias("links"))
    comp_id = F.coalesce("component", "vec_id")
    return src.select("vec_id").join(named, F.col("vec_id") == F.col("__v"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))
