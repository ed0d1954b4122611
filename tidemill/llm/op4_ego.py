"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of norm one with a cosine of 0.95 or more lie within epsilon = sqrt(2 - 2 * 0.95) of each other. A vector's
coordinates are its centred projections on the leading principal axes, and the norm of what they leave over: no two
vectors are nearer than their coordinates. Vectors are sorted by the grid cells of their coordinates and cut into blocks
of about `BLOCK_BYTES`. Two blocks are joined unless the boxes around their coordinates lie further apart than epsilon; a
task joins two blocks by halving both sequence intervals again and again, skips pairs of intervals whose boxes are
provably distant, and compares what remains in double precision.

Axes and cuts come from a bounded sample (`SAMPLE` rows expected) that decides the order and the balance only. Beyond
one cut for eight sampled vectors, intervals are dealt into parts by a hash, so blocks keep their size at any scale.

Equal vectors are one node with a weight. A task returns, for each node, the weight that it is linked to, and a
forest with the components of its links, never the links themselves, so dense groups stay linear in output. How much is
skipped depends on the data: boxes prove little in directions in which all vectors spread alike.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and so do
vectors of different lengths and rows with a null vec_id: no links, a component of their own, kept. Repeated rows are
vectors of their own and link with each other; rows with one vec_id share their component. An empty table gives an
empty result. Only vec_id and embedding are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved
from .components import components
from .op2_dartminhash import mix

COSINE = 0.95
#: Principal axes, vectors expected in the sample, bytes of a block's vectors as doubles, vectors of the intervals that are compared outright, and cells to epsilon.
AXES, SAMPLE, BLOCK_BYTES, LEAF, FINE = 16, 4096, 8 << 20, 128, 4
#: Vector lengths that get principal axes of their own; others use the first coordinates.
LENGTHS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """The rows scaled to norm one, safe for very large and very small components."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Frame:
    """For each vector length a centre and orthonormal axes."""

    def __init__(self, sample: list[np.ndarray]):
        by = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        self.known = {}
        for dim in sorted(by, key=lambda d: (-len(by[d]), d))[:LENGTHS]:
            x = unit(np.stack(by[dim]))
            if len(x) > 1:
                _, vectors = np.linalg.eigh(np.cov(x.T).reshape(dim, dim))
                self.known[dim] = x.mean(axis=0), vectors[:, ::-1][:, :AXES].copy()

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Of unit rows of one length: projections and the norm of the rest, padded to AXES + 1 columns. Distances never grow."""
        dim = x.shape[1]
        centre, axes = self.known.get(dim) or (np.zeros(dim), np.eye(dim)[:, :AXES])
        y = x - centre
        out = np.zeros((len(x), AXES + 1))
        out[:, : axes.shape[1]] = z = y @ axes
        out[:, AXES] = np.sqrt(((y - z @ axes.T) ** 2).sum(axis=1))
        return out


def cells(coordinates: np.ndarray, eps: float) -> np.ndarray:
    return np.floor(coordinates * (FINE / eps)).astype(np.int64)


def order_keys(dims: np.ndarray, z: np.ndarray, ids: np.ndarray, eps: float) -> list[np.ndarray]:
    """What the grid order compares, first key first: length, cells, and a hash that parts equal cells."""
    return [dims, *cells(z, eps).T, mix(ids.astype(np.int64).view(np.uint64))]


def epsilon(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9


class Side:
    """One block's vectors of one length in grid order: unit vectors, ids, weights, and the boxes of its leaves."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, frame: Frame, eps: float):
        x = unit(vectors)
        z = frame.coordinates(x)
        order = np.lexsort(order_keys(np.zeros(len(ids), np.int64), z, ids, eps)[::-1])
        self.ids, self.weights, self.x, z = ids[order], weights[order], x[order], z[order]
        self.cuts = [*range(0, len(ids), LEAF), len(ids)]
        self.low = np.minimum.reduceat(z, self.cuts[:-1])
        self.high = np.maximum.reduceat(z, self.cuts[:-1])
        self.linked = np.zeros(len(ids), np.int64)


def box_gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """The distance of two boxes: no two of their points are nearer."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(np.sqrt(gap @ gap))


def join_blocks(a: Side, b: Side, cosine: float, eps: float) -> tuple[np.ndarray, int]:
    """Adds to `linked` of both sides and returns forest edges (id, smaller id) of their links, and how many leaf pairs were compared. `b` may be `a`."""
    edges, compared = [], 0
    todo = [(0, len(a.cuts) - 1, 0, len(b.cuts) - 1)]
    while todo:
        i, j, k, m = todo.pop()
        if a is b and k >= j:  # mirrored by another pair
            continue
        if box_gap(a.low[i:j].min(axis=0), a.high[i:j].max(axis=0), b.low[k:m].min(axis=0), b.high[k:m].max(axis=0)) > eps:
            continue
        if j - i == 1 and m - k == 1:
            if a is b and k > i:
                continue
            compared += 1
            edges.append(_leaf(a, slice(a.cuts[i], a.cuts[j]), b, slice(b.cuts[k], b.cuts[m]), cosine))
            continue
        left = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > 1 else [(i, j)]
        right = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > 1 else [(k, m)]
        todo += [(*x, *y) for x in left for y in right]
    found = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return np.unique(found, axis=0), compared


def _leaf(a: Side, s: slice, b: Side, t: slice, cosine: float) -> np.ndarray:
    near = a.x[s] @ b.x[t].T >= cosine
    same = a is b and s == t
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return np.zeros((0, 2), np.int64)
    a.linked[s] += near @ b.weights[t]
    if not same:
        b.linked[t] += a.weights[s] @ near
    rows, columns = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
    near, ra, rb = near[np.ix_(rows, columns)], a.ids[s][rows], b.ids[t][columns]
    la, lb, top = ra.copy(), rb.copy(), np.iinfo(np.int64).max
    while True:  # smallest labels travel along the links until nothing changes
        new_b = np.minimum(lb, np.where(near, la[:, None], top).min(axis=0))
        new_a = np.minimum(la, np.where(near, new_b[None, :], top).min(axis=1))
        if (new_a == la).all() and (new_b == lb).all():
            break
        la, lb = new_a, new_b
    pairs = np.concatenate([np.stack([ra, la], 1), np.stack([rb, lb], 1)])
    return pairs[pairs[:, 0] != pairs[:, 1]]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, end to end, and the lists' lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy().astype(np.int64)


def by_length(column: pa.ListArray):
    """(row numbers, matrix of doubles) for each length of the lists."""
    values, dims = _lists(column)
    starts = np.cumsum(dims) - dims
    for dim in np.unique(dims):
        rows = np.nonzero(dims == dim)[0]
        yield rows, values[starts[rows][:, None] + np.arange(dim)].astype(np.float64)


def _plain(vectors: DataFrame):
    """The embedding without negative zeros: floats stay floats, other numbers become doubles."""
    kept = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    zero = F.lit(0.0).cast("float" if kept else "double")
    return F.transform("embedding", lambda x: (x if kept else x.cast("double")) + zero)


def nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different vectors that can link: node (smallest vec_id), weight (rows), k1 and k2 (a key of the vector), embedding; and the key of each row's vector."""
    e = F.col("embedding")
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))
    keyed = usable.select(F.col("vec_id").cast("long").alias("vec_id"), _plain(vectors).alias("embedding")).select("*", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    grouped = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("embedding").alias("embedding"))
    return grouped, keyed.select("vec_id", "k1", "k2")


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id and kept."""
    distinct, keyed = nodes(vectors)
    distinct = saved(distinct)
    made = _joined(distinct, cosine, epsilon(cosine))
    sums = made.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    comps = components(made.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    about = distinct.select("node", "weight", "k1", "k2").join(sums, "node", "left").join(comps, "node", "left")
    about = about.select("k1", "k2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
    known = keyed.join(about, ["k1", "k2"]).select(F.col("vec_id").alias("__id"), "k1", "k2", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(_plain(vectors)).alias("__k"))
    known = known.groupBy("__id", F.col("k1").alias("__k1")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rest.join(known, (F.col("vec_id") == F.col("__id")) & (F.col("__k") == F.col("__k1")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))


def cuts_of(sample: pa.Table, frame: Frame, blocks: int, eps: float) -> tuple[list[np.ndarray], int]:
    """(order keys of the sampled vectors that begin an interval, parts of each interval) for about `blocks` blocks."""
    intervals = max(1, min(blocks, len(sample) // 8))
    ids = sample["node"].to_numpy()
    z, dims = np.zeros((len(ids), AXES + 1)), np.zeros(len(ids), np.int64)
    for rows, matrix in by_length(sample["embedding"].combine_chunks()):
        z[rows], dims[rows] = frame.coordinates(unit(matrix)), matrix.shape[1]
    keys = order_keys(dims, z, ids, eps)
    at = np.lexsort(keys[::-1])[(np.arange(1, intervals) * len(ids)) // intervals]
    return [k[at] for k in keys], -(-blocks // intervals)


def interval_of(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted cuts are not above each row."""
    n = len(cuts[0])
    both = [np.concatenate([c, k]) for c, k in zip(cuts, keys)]
    order = np.lexsort([np.concatenate([np.zeros(n, bool), np.ones(len(keys[0]), bool)]), *both[::-1]])
    seen = np.empty(len(order), np.int64)
    seen[order] = np.cumsum(order < n)
    return seen[n:]


def _joined(distinct: DataFrame, cosine: float, eps: float) -> DataFrame:
    """(node, n, to): in parts, the weight n that each node is linked to, or a forest edge to a smaller node."""
    n, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-8 * size // BLOCK_BYTES))
    some = distinct.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample = some.select("node", "embedding").toArrow()  # about SAMPLE rows
    frame = Frame([v for _, m in by_length(sample["embedding"].combine_chunks()) for v in m])
    cuts, parts = cuts_of(sample, frame, blocks, eps)
    of = distinct.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            z, dims = np.zeros((len(ids), AXES + 1)), np.zeros(len(ids), np.int64)
            for rows, matrix in by_length(batch.column(2)):
                z[rows], dims[rows] = frame.coordinates(unit(matrix)), matrix.shape[1]
            keys = order_keys(dims, z, ids, eps)
            block = interval_of(keys, cuts) * parts + (keys[-1] % np.uint64(parts)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * (AXES + 1)), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(block)], names=["node", "weight", "embedding", "z", "block"])

    rows = saved(distinct.select("node", "weight", "embedding").mapInArrow(place, f"node long, weight long, embedding {of}, z array<double>, block long"))
    sides = lambda f: F.array(*(f(F.get("z", F.lit(k))) for k in range(AXES + 1)))
    boxes = rows.groupBy("block").agg(sides(F.min).alias("low"), sides(F.max).alias("high"))
    reach = lambda a, b: F.explode(F.sequence(F.floor(a / eps), F.floor(b / eps)))
    one = boxes.select(F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), reach(F.get("low", F.lit(0)), F.get("high", F.lit(0))).alias("cell"))
    two = boxes.select(F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), reach(F.get("low", F.lit(0)) - eps, F.get("high", F.lit(0)) + eps).alias("cell"))
    gaps = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    square = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    pairs = one.join(two, "cell").where((F.col("a") <= F.col("b")) & (square <= eps * eps)).select("a", "b").distinct()
    members = saved(pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")))
    met = rows.select("block", "node", "weight", "embedding").join(members, "block")

    def task(key: tuple, table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        def sides_of(block: int) -> dict[int, Side]:
            part = table.filter(pc.equal(table["block"], block)).combine_chunks()
            ids, weights = part["node"].to_numpy(), part["weight"].to_numpy()
            return {m.shape[1]: Side(ids[at], weights[at], m, frame, eps) for at, m in by_length(part["embedding"].combine_chunks())}

        a, b = (x.as_py() for x in key)
        first = sides_of(a)
        second = first if a == b else sides_of(b)
        forests = [join_blocks(first[dim], second[dim], cosine, eps)[0] for dim in first.keys() & second.keys()]
        forest = np.concatenate(forests) if forests else np.zeros((0, 2), np.int64)
        out = [*first.values(), *(() if second is first else second.values())]
        ids, counts = np.concatenate([x.ids for x in out]), np.concatenate([x.linked for x in out])
        ids, counts = ids[counts > 0], counts[counts > 0]
        none = pa.nulls(len(forest), pa.int64())
        return pa.table({
            "node": pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(forest[:, 0], pa.int64())]),
            "n": pa.concat_arrays([pa.array(counts, pa.int64()), none]),
            "to": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(forest[:, 1], pa.int64())]),
        })

    made = saved(met.groupBy("a", "b").applyInArrow(task, "node long, n long, to long"))
    drop(rows, members)
    return made
