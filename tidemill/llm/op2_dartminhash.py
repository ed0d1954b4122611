"""Near-duplicate documents by DartMinHash.

A document is the multiset of its shingles of five lower-case words; a shingle that occurs w times has weight w. Each
unit of weight is a region into which darts fall as a Poisson process in time: the k-th arrival of a region is a sum
of exponentials drawn from hashes of (shingle, unit, k), and a further hash gives the coordinate that it hits. Equal
regions get equal darts in every document. A signature keeps the earliest dart of each of `COORDINATES` coordinates,
so two documents agree in a coordinate with the probability of their weighted Jaccard similarity, at a cost of the
document's length plus k log k darts, whatever its weight.

`BANDS` bands of `ROWS` coordinates are joined. Candidates in a bucket are compared with pivots. One law decides about a
pair wherever it meets: sketches (four bits of each coordinate) that differ in at most `differing` places, and then an
exact comparison of the shingles: pairs with a similarity of `SIMILARITY` or more are links, and classes are the links'
components. A pair of similarity 0.8 differs in 24 of 126 places on average, with a deviation of 4.4; `DIFFERING` = 42 lies
beyond four deviations and loses one pair in 32,000, where the bands lose one in 600; `differing=None` compares all.

First every bucket that holds two classes names one pivot, which is compared with the bucket's members of other classes
and leaves the bucket. Then buckets of at most `LARGE` members name more and more pivots until they are settled. Larger ones
are dealt to tasks by pairs of blocks, where matrix products compare the shingles and only a forest of the links leaves
the task. The bucket's largest class is not compared with itself: its members meet only the blocks of the others, so a
hot bucket of near copies costs its size times the blocks of those that its pivot did not reach, and no rows for all pairs
of a group are made. Every pair that shares a band is either compared or already in one class.

Defined results: texts with equal lower-case words are copies. A text with one to four words has one shingle, all of
its words. A null text, or one without words, is like no other document, and so is a row with a null doc_id: its
class is its own id. Rows with one doc_id are one document. An empty table gives an empty result. Only doc_id and
text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop, saved, unclashing
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 21, 6
COORDINATES = BANDS * ROWS
#: Words of a sketch.
SKETCH = -(-COORDINATES // 16)
#: Coordinates in which the four-bit sketches of a candidate pair may differ.
DIFFERING = 42
#: Members beyond which a bucket is compared inside tasks (by the same law), and members of a block there.
LARGE, BLOCK = 16, 256
#: Regions worked on at once in a worker; a longer document is worked on alone.
CHUNK = 50_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def regions(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, region) of each unit of weight. `words` holds the word hashes of all documents, `ends` where each document ends."""
    begins = np.concatenate([[0], ends[:-1]])
    counts = ends - begins
    n = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(ends)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)
    last = np.repeat(ends, n)
    shingle = np.zeros(len(doc), np.uint64)
    for k in range(SHINGLE):
        inside = at + k < last
        w = words[np.minimum(at + k, len(words) - 1)] if len(words) else np.zeros(0, np.uint64)
        shingle = mix(shingle * _GOLD + np.where(inside, w, np.uint64(k + 1)))
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
    unit = (np.arange(len(doc)) - first).astype(np.uint64)
    return doc, mix(shingle + unit * _GOLD)


def signatures(doc: np.ndarray, region: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate: a row for each document with a region."""
    out = np.zeros((docs, k), np.uint64)
    weight = np.bincount(doc, minlength=docs)
    todo = weight > 0
    darts = k * np.log(k) + 4 * k
    while todo.any():
        until = np.zeros(docs)
        until[todo] = darts / weight[todo]
        use = todo[doc]
        d, r = doc[use], region[use]
        time, n = np.zeros(len(d)), 0
        keys, times, ids = [], [], []
        while len(d):
            n += 1
            dart = mix(r + np.uint64(n * int(_M2) % 2**64))
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
            alive = time <= until[d]
            d, r, time, dart = d[alive], r[alive], time[alive], dart[alive]
            keys.append(d * k + (mix(dart + _GOLD) % np.uint64(k)).astype(np.int64))
            times.append(time)
            ids.append(dart)
        key, when, dart = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
        late_first = np.argsort(-when, kind="stable")
        flat = out.reshape(-1)
        flat[key[late_first]] = dart[late_first]  # of equal keys the last assignment, the earliest dart, stays
        hit = np.zeros(docs * k, bool)
        hit[key] = True
        todo &= ~hit.reshape(docs, k).all(axis=1)
        darts *= 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of each row."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * _GOLD + parts[:, :, k])
    return out


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen coordinates to a word."""
    bits = np.zeros((len(signature), 16 * SKETCH), np.uint64)
    bits[:, :COORDINATES] = mix(signature) & np.uint64(15)
    parts = bits.reshape(len(signature), SKETCH, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(parts, axis=2)


def differing_places(a: Column, b: Column) -> Column:
    """In how many coordinates two sketches differ."""
    low = F.lit(0x1111111111111111)

    def word(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftright(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftright(x, 2)).bitwiseAND(low))

    return sum((word(k) for k in range(1, SKETCH)), word(0))


def _chunks(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about CHUNK words: (first row, row after the last, words, ends)."""
    offsets = column.offsets.to_numpy()
    words = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        stop = min(stop, len(column))
        yield at, stop, words[offsets[at] : offsets[stop]], (offsets[at + 1 : stop + 1] - offsets[at]).astype(np.int64)
        at = stop


def word_hashes(text: Column) -> Column:
    """The hashes of a text's lower-case words."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), ""), lambda w: F.xxhash64(w))


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, the key of equal word lists (k1, k2), the number of regions, and the band hashes of each document with words and an id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, ends in _chunks(batch.column(3)):
                doc, region = regions(hashes, ends)
                signature = signatures(doc, region, b - a)
                made, short = bands(signature).view(np.int64), np.ascontiguousarray(sketches(signature)).view(np.int64)
                count = pa.array(np.bincount(doc, minlength=b - a), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(made.reshape(-1)))
                words = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * SKETCH), pa.array(short.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), count, lists, words], names=["doc_id", "k1", "k2", "n", "bands", "sketch"])
            pa.default_memory_pool().release_unused()  # workers are kept from task to task

    hashed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("w")).where(F.size("w") > 0)
    return hashed.select("doc_id", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"), "w").mapInArrow(work, "doc_id long, k1 long, k2 long, n long, bands array<long>, sketch array<long>")


def sketch_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many coordinates each sketch of `a` differs from each of `b`."""
    out, low = np.zeros((len(a), len(b)), np.int16), np.uint64(0x1111111111111111)
    for k in range(SKETCH):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        out += np.bitwise_count(x & low)
    return out


def shingled(docs: DataFrame) -> DataFrame:
    """node and its regions by the upper half of their hashes, for the rows of `docs` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, ends in _chunks(batch.column(1)):
                doc, region = regions(words, ends)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array((region >> np.uint64(32)).astype(np.uint32).view(np.int32)))], names=["node", "regions"])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("node"), word_hashes(F.col("text")).alias("w")).mapInArrow(work, "node long, regions array<int>")


def forest_of_links(nodes: np.ndarray, sizes: np.ndarray, values: np.ndarray, sketch: np.ndarray, side: np.ndarray, similarity: float, differing: int | None) -> np.ndarray:
    """(node, smaller node) edges that span the components of the links among sets. `values` holds the sets end to end; where both sides occur, only pairs across them are links."""
    n = len(nodes)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, (a, a + 2048))
        part = np.zeros((n, 2048), np.float32)  # a part's sums are small whole numbers
        part[owner[lo:hi], column[lo:hi] - a] = 1
        both += part @ part.T
    near = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    if differing is not None:
        near &= sketch_gap(sketch, sketch) <= differing
    np.fill_diagonal(near, False)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    label, top = nodes.copy(), np.iinfo(np.int64).max
    while True:
        new = np.minimum(label, np.where(near, label[None, :], top).min(axis=1, initial=top))
        if (new == label).all():
            break
        label = new
    moved = label != nodes
    return np.stack([nodes[moved], label[moved]], 1)


def dealt_blocks(large: DataFrame) -> DataFrame:
    """(bucket, node, mine, lo, hi): each member of `large` (bucket, node, comp) once for every pair of blocks that it takes part in.

    Blocks 0, 1, ... hold the members outside the bucket's largest class, all of which meet; blocks -1, -2, ... hold that
    class, whose members meet the others only.
    """
    of_comp = large.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    counts = of_comp.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("size"))
    counts = counts.withColumns({"blocks": F.ceil((F.col("size") - F.col("n_main")) / BLOCK), "main_blocks": F.ceil(F.col("n_main") / BLOCK)})
    h = F.xxhash64("node")
    placed = large.join(counts, "bucket").withColumn("mine", F.when(F.col("comp") == F.col("main"), -1 - F.pmod(h, F.col("main_blocks"))).otherwise(F.pmod(h, F.col("blocks"))))
    meets = F.when(F.col("mine") < 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.sequence(-F.col("main_blocks"), F.col("blocks") - 1))
    spread = placed.select("bucket", "node", "mine", F.explode(meets).alias("other"))
    return spread.select("bucket", "node", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))


def links_inside(large: DataFrame, sets: DataFrame, similarity: float, differing: int | None) -> DataFrame:
    """Links (a, b) that, with the known classes, span the components of each bucket of `large` (bucket, node, comp): each pair of blocks is one task's work."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        lists = rows["regions"].combine_chunks()
        sizes, values = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        sketch = rows["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(sizes), -1)
        lo, hi = key[1].as_py(), key[2].as_py()
        side = rows["mine"].to_numpy() == hi if lo != hi else np.zeros(len(sizes), bool)
        edges = forest_of_links(rows["node"].to_numpy(), sizes, values, sketch, side, similarity, differing)
        del rows, lists, values
        pa.default_memory_pool().release_unused()
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    return dealt_blocks(large).join(sets, "node").groupBy("bucket", "lo", "hi").applyInArrow(task, "a long, b long").distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, differing: int | None = DIFFERING) -> DataFrame:
    """One row per row of `docs`: doc_id, copy_of (the smallest id with the same words), component_id (the smallest id of its class) and kept (it is that document)."""
    rows = saved(signed(docs))
    firsts = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    homes = saved(rows.select("doc_id", "k1", "k2").join(firsts, ["k1", "k2"]).groupBy("doc_id").agg(F.min("node").alias("node")))
    nodes = rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "bands", "sketch")).alias("x")).select(F.col("x.doc_id").alias("node"), "x.n", "x.bands", "x.sketch")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = spread.join(sizes, "bucket")
    central = members.groupBy("node").agg(F.sum(F.log2(F.col("size").cast("double"))).alias("central"))
    about = nodes.select("node", "n", "sketch").join(central, "node")
    members = saved(members.select("bucket", "node").join(about, "node"))
    wanted = saved(members.select(F.col("node").alias("doc_id")).distinct())  # stored, so that Spark knows whether it is small enough to broadcast
    sets = saved(shingled(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")).groupBy("node").agg(F.min("regions").alias("regions")))
    same = rows.select("doc_id", "k1", "k2").join(firsts, ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    # rows of one doc_id with different words are one document: their word lists are linked
    links = same.join(homes.select(F.col("doc_id").alias("a"), F.col("node").alias("home")), "a").where("b <> home").select(F.col("b").alias("a"), F.col("home").alias("b"))
    forest, pivots = components(links), 1
    while True:
        placed = members.join(forest, "node", "left").select("bucket", "node", "n", "central", "sketch", F.coalesce("comp", "node").alias("comp"))
        mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
        left = saved(placed.join(mixed, "bucket", "left_semi"))
        if left.isEmpty():
            drop(left, members, sets, wanted)
            break
        if pivots == 16:  # the second round: large buckets are settled at once
            counts = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LARGE)
            large = saved(left.join(counts, "bucket").select("bucket", "node", "comp", "sketch"))
            about = sets.join(large.select("node", "sketch").distinct(), "node")
            settled = saved(links_inside(large.drop("sketch"), about, similarity, differing))
            rest = saved(left.drop("comp").join(large.select("bucket").distinct(), "bucket", "left_anti"))
            joined = components(forest.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(settled))
            drop(forest, members, left, large, settled)
            forest, members, pivots = joined, rest, 17
            continue
        weight = left.select("comp", "node").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
        salted = left.join(weight, "comp").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(pivots)))
        rank = F.struct("central", F.col("node")) if pivots == 1 else F.struct(-F.col("weight"), F.col("central"), F.col("node"))
        chosen = salted.groupBy("bucket", "salt").agg(F.max_by(F.struct("node", "n", "comp", "sketch"), rank).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.comp").alias("pivot_comp"), F.col("p.sketch").alias("pivot_sketch"))
        chosen = saved(chosen)
        near = (F.col("n") >= similarity * F.col("pivot_n") - 1e-9) & (F.col("pivot_n") >= similarity * F.col("n") - 1e-9)
        alike = (F.col("comp") != F.col("pivot_comp")) & near
        if differing is not None:
            alike &= differing_places(F.col("sketch"), F.col("pivot_sketch")) <= differing
        pairs = left.join(chosen.withColumnRenamed("bucket", "__b"), (F.col("bucket") == F.col("__b")) & alike).select("pivot", "node").distinct()
        one = pairs.join(sets, "node").select("pivot", F.col("node").alias("other"), F.col("regions").alias("mine"))
        both = one.join(sets.withColumnRenamed("node", "pivot"), "pivot")
        shared = F.size(F.array_intersect("mine", "regions"))
        found = both.where(shared >= similarity * (F.size("mine") + F.size("regions") - shared) - 1e-9).select(F.col("other").alias("a"), F.col("pivot").alias("b"))
        joined = components(forest.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found))
        fewer = saved(left.join(chosen.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti").select("bucket", "node", "n", "central", "sketch"))
        drop(forest, members, left, chosen)
        forest, members, pivots = joined, fewer, 16 * pivots
    known = homes.join(forest, "node", "left").select(F.col("doc_id").alias("__id"), F.col("node").alias("copy_of"), F.coalesce("comp", "node").alias("component_id"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, F.col("doc_id") == F.col("__id"), "left")
    return out.select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose document is the smallest id of its class, with their columns."""
    (gone,) = unclashing(docs, "gone")
    others = classes(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(gone), "left_anti")


__all__ = ["classes", "components", "deduplicated", "drop", "mix", "regions", "signatures"]
