"""Sharding by a hierarchical weighted hash tree.

The tree has three levels: regions, racks and shards. A document descends it: at each node every child draws
-ln(u) / weight, where u is a hash of the document's key and the child's path, and the smallest draw wins. A child so
gets a share in proportion to its weight, and a change of one child's weight moves keys only into or out of that child:
movement stays in the subtrees whose weights change. `grow` hangs a new shard under a region of its own, so keys move
into the new shard alone.

The law of this operator is `key`: the document's id and the tree decide, so repeated rows of one id share a shard.
Defined results: a null id is a key of its own; a null text counts no bytes and has CRC 0; an empty table gives an
empty result. Only doc_id and text are read, so extra columns cannot clash. No group is held by one task: the numbers
of a shard's rows come from counts of `SLOT_BUCKETS` buckets in each shard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped_number

#: Buckets of a shard inside which rows are numbered.
SLOT_BUCKETS = 256
_NULL_KEY = "\x00null"


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves carry the shard's number and own weight; an inner node weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shards: int = 24, racks: int = 6, regions: int = 2, weights: Sequence[float] | None = None) -> Node:
    """A tree over shards 0 to shards - 1, dealt to racks and regions in runs of their numbers."""
    w = list(weights) if weights is not None else [1.0] * shards
    leaf = lambda s: Node(f"s{s}", (), s, w[s])
    runs = lambda items, n: [items[len(items) * k // n : len(items) * (k + 1) // n] for k in range(n)]
    made = [Node(f"k{k}", tuple(map(leaf, r))) for k, r in enumerate(runs(range(shards), racks)) if r]
    return Node("", tuple(Node(f"r{k}", tuple(r)) for k, r in enumerate(runs(made, regions)) if r))


def grow(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and region of its own: only that region's weight is new."""
    return Node(root.name, (*root.children, Node(f"r+{shard}", (Node(f"k+{shard}", (Node(f"s{shard}", (), shard, weight),)),))))


def shard_of(key: Column, root: Node) -> Column:
    """The number of the shard that `key`, a string without nulls, descends to."""

    def draw(path: str, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f"|{path}"))), 11)
        return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(weight))

    def descend(node: Node, path: str) -> Column:
        if not node.children:
            return F.lit(node.shard)
        paths = [f"{path}/{c.name}" for c in node.children]
        if len(paths) == 1:
            return descend(node.children[0], paths[0])
        if all(not c.children for c in node.children):
            return F.array_min(F.array(*(F.struct(draw(p, c.weight).alias("d"), F.lit(c.shard).alias("s")) for p, c in zip(paths, node.children)))).getField("s")
        won = F.array_min(F.array(*(F.struct(draw(p, c.weight).alias("d"), F.lit(k).alias("k")) for k, (p, c) in enumerate(zip(paths, node.children))))).getField("k")

        def pick(k: Column) -> Column:
            out = F.when(k == 0, descend(node.children[0], paths[0]))
            for n in range(1, len(paths)):
                out = out.when(k == n, descend(node.children[n], paths[n]))
            return out

        return F.transform(F.array(won), pick)[0]

    return descend(root, "")


def shards(docs: DataFrame, root: Node | None = None, grown: Node | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and the shard after growth by one."""
    root = root or tree()
    count = len(_leaves(root))
    grown = grown or grow(root, count)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(_NULL_KEY))
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, root).cast("int").alias("shard"),
        shard_of(key, grown).cast("int").alias("grown_shard"),
    )
    bucket = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_crc32")), F.lit(SLOT_BUCKETS)).cast("int")
    out = grouped_number(placed, ["shard"], ["doc_id", "text_crc32", "size"], bucket, SLOT_BUCKETS, "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in _leaves(c)] if node.children else [node]
