"""Packing by cutting-stock column generation.

Documents become token ids and are cut at every `CAPACITY` ids, so a document leaves full pieces and one rest. The
lengths of all pieces, rounded up to `GRAIN` ids, form a histogram of CAPACITY / GRAIN bins, which is all the driver
ever sees. On it a linear program picks patterns (multisets of bins that fit a sequence): a revised simplex over the
current patterns, whose prices a knapsack dynamic program turns into the next patterns, until a lower bound shows the
rest of the way to be below `GAP`. The patterns' counts are rounded down, and the few pieces left are patterned by first
fit. Pieces are ranked inside their bin, and the rank says which copy of which pattern a piece belongs to. The grain
bounds the padding by GRAIN - 1 ids a piece; with a grain of 1 the program has 1024 rows and no longer ends in seconds.

Defined results: a null text is empty, and an empty text is one piece with the end id alone. Repeated rows are packed
as often as they occur; a null doc_id is a document like any other. An empty table gives an empty result. Only doc_id
and text are read, so extra columns cannot clash.

Scale: one Arrow pass makes the pieces, which are stored once (about forty bytes each); ranking is a window over
(bin, bucket), so a length with a third of all rows is split into `BUCKETS` parts; a sequence has at most CAPACITY
pieces; the pattern table is bounded by the square of the bins.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped_number, saved

CAPACITY = 1024
END_ID = 0
GRAIN = 8
GAP = 0.002
#: Calls of the dynamic program at most, and patterns tried after each.
ROUNDS, PIVOTS = 5_000, 8
BUCKETS = 256
#: Code points beyond which a text goes through tokenizers itself.
LONG = 100_000
_workers: dict[str, Tokens] = {}
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tokens:
    """Token ids of many texts by a byte-level BPE file of the tokenizers library.

    Where the file's ids are the ranks of its merges, the texts go through tiktoken's engine, which gives the same ids
    in a third of the time; very long texts, texts with special tokens and other files go through tokenizers itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.special = [x.content for x in self.encoder.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            self.engine = self._engine(json.load(file))

    def _engine(self, spec: dict):
        """tiktoken's engine over the same vocabulary, or None where the two could differ."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        import public_tokenizers
        import tiktoken

        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = {t: k for t, k in model["vocab"].items() if t not in self.special}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if sorted(merges, key=vocabulary.__getitem__) != merges:
            return None
        ranks = {bytes(letters[c] for c in t): k for t, k in vocabulary.items()}
        return tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [self.engine is not None and len(t) <= LONG and not any(x in t for x in self.special) for t in texts]
        rest = iter(self.encoder.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [np.array(self.engine.encode_ordinary(t) if p else next(rest).ids, np.uint32) for t, p in zip(texts, plain)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with the CRC of their ids. `path` is the tokenizer's file, which every executor must see."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _workers.get(path) or _workers.setdefault(path, Tokens(path))  # a worker keeps what it knows from task to task
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 256):
                rows: list[list] = [[], [], [], [], []]
                for key, ids in zip(keys[at : at + 256], tokens.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        for column, value in zip(rows, (key, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, _PIECES)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity, the most that items, each as often as wanted, are worth in it, and an item of that choice (-1: the choice for one less room)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            totals = best[c - sizes[: upto[c]]] + worth[: upto[c]]
            k = int(totals.argmax())
            if totals[k] > best[c] + 1e-12:
                best[c], took[c] = totals[k], k
    return best, took


def chosen(sizes: np.ndarray, took: np.ndarray, room: int) -> np.ndarray:
    """How often the choice for `room` takes each item."""
    counts = np.zeros(len(sizes))
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return counts


def patterns(histogram: dict[int, int], capacity: int = CAPACITY // GRAIN, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) and how often each is used; together they hold each length exactly as often as the histogram.

    `gap` is the share of sequences by which the linear program may miss its optimum; `rounds` bounds the calls of the
    dynamic program. From each call the best pattern with each length is tried, as long as the prices still favour it.
    """
    sizes = np.array(sorted(k for k, n in histogram.items() if n), dtype=np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(k)] for k in sizes], dtype=np.float64)
    copies = (capacity // sizes).astype(np.float64)
    basis, inverse, amount = np.diag(copies), np.diag(1 / copies), demand / copies
    price = inverse.sum(axis=0)  # every pattern costs one sequence
    least = float(demand @ sizes) / capacity
    for _ in range(rounds):
        worth = np.maximum(price, 0)
        best, took = knapsack(sizes, worth, capacity)
        least = max(least, amount.sum() / max(best[capacity], 1.0))  # price / best is dual feasible, so this is a lower bound
        if best[capacity] <= 1 + 1e-9 or amount.sum() <= (1 + gap) * least:
            break
        values = worth + best[capacity - sizes]
        for k in np.argsort(-values)[:PIVOTS]:
            if values[k] <= 1 + 1e-9:
                break
            column = chosen(sizes, took, int(capacity - sizes[k]))
            column[k] += 1
            gain = float(price @ column) - 1
            if gain <= 1e-9:
                continue
            step = inverse @ column
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(step > 1e-9, np.maximum(amount, 0) / step, np.inf)
            leaves = int(ratio.argmin())
            most = ratio[leaves]
            amount -= most * step
            amount[leaves] = most
            inverse[leaves] /= step[leaves]
            price = price - gain * inverse[leaves]
            step[leaves] = 0
            touched = np.nonzero(np.abs(step) > 1e-12)[0]
            inverse[touched] -= np.outer(step[touched], inverse[leaves])
            basis[:, leaves] = column
    times = np.floor(np.maximum(amount, 0) + 1e-6).astype(np.int64)
    whole = basis.astype(np.int64)
    over = whole @ times - demand.astype(np.int64)
    for k in np.nonzero(over > 0)[0]:  # only by rounding errors of the basis
        for p in np.nonzero(whole[k] * (times > 0))[0]:
            while over[k] > 0 and times[p] > 0:
                times[p] -= 1
                over -= whole[:, p]
    found = Counter()
    for p in np.nonzero(times)[0]:
        found[tuple((int(sizes[k]), int(whole[k, p])) for k in np.nonzero(whole[:, p])[0])] += int(times[p])
    rest = {int(s): int(-o) for s, o in zip(sizes, over, strict=True) if o < 0}
    for pattern in first_fit(rest, capacity):
        found[tuple(sorted(pattern.items()))] += 1
    return [(dict(p), n) for p, n in found.items()]


def first_fit(rest: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Sequences for the pieces that rounding leaves, longest first, each into the fullest sequence that has room."""
    import bisect

    room: list[tuple[int, int]] = []
    out: list[dict[int, int]] = []
    for size in sorted(rest, reverse=True):
        for _ in range(rest[size]):
            k = bisect.bisect_left(room, (size, -1))
            if k < len(room):
                left, at = room.pop(k)
            else:
                left, at = capacity, len(out)
                out.append({})
            out[at][size] = out[at].get(size, 0) + 1
            bisect.insort(room, (left - size, at))
    return out


def layout(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first rank, rank after the last, copies, first sequence, first slot) for each pattern and bin."""
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in found:
        slot = 0
        for size in sorted(pattern, reverse=True):
            n = pattern[size]
            rows.append((size, ranks[size], ranks[size] + n * times, n, sequence, slot))
            ranks[size] += n * times
            slot += n
        sequence += times
    return rows


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, gap: float = GAP) -> DataFrame:
    """One row per piece: where it comes from, the CRC of its ids, and the sequence and offset it goes to."""
    cut = saved(pieces(docs, path, capacity)).withColumn("__bin", F.ceil(F.col("length") / grain).cast("long"))
    histogram = {r["__bin"]: r["n"] for r in cut.groupBy("__bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity / grain rows
    rows = layout(patterns(histogram, capacity // grain, gap))
    plan = cut.sparkSession.createDataFrame(rows, "p_bin long, low long, high long, copies long, first long, slot long")
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    ranked = grouped_number(cut, ["__bin"], ["doc_id", "start", "ids_crc32", "doc_tokens"], bucket, BUCKETS, "__rank")
    met = ranked.join(F.broadcast(plan), (F.col("__bin") == F.col("p_bin")) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")))
    k = F.col("__rank") - F.col("low")
    placed = met.withColumns({"sequence_id": (F.col("first") + F.floor(k / F.col("copies"))).cast("long"), "__slot": F.col("slot") + k % F.col("copies")})
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
