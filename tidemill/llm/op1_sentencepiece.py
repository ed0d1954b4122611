"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text is cut into units that no piece can cross (runs of word marks with the characters after them). Units of equal
length form a matrix and advance together: at each position the hashes of the substrings that end there probe the
sorted hashes of the pieces, and the best candidate's length is stored as a backpointer.

For a unigram model a candidate is worth the best score before it plus the piece's own. A BPE model does not add
scores up; but its segmentation is the one chain of pieces in which each neighbouring pair, encoded alone, stays that
pair. So there the search is a Viterbi search whose transitions admit such pairs only: the candidate that agrees with
the piece before it wins. Both give the ids of the sentencepiece library, byte fallback included.

Defined results: a null text is empty and has no ids. The ids depend on the text alone, so ties and repeated rows
agree. An empty table gives an empty result. Only doc_id and text are read, so extra columns cannot clash. Decoding
gives the text back, but that a word mark in a text reads as a space, as in the library. A worker's memory is bounded:
units and pairs that it remembers are forgotten beyond `UNITS` and `PAIRS`, which changes no result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNITS, PAIRS = 700_000, 1_000_000
#: Units of one length up to which each is searched alone, with the same result.
FEW = 4
_P = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _BYTE, _OWN = 1, 2, 6, 4
#: First id of characters that no piece spells: such a character's id is this plus its code point.
_LONE = 1 << 24
#: Hash bits that the table of possible keys leaves out.
_BITS = np.uint64(44)
_workers: dict[str, Model] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Model:
    """The pieces of a model file, and the search over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models with the identity normalizer are supported")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.bpe = spec.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = np.array([p.type for p in spec.pieces])
        self.scores = np.array([p.score for p in spec.pieces])
        self.bytes = {int(p[3:-1], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == _BYTE}
        self.names = list(self.pieces)
        for b, k in self.bytes.items():
            self.names[k] = chr(b) if b < 128 else ""
        self.high = np.zeros(len(self.pieces), bool)
        self.high[[k for b, k in self.bytes.items() if b >= 128]] = True
        self.unknown = int(np.nonzero(self.kinds == _UNKNOWN)[0][0])
        usable = np.nonzero(np.isin(self.kinds, (_NORMAL, _OWN)))[0]
        self.rank = {self.pieces[k]: (-self.scores[k], int(k)) for k in usable}
        if self.bpe:
            usable = np.array([k for k in usable if len(self.pieces[k]) == 1 or self._merged(self.pieces[k]) == [self.pieces[k]]])
        self.longest = max((len(self.pieces[k]) for k in usable), default=1)
        hashes = np.array([self._hash(self.pieces[k]) for k in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], usable[order].astype(np.int64)
        self.bits = np.zeros(1 << (64 - int(_BITS)), bool)  # most probes miss, and are seen to without a search
        self.bits[self.keys >> _BITS] = True
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a hash")
        self.least = float(self.scores[usable].min()) - 10 if len(usable) else -10.0
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.cut = re.compile(self._units())
        self.pairs: dict[int, bool] = {}
        self.table, self.truth = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, bool)
        self.forget()

    def _units(self) -> str:
        """A pattern of units: no piece has one of its cuts inside. A unit begins at word marks, or at a mark of punctuation that no piece has after another kind of character."""
        beside = {(x, y) for p in self.rank for x, y in zip(p, p[1:])}
        if any(y == MARK and x != MARK for x, y in beside):
            return "(?s:.+)"
        marks = set("\n\t\r!\"#$%&()*+,./:;<=>?@[]^_`{|}~-")
        while over := {y for x, y in beside if y in marks and x not in marks and x != MARK}:
            marks -= over
        own = "".join(map(re.escape, sorted(marks)))
        rest = f"[^{MARK}{own}]"
        return f"{MARK}*{rest}+|{MARK}*[{own}]+{rest}*|{MARK}+" if own else f"{MARK}*{rest}+|{MARK}+"

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.used, self.n = np.zeros(1 << 20, np.int32), 0, 0
        self.starts, self.sizes = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * _P + np.uint64(ord(c) + 1)
        return int(_mix(h + np.uint64(len(piece)))[0])

    def _merged(self, text: str) -> list[str]:
        """The merges of a BPE model, by their definition: again and again the adjacent pair whose joint piece ranks first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, k: int) -> str:
        return chr(k - _LONE) if k >= _LONE else self.pieces[k]

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces, encoded alone, stays that pair. A direct-mapped table answers what was asked before."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = (_mix(key * _P) & np.uint64(len(self.table) - 1)).astype(np.int64)
        for at in np.nonzero(self.table[slot] != key)[0].tolist():
            k = int(key[at])
            if k not in self.pairs:
                if len(self.pairs) > PAIRS:
                    self.pairs.clear()
                a, b = self._text(k >> 32), self._text(k & 0xFFFFFFFF)
                self.pairs[k] = self._merged(a + b) == [a, b]
            if self.table[slot[at]] != key[at]:
                self.table[slot[at]], self.truth[slot[at]] = key[at], self.pairs[k]
        out = self.truth[slot]
        for at in np.nonzero(self.table[slot] != key)[0].tolist():  # pushed out by another pair of this call
            out[at] = self.pairs.get(int(key[at])) if int(key[at]) in self.pairs else self._merged(self._text(int(left[at])) + self._text(int(right[at]))) == [self._text(int(left[at])), self._text(int(right[at]))]
        return out

    def viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units of one length, one unit after another, and how many each has; lone characters have ids from _LONE."""
        n, count = len(units[0]), len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(count, n).astype(np.uint64)
        hashes = np.zeros((count, n + 1), np.uint64)
        for j in range(n):
            hashes[:, j + 1] = hashes[:, j] * _P + codes[:, j] + np.uint64(1)
        powers = [np.uint64(1)]
        for _ in range(self.longest):
            powers.append(np.uint64(int(powers[-1]) * int(_P) % 2**64))
        best = np.full((count, n + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((count, n + 1), -1, np.int64)
        reached = best == 0
        for j in range(1, n + 1):
            for size in range(1, min(j, self.longest) + 1):
                i = j - size
                probe = _mix(hashes[:, j] - hashes[:, i] * powers[size] + np.uint64(size))
                who = np.nonzero(reached[:, i] & (self.bits[probe >> _BITS] | (size == 1)))[0]
                if not len(who):
                    continue
                at = np.minimum(np.searchsorted(self.keys, probe[who]), len(self.keys) - 1)
                hit = self.keys[at] == probe[who]
                piece = self.ids[at]
                if size > 1:
                    who, piece = who[hit], piece[hit]
                    worth = self.scores[piece]
                else:
                    worth = np.where(hit, self.scores[piece], self.least)
                    piece = np.where(hit, piece, _LONE + codes[who, i].astype(np.int64))
                if self.bpe:
                    if i and len(who):
                        fits = self._agree(last[who, i], piece)
                        who, piece = who[fits], piece[fits]
                    worth = np.zeros(len(who))
                total = best[who, i] + worth
                better = total > best[who, j]
                who = who[better]
                best[who, j], last[who, j], reached[who, j] = total[better], piece[better], True
        who, what, at = [], [], np.full(count, n)
        live = np.arange(count)
        while live.size:  # backpointers, from the ends
            piece = last[live, at[live]]
            who.append(live)
            what.append(piece)
            at[live] -= np.where(piece >= _LONE, 1, self.lengths[np.minimum(piece, len(self.lengths) - 1)])
            live = live[at[live] > 0]
        owner, ids = np.concatenate(who[::-1]), np.concatenate(what[::-1])
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=count)

    def single(self, unit: str) -> np.ndarray:
        """What viterbi() gives for one unit: all its substrings are probed at once, and the path is searched over the hits, so a unit of any length costs its length."""
        n = len(unit)
        codes = np.frombuffer(unit.encode("utf-32-le"), np.uint32).astype(np.uint64)
        starts, ends, pieces = [np.arange(n)], [np.arange(1, n + 1)], [_LONE + codes.astype(np.int64)]
        rolled = np.zeros(n, np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            rolled = rolled[: n - size + 1] * _P + codes[size - 1 :] + np.uint64(1)
            probe = _mix(rolled + np.uint64(size))
            who = np.nonzero(self.bits[probe >> _BITS])[0]
            at = np.minimum(np.searchsorted(self.keys, probe[who]), len(self.keys) - 1)
            who, piece = who[self.keys[at] == probe[who]], self.ids[at][self.keys[at] == probe[who]]
            if size == 1:
                pieces[0][who] = piece
            else:
                starts.append(who)
                ends.append(who + size)
                pieces.append(piece)
        i, j, piece = (np.concatenate(x) for x in (starts, ends, pieces))
        order = np.lexsort((-i, j))  # by end, shorter pieces first
        best, last = [0.0] + [float("-inf")] * n, [-1] * (n + 1)
        worth = np.where(piece >= _LONE, self.least, self.scores[np.minimum(piece, len(self.scores) - 1)])
        stays = {}
        for a, b, k, w in zip(i[order].tolist(), j[order].tolist(), piece[order].tolist(), worth[order].tolist()):
            if self.bpe:
                if best[b] == 0.0 or best[a] != 0.0:  # reached already, or not to be reached from here
                    continue
                if a:
                    pair = (last[a] << 32) | k
                    if pair not in stays:
                        left, right = self._text(last[a]), self._text(k)
                        stays[pair] = self._merged(left + right) == [left, right]
                    if not stays[pair]:
                        continue
                w = 0.0
            if best[a] + w > best[b]:
                best[b], last[b] = best[a] + w, k
        out, at = [], n
        while at:
            out.append(last[at])
            at -= 1 if last[at] >= _LONE else int(self.lengths[last[at]])
        return np.array(out[::-1], np.int64)

    def _final(self, ids: list[int]) -> list[int]:
        """Lone characters as byte pieces, or as one unknown piece a run where the model has no bytes."""
        out: list[int] = []
        for k in ids:
            if k < _LONE:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(k - _LONE).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _learn(self, units: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for u in units:
            by.setdefault(len(u), []).append(u)
        for length in sorted(by):
            step = max(1, 2_000_000 // (length + 1))
            for a in range(0, len(by[length]), step):
                part = by[length][a : a + step]
                if len(part) > FEW:
                    ids, sizes = self.viterbi(part)
                else:
                    each = [self.single(u) for u in part]
                    ids, sizes = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
                if (ids >= _LONE).any():
                    each = [self._final(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
                    ids, sizes = np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))
                self._keep(part, ids, sizes)

    def _keep(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total, k = len(ids), self.n
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while k + len(units) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        self.flat[self.used : self.used + total] = ids
        self.starts[k : k + len(units)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[k : k + len(units)] = sizes
        self.used, self.n = self.used + total, k + len(units)
        self.seen.update(zip(units, range(k, k + len(units))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.n > UNITS:
            self.forget()
        cut = [self.cut.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*cut) - self.seen.keys()
        if new:
            self._learn(sorted(new))
        get = self.seen.__getitem__
        out = []
        for units in cut:
            x = np.fromiter(map(get, units), np.int64, len(units))
            size = self.sizes[x]
            ends = np.cumsum(size)
            at = np.repeat(self.starts[x] - (ends - size), size) + np.arange(ends[-1] if len(x) else 0)
            out.append(self.flat[at])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, runs of bytes read as UTF-8, word marks as spaces, without the added prefix."""
        names = self.names
        if not self.high[ids].any():
            text = "".join([names[k] for k in ids.tolist()])
        else:
            kinds, names, parts, run = self.kinds[ids], self.pieces, [], bytearray()
            for k, kind in zip(ids.tolist(), kinds.tolist()):
                if kind == _BYTE:
                    run.append(int(names[k][3:-1], 16))
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(names[k])
            if run:
                parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _worker(path: str) -> Model:
    return _workers.get(path) or _workers.setdefault(path, Model(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, an array of ints, of every row of `docs`. `path` is the model file, which every executor must see."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids = model.encode(batch.column(1).slice(at, 256).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned, little-endian unsigned 32-bit ids), n_bytes (byte pieces) and round_trip (decoding gives the text back)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                ids = model.encode(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, 256), pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([int((model.kinds[x] == _BYTE).sum()) for x in ids], pa.int64()), pa.array([model.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts)]),
                ], names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean")
