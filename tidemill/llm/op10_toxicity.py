"""Toxicity by noisy-channel deobfuscation.

A token that may hide a word (digits or marks between letters, letters repeated, letters spaced out) becomes a lattice:
each character may stand for itself, for the letters that it resembles, or for nothing (marks, repetitions). A Viterbi
search finds the letters with the best product of channel and character-language-model probabilities; the model is a
trigram model whose counts come from every document, over the symbols that the search scores. A token of letters alone
without a letter after itself has a lattice with one path, so it is its own restoration; any doubled letter makes two.
Learning and scoring restore alike, so labels do not bend the channel.

The restored words are then scored by logistic regression over words and their prefixes of four to six letters; a
document is at least as toxic as the lower end of its surest feature's interval, where that is `SURE` or more. The
features are those whose share of toxic documents, by the lower end of a Wilson interval, is well above the base rate.
Labels come from a bounded sample: the `TRAIN_DOCS` labelled rows with the smallest hashes among those whose
crc32(doc_id) mod 5 is not 0.

Defined results: a null or empty text has no words and gets the base rate; without usable labels every score is 0. The
score depends on the text alone, so ties and repeated rows agree; repeated label rows count as often as they occur, and
labels without a document not at all; of
documents that share an id the smallest text is learned from. An empty table gives an empty result. Only doc_id and text of the documents and
doc_id and toxic of the labels are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop, saved
from .op5_langid import remainder

TRAIN_DOCS = 8000
#: Documents that a feature needs, z of its Wilson interval, how far above the base rate its lower end must lie, and from where it decides alone.
LEAST_DOCS, Z, ABOVE, SURE = 4, 1.96, 3.0, 0.7
PREFIXES = (4, 5, 6)
STEPS, RIDGE = 600, 0.005
#: Paths kept in each state of the search.
PATHS = 2
#: Rows whose tokens a worker unpacks at once.
SLICE = 1024

#: Letters that a digit or mark may stand for.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Channel costs in nats.
ITSELF, LOOKS, DROPPED, BREAK = 0.05, 1.2, 1.0, 3.0
#: Of dropping a digit or mark that is often a letter, and of dropping a letter after itself in a run of two and in longer runs.
UNREAD, DOUBLED, REPEATED = 7.0, 2.5, 0.2

#: Symbols of the language model: a word's edge, a to z, and one for all other letters.
EDGE, OTHER, SYMBOLS = 0, 27, 28
_BYTE = np.full(256, OTHER, np.int64)
_BYTE[:192] = -1  # a letter beyond ASCII counts by its first byte
for _k in range(26):
    _BYTE[ord("a") + _k] = _k + 1

_RUN = re.compile(r"([^\W\d_])\1")
_BLANKS = re.compile(f"[{SPACE}]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_MAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+\Z")
_ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$!")


def tokens_of(text: Column) -> Column:
    """The white-space tokens of a text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def spaced_of(text: Column) -> Column:
    """Runs of three or more white-space tokens with one letter or digit at most and any marks around it."""
    mark = rf"[^\p{{L}}\p{{N}}{SPACE}]*+"
    one = rf"(?=[^{SPACE}]){mark}(?:[\p{{L}}\p{{N}}]{mark})?+(?![^{SPACE}])"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?<![^{SPACE}]){one}(?:[{SPACE}]++{one}){{2,}}+"), F.lit(0))


def symbol(letter: str) -> int:
    k = ord(letter) - 96
    return k if 1 <= k <= 26 else OTHER


def trigram_counts(tokens: pa.StringArray, times: np.ndarray) -> np.ndarray:
    """Trigrams of symbols in the letters of the tokens, each token `times` as often: the symbols that the search scores. Marks are none."""
    tokens = pc.replace_substring_regex(pc.utf8_lower(tokens), r"[^\pL]+", "")
    n = len(tokens)
    out = np.zeros(SYMBOLS**3, np.int64)
    if not n:
        return out
    offsets = np.frombuffer(tokens.buffers()[1], np.int32, n + 1 + tokens.offset)[tokens.offset :]
    data = np.frombuffer(tokens.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kept = _BYTE[data] >= 0
    owner, mark = owner[kept], _BYTE[data[kept]]
    sizes = np.bincount(owner, minlength=n)
    has = sizes > 0
    sizes, weight = sizes[has], times[has]
    ends = np.cumsum(sizes + 3)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)  # two edges before, one after
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    inside[ends - sizes - 3] = False
    inside[ends - sizes - 2] = False
    flat[inside] = mark
    last = np.repeat(ends, sizes + 3)
    fits = np.nonzero(np.arange(len(flat)) + 2 < last)[0]
    code = (flat[fits] * SYMBOLS + flat[fits + 1]) * SYMBOLS + flat[fits + 2]
    return np.bincount(code, np.repeat(weight, sizes + 3)[fits], SYMBOLS**3).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most `rows` rows; what a batch held is given back, as workers are kept from task to task."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def language_model(docs: DataFrame) -> np.ndarray:
    """-log P(third | first, second) as a cube of symbols, from all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            coded = batch.column(0).flatten().dictionary_encode()
            sums += trigram_counts(coded.dictionary.cast(pa.string()), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["code", "n"])

    parts = docs.select(tokens_of(F.col("text")).alias("t")).mapInArrow(count, "code long, n long")
    cube = np.full(SYMBOLS**3, 0.1)
    for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS ** 3 rows
        cube[r["code"]] += r["n"]
    cube = cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return -np.log(cube / cube.sum(axis=2, keepdims=True))


@dataclass
class Restorer:
    """The search over character lattices; the same when learning and when scoring."""

    model: list
    seen: dict = field(default_factory=dict)

    def words(self, token: str) -> tuple[str, ...]:
        """The words that a token or spaced-out run stands for; its plain letters too, for a doubled letter is often right."""
        w = _BLANKS.sub(" ", token).lower().strip(_ENDS + " ")
        if not w:
            return ()
        if w.isalpha() and not _RUN.search(w):
            return (w,)
        if len(self.seen) > 200_000:
            self.seen.clear()
        if w not in self.seen:
            self.seen[w] = self._restored(w)
        return self.seen[w]

    def _restored(self, w: str) -> tuple[str, ...]:
        plain = tuple(x for x in _LETTERS.findall(w))
        if not plain or _MAIL.match(w):
            return plain
        found = self.decode(w)
        return tuple(dict.fromkeys((*found, *plain)))

    def decode(self, w: str) -> list[str]:
        """Viterbi over the lattice: states are the last two symbols and the last letter; each keeps its best PATHS."""
        model = self.model
        states: dict[tuple, list] = {(EDGE, EDGE, ""): [(0.0, "")]}
        before = ""
        for at, x in enumerate(w):
            step: dict[tuple, list] = {}
            letter = x.isalpha()
            options = [(x, ITSELF)] if letter else [(y, LOOKS) for y in RESEMBLES.get(x, "")]
            for (a, b, last), paths in states.items():
                for y, cost in options:
                    s = symbol(y)
                    gain = cost + model[a][b][s]
                    _add(step, (b, s, y), [(c + gain, t + y) for c, t in paths])
                if letter:
                    if last == x == before:
                        cost = REPEATED if 3 * x in w[max(0, at - 2) : at + 3] else DOUBLED
                        _add(step, (a, b, last), [(c + cost, t) for c, t in paths])
                else:
                    _add(step, (a, b, last), [(c + (0.1 if x == " " else UNREAD if x in "@$" or x.isdigit() else 0.1 if x == before else DROPPED), t) for c, t in paths])
                    if b != EDGE:
                        gain = BREAK + model[a][b][EDGE]
                        _add(step, (EDGE, EDGE, ""), [(c + gain, t + " ") for c, t in paths])
            states, before = step, x
        ends = [(c + model[a][b][EDGE], t) for (a, b, _), paths in states.items() for c, t in paths]
        return min(ends)[1].split()


def _add(step: dict, key: tuple, paths: list) -> None:
    have = step.get(key)
    step[key] = paths if have is None else sorted(have + paths)[:PATHS]


def parts_of(word: str) -> Iterable[str]:
    """The features of a word: itself, and its prefixes."""
    yield "=" + word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n]


@dataclass
class Scorer:
    """Weights of features and their base."""

    weights: dict
    sure: dict
    base: float
    model: list

    def score(self, features: Iterable[str]) -> float:
        """The regression's probability, or the surest feature's share of toxic documents if that is more."""
        found = list(features)
        fitted = float(1 / (1 + np.exp(-np.clip(self.base + sum(self.weights[x] for x in found), -40, 40))))
        return max([fitted, *(self.sure[x] for x in found if x in self.sure)])


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*more, tokens_of(F.col("text")).alias("t"), spaced_of(F.col("text")).alias("s"))


def restored_words(sample: DataFrame, model: list) -> DataFrame:
    """doc_id, toxic and the different restored words of each row of `sample` (doc_id, toxic, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches):
            words = [sorted({w for x in (*t, *s) for w in restorer.words(x)}) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["row", "toxic", "words"])

    return _rows(sample, F.col("row"), F.col("toxic")).mapInArrow(work, "row long, toxic int, words array<string>")


def trained(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Scorer | None:
    """A scorer from a bounded sample of labelled rows, or None if it holds no row of either kind."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    chosen = usable.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id", "toxic").limit(train_docs).withColumn("at", F.monotonically_increasing_id())
    chosen = saved(chosen)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("id").distinct()), F.col("doc_id") == F.col("id"))
    sample = texts.groupBy("id").agg(F.min("text").alias("text")).join(chosen, "id")  # at most train_docs rows: of documents with one id the smallest text
    model = language_model(docs).tolist()
    rows = saved(restored_words(sample.select(F.xxhash64("id", "at").alias("row"), "toxic", "text"), model))
    drop(chosen)
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total or toxic in (0, total):
        drop(rows)
        return None if not total else Scorer({}, {}, 40.0 if toxic else -40.0, model)
    pieces = F.flatten(F.transform("words", lambda w: F.array(F.concat(F.lit("="), w), *(F.when(F.length(w) > n, F.substring(w, 1, n)) for n in PREFIXES))))
    spread = rows.select("row", "toxic", F.explode(F.array_distinct(F.array_compact(pieces))).alias("x"))
    counted = spread.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= LEAST_DOCS)
    p = F.col("k") / F.col("n")
    low = (p + Z * Z / (2 * F.col("n")) - Z * F.sqrt((p * (1 - p) + Z * Z / (4 * F.col("n"))) / F.col("n"))) / (1 + Z * Z / F.col("n"))
    picked = saved(counted.withColumn("low", low).where(F.col("low") > min(0.5, ABOVE * toxic / total)).select("x", "low"))
    lows = {r["x"]: r["low"] for r in picked.collect()}  # bounded by the sample's words
    names = sorted(lows)
    held = spread.join(F.broadcast(picked), "x", "left_semi").groupBy("row").agg(F.collect_set("x").alias("xs"))
    table = rows.select("row", "toxic").join(held, "row", "left").select("toxic", "xs").collect()  # at most train_docs rows
    drop(rows, picked)
    at = {x: k for k, x in enumerate(names)}
    y = np.array([r["toxic"] for r in table], dtype=float)
    owner = np.array([k for k, r in enumerate(table) for _ in r["xs"] or ()], dtype=np.int64)
    column = np.array([at[x] for r in table for x in r["xs"] or ()], dtype=np.int64)
    order = np.lexsort((column, owner))
    owner, column = owner[order], column[order]
    weights, base = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean())))
    squares, square = np.full(len(names), 1e-8), 1e-8
    for _ in range(STEPS):
        slack = y - 1 / (1 + np.exp(-(base + np.bincount(owner, weights[column], len(y)))))
        g = np.bincount(column, slack[owner], len(names)) - RIDGE * weights
        squares += g * g
        weights += 0.3 * g / np.sqrt(squares)
        g0 = slack.sum()
        square += g0 * g0
        base += 0.3 * g0 / np.sqrt(square)
    return Scorer(dict(zip(names, weights.tolist())), {x: v for x, v in lows.items() if v >= SURE}, base, model)


def scored(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id and score of every row of `docs`."""
    if scorer is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by the training sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.model)
        weights = m.weights
        a, b, c = PREFIXES

        def found(token: str) -> tuple:
            return tuple({x for w in restorer.words(token) for x in parts_of(w) if x in weights})

        def quick(token: str) -> bool:
            """Whether the token can have a feature: a plain word only if its own parts are features."""
            w = token if token.islower() else token.lower()
            if not w.isalpha():
                w = w.strip(_ENDS)
                if not w.isalpha():
                    return bool(w)
            return w[:a] in weights or w[:b] in weights or w[:c] in weights or "=" + w in weights or _RUN.search(w) is not None

        for batch in slices(batches, 2 * SLICE):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            some = {k: x for k, t in enumerate(names) if quick(t) and (x := found(t))}
            has = np.zeros(len(names) + 1, bool)
            has[list(some)] = True
            index = coded.indices.to_numpy()
            where = np.nonzero(has[index])[0]
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[where]
            features: dict[int, set] = {}
            for d, k in zip(owner.tolist(), index[where].tolist()):
                features.setdefault(d, set()).update(some[k])
            for d, runs in enumerate(batch.column(2).to_pylist()):
                for run in runs:
                    if x := found(run):
                        features.setdefault(d, set()).update(x)
            base = m.score(())
            score = [m.score(sorted(features[d])) if d in features else base for d in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([docs.schema["doc_id"], StructField("score", DoubleType())])
    return _rows(docs, F.col("doc_id")).mapInArrow(work, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    made = scored(docs, trained(docs, labels))
    return made.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
