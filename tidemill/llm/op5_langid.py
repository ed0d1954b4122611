"""Language ID by a linear-chain conditional random field over words.

A text is the sequence of its words (runs of letters, in lower case). A word's features are its n-grams of two to four
bytes with marked ends (the marked ones are its affixes) and, if the training words know it, the word itself as a
lexicon entry. Emission weights of the features and a matrix of transitions are learned together by the gradient of the
conditional likelihood; forward-backward gives every word of a text a distribution over languages, so texts that switch
languages are labelled word by word. The language of a text is the one with the largest mean over its words, and the
score is that mean.

Words carry no labels of their own: a first fit gives every word of a labelled text the text's language, a second fit
uses the languages that the first decodes, so the transitions learn how texts switch. Training takes a bounded sample
among the labelled documents with letters whose crc32(doc_id) mod 4 is not 2: of each of the `LANGS` most frequent
languages the `TRAIN_DOCS` documents with the smallest hashes. Only ids are ranked; texts follow for the chosen ones.

Defined results: a null text, or one without letters, is `und` with score 0, and so is every text where no labelled
row can be learned from. The prediction depends on the text alone, so ties and repeated rows agree. An empty table
gives an empty result. Only doc_id, text and lang are read, and added columns get names that no column has, so extra
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, saved, unclashing

UNKNOWN = "und"
#: Documents of each language, and languages, that a fit learns from.
TRAIN_DOCS, LANGS = 400, 64
#: Hash bits of n-gram weights; words of a training segment; steps of a fit.
BITS, SEGMENT, STEPS = 18, 64, 30
LEXICON_COUNT = 5
#: Texts whose chains run side by side, texts that a worker holds the figures of at once, and words of a part of a fit.
WIDE, SLICE, PART = 512, 512, 1 << 15
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed n-gram) of all n-grams of the words, and a 64-bit hash of each word."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1 + words.offset)[words.offset :]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets).astype(np.int64)
    ends = np.cumsum(sizes + 2)
    flat = np.ones(int(ends[-1]) if n else 0, np.uint64)  # 1 marks both ends of a word
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    inside[ends - sizes - 2] = False
    flat[inside] = data[offsets[0] : offsets[-1]]
    owner = np.repeat(np.arange(n), sizes + 2)
    last = np.repeat(ends, sizes + 2)
    at = np.arange(len(flat))
    rolled, who, what = flat.copy(), [], []
    for k in range(1, 4):
        rolled[: len(flat) - k] = _mix(rolled[: len(flat) - k] * _P + flat[k:] + np.uint64(k))
        fits = at + k < last
        who.append(owner[fits])
        what.append((rolled[fits] & np.uint64((1 << BITS) - 1)).astype(np.int64))
    spread = _mix((flat + np.uint64(3)) * _P + (at - np.repeat(ends - sizes - 2, sizes + 2)).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    names = np.zeros(n, np.uint64)
    np.add.at(names, owner, spread)
    return np.concatenate(who), np.concatenate(what), names


@dataclass
class Model:
    """What a fit learns; all arrays are bounded by the parameters of the fit."""

    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    moves: np.ndarray

    def emissions(self, words: pa.StringArray) -> np.ndarray:
        who, what, names = features(words)
        out = np.stack([np.bincount(who, self.grams[what, c], len(words)) for c in range(len(self.langs))], 1)
        at = np.minimum(np.searchsorted(self.lexicon, names), max(0, len(self.lexicon) - 1))
        if len(self.lexicon):
            known = self.lexicon[at] == names
            out[known] += self.entries[at[known]]
        return out


def forward_backward(emit: np.ndarray, ends: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """The distribution of every word's label, the expected transitions, and the log-likelihood's partition sum.

    `emit` holds the log emissions of all texts, one after another, and `ends` where each text ends. Texts run side by
    side, longest first, in the probability domain with a scale for each step.
    """
    k = emit.shape[1]
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    top = emit.max(axis=1, keepdims=True)
    local, hop = np.exp(emit - top), np.exp(moves - moves.max())
    out, moved, log = np.empty_like(emit), np.zeros((k, k)), float(top.sum())
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(order), WIDE):
        group = order[a : a + WIDE]
        group = group[sizes[group] > 0]
        if not len(group):
            continue
        first, n = begins[group], sizes[group]
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # texts that have a word at each step
        alpha = local[first] / k
        for t in range(int(n[0])):
            at = first[: live[t]] + t
            if t:
                alpha = (alpha[: live[t]] @ hop) * local[at]
            scale = alpha.sum(axis=1, keepdims=True)
            alpha = alpha / scale
            out[at] = alpha
            log += float(np.log(scale).sum())
        beta = np.ones((len(group), k))
        for t in range(int(n[0]) - 1, 0, -1):
            at = first[: live[t]] + t
            right = local[at] * beta[: live[t]]
            back = right @ hop.T
            if pairs:
                joint = out[at - 1][:, :, None] * hop * right[:, None, :]
                moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            both = out[at] * beta[: live[t]]
            out[at] = both / both.sum(axis=1, keepdims=True)
            beta[: live[t]] = back / back.sum(axis=1, keepdims=True)
        both = out[first] * beta
        out[first] = both / both.sum(axis=1, keepdims=True)
    return out, moved, log


def parts_of(cuts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of whole segments with about PART words: (first word, word after the last, ends inside the run)."""
    begins = np.concatenate([[0], cuts[:-1]])
    a = 0
    while a < len(cuts):
        b = max(a + 1, int(np.searchsorted(cuts, begins[a] + PART, side="right")))
        yield int(begins[a]), int(cuts[b - 1]), cuts[a:b] - begins[a]
        a = b


def gradient(model: Model, who: np.ndarray, what: np.ndarray, common: np.ndarray, index: np.ndarray, cuts: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By word: label counts less expected ones; and observed less expected transitions. One part's figures are held at a time."""
    k, n = len(model.langs), int(index.max()) + 1
    emit = emissions_of(model, who, what, common, n)
    by_word, flow, eye = np.zeros((n, k)), np.zeros((k, k)), np.eye(k)
    for a, b, ends in parts_of(cuts):
        at, target = index[a:b], eye[label[a:b]]
        marginal, moved, _ = forward_backward(emit[at], ends, model.moves, pairs=True)
        slack = target - marginal
        by_word += np.stack([np.bincount(at, slack[:, c], n) for c in range(k)], 1)
        joined = np.ones(b - a, bool)
        joined[ends - 1] = False
        flow += target[:-1][joined[:-1]].T @ target[1:][joined[:-1]] - moved
    return by_word, flow, emit


def emissions_of(model: Model, who: np.ndarray, what: np.ndarray, common: np.ndarray, n: int) -> np.ndarray:
    """Log emissions of the n training words; `common` are those of the lexicon."""
    emit = np.stack([np.bincount(who, model.grams[what, c], n) for c in range(len(model.langs))], 1)
    emit[common] += model.entries
    return emit


def fit(texts: pa.ListArray, labels: np.ndarray, langs: list[str], steps: int = STEPS) -> Model:
    """A model of the labelled texts (lists of words)."""
    coded = texts.flatten().dictionary_encode()
    words, index = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
    ends = np.cumsum(texts.value_lengths().to_numpy()).astype(np.int64)
    k, n = len(langs), len(words)
    who, what, names = features(words)
    common = np.nonzero(np.bincount(index, minlength=n) >= LEXICON_COUNT)[0]
    common = common[np.argsort(names[common])]
    model = Model(langs, np.zeros((1 << BITS, k)), names[common], np.zeros((len(common), k)), np.zeros((k, k)))
    label = np.repeat(labels, np.diff(np.concatenate([[0], ends])))
    cuts = np.unique(np.concatenate([ends, np.arange(SEGMENT, len(index), SEGMENT)]))
    for stage in range(2):
        squares = [np.full(x.shape, 1e-8) for x in (model.grams, model.entries, model.moves)]
        for step in range(steps if stage == 0 else steps // 3):
            by_word, flow, _ = gradient(model, who, what, common, index, cuts, label)
            by_gram = np.stack([np.bincount(what, by_word[who, c], 1 << BITS) for c in range(k)], 1)
            rate = 0.3 / (1 + step / 10)
            for x, g, s in zip((model.grams, model.entries, model.moves), (by_gram - 0.02 * model.grams, by_word[common] - 0.02 * model.entries, flow), squares):
                s += g * g
                x += rate * g / np.sqrt(s)
        if stage == 0:  # the words' own languages, as far as the first fit is sure of them
            emit, label = emissions_of(model, who, what, common, n), label.copy()
            for a, b, inner in parts_of(cuts):
                marginal, _, _ = forward_backward(emit[index[a:b]], inner, model.moves)
                sure = marginal.max(axis=1) > 0.9
                label[a:b] = np.where(sure, marginal.argmax(axis=1), label[a:b])
    return model


def words_of(texts: pa.Array) -> pa.ListArray:
    """The lower-case words of each text, without nulls; none for a null text or one without letters."""
    bare = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"\PL+", " "))
    lists = pc.ascii_split_whitespace(bare)
    sizes = np.where(pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False), 0, lists.value_lengths().to_numpy())
    words = lists.flatten()
    words = words.filter(pc.greater(pc.binary_length(words), 0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), words)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang and a hash of the text of the documents that a fit learns from: at most `train_docs` of each of LANGS languages (more only where rows of the last repeat)."""
    usable = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), "text")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    # four times the share that suffices passes before anything is ranked; small languages pass whole
    share = F.least(F.lit(1.0), 4.0 * train_docs / F.col("n"))
    near = usable.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) <= share * (1 << 30)).where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", F.col("t"))
    return near.select("doc_id", "lang", "h", F.xxhash64("text").alias("t")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= train_docs).select(F.col("doc_id").alias("id"), "lang", "t").distinct()


def trained(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model of a bounded sample of labelled documents, or None if there are none."""
    chosen = saved(sampled(docs, train_docs).withColumnRenamed("lang", "lang_of"))
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("lang_of")) & (F.xxhash64("text") == F.col("t")))
    one = texts.groupBy("id", "lang", "t").agg(F.min("text").alias("text"))  # bounded by the sample, whatever repeats
    table = one.orderBy("lang", "id", "t").select("lang", "text").toArrow().combine_chunks()
    drop(chosen)
    if not len(table):
        return None
    langs = sorted(set(table["lang"].to_pylist()))
    labels = np.searchsorted(langs, table["lang"].to_pylist())
    lists = words_of(table["text"].combine_chunks())
    if len(langs) == 1:
        return Model(langs, np.zeros((1 << BITS, 1)), np.zeros(0, np.uint64), np.zeros((0, 1)), np.zeros((1, 1)))
    return fit(lists, labels, langs)


def predicted(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs`, then the language and its score under names that `docs` does not have."""
    kept = [F.col(c) for c in keep]
    lang, rated, given = unclashing(docs, "lang_found", "lang_score", "given")
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias(lang), F.lit(0.0).alias(rated))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters
    at = keep.index("text") if "text" in keep else len(keep)
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in keep), StructField(lang, StringType()), StructField(rated, DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for a in range(0, len(batch), SLICE):
                part = words_of(batch.column(at).slice(a, SLICE))
                sizes = part.value_lengths().to_numpy().astype(np.int64)
                best, score = np.full(len(part), len(m.langs)), np.zeros(len(part))
                if sizes.sum():
                    coded = part.flatten().dictionary_encode()
                    emit = m.emissions(coded.dictionary.cast(pa.string()))[coded.indices.to_numpy()]
                    marginal, _, _ = forward_backward(emit, np.cumsum(sizes), m.moves)
                    has = sizes > 0
                    ends = np.cumsum(sizes)[has]
                    mean = np.add.reduceat(marginal, ends - sizes[has], axis=0) / sizes[has][:, None]
                    best[has], score[has] = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, SLICE) for k in range(len(keep))), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=[*keep, lang, rated])
            pa.default_memory_pool().release_unused()  # workers are kept from task to task

    return docs.select(*kept, *(() if "text" in keep else [F.col("text").alias(given)])).mapInArrow(work, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    made = predicted(docs, trained(docs), ["doc_id"]).toDF("doc_id", "lang_pred", "score")
    return made.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of `docs` with a known language, with their columns; lang is what was predicted. Texts without letters, or without a language of the share `least`, go."""
    made = predicted(docs, trained(docs), docs.columns)
    lang, rated = made.columns[-2:]
    return made.where((F.col(lang) != UNKNOWN) & (F.col(rated) >= least)).withColumn("lang", F.col(lang)).select(*docs.columns)
