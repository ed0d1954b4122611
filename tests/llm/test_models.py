"""SentencePiece against the library, embeddings against all pairs, language ID and toxicity by held-out accuracy and brute force."""

import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidemill.llm import op1_sentencepiece as S
from tidemill.llm import op4_ego as E
from tidemill.llm import op5_langid as L
from tidemill.llm import op10_toxicity as T
from tidemill.llm.queries import tokenizer_path

ODD = ["", "  a  b ", "漢字😀 x", "\n\n\ta\r\n", "▁x▁▁y", " lead", "a" * 300, "trail   ", "é́ ﬁ", "x\x00y", "the of and some plain words", "z" * 5000]


def piece_models(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = tokenizer_path("piece_bpe_32k.model")
    spec = pb.ModelProto()
    spec.ParseFromString(open(path, "rb").read())
    spec.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
    (tmp_path / "unigram.model").write_bytes(spec.SerializeToString())
    return [path, str(tmp_path / "unigram.model")]


def test_pieces_as_the_library(tmp_path):
    import sentencepiece

    rng = random.Random(5)
    words = ["the", "of", "Tion", "éeaux", "schlich", "ción", "token", "=", "123", "a.b@c.de", "THE!!", "x" * 30, "\n", "漢", "  "]
    texts = ODD + [" ".join(rng.choice(words) + rng.choice(["", ",", "s", "ing"]) for _ in range(12)) for _ in range(200)]
    for path in piece_models(tmp_path):
        library, mine = sentencepiece.SentencePieceProcessor(model_file=path), S.Model(path)
        for text, ids in zip(texts, mine.encode(texts)):
            want = library.encode(text)
            if path.endswith("unigram.model"):  # equal scores may be reached by several paths
                total = lambda xs: sum(mine.least if mine.kinds[k] == 6 else mine.scores[k] for k in xs)
                assert total(ids) >= total(want) - 1e-6 * abs(total(want))
            else:
                assert ids.tolist() == want, text
            assert mine.decode(ids) == text.replace("▁", " ")


def test_piece_queries(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    frame = spark.createDataFrame([*((k, t, 0) for k, t in enumerate(ODD)), (None, None, 0)], "doc_id long, text string, ids int")
    rows = S.digest(frame, path).collect()
    assert len(rows) == len(ODD) + 1 and all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in S.decoded(S.encoded(frame, path), path).collect()}
    assert all(back[k] == t.replace("▁", " ") for k, t in enumerate(ODD)) and back[None] == ""
    assert S.digest(frame.limit(0), path).count() == 0


def vectors(seed=2, n=700, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    x = base[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * rng.choice([0.0, 0.05, 0.1, 0.2], (n, 1))
    x[::50] *= 1e3
    return x.astype(np.float32)


@pytest.mark.parametrize("sample", [4096, 60])  # with few sampled vectors, intervals are dealt into parts
def test_embeddings(spark, monkeypatch, sample):
    monkeypatch.setattr(E, "BLOCK_BYTES", 8 * 16 * 60)
    monkeypatch.setattr(E, "SAMPLE", sample)
    monkeypatch.setattr(E, "LEAF", 32)
    x = vectors()
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("inf")] + [1.0] * 15, 0), (1005, [], 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (None, x[0].tolist(), 0)]
    got = {r.vec_id: r for r in E.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")).collect()}
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum(), label[k], label[k] == k)
    for k in (1000, 1001, 1002, 1003, 1004, 1005):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[1006].n_links, got[1007].component_id) == (1, 1006) and got[None].n_links == 0
    assert E.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ego_skips_distant_blocks():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1, 8)) * 3 + rng.normal(size=(512, 8)) * 0.05 for _ in range(4)])
    frame = E.Frame(list(x))
    side = E.Side(np.arange(len(x)), np.ones(len(x), np.int64), x, frame, E.epsilon(0.95))
    _, compared = E.join_blocks(side, side, 0.95, E.epsilon(0.95))
    leaves = len(side.cuts) - 1
    assert compared < leaves * (leaves + 1) / 2
    u = E.unit(x)
    z = frame.coordinates(u)
    a, b = rng.integers(0, len(x), (2, 2000))
    assert (np.linalg.norm(z[a] - z[b], axis=1) <= np.linalg.norm(u[a] - u[b], axis=1) + 1e-12).all()


def brute_chain(emit, moves):
    """Marginals by summing over all label sequences."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = np.exp(sum(emit[t, c] for t, c in enumerate(labels)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        for t, c in enumerate(labels):
            out[t, c] += w
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(4)
    emit, moves, ends = rng.normal(size=(12, 3)), rng.normal(size=(3, 3)), np.array([5, 5, 6, 12])
    got, moved, _ = L.forward_backward(emit, ends, moves, pairs=True)
    want = np.concatenate([brute_chain(emit[a:b], moves) for a, b in ((0, 5), (5, 6), (6, 12))])
    assert np.allclose(got, want) and np.isclose(moved.sum(), 4 + 0 + 5)


def test_languages(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "ko", "ki", "mu"], "bb": ["stra", "schlo", "beng", "um"], "cc": ["éo", "que", "eau", "ré"]}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(k, say(lang := rng.choice("abc") * 2, rng.randint(1, 60)), lang, 0.5) for k in range(400)]
    rows += [(900, None, "aa", 0.5), (901, "123 ... !!", "bb", 0.5), (902, "", None, 0.5), (None, say("aa", 20), None, 0.5), (903, say("bb", 30) + " " + say("cc", 10), None, 0.5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in L.digest(frame).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in range(400) if got[k].held_out]
    assert held and np.mean([got[k].lang_pred == rows[k][2] for k in held]) > 0.97
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "bb" and got[None].lang_pred == "aa"
    out = L.identified(frame)
    assert out.columns == frame.columns and out.where("doc_id in (900, 901, 902)").count() == 0
    assert L.digest(frame.limit(0)).count() == 0
    assert {r.lang_pred for r in L.digest(frame.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def brute_restore(model, w):
    """The best restoration by trying every path of the lattice."""
    paths = [(0.0, (T.EDGE, T.EDGE), "", "")]
    for at, x in enumerate(w):
        new = []
        for cost, (a, b), last, text in paths:
            for y, c in [(x, T.ITSELF)] if x.isalpha() else [(y, T.LOOKS) for y in T.RESEMBLES.get(x, "")]:
                new.append((cost + c + model[a][b][T.symbol(y)], (b, T.symbol(y)), y, text + y))
            before = w[at - 1] if at else ""
            if x.isalpha():
                if last == x == before:
                    new.append((cost + (T.REPEATED if 3 * x in w[max(0, at - 2) : at + 3] else T.DOUBLED), (a, b), last, text))
            else:
                new.append((cost + (0.1 if x == " " else T.UNREAD if x in "@$" or x.isdigit() else 0.1 if x == before else T.DROPPED), (a, b), last, text))
                if b != T.EDGE:
                    new.append((cost + T.BREAK + model[a][b][T.EDGE], (T.EDGE, T.EDGE), "", text + " "))
        paths = new
    return min(c + model[a][b][T.EDGE] for c, (a, b), _, _ in paths), {t for c, (a, b), _, t in paths if c + model[a][b][T.EDGE] <= min(p[0] + model[p[1][0]][p[1][1]][T.EDGE] for p in paths) + 1e-9}


def small_model():
    words = pa.array("the idiot was a stupid loser and clown of the worthless trash in riot patio hello good letters".split() * 3)
    cube = T.trigram_counts(words, np.ones(len(words), np.int64)).reshape((T.SYMBOLS,) * 3) + 0.1
    return (-np.log(cube / cube.sum(axis=2, keepdims=True))).tolist()


def test_trigrams_are_those_that_the_search_scores():
    words, times = ["schön", "Straße", "it's", "“quoted”", "x1y", "123", "ÉÀ"], [1, 2, 3, 1, 1, 1, 2]
    want = np.zeros((T.SYMBOLS,) * 3, np.int64)
    for w, n in zip(words, times):
        marks = [T.symbol(c) for c in w.lower() if c.isalpha()]
        for x in zip([T.EDGE, T.EDGE, *marks], [T.EDGE, *marks, T.EDGE], [*marks, T.EDGE]) if marks else ():
            want[x] += n
    assert (T.trigram_counts(pa.array(words), np.array(times)) == want.reshape(-1)).all()


def test_doubled_letters_of_many_kinds():
    words = pa.array("clown idiot schön und der wort ist gut".split() * 5)
    cube = T.trigram_counts(words, np.ones(len(words), np.int64)).reshape((T.SYMBOLS,) * 3) + 0.1
    r = T.Restorer((-np.log(cube / cube.sum(axis=2, keepdims=True))).tolist())
    for token, word in {"cloown": "clown", "idiiot": "idiot", "schöön": "schön"}.items():
        assert word in r.words(token)


def test_features_by_hand():
    words = ["a", "straße", "año", "the", "a"]
    who, what, names = L.features(pa.array(words))
    mix = lambda x: int(L._mix(np.array([x % 2**64], np.uint64))[0])
    want = []
    for k, w in enumerate(words):
        marks = [1, *w.encode(), 1]
        for at in range(len(marks)):
            code = marks[at]
            for n in range(1, 4):
                if at + n < len(marks):
                    code = mix(code * int(L._P) + marks[at + n] + n)
                    want.append((k, code & ((1 << L.BITS) - 1)))
    assert sorted(zip(who.tolist(), what.tolist())) == sorted(want)
    assert names[0] == names[4] and len(set(names.tolist())) == 4


def test_gradient_by_differences():
    rng = np.random.default_rng(5)
    words, index = pa.array(["ab", "bc", "cde", "ab c"]), np.array([0, 1, 2, 0, 3, 1, 2])
    cuts, label = np.array([3, 4, 7]), rng.integers(0, 3, 7)
    who, what, names = L.features(words)
    common = np.array([1, 2])
    model = L.Model(["x", "y", "z"], rng.normal(size=(1 << L.BITS, 3)) * 0.3, names[common], rng.normal(size=(2, 3)), rng.normal(size=(3, 3)))

    def likelihood():
        emit, total = L.emissions_of(model, who, what, common, 4)[index], 0.0
        for a, b in ((0, 3), (3, 4), (4, 7)):
            score = lambda ys, a=a, emit=emit: sum(emit[a + k, y] for k, y in enumerate(ys)) + sum(model.moves[p, q] for p, q in zip(ys, ys[1:]))
            total += score(label[a:b]) - np.log(sum(np.exp(score(ys)) for ys in itertools.product(range(3), repeat=b - a)))
        return total

    by_word, flow, _ = L.gradient(model, who, what, common, index, cuts, label)
    step = 1e-5
    for array, got in ((model.moves, flow), (model.entries, by_word[common])):
        for at in np.ndindex(*array.shape):
            array[at] += step
            up = likelihood()
            array[at] -= 2 * step
            assert abs((up - likelihood()) / (2 * step) - got[at]) < 1e-5
            array[at] += step
    gram = int(what[0])
    assert (np.bincount(what, by_word[who, 1], 1 << L.BITS)[gram] != 0) == (gram in what)


def test_parts_hold_whole_segments(monkeypatch):
    monkeypatch.setattr(L, "PART", 5)
    cuts = np.array([2, 3, 9, 10, 14])
    runs = list(L.parts_of(cuts))
    assert [(a, b, e.tolist()) for a, b, e in runs] == [(0, 3, [2, 3]), (3, 9, [6]), (9, 14, [1, 5])]


def test_sample_is_bounded_by_language(spark):
    rows = [(k, f"text number {k} of a common tongue", "aa") for k in range(300)] + [(1000 + k, f"text {k} rare", "bb") for k in range(20)] + [(5, "text", "aa")] * 50 + [(2000, "123", "cc")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.lang: r["count"] for r in L.sampled(frame, 30).groupBy("lang").count().collect()}
    assert got["aa"] <= 30 and got["bb"] == sum(zlib.crc32(str(1000 + k).encode()) % 4 != 2 for k in range(20)) and "cc" not in got
    clash = frame.selectExpr("doc_id", "text", "lang", "1 as words", "2 as lang_found", "'x' as lang_score", "3 as id", "4 as t")
    out = L.identified(clash)
    assert out.columns == clash.columns and out.count() > 0


@pytest.mark.parametrize("token", ["1d10t", "st00pid", "l.o.s.e.r", "i d i o t", "clooown", "tr@sh", "l0s3rr", "go0d|", "a1b2", "w0rth"])
def test_lattice_search(token):
    model = small_model()
    _, best = brute_restore(model, token)
    assert " ".join(T.Restorer(model).decode(token)) in {" ".join(t.split()) for t in best}


def test_restores_insults():
    r = T.Restorer(small_model())
    for token, word in {"1d10t": "idiot", "i d i o t": "idiot", "l0s3r": "loser", "tr@sh!!": "trash", "s-t-u-p-i-d": "stupid", "cloooown": "clown", "plain": "plain"}.items():
        assert word in r.words(token)
    assert r.words("...") == () and r.words("a@b.cd") == ("a", "b", "cd") and r.words("12345") == ()


def test_toxicity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["the", "on", "er", "an", "ti", "re"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(600):
        words, bad = [word() for _ in range(rng.randint(5, 60))], rng.random() < 0.2
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "trash", "moron", "IDIOT!", "mo.ron", "tra5h"] if k > 200 else ["idiot", "trash", "moron"]))
        rows.append((k, " ".join(words), 0.1))
        if k < 500:
            labels.append((k, int(bad), 1))
    rows += [(900, None, 0.0), (901, "", 0.0), (902, "x" * 20000, 0.0), (None, "idiot idiot", 0.0), (903, "you are an i d i o t", 0.0), (904, "such an 1d10t", 0.0)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (7000, 1, 1)], "doc_id long, toxic int, text int")
    got = {r.doc_id: r for r in T.digest(frame, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[k].predicted, y) for k, y, _ in labels if got[k].held_out]
    assert held and np.mean([a == b for a, b in held]) > 0.95
    assert [got[k].predicted for k in (900, 901, 902, None, 903, 904)] == [0, 0, 0, 1, 1, 1]
    assert T.digest(frame.limit(0), marks).count() == 0
    assert {r.score for r in T.digest(frame, marks.limit(0)).collect()} == {0.0}


def test_spaced_runs_with_marks(spark):
    runs = ["i d i o t", "i d i o t.", "i d i o t,", "i d i o t!", "(i d i o t)", '"i d i o t"', "\u201ci d i o t\u201d", "i. d. i. o. t.", "i  d\ti\n\no  t", "*i* d i 0 t?!", "... i d i o t -"]
    texts = [x for run in runs for x in (run, f"such that {run}", f"{run} said he", f"such that {run} said he")]
    found = [r.s for r in spark.createDataFrame([(t,) for t in texts], "text string").select(T.spaced_of(F.col("text")).alias("s")).collect()]
    r = T.Restorer(small_model())
    assert [[t, x] for t, x in zip(texts, found) if len(x) != 1 or "idiot" not in r.words(x[0])] == []
    rows = spark.createDataFrame([("a b c",), ("so a b is",), ("ab c d",), ("",), (None,), ("1 2 ab 3 4",)], "text string").select(T.spaced_of(F.col("text")).alias("s")).collect()
    assert [r.s for r in rows] == [["a b c"], [], [], [], [], []]


def test_doubled_letters(spark):
    r = T.Restorer(small_model())
    for token, word in {"stuupid": "stupid", "iidiot": "idiot", "cclown": "clown", "LOSERR!": "loser", "wworthless": "worthless"}.items():
        assert word in r.words(token)
    assert "hello" in r.words("hello") and "letters" in r.words("letters") and r.words("patio") == ("patio",)
    scorer = T.Scorer({"=stupid": 5.0}, {}, -3.0, small_model())
    rows = spark.createDataFrame([(1, "a stuupid patio"), (2, "a hello patio")], "doc_id long, text string")
    assert {r.doc_id: r.score > 0.5 for r in T.scored(rows, scorer).collect()} == {1: True, 2: False}


def test_long_units(tmp_path):
    model = S.Model(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(3)
    units = ["".join(rng.choice("abcdeilmnorst") for _ in range(n)) for n in (1, 2, 7, 40, 300, 301)] + ["日本語" * 20, "ß😀x" * 30, "aaaa" * 50]
    for u in units:
        assert model.single(u).tolist() == model.viterbi([u])[0].tolist()
    began = time.time()
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789") for _ in range(200_000))
    ids = model.encode([text])[0]
    assert time.time() - began < 30 and model.decode(ids) == text
