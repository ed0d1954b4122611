"""Near-duplicates against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import op2_dartminhash as D
from tidemill.llm.components import components


def shingles(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def similarity(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 0.0


def brute(texts):
    """The smallest id that links reach, for each text."""
    bags = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.randint(60, 200))] for _ in range(12)]
    texts = [" ".join(x) for x in base]
    for k in range(120):
        x = list(base[k % 12])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 8, 30])):
            x[rng.randrange(len(x))] = word()
        texts.append(" ".join(x) if k % 5 else " ".join(x).upper())
    return [*texts, "", None, " \n", "few words", "few  WORDS", "other words", "a a a a a a a a a a a a a a", "a a a a a a a a a a a a a", "zz " * 5000]


@pytest.mark.parametrize("large", [(16, 512), (2, 3)])
def test_classes(spark, monkeypatch, large):
    monkeypatch.setattr(D, "LARGE", large[0])
    monkeypatch.setattr(D, "BLOCK", large[1])
    texts = corpus()
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: r for r in D.classes(frame).collect()}
    want = brute(texts)
    assert {k: r.component_id for k, r in got.items()} == dict(enumerate(want))
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    left = D.deduplicated(frame)
    assert left.columns == frame.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_a_pair_in_a_small_and_in_a_large_bucket(spark, monkeypatch):
    """The same pairs, alone and among many near copies, link alike, with and without the sketches."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(100)]

    def edited(n):
        x = list(base)
        for k in rng.sample(range(100), n):
            x[k] = word()
        return " ".join(x)

    pair = [edited(2), edited(2)]
    crowd = [edited(rng.choice([0, 1, 2, 3, 5])) for _ in range(150)]
    found = {}
    for name, texts in (("alone", pair), ("crowded", [*pair, *crowd])):
        for law in (D.DIFFERING, None):
            for large in (16, 1000):
                monkeypatch.setattr(D, "LARGE", large)
                monkeypatch.setattr(D, "BLOCK", 40)
                frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
                found[name, law, large] = {r.doc_id: r.component_id for r in D.classes(frame, differing=law).collect()}
    assert found["alone", None, 16] == dict(enumerate(brute(pair))) and found["crowded", None, 16] == dict(enumerate(brute([*pair, *crowd])))
    for name in ("alone", "crowded"):
        assert len({tuple(sorted(v.items())) for k, v in found.items() if k[0] == name}) == 1


def test_dealt_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    rows = [(1, k, 0 if k < 20 else k) for k in range(27)] + [(2, k, k % 2) for k in range(8)]
    dealt = D.dealt_blocks(spark.createDataFrame(rows, "bucket long, node long, comp long")).collect()
    at = {}
    for r in dealt:
        at.setdefault((r.bucket, r.lo, r.hi), []).append((r.node, r.mine))
    comp = {(b, k): c for b, k, c in rows}
    main = {1: 0, 2: 1}
    for bucket in (1, 2):
        met = Counter()
        for (b, lo, hi), members in at.items():
            if b == bucket:
                met.update(frozenset((x, y)) for x, m in members for y, n in members if x < y and (lo == hi or m != n))
        nodes = [k for b, k, _ in rows if b == bucket]
        want = Counter(frozenset((x, y)) for x in nodes for y in nodes if x < y and not comp[bucket, x] == comp[bucket, y] == main[bucket])
        assert met == want


def test_sketch_gap():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 2**63, (40, D.COORDINATES)).astype(np.uint64)
    s[1::2, ::3] = s[::2, ::3]
    made = D.sketches(s)
    bits = D.mix(s) & np.uint64(15)
    assert (D.sketch_gap(made, made) == (bits[:, None, :] != bits[None, :, :]).sum(axis=2)).all()


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "some words here"), (1, "some words here"), (1, "some words here"), (2, "Some words HERE"), (None, None)], "doc_id long, text string")
    got = sorted(D.classes(frame).collect(), key=str)
    assert len(got) == 5 and sorted({r.component_id for r in got if r.doc_id is not None}) == [1]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert D.classes(frame.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 2**62, 400).astype(np.uint64)
    other = words.copy()
    other[rng.choice(400, 12, replace=False)] = rng.integers(1, 2**62, 12).astype(np.uint64)
    doc, region = D.regions(np.concatenate([words, other]), np.array([400, 800]))
    a, b = set(region[doc == 0]), set(region[doc == 1])
    s = D.signatures(doc, region, 2, 2000)
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.05


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 10), (10, 4), (4, 4), *((k, k + 1) for k in range(100, 160)), *((500, k) for k in range(501, 560))]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 10: 4, **{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 560)}}
