"""Packing: ids against the tokenizer itself, and the law of the sequences."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemill.llm import op8_packing as P
from tidemill.llm.queries import tokenizer_path

TEXTS = ["", None, "a", "two  spaces \n line\n\n end ", "<|endoftext|> in text<|endoftext|>", "word " * 3000, "é ü 漢字  x \x1c y", "Don't  stop\tnow", " lead", "same text here", "same text here"]


def test_packed_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = [(k if k != 2 else None, TEXTS[k % len(TEXTS)] if k < 200 else f"text {k} " * (k % 90)) for k in range(400)]
    frame = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, length int")
    rows = P.packed(frame, path).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for key, text in docs:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert P.packed(frame.limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns(seed):
    rng = np.random.default_rng(seed)
    want = {int(k): int(rng.integers(1, 400)) for k in rng.choice(np.arange(1, 129), 1 + 40 * seed, replace=False)}
    found = P.patterns(want)
    got = Counter()
    for pattern, times in found:
        assert sum(k * n for k, n in pattern.items()) <= 128
        for k, n in pattern.items():
            got[k] += n * times
    assert got == Counter(want)
    used = sum(n for _, n in found)
    assert used <= len(P.first_fit(want, 128)) * 1.02 + 3
