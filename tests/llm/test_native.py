"""Chat formatting, sharding and quality rules against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

from tidemill.llm import op3_chat, op7_sharding, op9_quality

DOCS = "doc_id long, text string, lang string, n_words long, shard int, __m int"


def docs(spark, texts):
    return spark.createDataFrame([(k if k != 3 else None, t, None, -1, -1, 0) for k, t in enumerate(texts)], DOCS)


TEXTS = ["", None, "one", "a b c d e a b c d e", "a " * 30, "x\ny\nx\n\n  \nx", "é ü   # <|> ok" * 4, "word " * 3000, "the quick brown fox jumps over it " * 2, "the quick brown fox jumps over it " * 2, "Some plain words that make a good text of more than ten words.", "\x0b\x0c\r\t"]


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "a\\<|x|>\n</s>\n", None, "<|\\|>", "<<SYS>> <</SYS>> <s>", "", "plain", "<|||>\\\\"]
    rows = [(c, t, r, said[(c + t) % len(said)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user", None, "assistant", "end", "a|>\nb"][: c])]
    rows += [(None, 0, "user", "q"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (20, 5, "assistant", "only"), (21, None, "user", None)]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, cuts string")
    got = {r.conv_id: r for r in op3_chat.digest(frame).collect()}
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    made = op3_chat.examples(frame).where("conv_id = 6").orderBy("example").collect()
    assert [x.loss_start is not None for x in made] == [True, True]
    assert made[1].formatted.startswith(made[0].formatted)
    assert op3_chat.digest(frame.limit(0)).count() == 0


def brute_shard(key, node, path=""):
    if not node.children:
        return node.shard
    draw = lambda c: -math.log(((xxhash.xxh64(f"{key}|{path}/{c.name}".encode(), seed=42).intdigest() >> 11) + 0.5) / 2**53) / c.weight
    won = min(node.children, key=draw) if len(node.children) > 1 else node.children[0]
    return brute_shard(key, won, f"{path}/{won.name}")


def test_shards(spark):
    frame = docs(spark, TEXTS * 20)
    frame = frame.unionByName(frame)
    got = op7_sharding.shards(frame).collect()
    root = op7_sharding.tree()
    grown = op7_sharding.grow(root, 24)
    assert len(got) == len(TEXTS) * 40
    for r in got:
        key = "\x00null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute_shard(key, root) and r.grown_shard == brute_shard(key, grown)
        assert r.grown_shard in (r.shard, 24)
        text = (TEXTS[r.doc_id % len(TEXTS)] if r.doc_id is not None else TEXTS[3]) or ""
        assert (r["size"], r.text_crc32, r.law) == (len(text.encode()) + 8, zlib.crc32(text.encode()), "key")
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert op7_sharding.shards(frame.limit(0)).count() == 0


def test_weights_move_only_their_subtree(spark):
    keys = spark.range(4000).selectExpr("cast(id as string) as k")
    a = op7_sharding.tree(6, 3, 2)
    b = op7_sharding.tree(6, 3, 2, [1, 1, 1, 1, 1, 3])
    rows = keys.select("k", op7_sharding.shard_of(keys.k, a).alias("a"), op7_sharding.shard_of(keys.k, b).alias("b")).collect()
    region = lambda s: 0 if s < 2 else 1  # noqa: E731  racks of two; one rack, then two
    assert all(r.a == r.b or region(r.b) == 1 for r in rows)
    share = sum(r.b == 5 for r in rows) / len(rows)
    assert abs(share - 3 / 8) < 0.03


def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(set(grams)) < len(grams) else set()
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(many)


def test_ledger(spark):
    frame = docs(spark, TEXTS)
    got = {r.doc_id: r for r in op9_quality.digest(frame).collect()}
    for k, t in enumerate(TEXTS):
        r = got[k if k != 3 else None]
        n, *_, repeats = want = brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.kept and r.base_failed)
    assert got[10].kept
    assert op9_quality.accepted(frame, "base-v1").columns == frame.columns
    assert op9_quality.accepted(frame, ["few_words"]).count() == sum(brute_quality(t)[0] >= 10 for t in TEXTS)
    assert op9_quality.digest(frame.limit(0)).count() == 0


def test_windows_that_share_a_hash(spark, monkeypatch):
    """With two bits of hash nearly all windows collide, and the counts stay right."""
    monkeypatch.setattr(op9_quality, "_AT", 62)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(40)] + ["a b c d e f g h"]
    got = {r.doc_id: r.n_repeat_words for r in op9_quality.digest(docs(spark, texts).where("doc_id is not null")).collect()}
    assert all(got[k] == brute_quality(t)[4] for k, t in enumerate(texts) if k in got) and len(got) >= 40


@pytest.mark.parametrize("policy", ["base-v1", "prose-v1"])
def test_ablation(spark, policy):
    rows = op9_quality.ledger(docs(spark, TEXTS))
    bits = [r.failed for r in rows.collect()]
    mask = op9_quality.mask_of(policy)
    for r in op9_quality.ablation(rows, {policy: op9_quality.POLICIES[policy]}).collect():
        b = op9_quality.BIT[r.rule]
        assert (r.kept, r.fails, r.alone) == (sum(x & mask == 0 for x in bits), sum(x & b != 0 for x in bits), sum(x & mask == b for x in bits))
