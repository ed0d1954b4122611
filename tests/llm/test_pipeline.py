"""The pipeline against the stages' brute-force versions on a small table."""

import random

import corpus_pipeline

from .test_dedup import brute
from .test_native import brute_quality


def texts(rng):
    word = lambda: "".join(rng.choice(["the", "on", "er", "an", "ti", "re", "sh", "ou"]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(rng.randint(30, 80))) for _ in range(40)]
    base.append("mail me@example.com now " + " ".join(word() for _ in range(40)))
    return [*base, *base[:5], base[6] + " more", "few words", "", None, "a b c d e " * 20, "#### " * 30, base[8].upper()]


def test_run(spark, tmp_path):
    rows = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts(random.Random(3)))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {k: t for k, t, *_ in rows if t and brute_quality(t)[0] >= 10 and 100 * brute_quality(t)[4] <= 20 * brute_quality(t)[0] and 10 * brute_quality(t)[2] <= brute_quality(t)[0] and not t.isupper()}
    assert kept["quality rules"] == good and kept["language ID"] == good
    ids = sorted(good)
    assert sorted(kept["near-duplicates"]) == sorted({ids[c] for c in brute([good[k] for k in ids])})
    assert all("me@example.com" not in t for t in kept["personal data"].values()) and any("[EMAIL]" in t for t in kept["personal data"].values())
    assert sorted(kept["personal data"]) == sorted(kept["near-duplicates"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(kept["personal data"])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, [], tmp_path)).count() == 0


def test_repeated_long_and_null_rows(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["the", "on", "er", "an", "ti", "re", "sh", "ou"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)] + [" ".join(word() for _ in range(30_000))]
    rows = [(k, t, None if k % 3 == 0 else "en", None, len(t)) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], "en", "s", 1), (40, None, "en", "s", 0), (41, "", None, "s", 0), (42, texts[2], "en", "s", 1)]
    where = stored(spark, rows, tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = docs.collect()
    ids = [r.doc_id for r in left]
    assert sorted(k for k in ids if k is not None) == [0, 0, 0, *range(1, 13)] and ids.count(None) == 1
    assert all(r.lang == "en" for r in left) and {r.text for r in left if r.doc_id == 12} == {texts[12]}


def test_clashing_columns(spark, tmp_path):
    more = ["gone", "words", "lang_found", "lang_score", "row", "found", "told", "text_key", "base", "terms", "clean", "measured", "node", "comp", "bucket"]
    made = texts(random.Random(3))
    rows = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(made)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.selectExpr("*", *(f"'{x}' as {x}" for x in more))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, str(tmp_path)), stage(spark, clash, str(tmp_path))
        assert out.columns == clash.columns
        got = out.collect()
        assert sorted((r.doc_id, r.text or "") for r in got) == sorted((r.doc_id, r.text or "") for r in plain.collect()) and all(r[x] == x for r in got for x in more)
