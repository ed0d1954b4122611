"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger stores the measurements and one long whose bit k says that
rule k failed. A policy is a named, versioned mask over those bits, so a change of policy or an ablation is bitwise
work on the ledger and never reads a text again.

Defined results: a null or empty text has no words, so `few_words` fails and it is not kept. Repeated rows get equal
rows. An empty table gives an empty ledger. Only the named key columns of the input are carried over, so extra columns
cannot clash. Cost is linear in the text but for one sort of the window hashes, all inside one narrow stage: nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, total, unclashing

#: Words in a window.
WINDOW = 5
#: Low bits of a packed window that hold its position; the rest holds its hash.
_AT = 28

#: Rules in the order of their bits: name, and the test of a measurement struct that says the rule fails. All is integer arithmetic.
RULES = (
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["n_words"]),
    ("shouting", lambda m: 100 * m["n_upper"] > 40 * m["n_letters"]),
    ("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    ("short_words", lambda m: 10 * m["word_chars"] < 20 * m["n_words"]),
    ("long_words", lambda m: 10 * m["word_chars"] > 150 * m["n_words"]),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base-v1": ("few_words", "repeated_windows"),
    "prose-v1": ("few_words", "repeated_windows", "symbols", "shouting"),
    "strict-v1": tuple(BIT),
}
POLICY = "prose-v1"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def mask_of(policy: str | Sequence[str]) -> int:
    """The bits of a policy, by its name or its rules."""
    return sum(BIT[x] for x in (POLICIES[policy] if isinstance(policy, str) else policy))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of five words that the text holds twice or more.

    Windows are packed as hash and position into longs and sorted, so equal windows become neighbours; neighbours with
    equal hashes are compared word by word, so a collision of hashes is never counted. Where different windows share a
    hash, which could part equal ones, the text's windows are sorted by their words instead.
    """
    place = F.lit((1 << _AT) - 1)

    def packed(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).bitwiseAND(F.lit(~((1 << _AT) - 1))).bitwiseOR(i.cast("long"))

    def same(a: Column, b: Column) -> Column:
        at = lambda x: F.slice(words, x.bitwiseAND(place).cast("int") + 1, F.lit(WINDOW))
        return F.coalesce((F.shiftright(a, _AT) == F.shiftright(b, _AT)) & (at(a) == at(b)), F.lit(False))

    def covered(marked: Column) -> Column:
        steps = F.transform(marked, lambda x, k: F.when(k == 0, F.lit(WINDOW).cast("long")).otherwise(F.least(F.lit(WINDOW).cast("long"), x - F.get(marked, k - 1))))
        return total(steps)

    def exactly(ordered: Column) -> Column:
        equal = lambda k, x: F.coalesce(F.get(ordered, k)["w"] == x["w"], F.lit(False))
        twice = F.filter(ordered, lambda x, k: equal(k - 1, x) | equal(k + 1, x))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: same(F.get(ordered, k - 1), x) | same(x, F.get(ordered, k + 1)))
        alike = lambda a, b: F.coalesce(F.shiftright(a, _AT) == F.shiftright(b, _AT), F.lit(False))
        shared = F.size(F.filter(ordered, lambda x, k: alike(F.get(ordered, k - 1), x) & ~same(F.get(ordered, k - 1), x))) > 0
        spelled = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.slice(words, i + 1, F.lit(WINDOW)).alias("w"), i.cast("long").alias("i")))
        return F.when(shared, let(F.sort_array(spelled), exactly)).otherwise(let(F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(place))), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), packed)
    return F.when(F.size(words) > WINDOW, let(F.sort_array(windows), count)).otherwise(F.lit(0).cast("long"))


def measurements(text: Column) -> Column:
    """A struct of all measurements of one text."""

    def of_words(t: Column, words: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
        return let(lines, lambda kept: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(kept).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.array_remove(F.split(t, f"[{SPACE}]+"), ""), lambda w: of_words(t, w)))


def failures(m: Column) -> Column:
    """The failure bits of a measurement struct."""
    out = F.lit(0).cast("long")
    for name, fails in RULES:
        out = out.bitwiseOR(F.when(fails(m), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def verdict(bits: Column, policy: str | Sequence[str] = POLICY) -> Column:
    """True where no rule of the policy fails."""
    return bits.bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ledger(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: its keys, all measurements and `failed`, the failure bits."""
    (name,) = unclashing(docs, "measured")
    made = docs.select(*keys, measurements(F.col(text)).alias(name))
    return made.select(*keys, *(F.col(name)[x].alias(x) for x in MEASURES), failures(F.col(name)).alias("failed"))


def ablation(ledger_rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """For each policy and rule of it: documents kept, documents that the rule fails, and those that it alone rejects (kept again without it)."""
    bits = F.col("failed")
    pairs = [(p, r) for p, rules in policies.items() for r in rules]
    wanted = []
    for k, (p, r) in enumerate(pairs):
        m = bits.bitwiseAND(F.lit(mask_of(policies[p])).cast("long"))
        wanted += [F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(f"{n}{k}") for n, x in (("kept", m == 0), ("fails", m.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0), ("alone", m == BIT[r]))]
    one = ledger_rows.agg(*wanted)
    return one.select(F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), *(F.col(f"{n}{k}").alias(n) for n in ("kept", "fails", "alone"))) for k, (p, r) in enumerate(pairs)))).alias("x")).select("x.*")


def accepted(docs: DataFrame, policy: str | Sequence[str] = POLICY, text: str = "text") -> DataFrame:
    """The rows of `docs` that the policy keeps, with their columns as they were."""
    return docs.where(verdict(let(measurements(F.col(text)), failures), policy))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = mask_of("base-v1")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"),
        verdict(F.col("failed")).alias("kept"), F.col("failed").alias("failed_bits"),
    )


#: DuckDB SQL of digest(). The class excludes chr(28) to chr(31), which are no white space here.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i : i + 4] AS five FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper
      FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_upper > 40 * n_letters THEN 8 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN 10 * word_chars < 20 * n_words THEN 32 ELSE 0 END
             + CASE WHEN 10 * word_chars > 150 * n_words THEN 64 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, (bits & 15) = 0 AS kept,
       CAST(bits AS BIGINT) AS failed_bits FROM f
"""
