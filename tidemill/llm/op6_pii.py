"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that give them away.

Four kinds of protected entities are found by pattern: e-mail addresses, IP addresses, card numbers and phone numbers.
An entity stands at three levels, each protected: its exact value, its group (mail domain, network, issuer digits,
country and area code) and its kind. The corpus tells which words disclose one. A term is a word of `MIN_LETTERS`
letters or more; words that touch an e-mail address are no terms of their text. With document frequencies over all N
different whole texts, n(e) of the entity, n(t) of the term anywhere and n(t, e) of the texts that hold both, the term
discloses the share

    1 - log(P(e | t)) / log(P(e)),  P(e) = n(e) / N

of the entity's information, where P(e | t) is not the plain n(t, e) / n(t) but the lower end of its 95 % Wilson interval,
so that few texts prove little. A term is generalised if that share is `GENERALISE` or more and P(e | t) by its lower
end `LEAST` or more (a term most of whose texts do not hold the entity identifies nobody, however rare the entity is); it
is removed if the share is `REMOVE` or more for any entity. `LEAST` is just below the lower end for one text of one, so
a word that the corpus holds in a single text, one with an entity, is a quasi-identifier and counts; a word of two
texts of which one holds the entity does not. Each occurrence of a disclosing term in any text is a span, unless it
touches an e-mail address. An entity in all texts has no information to disclose.

Generalising puts the kind of word in a term's place: [NAME] for a capitalised word, [CODE] for one in capitals, [WORD].

Defined results: a null or empty text has no spans. Equal texts get equal spans, so ties and repeated rows agree; a
null doc_id is matched as such. An empty table gives an empty result. Only doc_id and text are read for spans, and
sanitised() changes the text alone, carrying the row as one struct, so extra columns cannot clash. All offsets are code
points, the end exclusive.

Scale: each different text counts once; only texts whose key may occur twice (by a bitmap of `SIEVE` longs, broadcast) are
moved for that. The frequencies of all words are counted map-side, so what is shuffled is vocabularies. With f the least
P(e | t) that discloses, the Wilson bound reads n(t, e) >= f n(t) + Z sqrt(n(t) f (1 - f)), and n(t, e) <= n(e): f and n(e)
rule most pairs out, exactly, before any is formed, and the most common terms (at most `COMMON`, broadcast) before
anything is shuffled. Counts for the four kinds are columns of the terms' own count. A second bitmap finds the texts that
hold disclosing terms, and marking looks for a text's own terms only. Other joins are broadcast below Spark's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, let, running_starts, saved, total

KINDS = ("email", "ip", "card", "phone", "term")
#: Patterns in Java's syntax; possessive, and anchored where a run begins, so that matching is linear in long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

MIN_LETTERS = 3
#: Shares of an entity's information from which a term is generalised, or removed, the least P(e | t), and the deviations of its lower end.
GENERALISE, REMOVE, LEAST, Z = 0.75, 0.9, 0.2, 1.96
_WORD = r"\p{L}{%d,}" % MIN_LETTERS
#: Longs of the bitmap of term hashes (2 ** 17 are 8 million bits), and common terms that are held against each text where it lies.
SIEVE, COMMON = 1 << 17, 1 << 18
#: A word that does not touch the sign that stands for an e-mail address.
_APART = r"(?<![\p{L}\x00])\p{L}{%d,}+(?!\x00)" % MIN_LETTERS
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def located(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches: an array of (start, end, value)."""

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.transform(hits, F.length), lambda g, h: g + h)
        return let(running_starts(sizes), lambda at: let(gaps, lambda g: F.transform(hits, lambda h, k: F.struct(
            (F.get(at, k) + F.get(g, k)).cast("int").alias("start"),
            (F.get(at, k) + F.get(g, k) + F.length(h)).cast("int").alias("end"),
            h.alias("value"),
        ))))

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, empty).otherwise(placed(hits)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    worth = F.transform(F.split(F.reverse(digits), ""), lambda c, k: let(c.cast("long"), lambda d: F.when(k % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))))
    return total(worth) % 10 == 0


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: let(F.ltrim(x, F.lit("0")), lambda y: (F.length(y) <= 3) & (F.when((F.length(y) > 0) & (F.length(y) <= 3), y.cast("int")).otherwise(0) <= 255)))


def entities(text: Column) -> Column:
    """The base spans of a text without nulls: an array of (kind, start, end, value), by kind, then start."""

    def of(kind: int, needed: Column, pattern: str, holds=None) -> Column:
        found = located(text, pattern)
        if holds is not None:
            found = F.filter(found, lambda x: holds(x["value"]))
        tagged = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
        return F.when(needed, tagged).otherwise(F.from_json(F.lit("[]"), "array<struct<kind:int,start:int,end:int,value:string>>"))

    some = text.rlike("[0-9]")
    return F.concat(
        of(0, text.contains("@"), EMAIL),
        of(1, some, IP, _is_ip),
        of(2, some, CARD, lambda v: let(_digits(v), lambda d: F.length(d).between(13, 19) & _luhn(d))),
        of(3, text.contains("+"), PHONE, lambda v: F.length(_digits(v)).between(9, 15)),
    )


def terms_of(text: Column) -> Column:
    """The different terms of a text. Of the entities only e-mail addresses have letters, so only they are taken out."""
    bare = F.when(text.contains("@"), F.regexp_replace(F.translate(text, "\0", " "), EMAIL, "\0")).otherwise(F.translate(text, "\0", " "))
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(_APART), F.lit(0)), F.lower))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*more, text.alias("text"), F.struct(F.xxhash64(text).alias("a"), F.length(text).alias("b")).alias("text_key"))


def levels(found: Column) -> Column:
    """The different entities of an array of base spans, each at its three levels."""

    def one(e: Column) -> Column:
        kind, value = e["kind"].cast("string"), F.lower(e["value"])
        digits = _digits(value)
        group = F.when(e["kind"] == 0, F.substring_index(value, "@", -1)).when(e["kind"] == 1, F.substring_index(value, ".", 2)).when(e["kind"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
        return F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit("/"), group), kind)

    return F.array_distinct(F.flatten(F.transform(found, one)))


def least_share(rate: Column, share: float) -> Column:
    """The least P(e | t) with which a term discloses `share` of the information of an entity of this rate."""
    return F.greatest(F.pow(rate, F.lit(1 - share)), F.lit(LEAST))


def proven(both: Column, n: Column, f: Column) -> Column:
    """Whether the lower end of the Wilson interval of both / n is f or more."""
    return both >= f * n + Z * F.sqrt(n * f * (1 - f))


def _slots(df: DataFrame, code: Column) -> DataFrame:
    """`df` with the slot and bit of a 64-bit code in a bitmap of `SIEVE` longs."""
    return df.withColumns({"slot": F.shiftright(code, 6).bitwiseAND(F.lit(SIEVE - 1)), "bit": F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(F.lit(63)).cast("int"))})


def _sieved(df: DataFrame, code: Column, of: DataFrame, of_code: Column) -> DataFrame:
    """`df` with the column `maybe`: false only if the code is no code of `of`. The bitmap has at most SIEVE rows."""
    bits = _slots(of, of_code).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    return _slots(df, code).join(F.broadcast(bits), "slot", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).drop("slot", "bit", "bits")


def different(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(text_key and text of each different text, a table to drop, their number). Texts move only if their key may occur twice."""
    keyed = _keyed(docs)
    counts = saved(keyed.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")))
    flagged = _sieved(keyed, F.col("text_key.a"), counts.where("n > 1"), F.col("text_key.a"))
    copied = saved(flagged.where("maybe").groupBy("text_key").agg(F.min("text").alias("text")))
    n = counts.count()
    return flagged.where("not maybe").select("text_key", "text").unionByName(copied), copied, n


def disclosures(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(text_key and word for all texts that hold a disclosing term, disclosing pairs (entity, term, gone)), over all of `docs`."""
    texts, copied, n_texts = different(docs)
    with_any = texts.select("text_key", "text", entities(F.col("text")).alias("found")).where(F.size("found") > 0)
    held = saved(with_any.select("text_key", levels(F.col("found")).alias("entities"), terms_of(F.col("text")).alias("terms")))
    rate = F.col("n_entity") / float(max(n_texts, 1))
    f = least_share(rate, generalise)
    slack = 1e-9  # the bounds below are for exact numbers
    who = held.select("text_key", F.explode("entities").alias("entity"))
    n_entity = saved(who.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") < n_texts))
    # kinds are four columns of the terms' count; values and groups are joined below
    kinds = [str(k) for k in range(4)]
    flags = [F.array_contains("entities", k).cast("int").alias(f"k{k}") for k in kinds]
    beside = held.select(*flags, F.explode("terms").alias("term")).groupBy("term").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in kinds))
    words = texts.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lower))).alias("term"))
    known = saved(beside.join(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "term"))
    of_kinds = known.select("term", "n_term", F.explode(F.array(*(F.struct(F.lit(k).alias("entity"), F.col(f"k{k}").alias("n_both")) for k in kinds))).alias("x")).select("x.entity", "term", "n_term", "x.n_both").where("n_both > 0")
    of_kinds = of_kinds.join(F.broadcast(n_entity.where(F.col("entity").isin(kinds))), "entity")  # four rows
    root = (F.sqrt(Z * Z * f * (1 - f) + 4 * f * F.col("n_entity")) - Z * F.sqrt(f * (1 - f))) / (2 * f)
    bounds = {"most": root * root * (1 + slack), "fewest": Z * Z * f / (1 - f) * (1 - slack)}
    who = saved(who.join(n_entity.where(~F.col("entity").isin(kinds)).withColumns(bounds).where("most >= fewest"), "entity"))
    met = known.agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0]
    common = known.where(F.col("n_term") > met / COMMON).select("term", F.col("n_term").alias("n_common"))  # at most COMMON rows, by their sum
    widest = who.groupBy("text_key").agg(F.max("most").alias("widest"))
    what = held.join(widest, "text_key").select("text_key", "widest", F.explode("terms").alias("term"))
    what = what.join(F.broadcast(common), "term", "left").where(F.col("n_common").isNull() | (F.col("n_common") <= F.col("widest")))
    rare = what.select("text_key", "widest", "term").join(known.select("term", "n_term"), "term").where("n_term <= widest")
    both = rare.join(who, "text_key").where("n_term between fewest and most").groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    holds = lambda x: proven(F.col("n_both"), F.col("n_term"), x)
    told = both.select("entity", "term", "n_entity", "n_term", "n_both").unionByName(of_kinds.select("entity", "term", "n_entity", "n_term", "n_both")).where(holds(f))
    told = saved(told.select("entity", "term", holds(least_share(rate, remove)).alias("gone")))
    asked = saved(told.select("term").distinct())
    words = texts.select("text_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("word"))
    some = _sieved(words, F.xxhash64(F.lower("word")), asked, F.xxhash64("term")).where("maybe")
    # an inner join with distinct terms: the optimizer would move a semi-join below the sieve
    hits = saved(some.join(asked, F.lower("word") == F.col("term")).select("text_key", "word"))
    drop(held, known, who, n_entity, copied)
    return hits, told


def spans(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: row (a struct of its columns), text, base and terms: arrays of (kind, start, end); terms also says which are removed."""
    hits, told = disclosures(docs)
    worst = told.groupBy("term").agg(F.bool_or("gone").alias("gone"))
    by = saved(hits.withColumn("term", F.lower("word")).join(worst, "term").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "gone"))).alias("told")))
    drop(hits)
    full = _keyed(docs, F.struct("*").alias("row")).select("row", "text", "text_key", entities(F.col("text")).alias("found"))
    joined = full.join(by, "text_key", "left")
    base = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def marked(mails: Column) -> Column:
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("told"), "|"), F.lit(r")(?!\p{L})"))
        looked = F.filter(located(F.col("text"), pattern), lambda x: ~F.exists(mails, lambda f: (f["start"] < x["end"]) & (x["start"] < f["end"])))
        return F.transform(looked, lambda x: F.struct(F.lit(4).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.element_at(F.col("told"), x["value"]).alias("gone")))

    terms = F.when(F.col("told").isNotNull(), let(F.filter("found", lambda f: f["kind"] == 0), marked))
    none = F.from_json(F.lit("[]"), "array<struct<kind:int,start:int,end:int,gone:boolean>>")
    return joined.select("row", "text", base.alias("base"), F.coalesce(terms, none).alias("terms"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    made = spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    base, terms = line(F.col("base")), line(F.col("terms"))
    return made.select(
        F.col("row.doc_id").alias("doc_id"), *(count(k).alias(f"n_{x}") for k, x in enumerate(KINDS[:4])),
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", *(F.when(x != "", x) for x in (base, terms))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def kind_of(word: Column) -> Column:
    """What a generalised word is replaced by."""
    return F.when(~word.rlike(r"^\p{Lu}"), "[WORD]").otherwise(F.when(word == F.upper(word), "[CODE]").otherwise("[NAME]"))


def masked(text: Column, base: Column, terms: Column) -> Column:
    """The text with every span replaced: [EMAIL], [IP], [CARD], [PHONE], the kind of a generalised word, or nothing for a removed one. Overlapping spans are one."""
    tags = F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS))
    plain = F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(tags, x["kind"]).alias("tag")))
    told = F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["gone"], "").otherwise(kind_of(F.substring(text, x["start"] + 1, x["end"] - x["start"]))).alias("tag")))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), x["tag"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(F.sort_array(F.concat(plain, told)), start, step)
    return let(done, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(text, d["at"] + 1, F.length(text))))


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced in its text (a null text stays null) and, where it has the column, n_chars brought up to date."""
    made = spans(docs).withColumn("clean", F.when(F.col("row.text").isNotNull(), masked(F.col("text"), F.col("base"), F.col("terms"))))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return made.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


__all__ = ["digest", "disclosures", "drop", "entities", "masked", "sanitised", "spans"]
