"""Personal data spans against plain regular expressions, and the disclosure of terms against counts by hand."""

import hashlib
import math
import os
import re
from collections import defaultdict

import pytest
import regex

from tidemill.llm import op6_pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end(), m.group()))
    return out


TEXTS = [
    "write to a.b@mail.example.com or x@y.z_w@q.r now", "é漢 1.2.3.4.5 256.1.1.1 001.02.3.255 😀 9.9.9.9", "card 4111 1111 1111 1111 and 4111-1111-1111-1112",
    "call +1 (212) 555-0123, +44 20 7946 0958x +12", "", None, "a@b.c_d@e.f@g.h.i", "1" * 3000, "a" * 3000 + "@", "+" * 50 + "1 2", "....@..@a.b", "0.0.0.0000000000000000000000001",
    "5500-0000-0000-0004 5500 0000 0000 0004", "x" * 200 + " 10.0.0.1 " * 300, "79927398713 4539578763621486",
]


def test_base_spans(spark):
    frame = spark.createDataFrame([(k, t, 0) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], 0), (0, TEXTS[0], 0)], "doc_id long, text string, n_email int")
    rows = P.digest(frame).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = base(TEXTS[r.doc_id or 0])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), r.doc_id
        assert r.spans.split(",")[: len(want)] == (line.split(",") if want else r.spans.split(",")[:0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in PATTERNS]
    assert P.digest(frame.limit(0)).count() == 0


def levels(kind, value):
    k, v = list(PATTERNS).index(kind), value.lower()
    digits = re.sub("[^0-9]", "", v)
    group = {"email": v.rsplit("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    return {f"{k}:{v}", f"{k}/{group}", str(k)}


def low(k, n, z=1.96):
    """The lower end of the Wilson interval."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def told_by_hand(texts, generalise=P.GENERALISE, remove=P.REMOVE):
    """{(entity, term): removed} of the pairs that disclose, from counts over different whole texts."""
    different = sorted({t or "" for t in texts})
    with_entity, both, anywhere = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, t in enumerate(different):
        found = base(t)
        mails = [(a, b) for kind, a, b, _ in found if kind == "email"]
        words = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\p{L}{3,}", t)]
        for _, _, w in words:
            anywhere[w].add(k)
        beside = {w for a, b, w in words if not any(c <= b and a <= d for c, d in mails)}
        for e in {e for kind, _, _, v in found for e in levels(kind, v)}:
            with_entity[e].add(k)
            for w in beside:
                both[e, w].add(k)
    out = {}
    for (e, w), s in both.items():
        rate = len(with_entity[e]) / len(different)
        sure = low(len(s), len(anywhere[w]))
        share = 1 - math.log(sure) / math.log(rate) if rate < 1 else 0
        if rate < 1 and share >= generalise and sure >= P.LEAST:
            out[e, w] = share >= remove
    return out


def mixed_texts():
    filler = "the office number {} about nothing much, ask them, and the desk is open for all who come by"
    far = " ".join([filler.format(1)] * 3)
    texts = [filler.format(k) for k in range(900)]
    texts += [f"Élodie-Zwickau wrote. {far} Reach her at sole@one.example.org or {far} or 10.1.2.3. ZWICKAU again", f"{far} NETTLEWOOD signs", f"{far} pair@two.example.org {far} Nettlewood", f"{far} nettlewood {far} pair@two.example.org x\0marbury\0pair@two.example.org"]
    return [*texts, f"quill éboss@three.example.org {far} 4111 1111 1111 1111 quartz", texts[900], None, ""]


def checked(spark, texts):
    """Disclosing pairs, spans and cleaned texts against counts by hand; returns the pairs."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = told_by_hand(texts)
    assert {(r.entity, r.term): r.gone for r in P.disclosures(frame)[1].collect()} == told
    terms = {w for _, w in told}
    removed = {w for (_, w), gone in told.items() if gone}
    clean = {r.doc_id: r.text for r in P.sanitised(frame).collect()}
    for r in P.digest(frame).collect():
        text = texts[r.doc_id] or ""
        found = base(text)
        mails = [(a, b) for kind, a, b, _ in found if kind == "email"]
        hits = [m for m in regex.finditer(r"\p{L}{3,}", text) if m.group().lower() in terms and not any(a < m.end() and m.start() < b for a, b in mails)]
        line = [f"{k}:{a}:{b}" for k, a, b, _ in found]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest()
        assert r.spans == ",".join([*line, *(f"term:{m.start()}:{m.end()}" for m in hits)]) and r.n_term == len(hits)
        tags = sorted([(a, b, f"[{k.upper()}]") for k, a, b, _ in found] + [(m.start(), m.end(), "" if m.group().lower() in removed else "[NAME]" if m.group()[0].isupper() and not m.group().isupper() else "[CODE]" if m.group().isupper() else "[WORD]") for m in hits])
        made, at = "", 0
        for a, b, tag in tags:
            if a >= at:
                made += text[at:a] + tag
            at = max(at, b)
        assert clean[r.doc_id] == (made + text[at:] if texts[r.doc_id] is not None else None)
    return told


def test_levels_and_removal(spark):
    filler = [f"the office number {k} about nothing much, ask them" for k in range(400)]
    texts = [f"Ask Quillfeather ({k}) at the office: boss@mail.example.com about number {k}" for k in range(14)]
    texts += [f"Write to Domainia: user{k}@corp.example.org, {k} at the office" for k in range(6)]
    texts += [f"Only HOTLINE {k}: +1 (212) 555-01{k:02} or the office" for k in range(10, 40)] + ["the Quill speaks of it", *filler, *texts[:2]]
    told = checked(spark, texts)
    assert told["0:boss@mail.example.com", "quillfeather"] and ("0:boss@mail.example.com", "office") not in told
    assert ("0/corp.example.org", "domainia") in told and ("3/1212", "hotline") in told and ("3", "hotline") in told


def test_masked_keeps_columns(spark):
    frame = spark.createDataFrame([(1, "a@b.cd and +1 212 555 0123!", 3, "x"), (2, None, 0, None)], "doc_id long, text string, n_chars long, lang string")
    out = {r.doc_id: r for r in P.sanitised(frame).collect()}
    assert out[1].text == "[EMAIL] and [PHONE]!" and out[1].n_chars == len(out[1].text) and out[2].text is None
    assert P.sanitised(frame).columns == frame.columns



def test_rare_entities_and_whole_texts(spark):
    texts = mixed_texts()
    told = checked(spark, texts)
    assert {("0:sole@one.example.org", "zwickau"), ("1:10.1.2.3", "zwickau"), ("2:4111 1111 1111 1111", "quartz")} <= set(told)
    assert not any(w in ("office", "nothing", "desk") for _, w in told)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_terms_on_a_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    assert len(checked(spark, texts)) > 100


def test_clashing_columns_and_empty(spark):
    frame = spark.createDataFrame([(k, t, 1, "a", "b", "c", "d") for k, t in enumerate(mixed_texts())], "doc_id long, text string, found int, row string, text_key string, told string, base string")
    plain = {r.doc_id: r.text for r in P.sanitised(frame.select("doc_id", "text")).collect()}
    out = P.sanitised(frame)
    assert out.columns == frame.columns and {r.doc_id: r.text for r in out.collect()} == plain
    assert P.sanitised(frame.limit(0)).count() == 0
