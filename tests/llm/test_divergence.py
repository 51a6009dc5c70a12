"""The source audit against direct sums over all kept terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallyforge.llm import divergence
from tallyforge.llm.divergence import divergence_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def direct(rows, least, top=10):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        names = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in names), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in names}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in names:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in names if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)]
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(term[:top])]
    return sorted(out)


def audited(spark, rows, least=10, **more):
    df = spark.createDataFrame([(lang, source, text, 1, "x") for lang, source, text in rows], "lang string, source string, text string, n long, k string")
    return sorted(tuple(r) for r in divergence_audit(df, least_docs=least, **more).collect())


def test_equals_direct_sums(spark, monkeypatch):
    rng = random.Random(4)
    words = ["Alpha", "beta", "été", "Ünder", "x", "don't", "a-b", "日本", "z9z"] + [f"w{c}" for c in "abcdefghij"]
    rows = [
        (rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "S1"]), rng.choice([None, "", " . ", *(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(9))]))
        for _ in range(400)
    ]
    rows += [("fr", "alone", "one two")] * 12 + [("it", "empty", None), ("it", "other", "once")]
    assert audited(spark, rows) == direct(rows, 10)
    #: Several sides and buckets give the same sums.
    many = [("en", f"s{k % 5}", " ".join(rng.choices(words, k=20))) for k in range(90)]
    monkeypatch.setattr(divergence, "SIDE", 2)
    monkeypatch.setattr(divergence, "PER_CELL", 70)
    assert audited(spark, many, 3, top=4) == direct(many, 3, 4)


def test_slices_of_a_long_text_count_a_document_once(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "Aa bb cc aa " * 50 + "é" * 40
    parts = list(divergence._words(text.encode()))
    assert len(parts) > 10 and [w for p in parts for w in p] == [w.encode() for w in TERM.findall(text.lower())]


def test_very_long_words_and_texts(spark):
    long = "x" * 300_000
    rows = [("en", f"s{k % 2}", f"{long} y " * (1 + k % 3)) for k in range(10)] + [("en", "s0", "word " * 200_000)]
    assert audited(spark, rows) == direct(rows, 10)


def test_no_documents(spark):
    assert audited(spark, []) == []


@pytest.mark.parametrize("count", [0, 7, 10**12])
def test_shares_are_exact_beyond_64_bits(spark, count):
    got = spark.range(1).select(divergence.share(count, 10**13, 12345)).head()[0]
    assert got == 1 + 10**9 * (count + 2) // (10**13 + 2 * 12345)
