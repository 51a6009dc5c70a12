"""Sketches that subtract and peel, against sets of paragraphs."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import fingerprints
from tallyforge.llm.fingerprints import PARAGRAPH, differing_paragraphs, fingerprint_documents, paragraph_digests


def signed(data):
    x = xxhash.xxh64(data.encode(), seed=42).intdigest()
    return x - (1 << 64) if x >> 63 else x


def pieces(text):
    return {m.group() for m in re.finditer(PARAGRAPH, text)}


def near(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def direct(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1].encode()))
    out = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, after)))
    return out


def texts(rng, n):
    words = ["été", "a", "Wort.", "what?", "日本", "🙂", "x" * 30, "no!", "and", "\n", "\r\n", "long " * 40]
    return [rng.choice([None, "", "\n\n", "same text. here\nand there", " ".join(rng.choices(words, k=rng.randint(1, 80)))]) for _ in range(n)]


@pytest.mark.parametrize("block", [3, 1000])
def test_equals_sets_of_paragraphs(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(block)
    rows = [(rng.choice([None, 5, -7, 2**62, *range(40)]), t) for t in texts(rng, 90)]
    rows += rows[:5] + [(9, "line of words. " * 3000 + "\n".join(f"paragraph {k}" for k in range(3000)))]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, row int, block string").repartition(3)
    got = fingerprint_documents(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=key) == sorted(direct(rows), key=key)
    prints = {}
    for r in got:  # equal edited texts have equal fingerprints
        assert prints.setdefault(r.edited_sha256, r.edited_fingerprint) == r.edited_fingerprint


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "One. Two.\nThree"), (2, "One. Two.\nThree"), (3, "other"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint_documents(df).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint and got[1].near_next == 1.0
    assert got[4].fingerprint == got[5].fingerprint == "" and got[4].near_next == got[4].near_edited == 1.0


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(1, "Alone. " * 30)], "doc_id long, text string")
    assert [(r.near_next, r.n_chars) for r in fingerprint_documents(df).collect()] == [(1.0, 210)]
    assert fingerprint_documents(df.limit(0)).collect() == []


def test_peeling_tells_the_digests(spark):
    rng = random.Random(2)
    rows = []
    for row in range(60):
        both = [rng.getrandbits(63) for _ in range(rng.choice([0, 5, 400]))]
        ours, theirs = ([rng.getrandbits(63) - 2**62 for _ in range(rng.choice([0, 1, 7, 60, 900]))] for _ in range(2))
        rows.append((row, "p", both + ours, theirs + both))
    rows.append((60, "p", None, [5]))
    df = spark.createDataFrame(rows, "row long, pair string, ours array<long>, theirs array<long>")
    got = {r.row: r for r in differing_paragraphs(df, digests=True).collect()}
    for row, _, ours, theirs in rows:
        ours, theirs = set(ours or ()), set(theirs)
        assert (set(got[row].only_ours), set(got[row].only_theirs), got[row].n_differ) == (ours - theirs, theirs - ours, len(ours ^ theirs))
    assert min(r.size for r in got.values()) == fingerprints.BASE and max(r.size for r in got.values()) > 1000


def test_paragraphs_cover_the_text(spark):
    rng = random.Random(3)
    for text in filter(None, texts(rng, 40)):
        assert "".join(m.group() for m in re.finditer(PARAGRAPH, text)) == text
    text = "One two. " * 60 + "\n\nend"
    got = spark.createDataFrame([(text,)], "text string").select(paragraph_digests("text").alias("d"), F.lit(1)).head().d
    assert set(got) == {signed(p) for p in pieces(text)}
