"""Operators on texts against brute force, the tokenizer library or held-out labels."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyforge.llm import minhash_dedup, mixing, pii, toxicity
from tallyforge.llm.bpe_codec import decode_column, encode_decode
from tallyforge.llm.minhash_dedup import near_duplicates
from tallyforge.llm.mixing import mix_sources, mixed_documents
from tallyforge.llm.prefix_tokens import _state, prefix_token_counts
from tallyforge.llm.toxicity import clean_documents, score, train

VOCAB = public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "",
    " \t\n",
    None,
    "a<|endoftext|>b <|startoftext|> foo!<|endoftext|>,bar",
    "it's they'RE I'll 12 3 Ångström ÅΣΣ 你好世界 émoji😀😀!! ---___ " + "ab" * 100,
    "<|endof text|> <|",
    "q" * 70 + "!?" * 50,
    "é" * 500,
    "word " * 5000,
    "same text twice",
    "same text twice",
]


def odd_rows(spark, texts=ODD):
    rows = [(k, t, "x", "s", k, 1) for k, t in enumerate(texts)] + [(None, "no id here", None, None, None, 2), (0, "", "x", "s", 0, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int").withColumnRenamed("lang", "found").withColumnRenamed("n_chars", "key")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


def test_bpe_is_the_library(spark, docs, library):
    both = docs.select("doc_id", "text").union(odd_rows(spark).select("doc_id", "text"))
    got = sorted(map(tuple, encode_decode(both, VOCAB, outputs=("ids", "ids_sha256", "decoded_sha256")).collect()), key=str)
    want = []
    for doc_id, text in both.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    again = decode_column(encode_decode(both, VOCAB), VOCAB, out="again")
    assert again.where("not (decoded <=> again)").count() == 0
    assert encode_decode(both.limit(0), VOCAB).count() == 0


def test_prefix_counts(spark, docs, library):
    both = docs.select("doc_id", "text").union(odd_rows(spark).select("doc_id", "text"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in prefix_token_counts(both, VOCAB, 100).collect())
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((i is None, i or 0, len((t or "").encode()), size(t), size(t) > 100) for i, t in both.collect())
    small = [t[:80] for t in ODD if t and len(t) < 600] + ["I'd we'll gone !!'re"]
    rows = spark.createDataFrame(list(enumerate(small)), "doc_id long, text string")
    for r in prefix_token_counts(rows, VOCAB, 7, prefix_column=True).collect():
        text = small[r.doc_id]
        assert r.prefix_tokens == [size(text[: k + 1]) for k in range(len(text)) if not text[k].isspace()], text
        if r.over_limit:
            assert size(text[: r.fit_chars]) <= 7 and all(size(text[:k]) > 7 for k in range(r.fit_chars + 1, len(text) + 1) if not text[k - 1].isspace())


def test_limits_at_word_ends(spark, library):
    """Limits that are reached just before each word, also before the one that is worked out last, and of no tokens."""
    text = "zqalpha zqbeta zqgamma zqdelta zqepsilon"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for limit in range(size(text) + 1):
        got = prefix_token_counts(rows, VOCAB, limit).head()
        fit = max(k for k in range(len(text) + 1) if (k == len(text) or not text[:k].endswith(" ")) and size(text[:k]) <= limit)
        assert (got.n_tokens, got.over_limit, got.fit_chars) == (size(text), size(text) > limit, fit), limit


def test_kept_prefix_counts():
    """The least count of each word is its own, and words that stay don't keep the others' counts in memory."""
    with open(VOCAB, "rb") as file:
        _, known = _state(file.read())
    known.most = 1500
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    often: list[bytes] = []
    for k in range(12):
        often.append(f"often{letters[k]}".encode())
        words = often + ["".join(rng.choice(letters) for _ in range(20)).encode() for _ in range(500)]
        size = np.array([len(x) for x in words])
        known.get(b"".join(words), np.cumsum(size) - size, size)
        total, least, held = known.columns
        counts = [np.frombuffer(x, dtype=np.int32) for x in held]
        assert [(x[-1], x.min()) for x in counts] == [*zip(total, least)]
    owners = {id(own): own for x in held for own in [x if getattr(x, "base", None) is None else x.base]}
    assert sum(memoryview(x).nbytes for x in owners.values()) == sum(memoryview(x).nbytes for x in held) <= 1500 * 20 * 4


def test_long_words(spark, library):
    """Unspaced text of 20,000 random and 1,000,000 repeated letters."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "unspacedtext" * 83_334, "你好世界" * 3000 + "é" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [r.ids for r in encode_decode(rows, VOCAB).orderBy("doc_id").collect()] == ids
    got = prefix_token_counts(rows, VOCAB, 2048, prefix_column=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(x) for x in ids]
    assert all(got[0].prefix_tokens[k] == len(library.encode(texts[0][: k + 1], add_special_tokens=False).ids) for k in (63, 64, 65, 4321))
    fit = got[1].fit_chars
    assert len(library.encode(texts[1][:fit], add_special_tokens=False).ids) <= 2048


def shingles(text, words):
    found = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def near_copies(seed, n):
    """A base text and n texts with a few words changed, of varied likeness."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_are_those_of_all_pairs(spark, docs):
    texts = [t for (t,) in docs.select("text").collect()] + near_copies(1, 120) + near_copies(2, 30) + ["one two", "ONE  two", "one", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, root = [shingles(t, 4) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = sorted(map(tuple, near_duplicates(rows, words=4).collect()))
    assert got == [(k, len(sets[k]), find(k), find(k) == k) for k in range(len(texts))]


def test_template_family_meets_few_pairs(spark, monkeypatch):
    """Texts of one template, some 0.7 alike, fill buckets without links: what is rare in them
    tells the few real links; tiles of shared rare shingles are small."""
    monkeypatch.setattr(minhash_dedup, "TILE", 7)
    rng = random.Random(11)
    base = [f"t{k}" for k in range(130)]
    texts = [" ".join([*base, *(f"u{k}x{j}" for j in range(22))]) for k in range(150)]
    texts += [t + f" end{k}" for k, t in enumerate(texts[:20])] + [" ".join([*base, *rng.choices([f"s{j}" for j in range(30)], k=20)]) for _ in range(60)]
    rng.shuffle(texts)
    sets, root = [shingles(t, 5) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    met, inner = [], minhash_dedup._rare_pairs
    monkeypatch.setattr(minhash_dedup, "_rare_pairs", lambda *x: met.append(inner(*x)) or met[-1])
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(k, find(k)) for k in range(len(texts))]
    assert met and met[0].count() < len(texts) * 20


def test_near_duplicates_odd_rows(spark):
    got = near_duplicates(odd_rows(spark), words=5).collect()
    assert len(got) == len(ODD) + 2
    by_id = {r.doc_id: r for r in got}
    assert by_id[10].component_id == 9 and by_id[9].kept and not by_id[10].kept
    assert by_id[None].kept and by_id[None].component_id is None and by_id[2].kept and by_id[2].n_shingles == 0
    assert near_duplicates(odd_rows(spark).limit(0)).count() == 0
    tied = spark.createDataFrame([(5, "a b c d e f"), (3, "g h i j k"), (5, "g h i j k"), (9, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(tied).collect()} == {3}


def brute_targets(rows):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(WORDS.findall(text or ""))
    names = sorted(x for x in size if x is not None) + [None] * (None in size)
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest, weights = total - sum(2 * size[x] for x in full), sum(weight[x] for x in names if x not in full)
        target = {x: 2 * size[x] if x in full else rest * weight[x] / weights for x in names}
        over = {x for x in names if x not in full and target[x] > 2 * size[x]}
        if not over:
            return size, target
        full |= over


@pytest.mark.parametrize("hot", [0, 400])
def test_mix(spark, docs, hot):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows += [(None, "a b  c", None), (None, None, None), (5, "", "z"), (5, "x y", "z"), (5, "x y", "z")] + [(k, "hot " * 50, "src1") for k in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "doc_id")
    got, (size, target) = mix_sources(df).collect(), brute_targets(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[x] - target[x]) <= 0.5 + 1e-6 for x in size)
    assert sorted(got, key=str) == sorted(mix_sources(df.repartition(7)).collect(), key=str)
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    assert sum(len(WORDS.findall(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_mix_of_repeated_rows_and_any_columns(spark, monkeypatch):
    """Equal rows are split over parts and shares; columns may be maps or named like the result."""
    monkeypatch.setattr(mixing, "COPIES", 7)
    monkeypatch.setattr(mixing, "SHARES", 4)
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 3)
    rows = [(None, "a b c d", f"s{k}", {"x": k}, k, k) for k in range(9) for _ in range(40)] + [(1, "e f", "s1", None, 0, 0)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size map<string,int>, taken int, `a.b` int")
    size, target = brute_targets([(None, t, x) for _, t, x, *_ in rows])
    got = mix_sources(df).collect()
    assert len(got) == len(rows) and all(r.target == pytest.approx(target[r.source]) for r in got)
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(WORDS.findall(r.text))
    assert all(abs(words[x] - target[x]) <= 0.5 + 1e-6 for x in size)


def test_mix_empty(spark, docs):
    assert mix_sources(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0
    assert mix_sources(odd_rows(spark)).count() == len(ODD) + 2


def brute_spans(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        check = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and check % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[1])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+- 2(5b0é9") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("9" * 50_000 + "a" * 50_000 + "@") == brute_spans("")


def test_personal_data(spark, docs):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"fill{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(k, f"{filler(20)} Zorblax, writes ann.lee@corp.example now {filler(20)}") for k in range(4)]
    rows += [(10 + k, f"{filler(30)} common words stand here {filler(5)}") for k in range(40)]
    rows += [(60 + k, f"one copied text {rows[0][1]}") for k in range(1)] + [(70, "Zorblax alone"), (71, None), (None, ""), (72, "common +1 (555) 123-4567 x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, found int")
    got = {r.doc_id: r for r in pii.find_personal_data(df, clean_text=True).collect()}
    text = dict(rows)
    for i, r in got.items():
        base = ",".join(f"{k}:{a}:{b}" for a, k, b in brute_spans(text[i] or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[70].spans == "term:0:7" and got[70].clean_text == "[NAME] alone"
    assert "ann.lee" not in got[0].clean_text and "[EMAIL]" in got[0].clean_text and "Zorblax" not in got[0].clean_text
    assert got[71].clean_text is None and got[71].spans == "" and got[72].clean_text == "common [PHONE] x"
    assert "common words stand" in got[10].clean_text
    assert pii.find_personal_data(df.limit(0)).count() == 0
    assert pii.find_personal_data(odd_rows(spark)).count() == len(ODD) + 2


def test_short_and_distant_terms_disclose(spark):
    rng = random.Random(6)
    filler = lambda n: " ".join(f"fill{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(k, f"From Quuxley {filler(40)} ask Bo, at bo.w@corp.example {filler(40)} of it") for k in range(4)]
    rows += [(4, f"Quuxley bo.w@corp.example {filler(5)}")] + [(10 + k, f"{filler(30)} of it From ask at {filler(5)}") for k in range(60)]
    got = {r.doc_id: r.clean_text for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), clean_text=True).collect()}
    assert all("Quuxley" not in got[k] for k in range(5)) and all(" Bo," not in got[k] for k in range(4))
    assert all("From [NAME] fill" in got[k] and "ask [NAME], at [EMAIL]" in got[k] and got[k].endswith(" of it") for k in range(4))
    assert all(got[i] == t for i, t in rows if i >= 10)


@pytest.mark.parametrize("pages", [0, 5])
def test_disclosing_terms_are_those_of_all_counts(spark, pages):
    """The terms of a random corpus against direct counts of documents; also with near copies of a
    directory of many addresses and words, some of which stand elsewhere too."""
    rng, rows = random.Random(7), []
    for k in range(300):
        words = [f"t{rng.randrange(60)}" for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.4:
            e = rng.randrange(12)
            words += [f"u{e}@corp.example"] + [f"x{e}"] * (rng.random() < 0.8) + [f"y{e % 5}"] * (rng.random() < 0.5)
            rng.shuffle(words)
        rows.append((k, " ".join(words)))
    rows += [(300 + k, rows[k][1]) for k in range(40)]
    listed = [f"d{k}@corp.example" for k in range(60)] + [f"v{k}" for k in range(400)] + [f"t{k}" for k in range(0, 60, 7)]
    for k in range(pages):
        rng.shuffle(listed)
        rows += [(400 + k, " ".join(listed[: 460 - 15 * k])), (500 + k, " ".join(w for w in listed[:9] if "@" not in w))]
    docs, held, texts_of = defaultdict(set), defaultdict(set), {i: t for i, t in rows}
    for i, t in rows:
        for w in set(t.split()):
            docs[w].add(i)
            if "@" in w:
                held[w].add(i)
    want = set()
    for e, mine in held.items():
        for w, own in docs.items():
            both = own & mine
            if "@" not in w and len({texts_of[i] for i in both}) >= pii.SUPPORT:
                carried = math.log2(len(rows) / len(mine))
                if carried > 0 and math.log2(len(both) * len(rows) / (len(own) * len(mine))) >= pii.DISCLOSURE * carried:
                    want.add(w)
    assert 5 < len(want) < 60 + 80 * pages
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        text, at, spans = texts_of[r.doc_id], 0, []
        for w in text.split():
            spans += [f"term:{at}:{at + len(w)}"] * (w in want)
            at += len(w) + 1
        assert [x for x in r.spans.split(",") if x.startswith("term")] == spans


def test_many_terms_in_a_long_text(spark):
    rows = [(k, f"ann@corp.example {'é ' * k}" + " ".join(f"zz{j}" for j in range(20_000))) for k in range(3)] + [(10 + k, f"other {k} words") for k in range(50)]
    got = pii.sanitised_documents(spark.createDataFrame([(t, i, {"a": 1}, "kept", i) for i, t in rows], "text string, doc_id long, n_term map<string,int>, clean_text string, found long"))
    assert got.columns == ["text", "doc_id", "n_term", "clean_text", "found"]
    held = {r.doc_id: r for r in got.collect()}
    assert held[2].text.count("[TERM]") == 20_000 and held[2].clean_text == "kept" and held[2].n_term == {"a": 1} and held[12].text == "other 2 words"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train(docs, labels)
    rows = score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted and not r.toxic for r in held) <= 0.02 * len(held)
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    assert sum((t > c) + (t == c) / 2 for t in toxic for c in clean) / (len(toxic) * len(clean)) > 0.88
    odd = [(1, "you i.d.i.o.t"), (2, "an idiot"), (3, "you i d i o t"), (4, "an idioot"), (5, "fine words"), (6, None), (7, "")]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == got[3] and got[4] > got[5] and got[6] == got[7]
    few = odd_rows(spark)
    assert score(few, model).count() == len(ODD) + 2 and score(few.limit(0), model).count() == 0
    assert clean_documents(few, model).columns == few.columns
    assert clean_documents(docs, model).count() == score(docs, model).where("predicted = 0").count()
    nobody = train(docs, labels.where("toxic = 0"))
    assert score(few, nobody).where("score > 0.01").count() == 0


def test_kernel_is_that_of_all_subsequences():
    """The kernel, its Nystroem map and the margins against direct enumeration."""
    rng = random.Random(4)

    def brute(a, b):
        total = 0.0
        for i in itertools.combinations(range(len(a)), 3):
            for j in itertools.combinations(range(len(b)), 3):
                if [a[x] for x in i] == [b[x] for x in j]:
                    total += toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
        return total

    like = lambda a, b: brute(a, b) / math.sqrt(brute(a, a) * brute(b, b)) if min(len(a), len(b)) > 2 else 0.0
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))).encode() for _ in range(60)] + ["éaéb".encode()]
    marks = tuple(sorted({w for w in words if len(w) > 2}))[:9]
    landmarks = toxicity.Landmarks(marks)
    want = np.array([[like(w, z) for z in marks] for w in words])
    assert np.allclose(landmarks.matrix(words), want)
    gram = landmarks.matrix([*marks])
    root = toxicity.inverse_root(gram)
    assert np.linalg.eigvalsh(gram).min() > -1e-9
    if np.linalg.eigvalsh(gram).min() > 0.05:
        assert np.allclose((gram @ root) @ (gram @ root).T, gram)
    judges = tuple(toxicity.Judge(np.array([rng.gauss(0, 1) for _ in marks]), b) for b in (-0.5, 0.25))
    reader = toxicity.Reader(marks, judges)
    texts = [b" ".join(words[k : k + 4]).decode() for k in range(0, 60, 4)] + ["", None, "a b c a b"]
    margins, vectors = reader(pa.array(texts), witness=True)
    for t, got, vector in zip(texts, margins, vectors):
        own = [w.encode() for w in (t or "").split()] + ([b"abcab"] if t == "a b c a b" else [])
        rows = np.array([[like(w, z) for z in marks] for w in own]).reshape(-1, len(marks))
        assert np.allclose(got, [max([j.bias, *(rows @ j.beta + j.bias)]) for j in judges], atol=1e-5)
        assert np.allclose(vector @ judges[0].beta + judges[0].bias, got[0], atol=1e-5)


def test_long_words_are_read_whole():
    owner, offset, size = toxicity.windows(np.array([5, 12, 13, 30, 0]))
    for k, n in enumerate([5, 12, 13, 30]):
        seen = {x for o, a, m in zip(owner, offset, size) if o == k for x in range(a, a + m)}
        assert seen == set(range(n))


def test_hashes_of_crc32(spark):
    import zlib

    from tallyforge.llm.toxicity import held_out

    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_runs_of_letters_and_invisible_marks():
    words = [b"idddiot", "tr\u200bash".encode(), b"grassss", b"see", b"", b"aaa"]
    raw = b" ".join(words)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - lengths - 1
    plain, s, n = toxicity.fold(raw, starts, lengths)
    assert [plain[a : a + k] for a, k in zip(s, n)] == [b"idddiot", b"trash", b"grassss", b"see", b"", b"aaa"]
    whole, s, n, of = toxicity.views(plain, s, n)
    got = {}
    for a, k, w in zip(s.tolist(), n.tolist(), of.tolist()):
        got.setdefault(w, []).append(whole[a : a + k])
    assert got == {
        0: [b"idddiot", b"idiot", b"iddiot"], 1: [b"trash"], 2: [b"grassss", b"gras", b"grass"],
        3: [b"see"], 4: [b""], 5: [b"aaa", b"a", b"aa"],
    }
