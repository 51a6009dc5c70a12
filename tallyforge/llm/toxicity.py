"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two strings sums, over all subsequences of three characters that they
share, the weight DECAY to the power of the lengths these span in both, and is divided by
the root of both strings' own kernels; so a gapped or padded insult stays close to the plain
one. Landmarks are strings that labelled texts tie to toxicity, and common clean words that
resemble them. The Nystroem map of a word is its kernel values with the landmarks times the
inverse root of the landmarks' kernel matrix, and a linear SVM over that map judges words. A
text is as toxic as its most toxic word: training starts from the strings of labelled texts,
then finds that word of each text in every round and adds it (a multiple-instance SVM). Margins of texts whose words the
fitted part hasn't been given (three folds) calibrate the score. Characters are folded first (case, look-alike digits,
punctuation inside words and invisible marks dropped; lone letters in a row are read as one word); a word
with a letter three times or more in a row is also read with that letter once and twice.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import Known, packed
from tallyforge.llm.common import bounded_batches, cut, worker_state
from tallyforge.llm.textblocks import find_words, slices, text_bytes

DECAY = 0.75
#: Letters of a word that the kernel sees at once; longer words are as many overlapping windows
#: as they need, the last one at their end.
WINDOW, STRIDE = 12, 4
#: Subsequences that are looked up together.
TOGETHER = 1 << 21
#: Fold of bytes: letters, look-alikes, and bytes above ASCII as they are; others go.
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    FOLD[_a] = _b
#: Folded bytes as numbers below SYMBOLS.
SYMBOLS = 155
CODE = np.zeros(256, dtype=np.int32)
CODE[97:123], CODE[128:] = np.arange(1, 27), np.arange(27, SYMBOLS)
#: The most labelled texts that training looks at, how many landmarks it takes, and from how
#: many of the strongest strings of either kind.
TRAIN_ROWS, TOXIC_MARKS, CLEAN_MARKS, MARK_POOL = 12_000, 40, 16, 2000
#: How strongly (twice a log likelihood ratio) a string must go with toxic texts.
TIE = 20
ROUNDS, FOLDS = 4, 3
#: Characters without width, in UTF-8: soft hyphen, zero-width space, joiners, direction marks, word joiner, byte order mark.
INVISIBLE = re.compile(rb"\xc2\xad|\xe2\x80[\x8b-\x8f]|\xe2\x81\xa0|\xef\xbb\xbf")
LONG_RUN = re.compile(rb"(.)\1\1+", re.DOTALL)


def fold(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words (ranges of ``raw``) after folding, end to end."""
    code = FOLD[np.frombuffer(raw, dtype=np.uint8)]
    for m in INVISIBLE.finditer(raw):
        code[m.start() : m.end()] = 0
    kept = np.append(0, np.cumsum(code > 0))
    # look-alikes alone ("1", "$5") are no letters: a word needs a real one
    real = np.append(0, np.cumsum((code >= 97) & (code == np.frombuffer(raw, dtype=np.uint8) | 32)))
    size = kept[starts + lengths] - kept[starts]
    size = np.where(real[starts + lengths] > real[starts], size, 0)
    owner = np.repeat(np.arange(len(starts)), lengths)
    if len(raw) == int(lengths.sum()):
        inside = code
    else:
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        inside = code[at]
    inside = inside[(inside > 0) & (size[owner] > 0)]
    return inside.tobytes(), np.cumsum(size) - size, size


def views(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Folded words, end to end, followed by those with a letter three times or more in a row, that letter
    once and twice: bytes, starts, lengths and the word each one is a view of."""
    code = np.frombuffer(raw, dtype=np.uint8)
    run = np.flatnonzero((code[2:] == code[1:-1]) & (code[1:-1] == code[:-2]))
    words = np.unique(np.searchsorted(starts + lengths, run, side="right"))
    more, owner = [], []
    for k in words.tolist():
        word = raw[starts[k] : starts[k] + lengths[k]]
        if LONG_RUN.search(word):
            more += [LONG_RUN.sub(rb"\1", word), LONG_RUN.sub(rb"\1\1", word)]
            owner += [k, k]
    size = np.array([len(w) for w in more], dtype=np.int64)
    begin = len(raw) + np.cumsum(size) - size
    whole = np.concatenate([np.arange(len(starts)), np.array(owner, dtype=np.int64)])
    return raw + b"".join(more), np.concatenate([starts, begin]), np.concatenate([lengths, size]), whole


@functools.cache
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the subsequences of three among n letters, and the lengths they span."""
    i, j, k = (np.array(x) for x in zip(*itertools.combinations(range(n), 3)))
    return i, j, k, k - i + 1


WEIGHTS = DECAY ** np.arange(WINDOW + 4.0)


def _sequences(codes: np.ndarray) -> np.ndarray:
    """[words, subsequences]: a number for each subsequence of words of one length."""
    i, j, k, _ = triples(codes.shape[1])
    first = codes * SYMBOLS
    return (first[:, i] + codes[:, j]) * SYMBOLS + codes[:, k]


def _own(sequences: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself: squares of the summed weights of equal subsequences."""
    ranked = np.sort(sequences.astype(np.int64) * 16 + spans, axis=1)
    first = np.ones(ranked.shape, dtype=bool)
    first[:, 1:] = ranked[:, 1:] >> 4 != ranked[:, :-1] >> 4
    sums = np.add.reduceat(WEIGHTS[ranked & 15].ravel(), np.flatnonzero(first.ravel()))
    return np.add.reduceat(sums**2, np.append(0, np.cumsum(first.sum(axis=1))[:-1]))


def features(word: bytes) -> dict[int, float]:
    """The normalised weight of each subsequence of a folded word of WINDOW letters at most."""
    found: dict[int, float] = {}
    if len(word) >= 3:
        spans = triples(len(word))[3]
        for x, n in zip(_sequences(CODE[np.frombuffer(word, dtype=np.uint8)][None, :])[0].tolist(), spans.tolist()):
            found[x] = found.get(x, 0.0) + DECAY**n
    size = sum(w * w for w in found.values()) ** 0.5
    return {x: w / size for x, w in found.items()}


def product(a: dict[int, float], b: dict[int, float]) -> float:
    """The normalised kernel of two words by their features."""
    return sum(w * b[x] for x, w in a.items() if x in b)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of words: word, offset, size."""
    n = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    offset = np.minimum(number * STRIDE, np.maximum(lengths[owner] - WINDOW, 0))
    return owner, offset, np.minimum(lengths[owner], WINDOW)


class Landmarks:
    """The kernel with a fixed list of strings (of WINDOW letters at most), by their subsequences."""

    def __init__(self, marks: tuple[bytes, ...]):
        self.marks, own = marks, [features(z) for z in marks]
        self.known = np.array(sorted({x for f in own for x in f}), dtype=np.int64)
        self.weight = np.array([[f.get(x, 0.0) for f in own] for x in self.known.tolist()]).reshape(len(self.known), len(marks))

    def table(self, beta: np.ndarray) -> np.ndarray:
        """What each subsequence adds to the sum of the kernel values times ``beta``."""
        out = np.zeros(SYMBOLS**3, dtype=np.float32)
        out[self.known] = self.weight @ beta
        return out

    def matrix(self, words: list[bytes]) -> np.ndarray:
        """[words, marks]: kernel values of folded words of WINDOW letters at most."""
        own = [features(w) for w in words]
        place = {x: k for k, x in enumerate(self.known.tolist())}
        out = np.zeros((len(words), len(self.marks)))
        for row, f in zip(out, own):
            for x, w in f.items():
                if x in place:
                    row += w * self.weight[place[x]]
        return out


def linear(tables: list[np.ndarray], raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, offset, size, [tables]) for each window of folded words whose kernel values times
    beta have a sum above 0 for some table; other windows can't raise a margin."""
    code = CODE[np.frombuffer(raw, dtype=np.uint8)]
    owner, offset, size = windows(lengths)
    rows_of, values = [np.zeros(0, dtype=np.int64)], [np.zeros((0, len(tables)))]
    for n in range(3, WINDOW + 1):
        spans = triples(n)[3]
        weights = WEIGHTS[spans].astype(np.float32)
        pick, step = np.flatnonzero(size == n), max(1, TOGETHER // len(spans))
        for k in range(0, len(pick), step):
            rows = pick[k : k + step]
            found = _sequences(code[(starts[owner[rows]] + offset[rows])[:, None] + np.arange(n)])
            sums = np.column_stack([t[found] @ weights for t in tables])
            up = np.flatnonzero((sums > 0).any(axis=1))
            if len(up):
                rows_of.append(rows[up])
                values.append(sums[up] / np.sqrt(_own(found[up], spans))[:, None])
    at = np.concatenate(rows_of)
    return owner[at], offset[at], size[at], np.concatenate(values)


def _spelled(raw: bytes, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> list[tuple[int, bytes]]:
    """(text, word) for each run of three or more lone letters."""
    lone = np.append(np.append(False, (lengths == 1)), False)
    begins, ends = np.flatnonzero(~lone[:-1] & lone[1:]), np.flatnonzero(lone[:-1] & ~lone[1:])
    out = []
    cuts = set(at.tolist())
    for a, b in zip(begins.tolist(), ends.tolist()):
        now = a
        for k in range(a + 1, b + 1):
            if k == b or k in cuts:
                if k - now >= 3:
                    out.append((int(np.searchsorted(at, now, side="right")) - 1, bytes(raw[starts[j]] for j in range(now, k))))
                now = k
    return out


@dataclass(frozen=True)
class Judge:
    """A linear function of the kernel with the landmarks: what it gives a word."""

    beta: np.ndarray
    bias: float


@dataclass(frozen=True)
class Model:
    marks: tuple[bytes, ...]
    judge: Judge
    slope: float
    shift: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


class Reader:
    """Texts to the margins of their most toxic words, for some judges; keeps what it knows of
    distinct words. A text without words, and any text beside its words, has the margin of a
    word that is like no landmark."""

    def __init__(self, marks: tuple[bytes, ...], judges: tuple[Judge, ...]):
        self.landmarks, self.base = Landmarks(marks), np.array([j.bias for j in judges])
        self.tables = [self.landmarks.table(j.beta) for j in judges]
        self.known = Known(lambda words: [self._margins(*fold(*packed(words)))], 200_000)

    def _margins(self, raw, starts, lengths) -> np.ndarray:
        """[words, judges]"""
        out = np.tile(self.base, (len(starts), 1))
        raw, starts, lengths, word = views(raw, starts, lengths)
        owner, _, _, values = linear(self.tables, raw, starts, lengths)
        np.maximum.at(out, word[owner], values + self.base)
        return out

    def __call__(self, column, witness: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """[texts, judges] margins and, for ``witness``, [texts, marks]: the kernel values of the
        word with the first judge's margin."""
        raw, offsets = text_bytes(column)
        starts, lengths, at = find_words(raw, offsets)
        out = np.tile(self.base, (len(at) - 1, 1))
        best = np.full(len(out), b"", dtype=object)

        def raise_to(texts, margins, word):
            """Margins of words go to their texts; ``word(k)`` is the folded k-th of them."""
            hot = np.flatnonzero((margins > self.base).any(axis=1))
            before = out[:, 0].copy()
            np.maximum.at(out, texts[hot], margins[hot])
            if witness:
                for k in hot[(margins[hot, 0] == out[texts[hot], 0]) & (margins[hot, 0] > before[texts[hot]])].tolist():
                    best[texts[k]] = word(k)

        if len(starts):
            rows, held = self.known.get(raw, starts, lengths), self.known.columns[0]
            hot = np.flatnonzero((held > self.base).any(axis=1)[rows])
            raise_to(np.searchsorted(at, hot, side="right") - 1, held[rows[hot]], lambda k: raw[starts[hot[k]] : starts[hot[k]] + lengths[hot[k]]])
            if spelled := _spelled(raw, starts, lengths, at):
                words = [w for _, w in spelled]
                raise_to(np.array([t for t, _ in spelled]), self._margins(*fold(*packed(words))), lambda k: words[k])
        return out, self._vectors(best.tolist()) if witness else out[:, :0]

    def _vectors(self, words: list[bytes]) -> np.ndarray:
        """[words, marks]: kernel values of each word's window with the largest margin."""
        raw, starts, lengths, word = views(*fold(*packed(words)))
        owner, offset, size, values = linear(self.tables[:1], raw, starts, lengths)
        picked = [b""] * len(words)
        for k in np.lexsort((offset, values[:, 0])).tolist():
            begin = starts[owner[k]] + offset[k]
            picked[word[owner[k]]] = raw[begin : begin + size[k]]
        return self.landmarks.matrix(picked)


def _stems(batches):
    """Distinct folded words of each text (their windows, if long) and their beginnings of four
    to seven letters."""
    worker_state("stems", dict)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            raw, offsets = text_bytes(part.column("text"))
            starts, lengths, at = find_words(raw, offsets)
            plain, s, n = fold(raw, starts, lengths)
            owner, offset, size = windows(n)
            own_at = np.searchsorted(owner, at)
            begin = (s[owner] + offset).tolist()
            size = size.tolist()
            toxic = part.column("toxic").to_pylist()
            words, flags = [], []
            for k, (a, b) in enumerate(zip(own_at[:-1].tolist(), own_at[1:].tolist())):
                own = {plain[begin[j] : begin[j] + size[j]] for j in range(a, b) if size[j] >= 4}
                own |= {w[:m] for w in own for m in range(4, min(8, len(w)))}
                words += own
                flags += [toxic[k]] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(flags, pa.int32())], names=["word", "toxic"])


def _tie(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Twice the log likelihood ratio, negative if the word is rarer in toxic texts."""
    whole = n_toxic + n_clean
    cells = [(toxic, n_toxic), (clean, n_clean), (n_toxic - toxic, n_toxic), (n_clean - clean, n_clean)]
    share = [(toxic + clean) / whole] * 2 + [1 - (toxic + clean) / whole] * 2
    g = 2 * sum(x * np.log(x / (n * p)) for (x, n), p in zip(cells, share) if x > 0)
    return g if toxic * n_clean > clean * n_toxic else -g


def choose_marks(counts: list, n_toxic: int, n_clean: int) -> tuple[list[bytes], list[bytes]]:
    """Toxic and clean landmarks from (word, toxic, clean) counts: strongest ties first, none
    too like another; the clean ones are those most like the toxic ones."""
    ties = {w: _tie(t, c, n_toxic, n_clean) for w, t, c in counts}
    ranked = sorted((-ties[w], -len(w), w) for w, t, c in counts if t >= 3 and ties[w] > TIE)
    known = functools.cache(features)
    apart = lambda w, zs: all(product(known(w), known(z)) <= 0.7 for z in zs)
    marks: list[bytes] = []
    for _, _, w in ranked:
        if len(marks) < TOXIC_MARKS and not any(w in z or z in w for z in marks) and apart(w, marks):
            marks.append(w)
    clean = sorted((w for w, t, c in counts if c >= 5 and ties[w] <= 0))
    chosen: list[bytes] = []
    if marks and clean:
        near = Landmarks(tuple(marks)).matrix(clean).max(axis=1)
        for k in np.argsort(-near, kind="stable"):
            if len(chosen) < CLEAN_MARKS and near[k] > 0 and apart(clean[k], chosen):
                chosen.append(clean[k])
    return marks, chosen


def inverse_root(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T


def fit_judge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, root: np.ndarray) -> Judge:
    """The SVM over the Nystroem map ``x @ root``, as a function of the kernel values x."""
    order = np.lexsort([*x.T, weight, y])  # sums don't depend on the order of the rows
    w, bias = fit_svm(x[order] @ root, y[order], weight[order])
    return Judge(root @ w, bias)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """A linear SVM with weighted squared hinge loss, by Newton steps; y is -1 or 1."""
    with_one = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(with_one.shape[1]), np.append(np.full(x.shape[1], penalty), 1e-3)
    for _ in range(50):
        inside = y * (with_one @ w) < 1
        a, c = with_one[inside], weight[inside]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(ridge), a.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (margin, label)."""
    hits, misses = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (hits + 1) / (hits + 2), 1 / (misses + 2))
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id):
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _witness(marks, judges, vectors: bool):
    """Labelled texts to toxic, fold, margins and the kernel values of the most toxic word."""

    def run(batches):
        reader = Reader(marks, judges)
        for batch in batches:
            for part in slices(batch, "text"):
                margins, held = reader(part.column("text"), vectors)
                lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("fold"), lists(margins), lists(held)], names=["toxic", "fold", "margins", "vector"])

    return run


def _collected(rows: DataFrame, marks, judges, vectors: bool):
    got = rows.mapInArrow(_witness(marks, judges, vectors), "toxic int, fold int, margins array<double>, vector array<double>").collect()
    column = lambda name: np.array([r[name] for r in got], dtype=np.float64)
    return np.where(column("toxic") > 0, 1.0, -1.0), column("fold").astype(int), column("margins"), column("vector")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learns from labelled rows that aren't held out, about ``most`` of them at most
    (drawn by a hash of the id). Without both classes the model scores everything 0.

    What the driver gets is a row of a few dozen numbers for each text of that sample."""
    bounded_batches(docs.sparkSession)
    nothing = Model((), Judge(np.zeros(0), 0.0), 0.0, -60.0)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    part = min(1.0, most / max(1, total))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    text = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    fold_of = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = cut(text.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", fold_of))  # the sample has a bound
    classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = classes.get(1, 0), classes.get(0, 0)
    if not n_toxic or not n_clean:
        return nothing
    counts = rows.select("text", "toxic").mapInArrow(_stems, "word binary, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    )
    counts = cut(counts.where("t + c >= 3"))
    rate = (F.col("t") + 0.5) / (F.col("c") + 0.5)
    strong = counts.orderBy(F.desc(F.sqrt("t") * F.log(rate * n_clean / n_toxic)), "word").limit(MARK_POOL).collect()
    common = counts.where(rate * n_clean < n_toxic).orderBy(F.desc("c"), "word").limit(MARK_POOL).collect()
    found = {bytes(r["word"]): r for r in [*strong, *common]}
    toxic, clean = choose_marks([(w, r["t"], r["c"]) for w, r in sorted(found.items())], n_toxic, n_clean)
    marks = (*toxic, *clean)
    if not toxic:
        return nothing
    landmarks = Landmarks(marks)
    root = inverse_root(landmarks.matrix([*marks]))
    #: Landmarks count once for each toxic and each clean text that holds them.
    pool = landmarks.matrix([*marks])
    times = np.array([(found[w]["t"], found[w]["c"]) for w in marks], dtype=np.float64)
    x, z = np.concatenate([pool, pool]), np.repeat([1.0, -1.0], len(pool))
    weight, of = times.T.ravel(), np.full(2 * len(pool), -1)
    judge = fit_judge(x, z, weight, root)
    for _ in range(ROUNDS):  # the most toxic words of texts, as they are found
        y, fold, _, vectors = _collected(rows, marks, (judge,), True)
        x, z = np.concatenate([x, vectors]), np.append(z, y)
        weight, of = np.append(weight, np.ones(len(y))), np.append(of, fold)
        judge = fit_judge(x, z, weight, root)
    apart = tuple(fit_judge(x[of != k], z[of != k], weight[of != k], root) for k in range(FOLDS))
    y, fold, margins, _ = _collected(rows, marks, apart, False)
    slope, shift = calibrate(margins[np.arange(len(y)), fold], y)
    return Model(marks, judge, slope, shift)


def _reader(model: Model) -> Reader:
    key = ("toxicity", model.marks, model.judge.beta.tobytes(), model.judge.bias)
    return worker_state(key, lambda: Reader(model.marks, (model.judge,)))


def _scores(model: Model, column) -> np.ndarray:
    return model.score(_reader(model)(column)[0][:, 0]) if model.marks else np.zeros(len(column))


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(model, part.column("text")), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold``) for each row.

    Only the whole text counts. Defined results: null and blank texts score as a text
    without words; null and repeated ids are kept as they are (a null id isn't held out);
    other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = base.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever
    their names and types."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(_scores(model, part.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
