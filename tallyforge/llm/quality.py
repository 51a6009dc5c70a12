"""Document quality by co-training of two views.

One logistic classifier sees the text's content, another the page's metadata (language,
source, stated length: all that ``documents`` has; ``pages`` shares no key with it). Both start from labelled rows; in each round either learns also
from the documents of which the other is confident, over all documents. Last, each view
is calibrated on labelled rows, and the two are combined as independent evidence.

Fitting is distributed: every Newton step is one pass over the (narrow, written) features
in which a task gives one row of sums; nothing of a single document goes to the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bounded_batches, cut, worker_state
from tallyforge.llm.textblocks import find_words, slices, text_bytes, word_hashes
from tallyforge.llm.toxicity import held_out

ROUNDS, STEPS, FIRST_STEPS = 3, 3, 6
#: How sure a view must be to teach the other, and what such a label weighs.
CONFIDENT, PSEUDO = 0.97, 0.3
RIDGE = 1.0
#: Byte classes: lower, upper, digit, space, line end, sentence marks, other marks, above ASCII, control.
CLASS = np.full(256, 8, dtype=np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 7
CLASS[33:48] = CLASS[58:65] = CLASS[91:97] = CLASS[123:127] = 6
CLASS[[32, 9, 11, 12]], CLASS[[10, 13]] = 3, 4
CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
CLASSES = 9
#: Buckets of hashed names (whole names).
SOURCES, LANGS = 64, 16
#: Partial sums that reach the driver at most.
SUMS = 32
TEXT_SIZE, META_SIZE = CLASSES * CLASSES + CLASSES + 14, SOURCES + LANGS + 12


def text_features(column) -> np.ndarray:
    """[texts, TEXT_SIZE]: shares of byte classes and of their successions, and of words,
    lines and repeats; all between 0 and about 1."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, TEXT_SIZE))
    out[:, -1] = 1
    if not raw:
        return out
    kind = CLASS[np.frombuffer(raw, dtype=np.uint8)]
    starts, lengths, at = find_words(raw, offsets)
    keys = word_hashes(raw, starts, lengths)
    ends = kind[starts + lengths - 1] if len(starts) else np.zeros(0, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)
    for k in range(n):
        a, b, p, q = offsets[k], offsets[k + 1], at[k], at[k + 1]
        if b == a:
            continue
        own = kind[a:b]
        out[k, :CLASSES] = np.bincount(own, minlength=CLASSES) / (b - a)
        pairs = np.bincount(own[:-1] * CLASSES + own[1:], minlength=CLASSES * CLASSES)
        out[k, CLASSES : CLASSES + CLASSES * CLASSES] = np.sqrt(pairs / max(1, b - a - 1))
        words = max(1, q - p)
        distinct, times = np.unique(keys[p:q], return_counts=True)
        lines = np.flatnonzero(data[a:b] == 10)
        bounds = np.concatenate([[0], lines + 1, [b - a]])
        text = [raw[a + x : a + y].strip() for x, y in zip(bounds[:-1], bounds[1:])]
        full = [x for x in text if x]
        mean = lengths[p:q].mean() if q > p else 0
        share = out[k, :CLASSES]
        out[k, CLASSES + CLASSES * CLASSES : -1] = [
            min(np.log1p(b - a) / 12, 1.5),
            min(words / 1000, 1),
            min(mean / 12, 2),
            len(distinct) / words,
            (times.max() if len(times) else 0) / words,
            (ends[p:q] == 6).sum() / words,
            (ends[p:q] == 5).sum() / words,
            (lengths[p:q] == 1).sum() / words,
            (lengths[p:q] > 20).sum() / words,
            1 - len(set(full)) / max(1, len(full)),
            min(len(full) / 100, 1),
            min((b - a) / max(1, len(full)) / 500, 2),
            -(share[share > 0] * np.log(share[share > 0])).sum() / 2,
        ]
    return out


def meta_features(lang, source, n_chars) -> np.ndarray:
    """[rows, META_SIZE]: hashed source and language, and ranges of the stated length."""
    n = len(lang)
    out = np.zeros((n, META_SIZE))
    place = lambda x, m: int.from_bytes(hashlib.blake2b(b"\0" if x is None else x.encode(), digest_size=8).digest(), "little") % m
    known: dict = {}
    for k in range(n):
        for x, m, base in ((source[k], SOURCES, 0), (lang[k], LANGS, SOURCES)):
            if (x, m) not in known:
                known[x, m] = place(x, m)
            out[k, base + known[x, m]] = 1
    size = np.array([-1 if x is None else x for x in n_chars], dtype=np.float64)
    log = np.log1p(np.maximum(size, 0))
    base = SOURCES + LANGS
    out[:, base] = size < 0
    out[:, base + 1] = log / 12
    out[np.arange(n), base + 2 + np.clip(log - 3, 0, 8).astype(int)] = 1
    out[:, -1] = 1
    return out


_FEATURES = "id long, text_view array<float>, meta_view array<float>"


def _describe(batches):
    worker_state("quality", dict)
    for batch in batches:
        for part in slices(batch, "text"):
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            meta = meta_features(*(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists(text_features(part.column("text"))), lists(meta)], names=["id", "text_view", "meta_view"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _matrix(column, width) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _newton_sums(x, w, y, weight) -> np.ndarray:
    """Gradient and Hessian of the weighted logistic loss, flat."""
    p = _sigmoid(x @ w)
    return np.concatenate([x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])


def _pass(weights, teachers, scales):
    """A task's sums for one Newton step of both views (of the scales, if ``scales``)."""

    def run(batches):
        sums = None
        for batch in batches:
            views = [_matrix(batch.column("text_view"), TEXT_SIZE), _matrix(batch.column("meta_view"), META_SIZE)]
            label = np.array([-1 if v is None else v for v in batch.column("label").to_pylist()], dtype=np.float64)
            part = []
            for k in (0, 1):
                y, weight = np.where(label > 0, 1.0, 0.0), (label >= 0).astype(np.float64)
                if teachers is not None:
                    other = _sigmoid(views[1 - k] @ teachers[1 - k])
                    new = (label < 0) & ((other >= CONFIDENT) | (other <= 1 - CONFIDENT))
                    y, weight = np.where(new, other > 0.5, y), np.where(new, PSEUDO, weight)
                x = views[k] if scales is None else np.column_stack([views[k] @ weights[k], np.ones(len(label))])
                part.append(_newton_sums(x, weights[k] if scales is None else scales[k], y, weight))
            part.append(np.array([(label > 0).sum(), (label == 0).sum()], dtype=np.float64))
            flat = np.concatenate(part)
            sums = flat if sums is None else sums + flat
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sums of a group of tasks, in the order of tasks."""
    table = table.sort_by("task")
    sums = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    return pa.table({"part": table.column("part")[:1], "sums": pa.array([sums.sum(axis=0).tolist()], pa.list_(pa.float64()))})


def _step(rows: DataFrame, weights, teachers=None, scales=None):
    """One Newton step. Sums of tasks are added in SUMS groups before they reach the driver."""
    each = rows.mapInArrow(_pass(weights, teachers, scales), "sums array<double>").withColumn("task", F.spark_partition_id())
    parts = each.withColumn("part", F.col("task") % SUMS).groupBy("part").applyInArrow(_added, "part int, sums array<double>")
    got = sorted(parts.collect(), key=lambda r: r["part"])
    now = scales if scales is not None else weights
    if not got:
        return now, (0, 0)
    sums, at, out = np.sum([r["sums"] for r in got], axis=0), 0, []
    for w in now:
        d = len(w)
        gradient, hessian = sums[at : at + d], sums[at + d : at + d + d * d].reshape(d, d)
        ridge = RIDGE if scales is None else 1e-6
        out.append(w - np.linalg.solve(hessian + ridge * np.eye(d), gradient + ridge * w * (scales is None)))
        at += d + d * d
    return out, tuple(sums[at : at + 2])


@dataclass(frozen=True)
class CoTrained:
    weights: list
    scales: list
    prior: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = [(x @ w) * s[0] + s[1] for x, w, s in zip((text, meta), self.weights, self.scales)]
        return _sigmoid(odds[0] + odds[1] - self.prior), _sigmoid(odds[0]), _sigmoid(odds[1])


def co_train(rows: DataFrame) -> CoTrained:
    """Fits on features (text_view, meta_view, label null where unknown)."""
    weights = [np.zeros(TEXT_SIZE), np.zeros(META_SIZE)]
    for _ in range(FIRST_STEPS):
        weights, counts = _step(rows, weights)
    if min(counts) > 0:
        for _ in range(ROUNDS):
            teachers = [w.copy() for w in weights]
            for _ in range(STEPS):
                weights, _ = _step(rows, weights, teachers)
    scales = [np.array([1.0, 0.0]), np.array([1.0, 0.0])]
    if min(counts) > 0:
        for _ in range(STEPS):
            scales, _ = _step(rows, weights, scales=scales)
    prior = float(np.log((counts[0] + 0.5) / (counts[1] + 0.5)))
    return CoTrained(weights, scales, prior)


def _score(model: CoTrained):
    def run(batches):
        for batch in batches:
            both, text, meta = model.score(_matrix(batch.column("text_view"), TEXT_SIZE), _matrix(batch.column("meta_view"), META_SIZE))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.float64()) for x in (both, text, meta))], names=["doc_id", "score", "text_score", "meta_score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), text_score, meta_score, predicted.

    Labels of held-out rows (crc32 of the id modulo 3 is 1) are never used. All documents take
    part in the exchange of pseudo-labels and are scored.

    Defined results: null and blank texts score as texts without words; null languages,
    sources and lengths are values of their own; null ids are unlabelled; of several labels
    of an id the largest counts; repeated rows are scored alike; columns with other names
    are ignored; without labels of both classes every score is about the share of the one
    there is (0.5 for none); an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")
    )
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("label"))
    features = base.mapInArrow(_describe, _FEATURES)
    rows = cut(features.join(known, "id", "left"))
    out = rows.mapInArrow(_score(co_train(rows)), "doc_id long, score double, text_score double, meta_score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= threshold).cast("int").alias("predicted"))
