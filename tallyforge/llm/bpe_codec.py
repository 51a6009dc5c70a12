"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can
never be joined by any merge. Every word is cut at all such places; the fragments are
merged independently and their ids concatenated, which gives the ids of the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import Known, Vocabulary, packed
from tallyforge.llm.common import bounded_batches, worker_state
from tallyforge.llm.textblocks import U64, find_words, slices, text_bytes, word_hashes


def fragment_ids(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of words and n + 1 offsets, by merging distinct fragments between forced cuts."""
    raw, starts, lengths = packed(pieces)
    if not raw:
        return np.zeros(0, dtype=np.int32), np.zeros(len(pieces) + 1, dtype=np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)
    begin = np.zeros(len(data), dtype=bool)
    begin[1:] = ~vocab.joined[data[:-1], data[1:]]
    begin[starts] = True
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, len(data)))
    last = np.isin(at + size, np.append(starts[1:], len(data)))
    keys, first, same = np.unique(word_hashes(raw, at, size) << U64(1) | last.astype(U64), return_index=True, return_inverse=True)
    flat, offsets = vocab.merge(raw, at[first], size[first], last[first])
    count = np.diff(offsets)[same]
    ends = np.cumsum(count)
    ids = flat[np.arange(ends[-1]) + np.repeat(offsets[:-1][same] - (ends - count), count)]
    return ids, np.append(0, ends)[np.append(np.searchsorted(at, starts), len(at))]


def word_codes(vocab: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """For each white-space-separated word: its ids (arrays of an object array)."""
    pieces: list[bytes] = []
    plan: list[list] = []  # a special id, or a range of pieces
    for word in words:
        steps: list = []
        for k, part in enumerate(vocab.parts(word.decode("utf-8", "replace"))):
            if k % 2:
                steps.append(vocab.special[part])
            elif part:
                new = vocab.pieces(vocab.normal(part))
                steps.append((len(pieces), len(pieces) + len(new)))
                pieces += new
        plan.append(steps)
    flat, at = fragment_ids(vocab, pieces)
    out = np.empty(len(words), dtype=object)
    for k, steps in enumerate(plan):
        got = [[x] if isinstance(x, int) else flat[at[x[0]] : at[x[1]]] for x in steps]
        out[k] = got[0] if len(got) == 1 else np.concatenate([np.zeros(0, dtype=np.int32), *got]).astype(np.int32)
    return out


def decode_ids(vocab: Vocabulary, ids) -> str:
    """The vocabulary has no decoder, so the library joins token strings with one space."""
    return " ".join(vocab.strings[np.asarray(ids, dtype=np.int64)].tolist())


def _known_words(vocab: Vocabulary) -> Known:
    def make(words):
        codes = word_codes(vocab, words)
        texts, plain = np.empty(len(codes), dtype=object), np.empty(len(codes), dtype=object)
        for k, ids in enumerate(codes):
            plain[k] = " ".join(map(str, ids.tolist() if isinstance(ids, np.ndarray) else ids))
            texts[k] = decode_ids(vocab, ids)
        return [np.array([len(x) for x in codes], dtype=np.int64), plain, texts]

    return Known(make)


def _state(raw: bytes) -> tuple[Vocabulary, Known]:
    vocab = Vocabulary(raw)
    return vocab, _known_words(vocab)


def _encode(raw_vocab, outputs: tuple[str, ...]):
    def run(batches):
        _, known = worker_state(("bpe", hash(raw_vocab.value)), lambda: _state(raw_vocab.value))
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_bytes(part.column("text"))
                starts, lengths, at = find_words(raw, offsets)
                rows = known.get(raw, starts, lengths)
                count, plain, texts = known.columns
                rows_n = count[rows] if len(rows) else np.zeros(0, dtype=np.int64)
                full = rows_n > 0
                cols: dict[str, list] = {name: [] for name in ("n_tokens", *outputs)}
                for a, b in zip(at[:-1], at[1:]):
                    own = rows[a:b][full[a:b]]
                    cols["n_tokens"].append(int(rows_n[a:b].sum()))
                    ids = " ".join(plain[own]) if {"ids", "ids_sha256"} & {*outputs} else ""
                    text = " ".join(texts[own]) if {"decoded", "decoded_sha256"} & {*outputs} else ""
                    if "ids" in outputs:
                        cols["ids"].append(np.array(ids.split(), dtype=np.int32))
                    if "ids_sha256" in outputs:
                        cols["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    if "decoded" in outputs:
                        cols["decoded"].append(text)
                    if "decoded_sha256" in outputs:
                        cols["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                arrays = [pa.array(v, kinds.get(k, pa.string())) for k, v in cols.items()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], names=["doc_id", *cols])

    return run


def encode_decode(
    docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """doc_id, n_tokens and the chosen ``outputs`` of each row: ids (array<int>), decoded
    (the text that the ids decode to), ids_sha256 (of the decimal ids joined by a space),
    decoded_sha256.

    ``vocab_path`` is read on the driver and its content (a file of fixed size) is sent to
    the executors. Special strings in a text become their own ids, as the library does.

    Defined results: null and blank texts have no tokens; null or repeated ids are kept as
    they are; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    with open(vocab_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long" + "".join(f", {x} {kinds[x]}" for x in outputs)
    return base.mapInArrow(_encode(raw, tuple(outputs)), schema)


def decode_column(df: DataFrame, vocab_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that an array of ids decodes to (null for null)."""
    with open(vocab_path, "rb") as file:
        raw = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def decode(column):
        vocab, _ = worker_state(("bpe", hash(raw.value)), lambda: _state(raw.value))
        return column.map(lambda ids: None if ids is None else decode_ids(vocab, ids))

    return df.withColumn(out, decode(F.col(ids_col)))
