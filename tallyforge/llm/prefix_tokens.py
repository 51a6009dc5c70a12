"""Token counts of every prefix by dynamic programming.

A token sequence is what BPE gives for its text exactly when each token stands alone and
each neighbouring pair keeps apart, that is, when merging the text of the pair gives the
pair back. So the last token of a prefix is the one token t ending there that keeps apart
from the last token of the prefix before t, and the count is one more than that prefix's.
One pass over a word thus gives the count of all its prefixes, as they would be encoded
if the text ended there, and budget or truncation questions need no encoding again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import FREE, Known, Table, Vocabulary, packed
from tallyforge.llm.common import bounded_batches, worker_state
from tallyforge.llm.textblocks import find_words, slices, text_bytes

#: Pairs whose answer a worker keeps (half as many for long words).
PAIRS = 1_000_000
#: Words above this many bytes go through the program one by one, others side by side.
LONG = 64
ALONE = 1 << 17


class Prefixes:
    """The dynamic program over one vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.pairs = Table(16)
        #: Tries of the reversed tokens: inside a word from state 0, at its end from state 1.
        states: dict[int, int] = {}
        token = [-1, -1]
        for i in vocab.ordinary.tolist():
            at = int(vocab.ends[i])
            for byte in reversed(vocab.bytes[i]):
                key = at << 8 | byte
                if key not in states:
                    states[key] = len(token)
                    token.append(-1)
                at = states[key]
            token[at] = i
        self.steps, self.tokens, self.known_pairs = states, token, {}
        self.next = Table(19)
        self.next.put(np.fromiter(states.keys(), dtype=np.int64), np.fromiter(states.values(), dtype=np.int32))
        self.token = np.array(token, dtype=np.int32)
        self.longest = max(len(vocab.bytes[i]) for i in vocab.ordinary.tolist())

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Does merging the text of tokens a, b give a, b? (a = -1: b alone)"""
        keys = np.where(a < 0, ALONE, a).astype(np.int64) << 18 | b
        known = self.pairs.get(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            if self.pairs.n + len(new) > PAIRS:
                self.pairs, new = Table(16), np.unique(keys)
            x, y = new >> 18, new & 0x3FFFF
            of = self.vocab.bytes
            raw, starts, lengths = packed([(of[i] if i < ALONE else b"") + of[j] for i, j in zip(x.tolist(), y.tolist())])
            flat, at = self.vocab.merge(raw, starts, lengths, self.vocab.ends[y])
            first = flat[at[:-1]]
            same = np.where(x < ALONE, (np.diff(at) == 2) & (first == x) & (flat[at[1:] - 1] == y), (np.diff(at) == 1) & (first == y))
            self.pairs.put(new, same.astype(np.int32))
            known = self.pairs.get(keys)
        return known > 0

    def _apart_one(self, a: int, b: int) -> bool:
        """``apart`` for one pair: merges the few symbols of the pair as plain integers."""
        key = a << 17 | b
        known = self.known_pairs.get(key)
        if known is None:
            vocab, rank_of = self.vocab, self.vocab.rank_of
            ids = vocab.inner[[*(vocab.bytes[a] if a >= 0 else b""), *vocab.bytes[b]]].tolist()
            if vocab.ends[b]:
                ids[-1] = int(vocab.final[vocab.bytes[b][-1]])
            while len(ids) > 1:
                best, at = min((rank_of.get(x << 16 | y, FREE), k) for k, (x, y) in enumerate(zip(ids, ids[1:])))
                if best == FREE:
                    break
                ids[at : at + 2] = [int(vocab.merged[best])]
            if len(self.known_pairs) > PAIRS // 2:
                self.known_pairs.clear()
            known = self.known_pairs[key] = ids == ([a, b] if a >= 0 else [b])
        return known

    def _long_counts(self, word: bytes) -> np.ndarray:
        """``counts`` of one word in time linear in its length: at each byte the tokens that end
        there are found by walking back through the trie, which is as deep as the longest token."""
        steps, tokens, apart = self.steps, self.tokens, self._apart_one
        n = len(word)
        last, inner, final = [-1] * n, [0] * n, [0] * n
        for e in range(n):
            for root, out in ((1, final), (0, inner)):
                state, k, found = root, e, []
                while k >= 0 and (state := steps.get(state << 8 | word[k], -1)) >= 0:
                    if tokens[state] >= 0:
                        found.append((k, tokens[state]))
                    k -= 1
                for k, token in reversed(found):
                    if apart(last[k - 1] if k else -1, token):
                        out[e] = 1 + (inner[k - 1] if k else 0)
                        if not root:
                            last[e] = token
                        break
        return np.array(final, dtype=np.int32)

    def _last(self, data, ends, sizes, root, last, width):
        """For strings that end at ``ends``: the token that ends there, and its length."""
        depth = min(self.longest, int(sizes.max()))
        tokens = np.full((len(ends), depth + 1), -1, dtype=np.int32)
        state, live = np.full(len(ends), root, dtype=np.int32), np.arange(len(ends))
        for k in range(1, depth + 1):
            live = live[sizes[live] >= k]
            state[live] = self.next.get(state[live].astype(np.int64) << 8 | data[ends[live] - k])
            live = live[state[live] >= 0]
            if not len(live):
                break
            tokens[live, k] = self.token[state[live]]
        won, length = np.full(len(ends), -1, dtype=np.int32), np.zeros(len(ends), dtype=np.int64)
        todo = np.arange(len(ends))
        for k in range(depth, 0, -1):
            able = todo[tokens[todo, k] >= 0]
            if len(able):
                before = sizes[able] - k
                good = able[self.apart(np.where(before > 0, last[ends[able] - k - 1], -1), tokens[able, k])]
                won[good], length[good] = tokens[good, k], k
                todo = todo[won[todo] < 0]
        return won, length

    def counts(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """At each byte of the words: the tokens of the word's prefix that ends with it."""
        data = np.frombuffer(raw, dtype=np.uint8)
        last, inner, final = (np.full(len(data), -1, dtype=np.int32) for _ in range(3))
        for k in np.flatnonzero(lengths > LONG).tolist():
            final[starts[k] : starts[k] + lengths[k]] = self._long_counts(raw[starts[k] : starts[k] + lengths[k]])
        short = np.flatnonzero(lengths <= LONG)
        order = short[np.argsort(-lengths[short], kind="stable")]
        starts, lengths = starts[order], lengths[order]
        for j in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            n = int(np.searchsorted(-lengths, -j, side="right"))
            ends, sizes = starts[:n] + j, np.full(n, j, dtype=np.int64)
            for root, out in ((1, final), (0, inner)):
                won, size = self._last(data, ends, sizes, root, last, j)
                before = ends - 1 - size
                out[ends - 1] = 1 + np.where(size < j, inner[np.maximum(before, 0)], 0)
                if root == 0:
                    last[ends - 1] = won
        return final


def _begins(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _plain_prefixes(dp: Prefixes, pieces: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts at the code points of words without special strings, which are the pieces
    first[k] to first[k + 1], end to end; and n + 1 offsets of the words."""
    raw, starts, lengths = packed(pieces)
    if not raw:
        return np.zeros(0, dtype=np.int32), np.zeros(len(first), dtype=np.int64)
    counts = dp.counts(raw, starts, lengths)
    for k in np.flatnonzero(lengths == 3).tolist():
        if pieces[k] in (b"'re", b"'ve", b"'ll"):  # two pieces until the last letter
            counts[starts[k] : starts[k] + 3] = 1, 2, counts[starts[k] + 2]
    total = counts[starts + lengths - 1].astype(np.int64)
    before = np.append(0, np.cumsum(total))
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = counts + np.repeat(before[:-1] - before[first[word]], lengths)
    ends = np.append(_begins(np.frombuffer(raw, dtype=np.uint8))[1:], True)
    place = np.append(0, np.cumsum(ends))
    return counts[ends].astype(np.int32), place[np.append(starts, len(raw))[first]]


def _special_prefixes(dp: Prefixes, parts: list[str]) -> np.ndarray:
    """The same for one word with special strings, which stand at the odd places of ``parts``."""
    vocab, base, got = dp.vocab, 0, []
    for k in range(0, len(parts), 2):
        special = parts[k + 1] if k + 1 < len(parts) else ""
        normal = vocab.normal(parts[k])
        text = normal + special[:-1]  # a special string that isn't whole yet is ordinary text
        pieces = vocab.pieces(text) if text else []
        flat = base + _plain_prefixes(dp, pieces, np.array([0, len(pieces)]))[0]
        shown = len(b"".join(vocab.pieces(normal)).decode("utf-8", "replace")) if normal else 0
        base = (int(flat[shown - 1]) if shown else base) + bool(special)
        got.append(np.append(flat, base) if special else flat)
    return np.concatenate(got).astype(np.int32)


def word_prefixes(dp: Prefixes, words: list[bytes]) -> list[np.ndarray]:
    """For each white-space-separated word the token count of its prefixes.

    Prefixes end at the code points of the normalised word; inside a special string the
    prefix is ordinary text, at its end it is one token.
    """
    vocab, pieces, first, special = dp.vocab, [], [0], {}
    for k, word in enumerate(words):
        if word.isalpha():  # ASCII letters only
            pieces.append(word.lower())
        else:
            parts = vocab.parts(text := word.decode("utf-8", "replace"))
            if len(parts) > 1:
                special[k] = parts
            else:
                pieces += vocab.pieces(vocab.normal(text))
        first.append(len(pieces))
    flat, at = _plain_prefixes(dp, pieces, np.array(first))
    out = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    for k, parts in special.items():
        out[k] = _special_prefixes(dp, parts)
    return out


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, dtype=np.int32)


def _known_prefixes(dp: Prefixes) -> Known:
    def make(words):
        each = word_prefixes(dp, words)
        held = np.empty(len(each), dtype=object)
        held[:] = [x.tobytes() for x in each]  # views would keep the counts of all words of this call
        size = np.array([len(x) for x in each], dtype=np.int64)
        # the last word's least is taken to the end of flat, so what is appended must be above all counts
        flat = np.append(np.concatenate([np.zeros(0, dtype=np.int64), *each]), FREE)
        ends = np.cumsum(size)
        total = np.where(size > 0, flat[ends - 1], 0)
        least = np.where(size > 0, np.minimum.reduceat(flat, ends - size), 0) if len(each) else total
        return [total, least, held]

    return Known(make, 250_000)


def _state(raw: bytes) -> tuple[Prefixes, Known]:
    dp = Prefixes(Vocabulary(raw))
    return dp, _known_prefixes(dp)


def _count(raw_vocab, limit: int, prefix_column: bool):
    def run(batches):
        _, known = worker_state(("prefixes", hash(raw_vocab.value)), lambda: _state(raw_vocab.value))
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                raw, offsets = text_bytes(part.column("text"))
                starts, lengths, at = find_words(raw, offsets)
                rows = known.get(raw, starts, lengths)
                total, least, held = known.columns
                size, low = (x[rows] if len(rows) else np.zeros(0, dtype=np.int64) for x in (total, least))
                points = np.append(0, np.cumsum(_begins(np.frombuffer(raw, dtype=np.uint8))))
                n_tokens, fits, lists = [], [], []
                for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    done = np.cumsum(size[a:b])
                    before = done - size[a:b]
                    n = int(done[-1]) if b > a else 0
                    n_tokens.append(n)
                    if n <= limit:
                        fits.append(int(points[offsets[k + 1]] - points[offsets[k]]))
                    else:  # the last prefix within the limit lies in the last word that has one
                        able = np.flatnonzero((before + low[a:b] <= limit) & (size[a:b] > 0))
                        fit = 0
                        if len(able):
                            w = int(able[-1])
                            own = _unpacked(held[rows[a + w]])
                            inside = np.flatnonzero(before[w] + own <= limit)[-1] + 1
                            s = starts[a + w]
                            whole = points[s + lengths[a + w]] - points[s]
                            same = whole == len(own)
                            fit = int(points[s] - points[offsets[k]] + (inside if same else whole if inside == len(own) else 0))
                        fits.append(fit)
                    if prefix_column:
                        lists.append(np.concatenate([np.zeros(0, dtype=np.int64), *(c + _unpacked(held[r]) for c, r in zip(before, rows[a:b]))]).astype(np.int32))
                cols = {
                    "doc_id": part.column("id"),
                    "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in n_tokens], pa.bool_()),
                    "fit_chars": pa.array(fits, pa.int64()),
                }
                if prefix_column:
                    cols["prefix_tokens"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    return run


def prefix_token_counts(
    docs: DataFrame, vocab_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", prefix_column: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars and, if asked for, prefix_tokens.

    prefix_tokens (array<int>) holds the exact token count of the prefix that ends at each
    code point of the normalised text that isn't white space. fit_chars is the length in
    code points of the longest prefix of the text within ``limit`` tokens, without trailing
    white space unless it is the whole text (a word whose normal form has another length
    counts whole or not at all).

    Words of any length take time in proportion to it.

    Defined results: null is an empty text with no tokens; null or repeated ids are kept
    as they are; other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    with open(vocab_path, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * prefix_column
    return base.mapInArrow(_count(raw, limit, prefix_column), schema)
