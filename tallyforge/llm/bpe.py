"""Byte-pair merging of many short strings at once (NumPy), for word-end vocabularies.

Such a vocabulary (a ``tokenizers`` JSON file) lower-cases, drops white space and marks
the last symbol of a word with a suffix, so words split at white space are independent.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import regex
from tokenizers import Tokenizer

from tallyforge.llm.textblocks import U64, mix, word_hashes

FREE = np.iinfo(np.int32).max
#: Strings above this many bytes are merged one by one with a heap.
WIDE = 64
#: Distinct words worked out together.
STEP = 16_384
#: Below this code point the two regular-expression libraries class all characters alike.
COMMON = 0x250


class Table:
    """A growing map from non-negative 64-bit keys to 32-bit values, looked up by arrays."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._size(bits)

    def _size(self, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where absent."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1).astype(np.int32)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            full = self.keys >= 0
            keys, values = np.concatenate([keys, self.keys[full]]), np.concatenate([values, self.values[full]])
            self.n = 0
            self._size(max(self.bits, int(3 * len(keys)).bit_length()))
        self.n += len(keys)
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            empty = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            first = first[empty[first]]
            self.keys[at[first]] = keys[todo[first]]
            self.values[at[first]] = values[todo[first]]
            stay = np.ones(len(todo), dtype=bool)
            stay[first] = False
            todo = todo[stay]
            slot[todo] = np.where(self.keys[slot[todo]] >= 0, (slot[todo] + 1) & ((1 << self.bits) - 1), slot[todo])


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class Vocabulary:
    """Merges, token strings and word splitting of one vocabulary file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        #: The library's normaliser and word splitter; its own copy of the merges isn't needed.
        parts = spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}
        self.library = Tokenizer.from_str(json.dumps(parts))
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        if size > 1 << 16:
            raise ValueError(f"pair keys hold 16 bits an id, the vocabulary has ids up to {size - 1}")
        self.strings = np.full(size, "", dtype=object)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = text
        letters = byte_letters()
        self.letter_bytes = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int32)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else x for x in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.ranks = Table(18)
        self.ranks.put(keys, np.arange(len(keys), dtype=np.int32))
        self._keys = keys
        #: Bytes of each ordinary token, and whether it ends a word.
        self.ends = np.zeros(size, dtype=bool)
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.ends[i] = text.endswith(self.suffix)
            self.bytes[i] = bytes(self.letter_bytes[c] for c in (text.removesuffix(self.suffix) if self.ends[i] else text))
        self.ordinary = np.array(sorted(vocab.values()))
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def normal(self, text: str) -> str:
        return text.lower() if text.isascii() else self.library.normalizer.normalize_str(text)

    def pieces(self, normal: str) -> list[bytes]:
        """The words that the vocabulary makes of a normalised text, as bytes."""
        if normal.isascii() and normal.isalpha():
            return [normal.encode()]
        if normal.isascii() or max(normal) < chr(COMMON):
            return [x.encode() for x in self._pieces.findall(normal)]
        return [bytes(self.letter_bytes[c] for c in x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, text: str) -> list[str]:
        """A text cut at the special strings; these stand at the odd places."""
        return self._special.split(text) if self._special and "<" in text else [text]

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        """Pair key to rank, for long strings that are merged one by one."""
        return dict(zip(self._keys.tolist(), range(len(self._keys))))

    @functools.cached_property
    def joined(self) -> np.ndarray:
        """[a, b]: do the bytes a, b stand side by side inside any token?"""
        out = np.zeros((256, 256), dtype=bool)
        for x in self.bytes:
            if len(x) > 1:
                at = np.frombuffer(x, dtype=np.uint8)
                out[at[:-1], at[1:]] = True
        return out

    def merge(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each string; ``last`` tells whether it ends a word. Flat ids and n + 1 offsets."""
        data = np.frombuffer(raw, dtype=np.uint8)
        count = np.zeros(len(starts), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        floor = 0
        for wide in (4, 8, 12, 16, 24, 32, WIDE):
            pick = np.flatnonzero((lengths > floor) & (lengths <= wide))
            floor = wide
            for k in range(0, len(pick), 1 << 16):
                rows = pick[k : k + (1 << 16)]
                for own, ids in self._merge_block(data, starts[rows], lengths[rows], last[rows], wide):
                    count[rows[own]] = ids.shape[1]
                    found.append((rows[own], ids))
        for row in np.flatnonzero(lengths > WIDE):
            ids = self._merge_long(data[starts[row] : starts[row] + lengths[row]], bool(last[row]))
            count[row] = len(ids)
            found.append((np.array([row]), ids[None, :]))
        at = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(at[-1], dtype=np.int32)
        for rows, ids in found:
            flat[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, at

    def _symbols(self, data, lengths, last):
        out = self.inner[data]
        rows = np.flatnonzero(last)
        out[rows, lengths[rows] - 1] = self.final[data[rows, lengths[rows] - 1]]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.ranks.get(a.astype(np.int64) << 16 | b)
        return np.where(rank < 0, FREE, rank)

    def _merge_block(self, data, starts, lengths, last, wide):
        """Yields (rows, ids) for the rows that end with the same number of tokens."""
        place = np.arange(wide)
        ids = self._symbols(data[np.minimum(starts[:, None] + place, len(data) - 1)], lengths, last)
        rows, left = np.arange(len(starts)), lengths.astype(np.int64)
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), wide - 1)
        rank[place[None, 1:] >= left[:, None]] = FREE
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == FREE
            for n in np.unique(left[done]):
                same = done & (left == n)
                yield rows[same], ids[same, :n]
            go = ~done
            rows, ids, rank, left, at, best = rows[go], ids[go], rank[go], left[go] - 1, at[go], best[go]
            if not len(rows):
                return
            line = np.arange(len(rows))
            after = place[None, :] > at[:, None]
            ids = np.take_along_axis(ids, np.minimum(place + after, wide - 1), axis=1)
            ids[line, at] = self.merged[best]
            gone = place[None, :-1] >= at[:, None]
            rank = np.take_along_axis(rank, np.minimum(place[:-1] + gone, wide - 2), axis=1)
            rank[place[None, 1:] >= left[:, None]] = FREE
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._rank(ids[before, at[before] - 1], ids[before, at[before]])
            behind = np.flatnonzero(at + 1 < left)
            rank[behind, at[behind]] = self._rank(ids[behind, at[behind]], ids[behind, at[behind] + 1])

    def _merge_long(self, data: np.ndarray, last: bool) -> np.ndarray:
        """One long string with a heap: its length times the logarithm of that."""
        ids = self._symbols(data[None, :], np.array([len(data)]), np.array([last]))[0].tolist()
        n, rank_of, merged = len(ids), self.rank_of, self.merged.tolist()
        back, ahead, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank_of.get(ids[k] << 16 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = ahead[k]
            if not alive[k] or ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], alive[j], ahead[k] = merged[r], False, ahead[j]
            if ahead[j] < n:
                back[ahead[j]] = k
            for x, y in ((back[k], k), (k, ahead[k])):
                if x >= 0 and y < n and (r := rank_of.get(ids[x] << 16 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x, here in zip(ids, alive) if here], dtype=np.int32)


def packed(strings: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Byte strings end to end, with their starts and lengths."""
    lengths = np.array([len(x) for x in strings], dtype=np.int64)
    return b"".join(strings), np.cumsum(lengths) - lengths, lengths


class Known:
    """What a worker has worked out for distinct words; when it holds too many or too long
    ones, those that it met in most slices stay (many words of a corpus occur only once).

    Words are told apart by a 63-bit hash and their bytes are not compared: among n distinct
    words of one worker two collide with a probability of about n**2 / 2**64."""

    def __init__(self, make, most: int = 200_000, most_bytes: int = 16 << 20):
        self.make, self.most, self.most_bytes = make, most, most_bytes
        self.at, self.n, self.columns = Table(16), 0, None
        self.keys, self.uses, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def _shrink(self, room: int) -> None:
        """Leave space for ``room`` words, and half of all at most."""
        often = np.flatnonzero(self.uses > 1)
        stay = often[np.argsort(-self.uses[often], kind="stable")][: max(0, min(self.most - room, self.most // 2))]
        stay = stay[np.cumsum(self.size[stay]) <= self.most_bytes // 2]
        self.keys, self.uses, self.size, self.columns = self.keys[stay], self.uses[stay] // 2, self.size[stay], [c[stay] for c in self.columns]
        self.at, self.n = Table(16), len(stay)
        self.at.put(self.keys, np.arange(self.n, dtype=np.int32))

    def get(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each word its row in ``columns``, the arrays that ``make`` gave."""
        keys, first, inverse = np.unique(word_hashes(raw, starts, lengths) >> U64(1), return_index=True, return_inverse=True)
        keys = keys.astype(np.int64)
        row = self.at.get(keys)
        self.uses[row[row >= 0]] += 1
        new = np.flatnonzero(row < 0)
        if len(new) and self.n and (self.n + len(new) > self.most or self.size.sum() > self.most_bytes):
            self._shrink(len(new))
            row = self.at.get(keys)
            new = np.flatnonzero(row < 0)
        if len(new) or self.columns is None:
            size = lengths[first[new]].astype(np.int64)
            at = [*zip(starts[first[new]].tolist(), size.tolist())]
            made = [self.make([raw[a : a + n] for a, n in at[k : k + STEP]]) for k in range(0, max(1, len(at)), STEP)]
            held = [] if self.columns is None else [self.columns]
            self.columns = [np.concatenate(x) for x in zip(*held, *made)]
            self.at.put(keys[new], np.arange(self.n, self.n + len(new), dtype=np.int32))
            self.keys, self.uses, self.size = np.append(self.keys, keys[new]), np.append(self.uses, np.ones(len(new), dtype=np.int32)), np.append(self.size, size)
            self.n += len(new)
            row = self.at.get(keys)
        return row[inverse]
