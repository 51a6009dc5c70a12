"""Personal data: base patterns, and information-theoretic sanitisation of revealing terms.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; each distinct
value is a protected entity. How much a term t says about an entity e is estimated from
the whole corpus: PMI(t; e) = log2(n(t, e) N / (n(t) n(e))), with n(t, e) the documents
that hold both, wherever they stand, and n(t), n(e) those that hold t or e.
An entity carries IC(e) = log2(N / n(e)). A term is disclosing if it gives away at least
DISCLOSURE of an entity's information, seen in SUPPORT different texts or more (so copies
of one text prove nothing); it is then replaced by its general class wherever it stands.

No list of entities or terms is sent to the tasks: they get tables of fixed size that let all
wanted hashes pass and few others, and joins by hash settle the rest.

Pairs of entities and terms of a text are not written out. PMI(t; e) >= D IC(e) needs
n(t) <= N^(1 - D) n(e)^D, so terms are counted first, and those too common for every entity of a
text leave it. Of the rest, terms of the same texts are one class, entities too, and a text's
pairs are those of its classes; copies of one long directory make one pair.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import packed
from tallyforge.llm.common import bounded_batches, cut, gathered, worker_state
from tallyforge.llm.textblocks import LOWER, U64, find_words, mix, slices, text_bytes, word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT, DISCLOSURE = 3, 0.8
#: Bits of the filter of hashes that is sent to the tasks (2 MB, however many hashes there are).
FILTER_BITS = 24
#: Slots of the tables of levels, a byte each, and levels to a doubling.
SLOT_BITS, LEVELS = 21, 4
#: Rows (term, text) of a batch; shares that one text's rows are dealt to.
ROWS, SALTS = 1 << 18, 16
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, each in time linear in the text."""
    out: list[tuple[int, str, int]] = []
    if not HINT.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, "email", m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, start = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, "ip", end))
            start = end + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def trim(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their ends."""
    starts, lengths = starts.copy(), lengths.copy()
    for first in (True, False):
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[lengths[todo] > 0]
            todo = todo[PUNCT[data[starts[todo] + (0 if first else lengths[todo] - 1)]]]
            lengths[todo] -= 1
            if first:
                starts[todo] += 1
    return starts, lengths


def _hashes(words: list[bytes]) -> np.ndarray:
    return word_hashes(*packed(words)).view(np.int64)


def _terms(words: list[str]) -> list[bytes]:
    shorn = (w.encode().translate(LOWER).strip(bytes(np.flatnonzero(PUNCT).tolist())) for w in words)
    return [w for w in shorn if w]


_SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def apart(text: str, spans: list[tuple[int, str, int]]) -> list[bytes]:
    """The distinct terms of a text, base spans apart."""
    taken = np.zeros(len(text) + 1, dtype=bool)
    for a, _, b in spans:
        taken[a:b] = True
    return sorted({*_terms([m[0] for m in _SPACES.finditer(text) if not taken[m.start() : m.end()].any()])})


def _name(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _named(text: str, spans: list[tuple[int, str, int]]) -> list[int]:
    """Hashes of the distinct entities of a text."""
    return sorted({_name(f"{kind}:{text[a:b].lower()}") for a, kind, b in spans})


def _entities(batches):
    """entity, text: 64-bit hashes."""
    worker_state("pii", dict)
    for batch in batches:
        for part in slices(batch, "text"):
            rows: list[tuple[int, int]] = []
            for text in part.column("text").to_pylist():
                if spans := base_spans(text) if text else []:
                    own = _name(text)
                    rows += [(entity, own) for entity in _named(text, spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["entity", "text"])


def _place(keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    return (mix(np.ascontiguousarray(keys).view(U64)) >> U64(64 - bits)).astype(np.int64)


def _set(held: np.ndarray, keys: np.ndarray) -> None:
    at = _place(keys)
    np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _filled(held: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(held)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].astype(np.int64))], names=["place", "value"])


def _bits(batches):
    """Hashes to the non-zero bytes (place, value) of their bit filter."""
    held = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for batch in batches:
        _set(held, np.asarray(batch.column("hash").to_numpy(zero_copy_only=False), dtype=np.int64))
    yield _filled(held)


def _sent(rows: DataFrame):
    """A broadcast bit filter of the bytes (place, value) of its parts; 2**FILTER_BITS bits at any size."""
    rows = rows.groupBy("place").agg(F.bit_or("value").alias("value"))
    return rows.sparkSession.sparkContext.broadcast(gathered(rows, 1 << (FILTER_BITS - 3), "uint8"))


def _filter(hashes: DataFrame):
    """A broadcast bit filter of the hashes."""
    return _sent(hashes.select(F.col(hashes.columns[0]).alias("hash")).mapInArrow(_bits, "place long, value long"))


def _highest(batches):
    """(hash, level) to the highest level (place, value) of each slot that has one."""
    held = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    for batch in batches:
        keys, level = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), dtype=np.int64) for k in ("hash", "level"))
        np.maximum.at(held, _place(keys, SLOT_BITS), level.astype(np.uint8))
    yield _filled(held)


def _levels(rows: DataFrame, level):
    """A broadcast table of the highest level (1 to 255, 0: none) of the hashes of each slot."""
    rows = rows.select(F.col(rows.columns[0]).alias("hash"), F.least(F.greatest(level, F.lit(1)), F.lit(255)).cast("long").alias("level"))
    rows = rows.mapInArrow(_highest, "place long, value long").groupBy("place").agg(F.max("value").alias("value"))
    return rows.sparkSession.sparkContext.broadcast(gathered(rows, 1 << SLOT_BITS, "uint8"))


def _passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _place(keys)
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _named_texts(batches, levels: np.ndarray):
    """(text, its base spans, the highest level of its entities) of texts with wanted entities."""
    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").to_pylist():
                if spans := base_spans(text) if text else []:
                    top = int(levels[_place(np.array(_named(text, spans), dtype=np.int64), SLOT_BITS)].max())
                    if top:
                        yield text, spans, top


def _near(sent):
    """The bit filter (place, value) of all terms of texts with wanted entities."""

    def run(batches):
        worker_state("pii", dict)
        held = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
        for text, spans, _ in _named_texts(batches, sent.value):
            if words := apart(text, spans):
                _set(held, _hashes(words))
        yield _filled(held)

    return run


def _contexts(sent, counted):
    """term, text: 64-bit hashes, for the terms of texts with wanted entities that are rare
    enough (by ``counted``, 255 less their level) for one of the text's entities."""

    def run(batches):
        worker_state("pii", dict)
        rows: list[list[np.ndarray]] = []
        held_rows = 0

        def flush():
            held = [np.concatenate([np.zeros(0, dtype=np.int64), *(r[k] for r in rows)]) for k in range(2)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["term", "text"])

        for text, spans, top in _named_texts(batches, sent.value):
            if words := apart(text, spans):
                terms = _hashes(words)
                level = counted.value[_place(terms, SLOT_BITS)].astype(np.int64)
                terms = terms[(level > 0) & (255 - level <= top)]
                rows.append([terms, np.full(len(terms), _name(text))])
                held_rows += len(terms)
                if held_rows >= ROWS:
                    yield flush()
                    held_rows = 0
        yield flush()

    return run


def _held(column, wanted: np.ndarray):
    """Words of a column whose term passes the filter: raw, offsets, text, start, length, term."""
    raw, offsets = text_bytes(column)
    low = raw.translate(LOWER)
    starts, lengths, _ = find_words(low, offsets)
    if len(starts):
        starts, lengths = trim(np.frombuffer(low, dtype=np.uint8), starts, lengths)
        able = lengths > 0
        starts, lengths = starts[able], lengths[able]
    keys = word_hashes(low, starts, lengths).view(np.int64) if len(starts) else np.zeros(0, dtype=np.int64)
    hit = np.flatnonzero(_passes(wanted, keys)) if len(keys) else np.zeros(0, dtype=np.int64)
    of = np.searchsorted(offsets, starts[hit], side="right") - 1
    return raw, offsets, of, starts[hit], lengths[hit], keys[hit]


def _frequency(sent):
    """In how many texts each term that passes stands; a task gives each term once in a while."""

    def run(batches):
        wanted = sent.value
        terms, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], names=["term", "n"])
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, of, _, _, keys = _held(part.column("text"), wanted)
                if not len(keys):
                    continue
                order = np.lexsort((keys, of))
                of, keys = of[order], keys[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))
                terms, back = np.unique(np.concatenate([terms, keys[new]]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([counts, np.ones(int(new.sum()), dtype=np.int64)]), minlength=len(terms)).astype(np.int64)
                if len(terms) > ROWS:
                    yield pack()
                    terms, counts = terms[:0], counts[:0]
        yield pack()

    return run


def _marks(sent):
    """text_key, term and place (code points) of each term that passes; texts by 128 bits."""

    def run(batches):
        wanted = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets, of, starts, lengths, keys = _held(part.column("text"), wanted)
                begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
                points = np.append(0, np.cumsum(begins))
                a, b = points[starts] - points[offsets[of]], points[starts + lengths] - points[offsets[of]]
                own = {k: _text_key(raw[offsets[k] : offsets[k + 1]]) for k in np.unique(of).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in of.tolist()], pa.binary()), pa.array(keys), pa.array(a), pa.array(b)], names=["text_key", "term", "a", "b"])

    return run


def _text_key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _general(word: str) -> str:
    """The class that stands for a disclosing term."""
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"


def _keyed(batches):
    """Adds the column ``text_key``; null for texts that can have no marks."""
    for batch in batches:
        for part in slices(batch, "text"):
            keys = [_text_key(x.encode()) if x else None for x in part.column("text").to_pylist()]
            yield part.append_column("text_key", pa.array(keys, pa.binary()))


def _beside(terms: list[tuple[int, int]], base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The terms that touch no base span; both lists are in order, ends of base spans aside."""
    out, k, reach = [], 0, -1
    for a, b in terms:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            out.append((a, "term", b))
    return out


def _finish(clean_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                cols: dict[str, list] = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")}
                cleaned: list = []
                for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                    base = base_spans(text) if text else []
                    terms = _beside([*zip(found[::2], found[1::2])], base) if found else []
                    spans = sorted(base + terms, key=lambda x: (x[0], KINDS.index(x[1])))
                    show = lambda xs: ",".join(f"{kind}:{a}:{b}" for a, kind, b in xs)
                    for kind in KINDS:
                        cols[f"n_{kind}"].append(sum(k == kind for _, k, _ in spans))
                    cols["base_sha256"].append(hashlib.sha256(show(base).encode()).hexdigest())
                    cols["spans"].append(show(spans))
                    if clean_text:
                        out, at = [], 0
                        for a, kind, b in spans:
                            if b > at:
                                out += [text[at : max(a, at)], (_general(text[a:b]) if kind == "term" else f"[{kind.upper()}]") if a >= at else ""]
                                at = b
                        cleaned.append(None if text is None else "".join(out) + text[at:])
                kinds = {"base_sha256": pa.string(), "spans": pa.string()}
                arrays = [pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()]
                names = [*cols]
                if clean_text:
                    arrays, names = [*arrays, pa.array(cleaned, pa.string())], [*names, "clean_text"]
                kept = [n for n in part.schema.names if n != "found"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *arrays], names=[*kept, *names])

    return run


def _same_texts() -> list:
    """Aggregates over rows of different texts that tell sets of texts apart (128 bits and their number)."""
    return [F.count("*").alias("texts"), F.bit_xor(F.xxhash64("text")).alias("f1"), F.bit_xor(F.xxhash64("text", F.lit(1))).alias("f2")]


SAME = ["texts", "f1", "f2"]


def disclosing_terms(base: DataFrame) -> DataFrame | None:
    """term (hash) and disclosure, of the terms in ``base`` (text) that give entities away."""
    seen = cut(base.mapInArrow(_entities, "entity long, text long").groupBy("entity", "text").agg(F.count("*").alias("n")))
    #: No term can have more support than its entity has.
    entities = cut(seen.groupBy("entity").agg(F.sum("n").alias("n_e"), *_same_texts()).where(F.col("texts") >= SUPPORT))
    if entities.isEmpty():
        return None
    n = float(base.count())
    most = (1 - DISCLOSURE) * F.log2(F.lit(n)) + DISCLOSURE * F.log2("n_e")
    sent = _levels(entities.select("entity", "n_e"), F.ceil(LEVELS * most) + 1)
    near = _sent(base.mapInArrow(_near(sent), "place long, value long"))
    counts = base.mapInArrow(_frequency(near), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    counts = cut(counts.where(F.col("n_t") >= SUPPORT))
    counted = _levels(counts, 255 - F.floor(LEVELS * F.log2("n_t")))
    rows = cut(base.mapInArrow(_contexts(sent, counted), "term long, text long").distinct())
    terms = cut(rows.groupBy("term").agg(*_same_texts()).where(F.col("texts") >= SUPPORT).join(counts, "term"))
    #: One term, and one entity, for each set of texts.
    leading = terms.groupBy(*SAME).agg(F.min("term").alias("term"), F.min("n_t").alias("least"))
    first = entities.groupBy(*SAME).agg(F.min("entity").alias("entity"), F.first("n_e").alias("n_e"))
    own_terms = rows.join(leading.select("term", "least"), "term")
    own_entities = seen.join(first.select("entity", "n_e"), "entity")
    #: The bound with some room, since it is of doubles.
    both = own_terms.join(own_entities, "text").where(F.log2("least") <= most + 0.01)
    pairs = both.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.first("n_e").alias("n_e"), F.count("*").alias("shared")).where(F.col("shared") >= SUPPORT)
    pairs = pairs.select(F.col("term").alias("leader"), "n_te", "n_e")
    members = terms.join(leading.select(*SAME, F.col("term").alias("leader")), SAME).select("term", "n_t", "leader")
    told = F.log2(F.col("n_te") * F.lit(n) / (F.col("n_t") * F.col("n_e")))
    carried = F.log2(F.lit(n) / F.col("n_e"))
    found = members.join(pairs, "leader").where((carried > 0) & (told >= DISCLOSURE * carried))
    flagged = cut(found.groupBy("term").agg(F.max(told / carried).alias("disclosure")))
    return None if flagged.isEmpty() else flagged


def marked_texts(base: DataFrame, flagged: DataFrame) -> DataFrame:
    """text_key and found: the places (a, b, a, b, ... in order) of flagged terms in each text."""
    hits = base.mapInArrow(_marks(_filter(flagged)), "text_key binary, term long, a long, b long").distinct()
    own = hits.join(flagged.select("term"), "term")
    places = F.sort_array(F.collect_list(F.struct("a", "b")))
    flat = F.flatten(F.transform(places, lambda p: F.array(p["a"], p["b"])))
    return own.groupBy("text_key").agg(flat.alias("found"))


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), clean_text: bool = False) -> DataFrame:
    """The columns ``keep`` of each row, and n_email, n_ip, n_card, n_phone, base_sha256,
    spans ("kind:start:end" by start, comma-joined, code points), n_term and, if asked for,
    clean_text: the text with every span replaced by its class.

    Base patterns are leftmost and non-overlapping for each kind; matches that fail a check
    are dropped. Terms that touch a base span give way to it.

    Defined results: null and blank texts have no spans (clean_text of null is null);
    null and repeated ids are kept as they are; other columns, whatever their names, are
    ignored unless kept; kept columns named like a column of the result give way to it; an
    empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    result = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long" + ", clean_text string" * clean_text
    names = [x.split()[0] for x in result.split(", ")]
    keep = [c for c in keep if c not in names]
    plain = [F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)]
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    base = docs.select(text)
    flagged = disclosing_terms(base)
    rows, none = docs.select(*plain, text), F.array().cast("array<bigint>")
    if flagged is None:
        rows = rows.withColumn("found", none)
    else:
        #: A text that copies share is dealt to SALTS shares of the join; a null one joins nothing.
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        keyed = rows.mapInArrow(_keyed, f"{schema}, text_key binary")
        share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
        keyed = keyed.withColumn("share", F.when(F.col("text_key").isNull(), -1 - share).otherwise(share))
        marks = marked_texts(base, flagged).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = keyed.join(marks, ["text_key", "share"], "left").withColumn("found", F.coalesce("found", none)).drop("text_key", "share")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "found")
    out = rows.mapInArrow(_finish(clean_text), f"{kept}, {result}")
    return out.select(*(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)), *names)


def sanitised_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its class; all columns stay, under any names."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    at = docs.columns.index(text_col)
    found = find_personal_data(plain, f"c{at}", tuple(c for k, c in enumerate(plain.columns) if k != at), clean_text=True)
    return found.select(*(F.col("clean_text" if k == at else f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
