"""Near duplicates by MinHash with tensored banding.

Two small collections of MinHash groups are computed for each set, and a table key is
formed from every pair of one group of the first and one of the second: with 2 x m
groups there are m x m tables, so 64 tables of six values cost 48 MinHash values and
not 384. Equal sets are first folded into classes; candidates are then confirmed on
full sets.

No bucket is ever expanded into all its pairs. Each bucket first links its members to
its smallest one. While that still joins many, members outside their bucket's largest
component meet one more, drawn member of it. What is still outside then is settled by a
prefix filter over the documents of the buckets that are still divided: in an order of all
shingles from rare to frequent, two sets of a similarity s or more share one of the first
n - ceil(s n) + 1 shingles of the larger set and n - ceil(2 s / (1 + s) n) + 1 of the
smaller, so only pairs that share such a rare shingle are met.
That is exact in any order, finds all pairs of those documents, and meets few pairs of a
template family, whose members differ in what is rare. Rare shingles that many documents
hold are dealt to tiles of bounded size. Pairs inside one component need no look, so the
components are those of all candidate pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bounded_batches, components, cut, gathered, worker_state
from tallyforge.llm.textblocks import LOWER, U64, find_words, mix, slices, text_bytes, word_hashes

PAD = U64(0x5851F42D4C957F2D)
#: Groups in each collection, MinHash values in each group.
GROUPS, VALUES = 8, 3
#: MinHash values of the sketch by which candidates are sifted before their sets are fetched.
SKETCH = 1024
MARKS = [f"m{k}" for k in range(SKETCH // 32)]
#: Bins of the shingle frequencies that order the prefix filter (2 MB when broadcast), rows of a tile's side.
BINS, TILE = 1 << 18, 1000


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``words`` words.

    A text with fewer words gives its whole sequence as one; one without words or a
    null gives an empty set. A-Z are lowered; words end at ASCII white space.
    """
    raw, offsets = text_bytes(column)
    raw = raw.translate(LOWER)
    starts, lengths, at = find_words(raw, offsets)
    one = word_hashes(raw, starts, lengths)
    count = np.diff(at)
    padded = np.concatenate([one, np.full(words, PAD, dtype=U64)])
    runs = mix(one)
    of = np.repeat(np.arange(len(count)), count)
    end = at[1:][of] if len(one) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(one))
    for k in range(1, words):
        here = np.where(place + k < end, padded[k : k + len(one)], PAD)
        runs = mix(runs * U64(3) + here)
    kept = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    return [np.unique(runs[a : a + n]) for a, n in zip(at[:-1], kept)]


def signature(one: np.ndarray, values: int) -> np.ndarray:
    """So many MinHash values of a non-empty set; other numbers of values, other functions."""
    seeds = mix((np.arange(2 * values, dtype=U64) + U64(values << 20)) * U64(0x9E3779B97F4A7C15))
    a, b = seeds[:values] | U64(1), seeds[values:]
    least = None
    step = (1 << 19) // values  # bounds memory for very long texts
    for k in range(0, len(one), step):
        x = one[k : k + step, None] * a + b
        x = ((x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)).min(axis=0)
        least = x if least is None else np.minimum(least, x)
    return least


def group_hashes(one: np.ndarray) -> np.ndarray:
    """A hash of each group: GROUPS of the first collection, then GROUPS of the second."""
    halves = signature(one, 2 * GROUPS * VALUES).reshape(2 * GROUPS, VALUES)
    part = mix(halves[:, 0])
    for k in range(1, VALUES):
        part = mix(part * U64(3) + halves[:, k])
    return part


def tensored_keys(rows: DataFrame) -> DataFrame:
    """key, id: a key for each pair of a group of either collection."""
    table = F.explode(F.sequence(F.lit(0), F.lit(GROUPS * GROUPS - 1)))
    each = rows.select("id", "groups", table.alias("table"))
    first, second = F.expr(f"groups[table div {GROUPS}]"), F.expr(f"groups[{GROUPS} + table % {GROUPS}]")
    return each.select(F.xxhash64(first, second, "table").alias("key"), "id")


def sketch(one: np.ndarray) -> np.ndarray:
    """Two bits of each of SKETCH further MinHash values, 32 of them in each long."""
    pairs = (signature(one, SKETCH) & U64(3)).reshape(-1, 32)
    return (pairs << (np.arange(32, dtype=U64) * U64(2))).sum(axis=1, dtype=U64)


def _long(values) -> pa.Array:
    return pa.array(np.array(values, dtype=U64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, dtype=U64), *arrays])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), _long(flat))


def _sign(words: int):
    def run(batches):
        worker_state("minhash", dict)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                groups = [group_hashes(x) if len(x) else x for x in sets]
                f1 = [mix(x).sum(dtype=U64) for x in sets]
                f2 = [mix(x ^ PAD).sum(dtype=U64) for x in sets]
                size = pa.array([len(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), size, _long(f1), _long(f2), _lists(groups)], names=["id", "n_shingles", "f1", "f2", "groups"])

    return run


def _expand(words: int):
    def run(batches):
        worker_state("minhash", dict)
        met: set = set()
        for batch in batches:
            for part in slices(batch, "text"):
                #: Rows that repeat an id and a text within a task count once.
                row = [(i, hash(t)) for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist())]
                new = [not (x in met or met.add(x)) for x in row]
                part = part if all(new) else part.filter(pa.array(new, pa.bool_()))
                sets = shingle_sets(part.column("text"), words)
                marks = [sketch(x) if len(x) else np.zeros(len(MARKS), dtype=U64) for x in sets]
                columns = np.array(marks, dtype=U64).reshape(-1, len(MARKS)).T
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(sets), *map(_long, columns)], names=["id", "items", *MARKS])

    return run


def _alike(percent: int):
    """Could a and b reach the similarity? Exact on sizes; by sketch 3.5 deviations below it."""
    fits = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    differ = F.lit(0)
    for name in MARKS:
        x = F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    p = percent / 100 + (1 - percent / 100) / 4
    return fits & (differ <= F.lit(int(SKETCH * (1 - p) + 3.5 * (SKETCH * p * (1 - p)) ** 0.5)))


def _side(about: DataFrame, name: str) -> DataFrame:
    return about.select(F.col("id").alias(name), *(F.col(m).alias(f"{name}_{m}") for m in ("n", *MARKS)))


def _sifted(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), each once, those that can reach the similarity."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return once.join(_side(about, "a"), "a").join(_side(about, "b"), "b").where(_alike(percent)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the similarity."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("a_items")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("items").alias("b_items")), "b")
    shared = F.size(F.array_intersect("a_items", "b_items"))
    return two.where(100 * shared >= percent * (F.size("a_items") + F.size("b_items") - shared)).select("a", "b")


def _open_buckets(busy: DataFrame, known: DataFrame) -> DataFrame:
    """key, id, component and main (the bucket's largest component), of buckets with several."""
    placed = busy.join(known.select(F.col("node").alias("id"), "component"), "id", "left")
    placed = placed.select("key", "id", F.coalesce("component", "id").alias("component"))
    groups = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    mixed = groups.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("parts"))
    return placed.join(mixed.where("parts > 1").select("key", "main"), "key")


def _binned(batches):
    """How often shingles of each bin stand in the sets of a task."""
    held = np.zeros(BINS, dtype=np.int64)
    for batch in batches:
        items = batch.column("items").flatten().to_numpy(zero_copy_only=False)
        held += np.bincount(items & (BINS - 1), minlength=BINS)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["place", "value"])


def _prefixes(sent, percent: int):
    """id, component, outer, n and each shingle of the set's prefix (its rarest) with its place."""

    def run(batches):
        often = sent.value
        for batch in batches:
            sets = batch.column("items")
            values, offsets = sets.flatten().to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
            offsets, picked = offsets - offsets[0], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                own = values[a:b]
                order = np.lexsort((own, often[own & (BINS - 1)]))
                picked.append(own[order[: len(own) - -(-percent * len(own) // 100) + 1]])
            size = np.array([*map(len, picked)], dtype=np.int64)
            at = np.repeat(np.arange(len(picked)), size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            item = np.concatenate([np.zeros(0, dtype=np.int64), *picked])
            columns = [batch.column(c).take(pa.array(at)) for c in ("id", "component", "outer")]
            columns += [pa.array(np.diff(offsets)[at], pa.int64()), pa.array(item, pa.int64()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "outer", "n", "item", "place"])

    return run


def _rare_pairs(divided: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components, one of them outside, that share a shingle
    of their prefixes. ``divided``: id, component, outer."""
    spark = sets.sparkSession
    own = cut(sets.select("id", "items").join(divided, "id"))
    bins = own.select("items").mapInArrow(_binned, "place long, value long").groupBy("place").agg(F.sum("value").alias("value"))
    often = gathered(bins, BINS)
    sent = spark.sparkContext.broadcast(often)
    rows = cut(own.mapInArrow(_prefixes(sent, percent), "id long, component long, outer boolean, n long, item long, place long"))
    #: The smaller set of a pair needs a shorter prefix than the larger.
    small = F.col("place") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    rows = rows.withColumn("small", small)
    sides = rows.groupBy("item").agg(
        F.count_if(F.col("small") & F.col("outer")).alias("small_outer"), F.count_if(F.col("small") & ~F.col("outer")).alias("small_inner"), F.count_if(F.col("outer")).alias("outers"), F.count("*").alias("all"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    )
    sides = sides.where("outers > 0 and low < high")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    share = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n))
    named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("id", "component", "n", "place")]
    #: What the sets can share if this is the first shingle that they share.
    first = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    fits = (F.col("a_component") != F.col("b_component")) & (F.struct("a_n", "a_id") < F.struct("b_n", "b_id")) & ((100 + percent) * first >= percent * (F.col("a_n") + F.col("b_n")))
    found = []
    for few, many, a_side, b_side in (("small_outer", "all", "small and outer", "true"), ("small_inner", "outers", "small and not outer", "outer")):
        busy = sides.where(f"{few} > 0").select("item", F.ceil(F.col(few) / TILE).alias("down"), F.ceil(F.col(many) / TILE).alias("across"))
        dealt = rows.join(busy, "item")
        left = dealt.where(a_side).select("item", *named("a"), share("down").alias("i"), numbers("across").alias("j"))
        right = dealt.where(b_side).select("item", *named("b"), share("across").alias("j"), numbers("down").alias("i"))
        found.append(left.join(right, ["item", "i", "j"]).where(fits).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")))
    return found[0].union(found[1]).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows whose shingle sets have ``100 * intersection >= percent * union`` are linked;
    component_id is the smallest id reachable and kept marks the row that bears it.

    Defined results: a null or blank text has an empty set, links with nothing and is
    kept; a null id takes no part (component_id null, kept true); rows that share an id
    are one document, linked as any of them is; other columns, whatever their names,
    are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(base.mapInArrow(_sign(words), "id long, n_shingles long, f1 long, f2 long, groups array<long>"))
    usable = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))

    classes = usable.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("groups").alias("groups"))
    member = cut(usable.select("id", "f1", "f2").distinct().join(classes.select("f1", "f2", "rep"), ["f1", "f2"]))
    #: Classes that one repeated id ties together.
    tied = member.groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    tied = member.join(tied.select("id", "a"), "id").select("a", F.col("rep").alias("b")).where("a != b")

    rows = tensored_keys(classes.select(F.col("rep").alias("id"), "groups"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot < top")
    busy = cut(rows.join(buckets.select("key", "pivot"), "key"))

    expanded = "id long, items array<long>, " + ", ".join(f"{m} long" for m in MARKS)
    sets = cut(base.join(busy.select("id").distinct(), "id", "left_semi").mapInArrow(_expand(words), expanded))
    about = sets.select("id", F.size("items").alias("n"), *MARKS)

    pairs = busy.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = _confirmed(_sifted(pairs, about, percent), sets, percent).union(tied)
    before = None
    for turn in itertools.count():
        known = cut(components(links, "a", "b"))
        open_ = cut(_open_buckets(busy, known))
        apart = open_.where("component != main").select("id").distinct().count()
        if not apart or before is not None and 3 * apart > 2 * before:
            break
        before = apart
        pivots = open_.where("component = main").groupBy("key").agg(F.max_by("id", F.xxhash64("id", "key", F.lit(turn))).alias("a"))
        pairs = open_.where("component != main").join(pivots, "key").select("a", F.col("id").alias("b"))
        links = _confirmed(_sifted(pairs, about, percent), sets, percent).union(known.select("node", "component"))
    if apart:
        divided = open_.groupBy("id", "component").agg(F.max(F.col("component") != F.col("main")).alias("outer"))
        late = _sifted(_rare_pairs(divided, sets, percent), about, percent)
        known = components(_confirmed(late, sets, percent).union(known.select("node", "component")), "a", "b")

    found = member.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.select("id", "n_shingles").join(found, "id", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )
