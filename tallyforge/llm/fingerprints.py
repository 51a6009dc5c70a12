"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A paragraph (a line, cut at sentence ends where it is long) has a 64-bit digest. A sketch hashes
each digest of a text to one cell in each of three tables; a cell holds how many digests came
and the XOR of them and of their checks. Sketches of two texts subtract cell by cell: what both
hold cancels. A cell that is left with one digest tells it; taken out of its other cells too,
it uncovers further ones. If cells are left at the end, the sketch was too small, and the pair
is compared again in larger ones.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import cut

#: Up to 80 characters, on to the next sentence end within 320 more, line breaks after it.
PARAGRAPH = r"[^\n]{1,80}[^.!?\n]{0,320}[.!?]*\n*|\n+"
TABLES = 3
#: Cells a table of the fingerprint; the least of a retry, its share of both texts' digests.
BASE, LEAST, LOAD = 4, 16, 0.55
#: Steps of peeling, each over one table, so that no digest is taken twice in a step.
FIRST_STEPS, STEPS = 6, 15
#: Documents of a block, and blocks at most.
BLOCK, BLOCKS = 256, 8192


def paragraph_digests(text: str | Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.shiftright(F.xxhash64(digest, F.lit("check")), 32)


def _cell(digest: Column, tab, size) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(tab), size), size)


def _at(digest: Column, tab: int, size: Column, n: Column) -> Column:
    """What ``n`` times a digest adds to its cell of a table."""
    return F.struct(F.lit(tab).alias("tab"), _cell(digest, tab, size).alias("cell"), n.alias("n"), digest.alias("digest"), _check(digest).alias("mark"))


def _found(digest: Column, n: Column) -> Column:
    """A digest that was taken out, kept beside the cells as table 3."""
    none = F.lit(0).cast("long")
    return F.struct(F.lit(TABLES).alias("tab"), digest.alias("cell"), n.alias("n"), none.alias("digest"), none.alias("mark"))


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, size, digest, n) summed into the cells of their sketches."""
    spread = F.explode(F.array(*(_at(F.col("digest"), t, F.col("size"), F.col("n")) for t in range(TABLES)))).alias("c")
    return _summed(rows.select(*keys, "size", spread), keys)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    rows = rows.select(*keys, "size", "c.*").groupBy(*keys, "size", "tab", "cell")
    return rows.agg(F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("mark").alias("mark"))


def _peeled(cells: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Takes single digests out, ``steps`` times; cells that cancel are dropped."""
    left = cells.where("n <> 0 or digest <> 0 or mark <> 0")
    names = ["tab", "cell", "n", "digest", "mark"]
    for step in range(steps):
        tab = step % TABLES
        single = (F.col("tab") == tab) & (F.abs("n") == 1) & (F.col("mark") == _check(F.col("digest")))
        single &= F.col("cell") == _cell(F.col("digest"), tab, F.col("size"))
        taken = [_at(F.col("digest"), t, F.col("size"), -F.col("n")) for t in range(TABLES) if t != tab]
        out = F.when(single, F.array(_found(F.col("digest"), F.col("n")), *taken)).otherwise(F.array(F.struct(*names)))
        left = _summed(left.select(*keys, "size", F.explode(out).alias("c")), keys).where("n <> 0 or digest <> 0 or mark <> 0")
    return left


def differing_paragraphs(pairs: DataFrame, digests: bool = False) -> DataFrame:
    """row, pair, size, n_differ for ``pairs`` (row, pair, ours, theirs: arrays of distinct
    digests): how many digests one side has and the other hasn't, and the cells a table that
    it took. ``digests`` adds them: only_ours, only_theirs.

    The first sketch is the fingerprint's; pairs that fail are compared again at a size that
    their two counts call for, then at four times that, until none fails. Equal arrays (also
    two empty ones) differ by 0. An array that is null counts as empty.
    """
    keys, done = ["row", "pair"], None
    held = F.size(F.coalesce("ours", F.array())) + F.size(F.coalesce("theirs", F.array()))
    called = F.greatest(F.lit(LEAST), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(held * LOAD, F.lit(1.0)))))).cast("long")
    rest, times = pairs, 0
    while True:
        size = called * F.lit(4 ** (times - 1)) if times else F.lit(BASE).cast("long")
        dealt = rest.repartition("row").withColumn("size", size)
        sides = F.explode(F.array(F.struct(F.lit(1).cast("long").alias("n"), F.col("ours").alias("all")), F.struct(F.lit(-1).cast("long").alias("n"), F.col("theirs").alias("all"))))
        rows = dealt.select(*keys, "size", sides.alias("s")).select(*keys, "size", "s.n", F.explode("s.all").alias("digest"))
        peeled = _peeled(_cells(rows, keys), keys, STEPS if times else FIRST_STEPS)
        taken = F.col("tab") == TABLES
        sums = [F.sum(F.when(taken, 0).otherwise(1)).alias("left"), F.sum(F.when(taken, 1).otherwise(0)).alias("n_differ"), F.max("size").alias("size")]
        if digests:
            sums += [F.collect_list(F.when(taken & (F.col("n") == n), F.col("cell"))).alias(c) for c, n in (("only_ours", 1), ("only_theirs", -1))]
        found = cut(peeled.groupBy(*keys).agg(*sums))
        good = found.where("left = 0").drop("left")
        done = good if done is None else done.union(good)
        failed = found.where("left > 0").select(*keys)
        if failed.isEmpty():
            break
        rest, times = rest.join(failed, keys, "left_semi"), times + 1
    names = ["size", "n_differ"] + ["only_ours", "only_theirs"] * digests
    same = {"size": F.lit(BASE), "n_differ": F.lit(0)} | ({c: F.array().cast("array<bigint>") for c in names[2:]})
    return pairs.select(*keys).join(done.select(*keys, *names), keys, "left").select(*keys, *(F.coalesce(c, same[c]).alias(c) for c in names))


def fingerprints(texts: DataFrame) -> DataFrame:
    """row, version, fingerprint for ``texts`` (row, version, digests): the cells of the smallest
    sketch as ``table.cell:count:digests:checks`` in hexadecimal, without empty ones."""
    keys = ["row", "version"]
    rows = texts.select(*keys, F.lit(BASE).cast("long").alias("size"), F.lit(1).cast("long").alias("n"), F.explode("digests").alias("digest"))
    shown = F.format_string("%d.%d:%x:%016x:%x", "tab", "cell", "n", "digest", F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = _cells(rows, keys).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(shown)), ";").alias("fingerprint"))
    return texts.select(*keys).join(cells, keys, "left").select(*keys, F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by (doc_id, hash, text), null ids first;
    after the last row comes the first.

    Rows go to blocks of neighbours once; each block's first row goes to the block before it
    as well, so no row is looked up elsewhere and no task holds more than a block.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = told.withColumn("hash", F.xxhash64("text"))
    #: Never falls along the order; rows that share an id still spread.
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf)) + (F.shiftright("hash", 44) + (1 << 19)) / F.lit(float(1 << 20))
    told = told.withColumn("place", place)
    blocks = min(BLOCKS, max(1, -(-told.count() // BLOCK)))
    starts: list = []
    if blocks > 1:
        parts = F.from_json(F.lit(json.dumps([k / blocks for k in range(1, blocks)])), "array<double>")
        starts = sorted({x for x in told.agg(F.percentile_approx("place", parts, 10 * blocks)).head()[0] if x > -math.inf})
    told = told.withColumn("block", _block(F.col("place"), starts))

    first = told.groupBy("block").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    ends = Window.orderBy("block")  # of at most BLOCKS rows
    before = F.coalesce(F.lag("block").over(ends), F.max("block").over(Window.partitionBy(F.lit(0))))
    first = first.select("block", F.col("first.doc_id").alias("first_id"), F.col("first.hash").alias("first_hash"), before.alias("before"))
    here = (F.col("first_hash") == F.col("hash")) & F.col("first_id").eqNullSafe(F.col("doc_id")) & (F.col("f.block") == F.col("t.block"))
    told = told.alias("t").join(F.broadcast(first).alias("f"), here, "left").select("t.*", "before")
    to = lambda block, copy: F.struct(block.alias("block"), F.lit(copy).alias("copy"))
    both = F.when(F.col("before").isNull(), F.array(to(F.col("block"), False))).otherwise(F.array(to(F.col("block"), False), to(F.col("before"), True)))
    sent = told.select("doc_id", "text", "hash", F.explode(both).alias("to")).select("doc_id", "text", "hash", "to.*")
    order = Window.partitionBy("block").orderBy("copy", F.asc_nulls_first("doc_id"), "hash", "text")
    return sent.withColumn("next_text", F.lead("text").over(order)).where("not copy").select("doc_id", "text", "next_text")


def _block(place: Column, starts: list[float], wide: int = 64) -> Column:
    """How many starts are not after a place: first among every 64th, then among the 64."""
    if not starts:
        return F.lit(0)
    array = lambda x: F.from_json(F.lit(json.dumps(x)), "array<double>")
    coarse = F.size(F.filter(array(starts[::wide]), lambda s: s <= place))
    fine = F.slice(array(starts), F.greatest((coarse - 1) * wide + 1, F.lit(1)), F.lit(wide))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * wide + F.size(F.filter(fine, lambda s: s <= place)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    over all ``documents``: each text against its edited form (its last half replaced by the
    start of the next document) and against the next document.

    Likeness is the Jaccard similarity of the two sets of paragraph digests, from what peeling
    recovers; two texts without paragraphs have 1. A null text is empty. Ids may repeat or be
    null: rows are ordered by id (nulls first), hash and text, and each is a document. A single
    document is its own next. Other columns are not read. No documents give no rows.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    told = with_next(docs).select("doc_id", "text", "next_text", edited.alias("edited"))
    told = told.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *(paragraph_digests(c).alias(a) for c, a in (("text", "ours"), ("edited", "changed"), ("next_text", "after"))),
    )
    told = cut(told)
    pair = lambda name, side: F.struct(F.lit(name).alias("pair"), F.col(side).alias("theirs"))
    pairs = told.select("row", "ours", F.explode(F.array(pair("edited", "changed"), pair("next", "after"))).alias("p")).select("row", "p.pair", "ours", "p.theirs")
    differ = differing_paragraphs(pairs)
    text = lambda name, side: F.struct(F.lit(name).alias("version"), F.col(side).alias("digests"))
    texts = told.repartition("row").select("row", F.explode(F.array(text("own", "ours"), text("edited", "changed"))).alias("v")).select("row", "v.*")
    marks = fingerprints(texts).groupBy("row").agg(*(F.max(F.when(F.col("version") == v, F.col("fingerprint"))).alias(a) for v, a in (("own", "fingerprint"), ("edited", "edited_fingerprint"))))
    counts = differ.groupBy("row").agg(*(F.max(F.when(F.col("pair") == p, F.col("n_differ"))).alias(p) for p in ("edited", "next")))
    small = told.select("row", "doc_id", "n_chars", "edited_sha256", *(F.size(c).alias(c) for c in ("ours", "changed", "after")))
    out = small.join(marks, "row").join(counts, "row")

    def near(other: str, n: str) -> Column:
        whole = F.col("ours") + F.col(other)
        return F.when(whole == 0, F.lit(1.0)).otherwise((whole - F.col(n)) / (whole + F.col(n)))

    near_edited, near_next = near("changed", "edited").alias("near_edited"), near("after", "next").alias("near_next")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited, near_next)
