"""Mixing sources to target weights with hash-random order and exact word budgets.

DataFrame functions only. Every row gets a hash-random key; rows that are equal in id, text and
source are one class with a count. Key ranges are the blocks of a range sort within each
source. Sums of the blocks give each block's offset in its source, and a window inside one
block adds the classes before, so a source of any share is spread over all its blocks, a
class of any share is one row, and prefix sums need no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import blocks_for, cut

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACED = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Rows that a block of keys holds on average, and the least number of blocks.
BLOCK_ROWS, LEAST_BLOCKS = 20_000, 256
#: Sources in one range of names, copies that one task writes of a class, shares of copies.
RANGE_SOURCES, COPIES, SHARES = 200_000, 10_000, 1024


def _ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with ``place``, the row's number from 0 in the order of source names, null last:
    numbers inside ranges of names, and the sizes of the ranges before."""
    ranges = blocks_for(totals.count(), RANGE_SOURCES)
    dealt = cut(totals.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    sizes = sorted((r["range"], r["count"]) for r in dealt.groupBy("range").count().collect())  # a row a range
    before, offset = 0, F.lit(0)
    for number, size in sizes:
        offset, before = F.when(F.col("range") == number, F.lit(before)).otherwise(offset), before + size
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("place", inside - 1 + offset).drop("range")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Sources in order of code points, null last, take the weights in turn. The targets are
    in proportion to the weights and sum to ``share`` (a fraction) of all sizes; none
    exceeds ``most`` times its source's size: what is over is shared out again by weight
    until none is above. Each round is one sum over the sources, so there may be any number
    of them; the rounds end when no further source is full.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = cut(_ranked(totals).withColumn("weight", pick.cast("long")).drop("place"))
    full, ratio, level, held = most * F.col("source_size"), most * F.col("source_size") / F.col("weight"), None, -1
    while True:
        taken = F.lit(False) if level is None else ratio < F.lit(level)
        open_ = F.when(~taken, F.col("weight"))
        n, total, over, weight = weighed.agg(F.count_if(taken), F.sum("source_size"), F.sum(F.when(taken, full)), F.sum(open_)).head()
        if n == held or not weight:
            break
        held, level = n, (total * share[0] / share[1] - (over or 0)) / weight
    target = full.cast("double") if not weight else F.when(ratio < F.lit(level), full.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighed.select("source", "source_size", "weight", target.alias("target"))


def _keys(id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    """What places a row: doc_id, source, size, and a key drawn from its id and text."""
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return {"doc_id": doc_id, "source": F.col(f"`{source_col}`").cast("string"), "size": size, "key": F.xxhash64(F.lit(seed), doc_id, text)}


def _classes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """source, key, doc_id, size, n (equal rows) and source_size, target, epochs, rest (words of
    the last, partial epoch), before (words that come before the class in its source)."""
    keys = _keys(id_col, text_col, source_col, seed)
    rows = cut(docs.select(*(c.alias(k) for k, c in keys.items())).groupBy(*keys).agg(F.count("*").alias("n")))
    blocks = max(LEAST_BLOCKS, blocks_for(rows.count(), BLOCK_ROWS))
    width = F.lit(str(2**64 // blocks + 1)).cast("decimal(20,0)")
    rows = rows.withColumn("block", F.floor((F.col("key").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")) / width).cast("int"))
    words = F.sum(F.col("size") * F.col("n"))
    sums = cut(rows.groupBy("source", "block").agg(words.alias("block_size")))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("offset"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")))
    plan = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(offsets["source"], "block", "offset", "source_size", "target")
    here = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(words.over(here), F.lit(0)))
    both = placed.join(plan, placed["source"].eqNullSafe(plan["source"]) & (placed["block"] == plan["block"]))
    budget = F.round("target").cast("long")
    epochs = F.floor(budget / F.greatest("source_size", F.lit(1))).cast("long")
    return cut(
        both.select(
            placed["source"], "key", "doc_id", "size", "n", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"), (F.col("offset") + F.col("inside")).alias("before")
        )
    )


def _taken(copy: Column) -> Column:
    """Words that the mix takes of the class's row number ``copy``, from 0."""
    extra = F.col("rest") - F.col("before") - copy * F.col("size")
    return F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), extra))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``.

    size counts the words of the text. The budget of a source is its target rounded to
    whole words: as many whole epochs as fit, then rows in hash-random order up to the
    budget, where the row at the cut gives the words that are left. So each source's
    taken words are its budget exactly and no row gives more than twice its size.

    Defined results: null and blank texts have size 0 and give nothing; a null source is
    a source of its own, the last; null and repeated ids are rows like others (equal rows
    tie in any order, with the same result); a source without words has target 0; other
    columns are ignored; an empty table gives an empty result.
    """
    classes = _classes(docs, id_col, text_col, source_col, seed)
    last = F.col("n") - 1
    few = classes.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    #: Larger classes are written by several tasks.
    parts = classes.where(F.col("n") > COPIES).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES))))
    begin = F.col("part") * COPIES
    many = parts.repartition("doc_id", "key", "part").withColumn("copy", F.explode(F.sequence(begin, F.least(last, begin + COPIES - 1)))).drop("part")
    return few.unionByName(many).select("doc_id", "source", "size", "source_size", "target", _taken(F.col("copy")).alias("taken"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``copy``, a number from 0 for each row of its class: numbers inside SHARES shares of
    a class, and the sizes of the shares before, so a class of any size is several groups."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id())).withColumn("share", F.pmod(F.xxhash64("row"), F.lit(SHARES)))
    sizes = rows.groupBy(*keys, "share").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(*keys).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("share").alias("s_share"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*keys, "share").orderBy("row"))
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"s_{k}")), keys, F.col("share") == F.col("s_share"))
    return rows.withColumn("inside", inside).join(sizes, same).withColumn("copy", F.col("first") + F.col("inside") - 1)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The documents of the mix, with the columns of ``docs`` (of any names and types).

    A row appears once for each whole time that it is taken; the row at a source's cut
    appears with its first words, up to the budget. Rows of which nothing is taken go.
    Rows that share an id, text and source are mixed as what they are: that many rows; if
    such rows differ in other columns, which of them comes first isn't fixed.
    """
    classes = _classes(docs, id_col, text_col, source_col, seed).where("epochs > 0 or before < rest")
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    keys = _keys(at[id_col], at[text_col], at[source_col], seed)
    held = docs.toDF(*at.values()).withColumns(keys)
    plan = classes.select(*(F.col(k).alias(f"p_{k}") for k in keys), "n", "epochs", "rest", "before")
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"p_{k}")), ("doc_id", "source", "size"), F.col("key") == F.col("p_key"))
    each = held.join(plan.where("n = 1"), same).withColumn("taken", _taken(F.lit(0)))
    names = [*at.values(), "size", "taken"]
    each = each.select(*names)
    repeated = plan.where("n > 1")
    if not repeated.isEmpty():
        rows = _numbered(held.join(repeated, same), [*keys])
        each = each.union(rows.withColumn("taken", _taken(F.col("copy"))).select(*names))
    each = each.where("taken > 0").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("time") - 1) * F.col("size"))
    text = F.col(at[text_col])
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED), 0), F.lit(1), words.cast("int")), "")
    cut_text = F.when(words < F.col("size"), first).otherwise(text)
    return each.select(*((cut_text if c == text_col else F.col(k)).alias(c) for c, k in at.items()))
