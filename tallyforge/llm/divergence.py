"""Source divergence audit: how far the sources of a language lie apart in their words.

Every pair of sources is compared over all terms that its language keeps, also those that one
or both never use. Most (source, term) counts are zero, so the sums are put together by
inclusion and exclusion over the supports:

* a term that only one source uses costs what its count costs against zero; sources are
  reduced to histograms (count, terms with it), which price all terms as if they were one-sided;
* terms that both use are found in the terms' posting lists and corrected;
* terms that neither uses have one price; their number follows from the supports' sizes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import blocks_for, bounded_batches, cut

#: A term is a run of ASCII letters and of bytes of other characters; only A-Z change case.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SLICE, HELD = 1 << 20, 200_000
#: Postings of a cell, sources of a side of it, and shares of a language's histograms.
PER_CELL, SIDE, SHARES = 250_000, 64, 8
ONE = 1_000_000_000


def _words(text: bytes):
    """Lists of a text's terms, for about a MB of it at a time."""
    line, at = text.translate(TERM), 0
    while at < len(line):
        end = line.find(b" ", at + SLICE)
        end = len(line) if end < 0 else end
        yield line[at:end].split()
        at = end


def _counted(batches):
    """(lang, source, term, n, docs): occurrences and documents, summed as far as memory of a
    fixed size goes."""

    def rows():
        for (lang, source), (n, docs) in held.items():
            if n:
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                name = lambda x: pa.array([x]).cast(pa.string()).take(pa.array(np.zeros(len(n), np.int64)))  # noqa: E731, B023
                counts = [pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays([name(lang), name(source), terms, *counts], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    held: dict = {}
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set = set()
            for words in _words(text):
                n.update(words)
                new = set(words) - seen
                docs.update(new)
                seen |= new
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def share(count, total, kept) -> Column:
    """p of a count in a group with ``total`` occurrences of ``kept`` terms: a smoothed share in
    billionths, rounded down, plus 1; exact beyond 64 bits. Null where no term is kept."""
    count, total, kept = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (count, total, kept))
    wide = "decimal(20,0)"
    whole = F.call_function("div", F.lit(ONE) * (count + F.lit(2)).cast(wide), F.nullif(total + 2 * kept, F.lit(0)).cast(wide))
    return whole.cast("long") + 1


def gap(p: str | Column, q: str | Column) -> Column:
    """f: the squared difference over the sum, rounded down; below 2^63 since shares are below 2^31."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p, q):
    return (p - q) ** 2 // (p + q)


def _overlaps(table: pa.Table) -> pa.Table:
    """Corrections of one cell: for each pair of its sources, over the terms that both use."""
    lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((table.column("k").to_numpy(), term))
    term = term[order]
    k, p, zero, side = (table.column(c).to_numpy()[order] for c in ("k", "p", "zero", "side"))
    names, slot = np.unique(k, return_inverse=True)
    total, met = np.zeros((2, len(names) ** 2), dtype=np.int64)
    step = 1
    while step < len(term):
        a = np.flatnonzero(term[step:] == term[:-step])
        if not len(a):
            break
        b = a + step
        if lo != hi:  # pairs within one side have a cell of their own
            apart = side[a] != side[b]
            a, b = a[apart], b[apart]
        at = slot[a] * len(names) + slot[b]
        np.add.at(total, at, _f(p[a], p[b]) - _f(p[a], zero[b]) - _f(zero[a], p[b]) + _f(zero[a], zero[b]))
        np.add.at(met, at, 1)
        step += 1
    found = np.flatnonzero(met)
    lang = pa.array([table.column("lang")[0].as_py()] * len(found), pa.string())
    return pa.table({"lang": lang, "k": names[found // len(names)], "other": names[found % len(names)], "value": total[found]})


def divergence_audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank over ``documents`` (text, lang, source; nulls are '').

    A language keeps the terms of at least ``least_docs`` of its documents. Part ``pair`` gives
    each other source of the language with the summed gap over all kept terms; part ``term``
    the ``top`` kept terms that the source uses more than its language does, by their gap.

    A source without terms has all counts zero; a language that keeps no term has pairs of
    value 0; a language's only source has no pair. Texts may be empty or of any length, rows
    may repeat (each counts), other columns are not read. No documents give no rows.
    """
    bounded_batches(docs.sparkSession)
    told = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    read = told.select("lang", "source").distinct()
    counted = told.withColumn("text", F.col("text").cast("binary")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    #: One shuffle serves the sums and the languages' view of each term.
    by_term = Window.partitionBy("lang", "term")
    kept = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = kept.withColumns({"lang_n": F.sum("n").over(by_term), "lang_docs": F.sum("docs").over(by_term), "place": F.row_number().over(by_term.orderBy("source"))})
    kept = cut(kept.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).cast("long").alias("first")))

    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_total"))
    groups = read.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "used", "kept", "lang_total"])
    groups = groups.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - F.lit(1).cast("long"))
    groups = groups.withColumn("sides", F.ceil(F.count("*").over(Window.partitionBy("lang")) / SIDE))
    groups = cut(groups.withColumn("zero", share(0, "total", "kept")))

    postings = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    pairs = _pair_sums(groups, postings, blocks_for(kept.count(), PER_CELL))
    names = groups.select("lang", "k", "source")
    named = pairs.join(names, ["lang", "k"]).join(names.select("lang", F.col("k").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    terms = postings.withColumn("q", share("lang_n", "lang_total", "kept")).where("n > 0 and p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    both = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    best = terms.select("*", rank).where(F.col("rank") <= top)
    return both.select("*", rank).unionByName(best)


def _pair_sums(groups: DataFrame, postings: DataFrame, buckets: int) -> DataFrame:
    """lang, k, other, value: the three parts of each ordered pair of sources, added up."""
    g, h = groups.alias("g"), groups.alias("h")
    each = g.join(h, (F.col("g.lang") == F.col("h.lang")) & (F.col("g.k") != F.col("h.k")))
    neither = F.col("g.kept") - F.col("g.used") - F.col("h.used")
    none = each.select("g.lang", "g.k", F.col("h.k").alias("other"), F.coalesce(neither * gap("g.zero", "h.zero"), F.lit(0)).alias("value"))

    #: A language's histograms are dealt into shares, since one language can hold them all.
    bars = postings.groupBy("lang", "k", "p").agg(F.count("*").alias("terms")).withColumn("share", F.pmod(F.xxhash64("k", "p"), F.lit(SHARES)).cast("int"))
    other = groups.select("lang", F.col("k").alias("other"), "zero", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    one = bars.join(other, ["lang", "share"]).where("k <> other")
    one = one.groupBy("lang", "k", "other").agg(F.sum(F.col("terms") * gap("p", "zero")).alias("value"))

    #: A cell has two sides of up to 64 sources and a share of the terms: bounded for any number of either.
    side = F.floor(F.col("k") / SIDE)
    facing = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("facing")
    dealt = postings.select("lang", "term", "k", "p", "zero", side.alias("side"), facing)
    dealt = dealt.select("lang", "term", "k", "p", "zero", "side", F.least("side", "facing").alias("lo"), F.greatest("side", "facing").alias("hi"), F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"))
    both = dealt.groupBy("lang", "lo", "hi", "bucket").applyInArrow(_overlaps, "lang string, k long, other long, value long")
    both = both.groupBy("lang", "k", "other").agg(F.sum("value").alias("value"))
    turned = lambda df: df.union(df.select("lang", F.col("other").alias("k"), F.col("k").alias("other"), "value"))
    return none.union(turned(one)).union(turned(both)).groupBy("lang", "k", "other").agg(F.sum("value").alias("value"))
