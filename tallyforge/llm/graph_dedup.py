"""Near duplicates of vectors by a robust-pruned graph, with exact tiles for dense groups.

Vectors of one label are dealt to overlapping shards around sampled centroids: the nearest one
(their home) and the next nearest that a link could reach. Each shard builds a graph by robust
pruning; the lists of a vector are united over its shards. A range-expanding greedy search from
medoids then runs in each shard over the united lists; edges that leave a shard from a row in
range give candidates elsewhere, which are verified and followed in turn. A search whose list
fills up marks a dense vector. A bounded audit compares drawn vectors with all others, and
shards in which it finds a loss are treated as dense too. Links between two dense vectors come
from exact tiles: all pairs of blocks that can hold a link (triangle inequality on angles) are
compared. Every link is decided in double precision where single precision leaves a doubt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import components, cut
from tallyforge.llm.pruned_graph import padded, range_search, robust_prune
from tallyforge.llm.vectors import matrices, usable

#: Vectors for each centroid, bytes of centroids sent to the tasks in one round, vectors a shard holds.
PER_CENTROID, CENTROID_BYTES, SHARD = 400, 4 << 20, 2000
#: Shards that a vector joins in a round, rounds of dealing.
OVERLAP, ROUNDS = 2, 8
#: Vectors that the audit compares with all others, and the bytes they may have.
AUDIT, AUDIT_BYTES = 1024, 4 << 20
#: Rows of a tile that are compared at once, and parts over which block pairs of a label spread.
STEP, SPREAD = 512, 16


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a - b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _deal(plan, least: float):
    """Rows to rows with the shard of the nearest centroid; ``plan``: parent -> centroids. A home
    row also becomes a guest of the next nearest, unless no link can reach it: both ends
    are nearest to their own centroid, so that one is at most two linking angles farther."""
    reach = 2 * float(np.arccos(least)) + 1e-6

    def run(batches):
        held = plan.value
        for batch in batches:
            parents = np.array(batch.column("shard").to_pylist(), dtype=object)
            homes = np.array(batch.column("home").to_pylist(), dtype=bool)
            rows_of, shards, home = [], [], []
            for at, rows in matrices(batch.column("vector")):
                x = unit(rows)
                for parent in np.unique(parents[at].astype(str)):
                    own = np.flatnonzero(parents[at] == parent)
                    angle = np.arccos(np.clip(x[own] @ held[parent].T, -1, 1))
                    order = np.argsort(angle, axis=1, kind="stable")[:, :OVERLAP]
                    near = np.take_along_axis(angle, order, axis=1)
                    fits = (near - near[:, :1] <= reach) & homes[at[own]][:, None]
                    fits[:, 0] = True
                    r, c = np.nonzero(fits)
                    rows_of.append(at[own[r]])
                    shards += [f"{parent}/{k}" for k in order[r, c]]
                    home.append(homes[at[own[r]]] & (c == 0))
            if rows_of:
                out = batch.take(pa.array(np.concatenate(rows_of)))
                out = out.set_column(out.schema.get_field_index("shard"), "shard", pa.array(shards, pa.string()))
                yield out.set_column(out.schema.get_field_index("home"), "home", pa.array(np.concatenate(home)))

    return run


_MEMBER = ["node", "rep", "label", "shard", "weight", "home", "hard", "vector"]


def shards_of(reps: DataFrame, least: float, widest: int) -> DataFrame:
    """Deals rows of ``_MEMBER`` on until no shard holds more than SHARD vectors.

    Each row has one home and may be a guest elsewhere. What centroids don't divide within
    ROUNDS is divided by hash and marked ``hard``: only exact tiles serve it."""
    now, done = reps, None
    schema = reps.select(_MEMBER).schema
    most = max(2, CENTROID_BYTES // (8 * widest))
    for turn in range(ROUNDS + 1):
        sizes = now.groupBy("shard").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > SHARD))
        fine = now.join(large, "shard", "left_anti").select(_MEMBER)
        done = fine if done is None else done.union(fine)
        total = large.agg(F.sum("n")).head()[0]
        if not total:
            break
        now = now.join(large, "shard")
        if turn == ROUNDS:
            parts = F.ceil(2 * F.col("n") / SHARD)
            salted = F.concat_ws("#", "shard", F.pmod(F.xxhash64(F.lit("part"), "node"), parts))
            done = done.union(now.withColumn("shard", salted).withColumn("hard", F.lit(True)).select(_MEMBER))
            break
        per = max(PER_CENTROID, -(-2 * total // most))
        drawn = now.where(F.pmod(F.xxhash64("node", "shard", F.lit(turn)), F.lit(per)) == 0).select("shard", "vector").limit(most).collect()
        plan: dict[str, list] = {}
        for row in drawn:
            plan.setdefault(row["shard"], []).append(row["vector"])
        plan = {k: unit(np.array(v, dtype=np.float64)) for k, v in plan.items() if len(v) > 1}
        if plan:
            sent = reps.sparkSession.sparkContext.broadcast(plan)
            ready = now.where(F.col("shard").isin(*plan)).select(_MEMBER).mapInArrow(_deal(sent, least), schema)
            now = cut(ready.union(now.where(~F.col("shard").isin(*plan)).select(_MEMBER)))
        else:
            now = now.select(_MEMBER)
    return cut(done)


_EDGES = "node long, near array<struct<id: long, cos: float>>"


def _graph(table: pa.Table) -> pa.Table:
    """A shard's rows to their pruned lists of neighbours."""
    node = table.column("node").to_numpy()
    x = unit(matrices(table.column("vector").combine_chunks())[0][1]).astype(np.float32)
    sims = x @ x.T
    a, b = robust_prune(sims)
    ends = pa.StructArray.from_arrays([pa.array(node[b], pa.int64()), pa.array(sims[a, b], pa.float32())], names=["id", "cos"])
    offsets = np.append(0, np.cumsum(np.bincount(a, minlength=len(node))))
    return pa.table({"node": pa.array(node), "near": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ends)})


def _cosine_at_least(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have a cosine of ``least`` in double precision, some at a time."""
    parts = [_cosines(a[k : k + 65536], b[k : k + 65536]) >= least for k in range(0, len(a), 65536)]
    return np.concatenate([np.zeros(0, dtype=bool), *parts])


#: What a search gives: 0 a link (a < b), 1 a dense vector a, 2 a candidate b in another shard.
_FOUND = "kind int, a long, b long, ra long, rb long, wa long, wb long"


def _search(least: float):
    def run(table: pa.Table) -> pa.Table:
        node, rep, weight = (table.column(name).to_numpy() for name in ("node", "rep", "weight"))
        rows = matrices(table.column("vector").combine_chunks())[0][1]
        lists = table.column("near").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        begin = np.repeat(np.arange(len(node)), sizes)
        to, cos = flat.field("id").to_numpy(), flat.field("cos").to_numpy()
        order = np.argsort(node)
        place = order[np.minimum(np.searchsorted(node, to, sorter=order), len(node) - 1)]
        inside = node[place] == to
        x = unit(rows).astype(np.float32)
        close = max(1e-4, 2e-7 * x.shape[1])
        q, y, full = range_search(x, padded(len(node), begin[inside], place[inside]), least - close)
        sure = _cosine_at_least(rows[q], rows[y], least)
        q, y = q[sure], y[sure]
        # edges that leave the shard from a row in range, where the angles allow a link
        out_from, out_to, out_cos = begin[~inside], to[~inside], cos[~inside]
        count = np.bincount(out_from, minlength=len(node))
        first = np.cumsum(count) - count
        starts, via = np.concatenate([q, np.flatnonzero(~full)]), np.concatenate([y, np.flatnonzero(~full)])
        who = np.repeat(np.arange(len(starts)), count[via])
        edge = first[via[who]] + np.arange(len(who)) - np.repeat(np.cumsum(count[via]) - count[via], count[via])
        angle = lambda c: np.arccos(np.clip(c, -1, 1))
        reach = angle(least) + angle(np.einsum("kd,kd->k", x[starts], x[via])) + 1e-3
        could = angle(out_cos[edge]) <= reach[who]
        outer = np.unique(np.column_stack([node[starts[who[could]]], out_to[edge[could]]]), axis=0)
        low, high = np.where(node[q] < node[y], q, y), np.where(node[q] < node[y], y, q)
        pairs = np.unique(np.column_stack([low, high]), axis=0)
        low, high = pairs[:, 0], pairs[:, 1]
        dense = np.flatnonzero(full)
        none = np.zeros(len(dense) + len(outer), dtype=np.int64)
        return pa.table({
            "kind": pa.array(np.repeat([0, 1, 2], [len(low), len(dense), len(outer)]), pa.int32()),
            "a": np.concatenate([node[low], node[dense], outer[:, 0]]), "b": np.concatenate([node[high], node[dense], outer[:, 1]]),
            "ra": np.concatenate([rep[low], none]), "rb": np.concatenate([rep[high], none]),
            "wa": np.concatenate([weight[low], none]), "wb": np.concatenate([weight[high], none]),
        })

    return run


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), a < b, that are links, as rows of ``_FOUND``."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("rep").alias(f"r{x}"), F.col("weight").alias(f"w{x}"), F.col("vector").alias(f"v{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size("va") == F.size("vb")).select(F.lit(0).alias("kind"), "a", "b", "ra", "rb", "wa", "wb", "va", "vb")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            other = dict((len(rows[0]), rows) for _, rows in matrices(batch.column("vb")))
            for at, rows in matrices(batch.column("va")):
                keep[at] = _cosine_at_least(rows, other[rows.shape[1]], least)
            yield batch.select(["kind", "a", "b", "ra", "rb", "wa", "wb"]).filter(pa.array(keep))

    return met.mapInArrow(run, _FOUND)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def graph_links(members: DataFrame, classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, dense): links found by search, and the nodes whose search list filled up."""
    lists = cut(members.where("not hard").groupBy("shard").applyInArrow(_graph, _EDGES).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    ready = members.where("not hard").select("node", "rep", "shard", "weight", "vector").join(lists, "node")
    got = cut(ready.groupBy("shard").applyInArrow(_search(least), _FOUND))
    dense = cut(got.where("kind = 1").select(F.col("a").alias("node")).union(members.where("hard").select("node")).distinct())
    links = got.where("kind = 0").distinct()
    fresh = _ordered(got.where("kind = 2").select("a", "b")).join(links.select("a", "b"), ["a", "b"], "left_anti")
    new = cut(_verified(fresh, classes, least))
    while not new.isEmpty():  # each round follows links that cross shards by one edge more
        links = cut(links.union(new))
        both = new.select(F.col("a").alias("q"), F.col("b").alias("node")).union(new.select(F.col("b").alias("q"), F.col("a").alias("node")))
        step = both.join(dense.withColumnRenamed("node", "q"), "q", "left_anti").join(lists, "node").select("q", F.explode("near").alias("e"))
        step = step.where(F.col("e.cos") >= float(np.cos(min(np.pi, 2 * np.arccos(least) + 1e-3)))).select(F.col("q").alias("a"), F.col("e.id").alias("b"))
        new = cut(_verified(_ordered(step).join(links.select("a", "b"), ["a", "b"], "left_anti"), classes, least))
    return links, dense


def audited(classes: DataFrame, links: DataFrame, dense: DataFrame, least: float, widest: int) -> DataFrame:
    """The links (a, b) that the search lost, of at most AUDIT vectors that aren't dense, drawn by
    hash: these are compared with all others, a linear amount of work. Their bytes are bounded."""
    most = max(1, min(AUDIT, AUDIT_BYTES // (8 * widest)))
    sparse = classes.join(dense, "node", "left_anti")
    drawn = sparse.orderBy(F.xxhash64("node"), "node").select("node", "label", "vector").limit(most).collect()
    asked: dict[str, tuple] = {}
    for label in sorted({r["label"] for r in drawn}):
        own = [r for r in drawn if r["label"] == label]
        asked[label] = (np.array([r["node"] for r in own]), np.array([r["vector"] for r in own], dtype=np.float64))
    sent = classes.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for batch in batches:
            labels, node = np.array(batch.column("label").to_pylist(), dtype=object), batch.column("node").to_numpy()
            for at, rows in matrices(batch.column("vector")):
                for label in np.unique(labels[at].astype(str)):
                    if label in sent.value:
                        own = labels[at] == label
                        q, x = sent.value[label]
                        for i, j in tile_links(x, rows[own], least):
                            yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(node[at[own]][j])], names=["a", "b"])

    true = _ordered(classes.select("node", "label", "vector").mapInArrow(run, "a long, b long"))
    return true.join(links.select("a", "b"), ["a", "b"], "left_anti")


def _pack(table: pa.Table) -> pa.Table:
    """A shard's rows to one row: its vectors, mean direction and radius."""
    rows = matrices(table.column("vector").combine_chunks())[0][1]
    x = unit(rows)
    center = x.mean(axis=0)
    length = np.sqrt((center**2).sum())
    center = center / length if length > 1e-9 else x[0]
    radius = float(np.arccos(np.clip(x @ center, -1, 1)).max())
    short = rows.astype(np.float32)
    whole = short if (short == rows).all() else rows
    one = {
        "label": table.column("label")[:1], "shard": table.column("shard")[:1], "center": pa.array([center.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]),
        "nodes": pa.array([table.column("node").to_numpy().tobytes()]), "reps": pa.array([table.column("rep").to_numpy().tobytes()]),
        "weights": pa.array([table.column("weight").to_numpy().tobytes()]), "vectors": pa.array([whole.tobytes()]),
    }
    return pa.table(one)


_BLOCK = "label string, shard string, center array<double>, radius double, nodes binary, reps binary, weights binary, vectors binary"


def tile_links(a: np.ndarray, b: np.ndarray | None, least: float):
    """Pairs (rows of a, rows of b) with a cosine of ``least`` or more, some rows of a at a
    time; without b the pairs i < j of a."""
    x = unit(a).astype(np.float32)
    y = x if b is None else unit(b).astype(np.float32)
    other = a if b is None else b
    close = max(1e-4, 2e-7 * a.shape[1])
    for k in range(0, len(x), STEP):
        sims = x[k : k + STEP] @ y.T
        i, j = np.nonzero(sims >= least - close)
        if b is None:
            i, j = i[i + k < j], j[i + k < j]
        doubt = np.flatnonzero(sims[i, j] < least + close)
        sure = np.ones(len(i), dtype=bool)
        for m in range(0, len(doubt), 65536):
            at = doubt[m : m + 65536]
            sure[at] = _cosines(a[k + i[at]], other[j[at]]) >= least
        yield k + i[sure], j[sure]


def _tile(least: float):
    def run(table: pa.Table) -> pa.Table:
        """One or two blocks to (node, rep, links, root) of their linked rows."""
        read = lambda name: [np.frombuffer(v.as_py(), dtype=np.int64) for v in table.column(name)]
        nodes, reps, weights = read("nodes"), read("reps"), read("weights")
        rows = []
        for v, c, own in zip(table.column("vectors"), table.column("center"), nodes):
            raw, dim = v.as_py(), len(c)
            rows.append(np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * dim * len(own) else np.float64).reshape(-1, dim).astype(np.float64))
        two = len(rows) == 2
        shift = len(nodes[0]) if two else 0
        node, rep, weight = (np.concatenate(x) for x in (nodes, reps, weights))
        links, root = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for i, j in tile_links(rows[0], rows[1] if two else None, least):
            j = j + shift
            links += np.bincount(i, weights=weight[j], minlength=len(node)).astype(np.int64) + np.bincount(j, weights=weight[i], minlength=len(node)).astype(np.int64)
            #: What the strips before have joined goes in as one link a row.
            old = np.flatnonzero(root != np.arange(len(node)))
            root = _roots(len(node), np.concatenate([i, old]), np.concatenate([j, root[old]]))
        at = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[at]), "rep": pa.array(rep[at]), "links": pa.array(links[at]), "root": pa.array(rep[root[at]])})

    return run


def block_pairs(blocks: DataFrame, least: float) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks of a label that can hold a link."""
    head = blocks.select("label", "shard", "center", "radius")
    left = head.select("label", F.pmod(F.xxhash64("shard"), F.lit(SPREAD)).alias("part"), F.col("shard").alias("a"), F.col("center").alias("ac"), F.col("radius").alias("ar"))
    right = head.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"), F.col("shard").alias("b"), F.col("center").alias("bc"), F.col("radius").alias("br"))
    cosine = F.aggregate(F.zip_with("ac", "bc", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    reach = F.col("ar") + F.col("br") + F.lit(float(np.arccos(least)) + 1e-6)
    return left.join(right, ["label", "part"]).where((F.col("a") <= F.col("b")) & ((F.col("a") == F.col("b")) | (angle <= reach))).select("a", "b")


def vector_duplicates(
    vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows of the same label (not null) link at a cosine, in double precision, of ``least``
    or more. Equal vectors are one node with their number as weight; n_links counts the
    other rows linked. Links of dense vectors are all found; others as the graph's search
    finds them, and ``audit_recall`` compares with all pairs.

    Defined results: vectors that are null, empty, zero or hold null or non-finite
    components, and rows without a label or id, link with nothing and are kept (their
    component_id is their own id); vectors of other dimensions are like other labels; rows that
    repeat an id are vectors of their own for n_links and one node for components; other
    columns are ignored; an empty table gives an empty result.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are exact as they are
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    part = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")), F.lit(False))
    rows = rows.withColumn("label", F.when(part, F.concat_ws(":", "label", F.size("vector"))))
    able = rows.where("label is not null")
    folded = able.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = cut(folded.withColumn("node", F.monotonically_increasing_id()))
    widest = classes.agg(F.max(F.size("vector"))).head()[0] or 1
    reps = classes.select("*", F.col("label").alias("shard"), F.lit(True).alias("home"), F.lit(False).alias("hard"))
    members = shards_of(reps, least, widest)
    links, full = graph_links(members, classes, least)
    lost = cut(audited(classes, links, full, least, widest))
    homes = members.where("home")
    ends = lost.select(F.col("a").alias("node")).union(lost.select(F.col("b").alias("node"))).distinct()
    worse = homes.join(homes.join(ends, "node").select("shard").distinct(), "shard").select("node")
    dense = cut(full.union(worse).distinct())
    # links of two dense vectors come from tiles, all others from the search of the other one
    a, b = (dense.select(F.col("node").alias(x), F.lit(True).alias(f"dense_{x}")) for x in "ab")
    kept = links.join(a, "a", "left").join(b, "b", "left").where("dense_a is null or dense_b is null")
    one = lambda x, y: kept.select(F.col(x).alias("node"), F.col(f"r{x}").alias("rep"), F.col(f"w{y}").alias("links"), F.col(f"r{y}").alias("root"))
    blocks = cut(homes.join(dense, "node").groupBy("shard").applyInArrow(_pack, _BLOCK))
    pairs = block_pairs(blocks, least)
    sides = pairs.select("a", "b", F.col("a").alias("shard")).union(pairs.where("a != b").select("a", "b", F.col("b").alias("shard")))
    met = blocks.join(sides, "shard").select("a", "b", "center", "nodes", "reps", "weights", "vectors")
    tiled = met.groupBy("a", "b").applyInArrow(_tile(least), "node long, rep long, links long, root long")
    found = cut(one("a", "b").union(one("b", "a")).union(tiled))
    near = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a != b"), "a", "b")
    by_class = classes.select("label", "vector", "rep", "weight", "node")
    placed = rows.join(by_class, ["label", "vector"], "left").select("id", "rep", "weight", "node")
    one = placed.join(near, "node", "left").join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return one.select(
        F.col("id").alias("vec_id"),
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def audit_recall(vectors: DataFrame, found: DataFrame, least: float = 0.93, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links that ``found`` counts and links that there are, for the rows whose id is
    divisible by ``every`` (a stated query set against all rows): n_found, n_true, recall."""
    ok = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    side = lambda x: ok.select(F.col(id_col).alias(f"{x}_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias(f"{x}_vector"))

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(x) == len(y) and bool(_cosines(np.array([x]), np.array([y]))[0] >= least) for x, y in zip(a, b)])

    asked = side("q").where(F.col("q_id") % every == 0)
    true = asked.join(side("c"), "label").where("q_id != c_id").where(linked("q_vector", "c_vector")).agg(F.count("*").alias("n_true"))
    got = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links").alias("n_found"))
    return got.crossJoin(true).select("n_found", "n_true", (F.col("n_found") / F.col("n_true")).alias("recall"))
