"""Exact nearest neighbours by a block matrix join with int8 tiles.

Candidates and queries are packed into blocks of codes, and each pair of blocks is one
tile. A vector x is coded as s * q with q in int8; the length r of what the code leaves
out is kept. A tile's products of codes (exact integers) give the distance of the coded
vectors, which is off by r(x) + r(y) at most. Candidates whose least possible distance is
above the k-th smallest greatest possible one can't be among the k nearest. Only codes move
to the tiles; the vectors of the few pairs that are left are fetched afterwards, computed
anew in double precision, and each task's heaps of the k best are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import blocks_for, cut
from tallyforge.llm.vectors import matrices, usable

#: Vectors in a block of candidates and of queries; blocks of candidates that a task meets in turn.
CANDIDATES, QUERIES, TURN = 4096, 512, 8


def coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, squared lengths of what they stand for, lengths of the rest."""
    scale = np.abs(rows).max(axis=1) / 127
    code = np.rint(rows / scale[:, None]).astype(np.int8)
    stands = code * scale[:, None]
    return code, scale, (stands**2).sum(axis=1), np.sqrt(((rows - stands) ** 2).sum(axis=1))


_BLOCK = "dim int, ids binary, rows binary, codes binary, about binary"


def _pack(most: int):
    """Rows (id, row, vector) to blocks of codes of ``most`` vectors at most."""

    def run(batches):
        held: dict[int, list] = {}

        def block(dim):
            ids, rows, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            code, *about = coded(vectors)
            for k in range(0, len(ids), most):
                at = slice(k, k + most)
                own = [dim, ids[at].tobytes(), rows[at].tobytes(), np.ascontiguousarray(code[at]).tobytes(), np.array([x[at] for x in about]).tobytes()]
                kinds = (pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, kinds)], names=["dim", "ids", "rows", "codes", "about"])

        for batch in batches:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            for at, vectors in matrices(batch.column("vector")):
                dim = vectors.shape[1]
                held.setdefault(dim, []).append((ids[at], rows[at], vectors))
                if sum(len(x) for x, _, _ in held[dim]) >= most:
                    yield from block(dim)
        for dim in [*held]:
            yield from block(dim)

    return run


def bounds(q, c) -> tuple[np.ndarray, np.ndarray]:
    """[queries, candidates]: least and greatest possible distance, from (code, scale, square, rest)."""
    #: Sums of products of int8 are exact in float32 up to 1,040 components, then in float64.
    kind = np.float32 if q[0].shape[1] <= 1000 else np.float64
    product = (q[0].astype(kind) @ c[0].astype(kind).T).astype(np.float64)
    near = np.sqrt(np.maximum(0, q[2][:, None] + c[2] - 2 * q[1][:, None] * c[1] * product))
    slack = (q[3][:, None] + c[3]) * (1 + 1e-9) + 1e-7 * np.sqrt(q[2][:, None] + c[2])
    return near - slack, near + slack


def _read(row, side: str):
    whole = lambda name: np.frombuffer(row[f"{side}_{name}"], dtype=np.int64)
    about = np.frombuffer(row[f"{side}_about"]).reshape(3, -1)
    return whole("ids"), whole("rows"), (np.frombuffer(row[f"{side}_codes"], dtype=np.int8).reshape(-1, row["dim"]), *about)


def _tiles(k: int):
    """Tiles to pairs (q_row, c_row, low, high) that may count. Tiles of one block of queries
    that follow each other share the bound: the k-th smallest greatest distance so far."""

    def run(batches):
        now, best, rows, kept = None, None, None, []

        def done():
            if not kept:
                return
            own, c_row, low, high = (np.concatenate(x) for x in zip(*kept))
            stay = low <= best[own, -1]
            columns = (rows[own[stay]], c_row[stay], low[stay], high[stay])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["q_row", "c_row", "low", "high"])

        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q_rows, q = _read(row, "q")
                c_ids, c_rows, c = _read(row, "c")
                if row["q"] != now:
                    yield from done()
                    now, best, rows, kept = row["q"], np.full((len(q_ids), k), np.inf), q_rows, []
                low, high = bounds(q, c)
                same = q_ids[:, None] == c_ids
                low[same] = high[same] = np.inf
                first = np.partition(high, min(k, high.shape[1]) - 1, axis=1)[:, :k]
                best = np.sort(np.concatenate([best, first], axis=1), axis=1)[:, :k]
                own, at = np.nonzero((low <= best[:, -1:]) & np.isfinite(low))
                kept.append((own, c_rows[at], low[own, at], high[own, at]))
        yield from done()

    return run


def _heaps(k: int):
    """(query_id, q_row, vec_id, score) to the k best of each query within the task."""

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for q_id, q_row, c_id, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "q_row", "vec_id", "score"))):
                heap, item = held.setdefault((q_id, q_row), []), (-score, -c_id)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        rows = [(q_id, q_row, -c, -s) for (q_id, q_row), heap in held.items() for s, c in heap]
        columns = [*zip(*rows)] or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["query_id", "q_row", "vec_id", "score"])

    return run


def _numbered(rows: DataFrame) -> DataFrame:
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Blocks of codes, nearly all full: a task gets several blocks' worth of rows."""
    spread = rows.select("id", "row", "vector").repartition(blocks_for(rows.count(), 4 * most))
    return cut(spread.mapInArrow(_pack(most), _BLOCK).withColumn(name, F.monotonically_increasing_id()))


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest others of each row for which the
    condition ``is_query`` holds, by Euclidean distance, ties to the smaller id.

    Every query block meets every candidate block of its dimension, as the search asks. Of
    equal vectors only the k + 1 smallest ids can be among any k nearest, so the others are
    no candidates and a vector with any number of copies stays a few rows.

    Defined results: vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null id, take no part; vectors of other dimensions are no
    candidates; rows that repeat an id and a vector count once, rows that share the
    query's id are no candidates of it; different query vectors of one id are ranked together;
    other columns are ignored; too few candidates give that many rows; an empty table gives
    an empty result.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")]
    asked = _numbered(rows.where(is_query).select(*pick).distinct())
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    once = _numbered(rows.select(*pick).distinct().withColumn("n", smallest).where(F.col("n") <= k + 1).drop("n"))
    candidates, queries = _blocks(once, CANDIDATES, "c"), _blocks(asked, QUERIES, "q")
    #: Block numbers only; the blocks of codes move once for each tile they are in.
    turns = blocks_for(candidates.count(), TURN)
    tiles = candidates.select("dim", "c").join(queries.select("dim", "q"), "dim").select("c", "q", F.pmod(F.xxhash64("c"), F.lit(turns)).alias("turn"))
    of = lambda df, x: df.select(x, *(["dim"] if x == "c" else []), *(F.col(n).alias(f"{x}_{n}") for n in ("ids", "rows", "codes", "about")))
    whole = tiles.join(of(candidates, "c"), "c").join(of(queries, "q"), "q")
    whole = whole.repartition("q", "turn").sortWithinPartitions("q", "c")
    found = cut(whole.mapInArrow(_tiles(k), "q_row long, c_row long, low double, high double"))

    by_high = F.row_number().over(Window.partitionBy("q_row").orderBy("high"))
    last = found.select("q_row", "high").withColumn("n", by_high).where(F.col("n") <= k).where(F.col("n") == k).select("q_row", F.col("high").alias("bound"))
    left = found.join(last, "q_row", "left").where(F.col("low") <= F.coalesce("bound", F.lit(float("inf"))))
    one = left.select("q_row", "c_row").join(asked.select(F.col("row").alias("q_row"), F.col("id").alias("query_id"), F.col("vector").alias("q_vector")), "q_row")
    two = one.join(once.select(F.col("row").alias("c_row"), F.col("id").alias("vec_id"), F.col("vector").alias("c_vector")), "c_row")
    apart = F.zip_with("q_vector", "c_vector", lambda x, y: (x - y) * (x - y))
    exact = two.select("query_id", "q_row", "vec_id", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda x, y: x + y)).alias("score"))
    heaps = exact.mapInArrow(_heaps(k), "query_id long, q_row long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id", "q_row")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
