"""WARC archives, vectors, components, and the registered queries."""

import base64
import gzip
import hashlib
import math
import random

import numpy as np
import pytest

from tallyforge.llm import block_knn, graph_dedup
from tallyforge.llm.block_knn import nearest
from tallyforge.llm.common import components
from tallyforge.llm.graph_dedup import audit_recall, vector_duplicates
from tallyforge.llm.warc import read_warc, write_warc
from pyspark.sql import functions as F


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in root)


PAGES = [
    (3, "http://a/1", "<p>same</p>"),
    (1, "http://a/2", "<p>same</p>"),
    (2, "http://b/3", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n"),
    (4, None, None),
    (5, "http://b/ 5\nx", ""),
    (None, "http://c", "<p>same</p>"),
    (7, "http://d", "x" * 3_000_000),
    (8, "http://d", "x" * 3_000_000),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "files")
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")
    write_warc(pages.repartition(3), folder)
    return folder


def test_warc_round_trip(spark, archive):
    got = {r.page_id: r for r in read_warc(spark, archive).collect()}
    assert len(got) == len(PAGES)
    for i, url, html in PAGES:
        body = (html or "").encode()
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and got[i].payload_bytes == len(body)
        if got[i].record_type == "response":
            assert bytes(got[i].payload) == body
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 1, None: 1, 5: 4, 8: 7}
    assert got[5].target_uri == "http://b/ 5 x" and got[4].target_uri is None and got[2].headers["warc-type"] == "response"


def test_warc_pushdown(spark, archive):
    some = read_warc(spark, archive).where("record_type = 'response' and target_uri like 'http://b%' and page_id in (2, 5)")
    assert "PythonScan" in some._jdf.queryExecution().toString() or "BatchScan" in some._jdf.queryExecution().toString()
    assert [r.page_id for r in some.select("page_id").collect()] == [2]
    assert read_warc(spark, archive, payloads=False).where("payload is not null").count() == 0
    assert read_warc(spark, archive).where("target_uri is null").count() == 1


def test_warc_ranges_and_foreign_archives(spark, archive, tmp_path):
    small = spark.read.format("warc").option("rangeBytes", "700").load(archive)
    assert small.count() == len(PAGES)
    records = b"".join(
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: u%d\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(b), b)
        for k, b in enumerate([b"one", b"WARC/1.0\r\n\r\n", b"z" * 5000])
    )
    (tmp_path / "plain.warc").write_bytes(records)
    parts = records.split(b"\r\n\r\nWARC/1.0\r\nWARC-Type")
    (tmp_path / "other.warc.gz").write_bytes(b"".join(gzip.compress((b"WARC/1.0\r\nWARC-Type" if k else b"") + x + b"\r\n\r\n") for k, x in enumerate(parts)))
    got = read_warc(spark, str(tmp_path)).where("record_type = 'resource'").collect()
    assert sorted((r.target_uri, len(r.payload)) for r in got) == sorted([("u0", 3), ("u1", 12), ("u2", 5000)] * 2)


def test_warc_members_of_several_records_are_an_error(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(one + one))
    with pytest.raises(Exception, match="more than one record"):
        read_warc(spark, str(tmp_path)).count()


def test_warc_overwrite_and_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    write_warc(empty, str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0
    one = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    for _ in range(2):
        write_warc(one, str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 1
    with pytest.raises(Exception, match="missing"):
        read_warc(spark, str(tmp_path / "missing")).count()


def vectors(spark, seed=2, groups=6, size=150):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for _ in range(12):
            center = rng.normal(size=16)
            rows += [(center + rng.normal(size=16) * 0.12, g) for _ in range(size // 12)]
    rows = [(k, [float(np.float32(x)) for x in v], g) for k, (v, g) in enumerate(rows)]
    copies = [(5000 + k, rows[7][1], rows[7][2]) for k in range(60)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [math.nan] + [1.0] * 15, 1), (9003, rows[0][1], None), (9004, [], 1), (9005, [1.0, 2.0], 1), (9006, [None] + [1.0] * 15, 1), (9007, [2 * x for x in rows[3][1]], rows[3][2]), (None, rows[0][1], 0)]
    return spark.createDataFrame([(*r, 0) for r in rows + copies + odd], "vec_id long, embedding array<float>, label int, id int")


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("shard", [1500, 100])
def test_vector_duplicates(spark, monkeypatch, shard):
    monkeypatch.setattr(graph_dedup, "SHARD", shard)
    monkeypatch.setattr(graph_dedup, "PER_CENTROID", 40)
    df = vectors(spark)
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    able = [r for r in rows if fine(r[1]) and r[2] is not None and r[0] is not None and len(r[1]) == 16]
    x = np.array([r[1] for r in able], dtype=np.float64)
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    link = (x @ x.T >= 0.93) & (np.array([r[2] for r in able])[:, None] == np.array([r[2] for r in able]))
    np.fill_diagonal(link, False)
    root = np.arange(len(able))
    for _ in range(100):
        root = np.array([min(root[k], root[link[k]].min(initial=k)) for k in range(len(able))])
    want = {r[0]: (int(link[k].sum()), able[root[k]][0]) for k, r in enumerate(able)}
    found = vector_duplicates(df).cache()
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r[0] not in want:
            assert got[r[0]] == (0, r[0])
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert {i: got[i] for i in want} == want
    audit = audit_recall(df, found, every=10).head()
    assert audit.recall > 0.95
    assert vector_duplicates(df.limit(0)).count() == 0


def dense_groups(spark, n=700):
    """A group of different vectors that nearly all link, and as many that stand alone."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=24) + rng.normal(size=(n, 24)) * 0.25, rng.normal(size=(n, 24))])
    rows = [(k, [float(np.float32(c)) for c in v], 1) for k, v in enumerate(x)]
    y = np.array([r[1] for r in rows])
    y /= np.sqrt((y**2).sum(axis=1, keepdims=True))
    link = y @ y.T >= 0.93
    np.fill_diagonal(link, False)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), link.sum(axis=1).tolist()


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1)]
    got = vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_dense_group_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD", 200)
    monkeypatch.setattr(graph_dedup, "PER_CENTROID", 50)
    df, want = dense_groups(spark)
    assert sum(want) > 100_000
    assert [r.n_links for r in vector_duplicates(df).orderBy("vec_id").collect()] == want


def test_later_rounds_keep_all_links(spark, monkeypatch):
    for name, value in (("SHARD", 60), ("PER_CENTROID", 20), ("CENTROID_BYTES", 4 * 8 * 24)):
        monkeypatch.setattr(graph_dedup, name, value)
    df, want = dense_groups(spark, 300)
    assert [r.n_links for r in vector_duplicates(df).orderBy("vec_id").collect()] == want


def test_one_dense_group_and_even_spread(spark, monkeypatch):
    rng = np.random.default_rng(4)
    clique = rng.normal(size=24) + rng.normal(size=(4000, 24)) * 0.05
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(clique)], "vec_id long, embedding array<double>, label int")
    assert vector_duplicates(df).agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).head()[:] == (3999, 3999, 0)
    even = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rng.normal(size=(3000, 24)))], "vec_id long, embedding array<double>, label int")
    tiles, inner = spark.sparkContext.accumulator(0), graph_dedup._tile

    def tile(least):
        run = inner(least)

        def counted(table):
            tiles.add(1)
            return run(table)

        return counted

    monkeypatch.setattr(graph_dedup, "_tile", tile)
    assert vector_duplicates(even).agg(F.max("n_links")).head()[0] == 0 and tiles.value == 0


def test_shards_without_centroids_are_divided(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD", 200)
    monkeypatch.setattr(graph_dedup, "PER_CENTROID", 10**9)
    df, want = dense_groups(spark)
    met, inner = spark.sparkContext.accumulator(0), graph_dedup._pack

    def pack(table):
        met.add(int(table.num_rows > 200))
        return inner(table)

    monkeypatch.setattr(graph_dedup, "_pack", pack)
    assert [r.n_links for r in vector_duplicates(df).orderBy("vec_id").collect()] == want and met.value == 0


def test_nearest(spark):
    df = vectors(spark)
    rows = [tuple(r) for r in df.select("vec_id", "embedding").distinct().collect() if fine(r[1]) and r[0] is not None]
    twice = df.union(df.where("vec_id < 20"))
    got = {}
    for r in nearest(twice, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i, v in rows:
        if i % 50 == 0:
            near = []
            for j, w in rows:
                if j != i and len(w) == len(v):
                    total = 0.0
                    for a, b in zip(v, w):
                        total += (a - b) ** 2
                    near.append((math.sqrt(total), j))
            assert sorted(got[i]) == [(k + 1, j, d) for k, (d, j) in enumerate(sorted(near)[:10])]
    few = df.where("vec_id in (0, 1, 2, 9005)")
    assert nearest(few, F.col("vec_id") == 0).count() == 2 and nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_with_many_copies(spark):
    rows = [(0, [1.0, 0.0])] + [(5, [1.0, 1.0])] * 12 + [(6, [1.0, 2.0]), (7, [1.0, 3.0]), (8, [1.0, 4.0])] + [(9, [1.0, 5.0]), (9, [1.0, -5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df.repartition(3), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 5, 1.0), (2, 6, 2.0), (3, 7, 3.0)]
    got = nearest(df, F.col("vec_id") == 0, k=9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 6, 7, 8, 9, 9]  # different vectors of one id are rows of their own


def test_nearest_ties_at_the_last_rank(spark, monkeypatch):
    """Sixty candidates at one distance over several blocks: the smallest ids count."""
    monkeypatch.setattr(block_knn, "CANDIDATES", 8)
    monkeypatch.setattr(block_knn, "TURN", 2)
    ring = [[math.cos(t), math.sin(t)] for t in range(60)]
    rows = [(0, [2.0, 0.0], 1)] + [(100 - k, [3.0, 0.0], 1) for k in range(60)] + [(200 + k, [2.0 + a, b], 1) for k, (a, b) in enumerate(ring)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int").repartition(5)
    got = [r.vec_id for r in nearest(df, F.col("vec_id") == 0, k=10).orderBy("rank").collect()]
    exact = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(v, [2.0, 0.0]))), i) for i, v, _ in rows if i)
    assert got == [i for _, i in exact[:10]]


def test_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{k}" for k in range(1, 11)} <= {n.partition("_")[0] for n in names} and "pipeline" in names


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, held = held, stage(spark, held, sf).cache()
        assert held.columns == docs.columns
        ids = {r.doc_id for r in before.collect()}
        left = {r.doc_id for r in held.collect()}
        assert left <= ids
        if name in ("toxicity", "near_dedup"):
            assert len(left) > 0.75 * len(ids)
        if name == "personal_data":
            assert left == ids and not held.where("text rlike '[a-z]@[a-z0-9]+[.]example'").count()
    last = corpus_pipeline.STAGES[-1][1](spark, held, sf)
    assert last.count() == held.count() and last.where("size(ids) != n_tokens").count() == 0
