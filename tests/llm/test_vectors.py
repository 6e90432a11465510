"""Operators on vectors: against their SQL on awkward tables, and their pruning against full scans."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rolecall.llm import centroid_clusters, topk_search, vector_codes, vectors

OPERATORS = {
    "op11": (vector_codes.op11_vector_codes, vector_codes.ORACLE),
    "op12": (centroid_clusters.op12_centroid_clusters, centroid_clusters.ORACLE),
    "op13": (topk_search.op13_topk_search, topk_search.ORACLE),
}


def table(ids, rows, labels=None, **more):
    labels = labels or [i % 3 for i in range(len(ids))]
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())),
                     "label": pa.array(labels, pa.int32()), **more})


def usual(n=400, seed=1, spread=0.3):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 0.5, (7, 64))
    return (centres[random.integers(0, 7, n)] + random.normal(0, spread, (n, 64))).astype("f4").tolist()


def awkward():
    rows = usual()
    ids = list(range(400))
    ids[7], ids[8], ids[9], ids[300] = 6, 6, None, None  # repeated and missing ids
    labels = [i % 4 if i % 5 else None for i in range(400)]
    rows[3], rows[4][5], rows[5][0], rows[10][63], rows[350] = None, None, float("nan"), float("inf"), None
    rows[50] = rows[100] = rows[150] = rows[51]  # queries and others that tie
    rows[60:120] = [rows[60]] * 60               # one vector that a sixth of all rows hold
    rows[200] = [0.0] * 64
    ids += [20, 20, 50]                          # repeated rows
    rows += [rows[20], rows[20], rows[50]]
    labels += [labels[20], labels[20], labels[50]]
    return table(ids, rows, labels)


TABLES = {
    "awkward": awkward,
    "clashing columns": lambda: table(
        list(range(90)), usual(90), row=pa.array(range(90)), code=pa.array(["x"] * 90), v=pa.array([None] * 90),
        _label=pa.array(["y"] * 90), distance=pa.array([0.5] * 90), near=pa.array(range(90))),
    "few rows": lambda: table([50, 3, 100], usual(3)),
    "one row": lambda: table([50], usual(1)),
    "no label, no id": lambda: table([None] * 5, usual(5), [None] * 5),
    "nothing usable": lambda: table([1, 50], [None, [float("nan")] * 64]),
    "empty": lambda: table([], []),
}


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("op", OPERATORS)
def test_against_sql(spark, tmp_path, op, name):
    query, sql = OPERATORS[op]
    pq.write_table(TABLES[name](), f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = base.execute(sql)
    columns = [c[0] for c in want.description]
    got = query(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_other_lengths(spark, tmp_path):
    rows = usual(60)
    rows[50], rows[7], rows[8], rows[9] = [], [], [1.0, 2.0], [0.5] * 70
    pq.write_table(table(list(range(60)), rows), f"{tmp_path}/embeddings.parquet")
    left = set(range(60)) - {7, 8, 9, 50}
    for op in ("op11", "op12"):
        assert {r.vec_id for r in OPERATORS[op][0](spark, str(tmp_path)).collect()} == left
    found = OPERATORS["op13"][0](spark, str(tmp_path)).collect()
    assert [(r.vec_id, r.score) for r in found if r.query_id == 50] == [(7, 0)]
    assert {r.vec_id for r in found if r.query_id == 0} <= left


def test_very_large_components(spark, tmp_path):
    rows = usual(60)
    rows[0][0], rows[1][0] = 3e38, -3e38
    pq.write_table(table(list(range(60)), rows), f"{tmp_path}/embeddings.parquet")
    for query, _ in OPERATORS.values():
        assert query(spark, str(tmp_path)).count() in (60, 10)
    best = OPERATORS["op13"][0](spark, str(tmp_path)).where("query_id = 0 AND rank = 1").first()
    held = np.floor(np.array(rows, "f8") * 256).clip(-vectors.LIMIT, vectors.LIMIT).astype(object)
    scores = held[1:] @ held[0]
    assert (best.vec_id, best.score) == (1 + int(np.argmax(scores)), max(scores))


def test_empty_table_types(spark, tmp_path):
    pq.write_table(table([], []), f"{tmp_path}/embeddings.parquet")
    for (query, _), kinds in zip(OPERATORS.values(), (
            "vec_id bigint code string error bigint label_error bigint codebooks_sha256 string",
            "vec_id bigint cluster int distance bigint cluster_inertia bigint inertia bigint centroid_sha256 string",
            "query_id bigint rank int vec_id bigint score bigint")):
        assert " ".join(f"{n} {t}" for n, t in query(spark, str(tmp_path)).dtypes) == kinds


def test_pivots_find_the_nearest_entry_with_fewer_evaluations():
    random = np.random.default_rng(5)
    for spread, most in ((600, 1.0), (20, 0.35)):
        centres = random.integers(-2000, 2000, (40, 16))
        book = centres[random.integers(0, 40, 256)] + random.integers(-spread, spread, (256, 16))
        book[77] = book[200]  # equal entries: the lower index
        part = np.concatenate([centres[random.integers(0, 40, 900)] + random.integers(-spread, spread, (900, 16)),
                               np.repeat(book[[200]], 9, 0), book[:50]])
        pivots = vector_codes.choose_pivots(book, 12)
        entry, best, made = vector_codes.nearest(
            part, vector_codes.distances(part, pivots).astype("f4"), book,
            vector_codes.distances(book, pivots).astype("f4"))
        full = ((part[:, None, :] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (best == full.min(1)).all()
        assert made <= most * full.size


def test_heaps_leave_most_vectors_alone_once_centroids_rest():
    random = np.random.default_rng(6)
    centres = random.integers(-500, 500, (8, 16))
    v = centres[random.integers(0, 8, 3000)] + random.integers(-60, 60, (3000, 16))
    at = centroid_clusters.Centroids(v[:8].copy(), [0] * 8)
    cluster, heaps, scans = np.full(3000, -1), [[] for _ in range(8)], []
    scan = centroid_clusters.Centroids.scan
    for _ in range(8):
        counted = []
        at.scan = lambda rows, at=at: counted.append(len(rows)) or scan(at, rows)
        centroid_clusters.rescan(v, cluster, heaps, at)
        full = ((v[:, None] - at.points[None]) ** 2).sum(2)
        assert (cluster == full.argmin(1)).all()
        assert sorted(e & (1 << centroid_clusters.PLACE) - 1 for h in heaps for e in h) == list(range(3000))
        scans.append(sum(counted))
        at = at.moved(np.array([v[cluster == c].sum(0) // max((cluster == c).sum(), 1) if (cluster == c).any()
                                else at.points[c] for c in range(8)]))
    assert scans[0] == 3000 and scans[-1] < 300


def test_blocks_below_the_threshold_are_not_scored():
    random = np.random.default_rng(7)
    centres = random.integers(-200, 200, (30, 64))
    v = centres[random.integers(0, 30, 4000)] + random.integers(-15, 15, (4000, 64))
    order = topk_search.Chunk.near_together(v)
    chunk = topk_search.Chunk(np.arange(4000)[order], np.arange(4000)[order] * 2, v[order])
    queries = np.arange(0, 4000, 50)
    best = topk_search.Best(v[queries], queries, np.full(len(queries), topk_search.LEAST), 5)
    made = best.search(chunk)
    scores = v[queries] @ v.T
    scores[np.arange(len(queries)), queries] = -1 << 60
    want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert (best.ids == want * 2).all() and (best.scores == np.take_along_axis(scores, want, 1)).all()
    assert made < 0.3 * scores.size


def test_several_sets_of_queries_and_chunks(spark, rows, monkeypatch):
    v = usual(300, seed=9)
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>").repartition(6)
    whole = topk_search.top_products(df, k=3, every=7).collect()
    several = topk_search.top_products(df, k=3, every=7, set_size=600).collect()
    assert sorted(whole) == sorted(several) and len(whole) == 3 * 43
