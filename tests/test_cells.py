"""Vector search over cells against full products."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuscle.operators import cells as C
from corpuscle.operators import index as I

VECTORS = "chunk_id int, embedding array<double>, tenant string"


def clustered(rng, n=600, groups=12, dim=8):
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, 0.03) for x in middle[i % groups]], "a" if i % 3 else "b") for i in range(n)]


def plain(unit, queries, k):
    out = {}
    for q, x in queries.items():
        order = sorted(unit, key=lambda j: (-round(float(np.dot(x, unit[j])), 6), j))[:k]
        out |= {(q, n + 1): j for n, j in enumerate(order)}
    return out


def test_rows_equal_full_products_and_few_cells_are_visited(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 20)  # crowded cells lie in several parts
    rows = clustered(random.Random(5)) + [(10_000 + i, [0.0] * 8, "a") for i in range(3)] + [(20_000 + i, [1.0] + [0.0] * 7, "a") for i in range(90)]
    v = I.unit_vectors(spark.createDataFrame(rows, VECTORS))
    unit = {r.chunk_id: np.array(r.embedding) for r in v.collect()}
    cells = C.build(v, "chunk_id", cells=24)
    q = v.where("chunk_id < 30").select(F.col("chunk_id").alias("query_id"), "embedding")
    for k in (1, 5, 200):
        got = {(r.query_id, r.rank): r.chunk_id for r in C.top_k(q, cells, k).collect()}
        assert got == plain(unit, {i: unit[i] for i in range(30)}, k)
    asked = q.select("query_id", F.col("embedding").alias("_q"))
    floor = C.top_k(q, cells, 5).where("rank = 5").select("query_id", F.col("score").alias("floor"))
    first = C.visits(asked, cells, 5, "query_id").select("query_id", "cell").distinct().count()
    later = C.visits(asked.join(floor, "query_id"), cells, 5, "query_id", floors=True).select("query_id", "cell").distinct().count()
    assert first + later < 30 * len(cells.centres) / 3
    assert int(cells.sizes.sum()) == len(rows) and cells.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 90


def test_a_filter_keeps_the_search_exact(spark):
    v = I.unit_vectors(spark.createDataFrame(clustered(random.Random(7)), VECTORS))
    unit = {r.chunk_id: np.array(r.embedding) for r in v.where("tenant = 'b'").collect()}
    q = v.where("chunk_id < 12").select(F.col("chunk_id").alias("query_id"), "embedding")
    asked = {r.query_id: np.array(r.embedding) for r in q.collect()}
    cells = C.build(v, "chunk_id", cells=16)
    got = {(r.query_id, r.rank): r.chunk_id for r in C.top_k(q, cells, 7, keep=F.col("tenant") == "b").collect()}
    assert got == plain(unit, asked, 7)
    assert C.top_k(q, cells, 3, keep=F.lit(False)).count() == 0


def test_few_vectors_and_none(spark):
    v = I.unit_vectors(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [2.0, 1.0], "a")], VECTORS))
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding")
    assert {(r.query_id, r.rank): r.chunk_id for r in C.top_k(q, C.build(v, "chunk_id"), 9).collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 2, (2, 2): 1}
    assert C.top_k(q, C.build(v.limit(0), "chunk_id"), 9).count() == 0 and C.top_k(q.limit(0), C.build(v, "chunk_id"), 9).count() == 0
