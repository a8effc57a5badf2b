"""Top-k over posting blocks against full sums."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import blockmax as B


def made(rng, chunks, terms):
    """(chunk, term, impact) with frequent terms of low impact and rare ones of high impact."""
    rows = []
    for t in range(terms):
        share = 0.9 / (t + 1)
        rows += [(f"c{c:05d}", f"t{t}", round(rng.uniform(0.2, 1.0), 3)) for c in range(chunks) if rng.random() < share]
    return rows


def plain(rows, asked, k, seen=None):
    by = defaultdict(list)
    for c, t, i in rows:
        by[t].append((c, i))
    out = {}
    sums = defaultdict(lambda: defaultdict(float))
    for q, v, t, w in asked:
        for c, i in by.get(t, []):
            if seen is None or c in seen[q]:
                sums[(q, v)][c] += w * i
    best = defaultdict(dict)
    for (q, _), s in sums.items():
        for c, x in s.items():
            best[q][c] = max(best[q].get(c, 0), round(x, 6))
    for q, s in best.items():
        for n, (c, x) in enumerate(sorted(s.items(), key=lambda e: (-e[1], e[0]))[:k]):
            out[(q, n + 1)] = c, x
    return out


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(6)
    rows = made(rng, 1500, 40) + [("c00007", "only", 1.0), ("c00008", "only", 1.0)]
    kept = B.SHARD
    B.SHARD = 256  # several shards
    df = spark.createDataFrame(rows, "chunk_id string, term string, bm25 double")
    no = B.numbers(df)
    yield rows, no, B.blocks(df, no, ["bm25"], df.limit(0)), df
    B.SHARD = kept


def questions(rng, n=12):
    out = []
    for q in range(n):
        for v in range(1 + q % 2):
            out += [(f"q{q}", v, f"t{t}", round(rng.uniform(0.5, 2) * (1 + t), 3)) for t in rng.sample(range(40), rng.randrange(1, 15))]
    return out + [("qx", 0, "only", 1.0), ("qy", 0, "absent", 1.0)]


def test_rows_equal_full_sums(spark, index):
    rows, no, blocks, _ = index
    asked = questions(random.Random(1))
    df = spark.createDataFrame(asked, "query_id string, variant int, term string, weight double")
    for k in (1, 10, 100):
        got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in B.top_k(df, blocks, no, "bm25", k, source=df.limit(0)).collect()}
        want = plain(rows, asked, k)
        assert {x: c for x, (c, _) in got.items()} == {x: c for x, (c, _) in want.items()}
        assert all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    assert B.top_k(df.limit(0), blocks, no, "bm25", 5).count() == 0


def test_a_question_sees_its_pool_only(spark, index):
    rows, no, blocks, df = index
    asked = questions(random.Random(2))
    facet = (F.substring("chunk_id", 2, 5).cast("int") % 7).cast("long")
    shards = B.facet_shards(df.select("chunk_id", facet.alias("facet")).distinct(), no)
    allowed = {q: {n % 7, (n + 3) % 7} for n, q in enumerate(sorted({a[0] for a in asked}))}
    pool = spark.createDataFrame([(q, f) for q, fs in allowed.items() for f in fs if q != "q3"], "query_id string, facet long")
    ask = spark.createDataFrame(asked, "query_id string, variant int, term string, weight double")
    got = {(r.query_id, r.rank): r.chunk_id for r in B.top_k(ask, blocks, no, "bm25", 20, pool=pool, facets=shards).collect()}
    seen = {q: {c for c, _, _ in rows if int(c[1:]) % 7 in fs and q != "q3"} for q, fs in allowed.items()}
    assert got == {x: c for x, (c, _) in plain(rows, asked, 20, seen).items()} and not any(q == "q3" for q, _ in got)


def test_frequent_terms_are_read_in_few_blocks(monkeypatch):
    monkeypatch.setattr(B, "SHARD", 1 << 13)
    rng = np.random.default_rng(3)
    every = np.arange(B.SHARD, dtype=np.int32)

    def one(weight, nos):
        impacts = rng.uniform(0.5, 1.0, len(nos))
        return weight, nos, impacts, np.maximum.reduceat(impacts, np.arange(0, len(nos), B.BLOCK))

    rare = [one(9.0, np.sort(rng.choice(every, 60, replace=False)).astype(np.int32)) for _ in range(4)]
    common = [one(0.05, every) for _ in range(8)]
    at, scores, read = B.best_in_shard(rare + common, 3)
    total = np.zeros(B.SHARD)
    for w, nos, impacts, _ in rare + common:
        total[nos] += w * impacts
    want = np.argsort(-total, kind="stable")[:3]
    assert set(want) <= set(at.tolist()) and np.allclose(scores, total[at])
    blocks = sum(len(tops) for *_, tops in common)
    assert read < blocks / 4


def test_terms_reach_the_scan_and_shards_need_no_exchange(spark, index):
    _, no, blocks, _ = index
    df = spark.createDataFrame([("q", 0, "t3", 1.0), ("q", 0, "only", 2.0)], "query_id string, variant int, term string, weight double")
    plan = B.top_k(df, blocks, no, "bm25", 5, source=df.limit(0))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "blocks_" in line)
    assert "In(term" in scan and "Bucketed: true" in scan
    assert "Exchange hashpartitioning(shard" not in plan
