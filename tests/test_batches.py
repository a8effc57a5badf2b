"""What goes to tasks in Arrow, pools that questions share, and arms of an ablation side by side."""

import threading

from pyspark.sql import functions as F

from corpuscle.operators import blockmax as B
from corpuscle.operators import index as I
from corpuscle.plans import retrieve as P

TEXTS = [(f"c{i:03d}", f"word{i % 7} other{i % 5} same {'x' * (i % 3 + 1)}" if i % 11 else "") for i in range(60)]


def test_no_null_list_goes_to_the_tasks(spark, monkeypatch):
    texts = spark.createDataFrame(TEXTS, "chunk_id string, text string")
    shards, made = B.shards(texts, 4), B._known

    def strict(rows, idfs, k1, b, avg):
        lists = [rows.column(c).null_count for c in ("nos", "tfs", "lens", "most")]
        if any(lists):
            raise ValueError(f"null lists: {lists}")
        return made(rows, idfs, k1, b, avg)

    monkeypatch.setattr(B, "_known", strict)
    stats = texts.agg(F.count("*").alias("n"), F.lit(4.0).alias("avg_len"))
    known = B.shard_blocks(shards, I.vocabulary(B.shard_frequency(shards)), stats, 4).known.collect()
    assert known and all(max(r.most) >= 1 and len(r.norms) == B.SHARD for r in known)
    odd = spark.createDataFrame([(1, None, None), (2, [3], None), (None, [], ["a", None])], "k long, a array<int>, b array<string>")
    assert [tuple(r) for r in B.without_null_lists(odd).collect()] == [(1, [], []), (2, [3], []), (None, [], ["a", None])]


def test_questions_of_the_same_facets_share_a_pool(spark, monkeypatch):
    texts = spark.createDataFrame(TEXTS, "chunk_id string, text string")
    shards = B.shards(texts, 4)
    vocab = I.vocabulary(B.shard_frequency(shards))
    blocks = B.shard_blocks(shards, vocab, texts.agg(F.count("*").alias("n"), F.lit(4.0).alias("avg_len")), 4)
    no = B.about_texts(shards).select("chunk_id", "no")
    facet = (F.substring("chunk_id", 2, 3).cast("int") % 6).cast("long")
    facets = B.facet_shards(texts.select("chunk_id", facet.alias("facet")).where("facet <> 5"), no)
    sees = {f"q{n}": {(n % 2) * 2, (n % 2) * 2 + 1} for n in range(12)} | {"all": set(range(6)), "gone": {5}}
    pool = spark.createDataFrame([(q, f) for q, fs in sees.items() for f in fs], "query_id string, facet long")
    asked = spark.createDataFrame([(q, v, "same", 1.0) for q in [*sees, "none"] for v in (0, 1)], "query_id string, variant int, term string, weight double")
    kept, write = [], B.written
    monkeypatch.setattr(B, "written", lambda df, name, *a, **k: kept.append((name, out := write(df, name, *a, **k))) or out)
    got = {(r.query_id, r.chunk_id) for r in B.top_k(asked, blocks, no, "bm25", 100, pool=pool, facets=facets).collect()}
    assert got == {(q, c) for q, fs in sees.items() for i, (c, t) in enumerate(TEXTS) if t and i % 6 in fs and i % 6 != 5}
    assert dict(kept)["pools"].count() == 4


def test_arms_run_side_by_side(spark, monkeypatch):
    plans = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    gold = spark.createDataFrame([("q1", "d1"), ("q1", "d2")], "query_id string, document_id string")
    meet, arms = threading.Barrier(2, timeout=60), {"first": {}, "second": {"fusion": "rrf"}, "third": {"use_rerank": False}}

    def found(plans, variants, index, flags, scored=None, shared=None):
        if flags != P.Flags():
            meet.wait()
        return spark.createDataFrame([("q1", "d1")] + [("q1", "d2")] * (flags.fusion == "rrf"), "query_id string, document_id string")

    monkeypatch.setattr(P, "retrieve", found)
    index = P.Index(*[None] * 6, blocks=plans, pools=P.Pools(None, None))
    rows = [tuple(r) for r in P.ablation(plans, plans, index, gold, arms).collect()]
    assert rows == [("first", 2, 0.5, 1), ("second", 2, 1.0, 1), ("third", 2, 0.5, 1)]
