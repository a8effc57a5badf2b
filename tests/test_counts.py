"""Term lists, posting blocks made from counts, shared channel cuts and quick text tests."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators import blockmax as B
from corpuscle.operators import index as I
from corpuscle.operators import scoring as S
from corpuscle.plans import corpus as K
from corpuscle.plans import retrieve as P

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "a", "plain words  here\tand\t\tthere \n\n\n\nnext", "AUTOSAR  Release 4\nPage 3 of 9\nkept line", "x\x85y\u2028z\r\nq\rw\x0bv",
    "1.2 Heading of it\nSWS_Com_00001 RS_x [constr_1-2] [SRS_a]", "Com_Init ComCfg MyConfigSet Xcfg fooConfig _a Ab_Cd", "\u3000wide\u00a0blank\u2003\u00e9t\u00e9 ",
    "CamelCase-x.y_Z HTTPServer a.b.c A 1 AB9 a-b", "Document ID 7 " + "long " * 40, None, "para one\n \t\npara two\n\n\npara three",
]


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_quick_text_tests_change_nothing(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "t string")
    c = F.col("t")
    lines = F.filter(F.split(c, V.LINE_BREAK), lambda s: (T.strip(s) != "") & ~(T.strip(s).rlike(V.FURNITURE) & (F.length(T.strip(s)) < 120)))
    page = T.strip(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))
    paras = F.filter(F.transform(F.split(c, r"\n" + V.WS + r"*\n"), T.strip), lambda p: p != "")
    pairs = F.zip_with(T.found(c, V.HEADING, 1), T.found(c, V.HEADING, 2), lambda n, t: F.struct(n.alias("number"), T.strip(t).alias("title")))
    want = {
        "page": (T.normalize_page(c), page), "words": (T.words(c), F.filter(F.split(c, V.WS + "+"), lambda w: w != "")),
        "flat": (T.collapse(c), T.strip(F.regexp_replace(c, V.WS + "+", " "))), "paras": (T.paragraphs(c), paras), "heads": (T.headings(c), pairs),
        "reqs": (T.requirement_ids(c), T.distinct_sorted(F.concat(T.found(c, V.REQ_A, 1), T.found(c, V.REQ_B, 1)))),
        "apis": (T.api_names(c), T.distinct_sorted(T.found(c, V.API_SIG, 1))), "ecu": (T.ecu_parameters(c), T.distinct_sorted(T.found(c, V.ECUC, 1))),
    }
    for name, (new, old) in want.items():
        assert [r[0] for r in df.select(new).collect()] == [r[0] for r in df.select(old).collect()], name
    plan = df.select(T.requirement_ids(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan  # texts that can't match are not searched


def test_term_lists_hold_the_postings(spark):
    df = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(ODD)], "chunk_id string, text string").fillna("", ["text"])
    lists = I.term_lists(df, parts=3)
    cols = ("chunk_id", "len", "term", "tf")
    assert rows(I.postings_of(lists), *cols) == rows(I.postings(I.tokenized(df)), *cols)
    assert lists.count() == len(ODD) and rows(lists, "chunk_id", "len") == rows(I.token_counts(df), "chunk_id", "len")


def test_repeated_documents_count_as_before(spark, tmp_path):
    line = "SWS_Com_00001 the Com module sends signals over the bus to each receiver "
    docs = [(i, "\n".join([line * 3 + str(i), "?" * 60, line + "again"]), "en", "src1") for i in (1, 2, 2, 3)] + [(3, line * 2 + "other", "en", "src1"), (4, None, "de", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = K.chunks(spark, str(tmp_path))
    tokens = I.tokenized(I.indexed_text(c))
    cols = ("chunk_id", "len", "term", "tf")
    assert rows(K.postings(spark, str(tmp_path)), *cols) == rows(I.postings(tokens), *cols)
    assert K.stats(spark, str(tmp_path)).first().n == c.count() == K.lengths(spark, str(tmp_path)).count()


def test_blocks_of_counts_rank_like_full_sums(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD", 64)  # several shards
    texts = spark.createDataFrame([(f"c{i:04d}", " ".join(f"w{(i * k) % (5 + k)} word{i % 7}" for k in range(1, 4 + i % 9))) for i in range(300)] + [("c9999", "")], "chunk_id string, text string")
    lists = I.written(I.term_lists(texts, parts=4), "lists", "chunk_id", 4, already_placed=True)
    posts = I.postings_of(lists)
    vocab, stats = I.document_frequency(posts), lists.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    terms = S.query_terms(spark.createDataFrame([("q1", 0, "w1 word3 w4"), ("q1", 1, "word2"), ("q2", 0, "w0 w2 absent"), ("q3", 0, "nothing")], "query_id string, variant int, text string"))
    no = B.numbers(lists)
    for limit in (1 << 30, 0):  # with the vocabulary broadcast, and met by term
        monkeypatch.setattr(I, "BROADCAST_BYTES", limit)
        blocks = B.term_blocks(lists, no, vocab, stats)
        assert not {"bm25", "dense"} & set(blocks.columns)  # counts, not two numbers for each posting
        full = {"bm25": S.bm25(terms, posts, stats, df=vocab), "dense": S.cosine(terms, I.tfidf_weights(posts, vocab, stats), vocab, stats)}
        asked = {"bm25": S.bm25_weights(terms, vocab, stats), "dense": S.cosine_weights(terms, vocab, stats)}
        for name in full:
            got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in B.top_k(asked[name], blocks, no, name, 20).collect()}
            want = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in S.channel(full[name], 20).collect()}
            assert {x: c for x, (c, _) in got.items()} == {x: c for x, (c, _) in want.items()} and want
            assert all(abs(got[x][1] - want[x][1]) < 2e-6 for x in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_ablation_arms_share_their_channels(spark, monkeypatch):
    from corpuscle.plans import q_retrieval as Q

    plans = K.plans(spark, SF).limit(8)
    plans = I.written(plans, "plans")
    variants = plans.select("query_id", F.lit(0).alias("variant"), "text")
    arms = {"A": {"corrective_loop": False}, "B": {"corrective_loop": False, "use_rerank": False}, "C": {"corrective_loop": False, "use_bm25": False}}
    index, calls, plain = Q.index(spark, SF), [], B.top_k
    monkeypatch.setattr(P.B, "top_k", lambda *a, **b: calls.append(a) or plain(*a, **b))
    got = rows(P.ablation(plans, variants, index, K.gold(spark, SF), arms), "*")
    assert len(calls) == 2
    assert got == rows(P.ablation(plans, variants, replace(index, blocks=None), K.gold(spark, SF), arms), "*") and len(got) == 3


def test_shards_are_made_where_the_texts_lie(spark, monkeypatch):
    monkeypatch.setattr(B, "SHARD", 16)  # several shards a task
    made = [(f"c{(i * 37) % 100:04d}", " ".join(f"w{(i * k) % (5 + k)} word{i % 7}" for k in range(1, 4 + i % 9))) for i in range(100)]
    made += [("c9999", "")] + [(f"e{i % 30}", "w1 word3 w4 equal") for i in range(30)]  # ties are decided by the ids
    terms = S.query_terms(spark.createDataFrame([("q1", 0, "w1 word3 w4"), ("q1", 1, "word2"), ("q2", 0, "w0 w2 absent"), ("q3", 0, "nothing"), ("q4", 0, "equal")], "query_id string, variant int, text string"))
    for more in ([], made[:40] + [("e3", "w1 word3 w4 equal")] * 50):  # with ids that are repeated, too
        texts = I.written(spark.createDataFrame(made + more, "chunk_id string, text string").repartition(3), "texts")
        shards = B.shards(texts, 4)
        posts, lens = I.postings(I.tokenized(texts)), I.token_counts(texts)
        about = B.about_texts(shards)
        assert rows(about, "chunk_id", "len", "copies") == rows(lens.groupBy("chunk_id", "len").agg(F.count("*").alias("copies")), "chunk_id", "len", "copies")
        assert about.select("no").distinct().count() == about.count()
        tf = shards.where("term IS NOT NULL").select("shard", "term", F.explode(F.arrays_zip("nos", "tfs")).alias("p"))
        tf = tf.select((F.col("shard") * B.SHARD + F.col("p.nos")).alias("no"), "term", F.col("p.tfs").alias("tf")).join(about, "no")
        assert rows(tf, "chunk_id", "len", "term", "tf") == rows(posts, "chunk_id", "len", "term", "tf")
        vocab, stats = B.shard_frequency(shards), lens.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        assert rows(vocab, "term", "df") == rows(I.document_frequency(posts), "term", "df")
        blocks = B.shard_blocks(shards, vocab, stats, 4)
        full = {"bm25": S.bm25(terms, posts, stats, df=vocab), "dense": S.cosine(terms, I.tfidf_weights(posts, vocab, stats), vocab, stats)}
        asked = {"bm25": S.bm25_weights(terms, vocab, stats), "dense": S.cosine_weights(terms, vocab, stats)}
        for name in full:
            got = {(r.query_id, r.rank): r.chunk_id for r in B.top_k(asked[name], blocks, about, name, 20).collect()}
            assert got == {(r.query_id, r.rank): r.chunk_id for r in S.channel(full[name], 20).collect()} and got


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_retrieval_writes_no_lists_by_chunk(spark):
    from corpuscle.plans import q_index as Q
    from corpuscle.plans import q_retrieval as QR

    d = SF + "/"  # a path that no other test has built
    Q.channel_top(spark, d, "bm25").collect()
    QR.index(spark, d)
    assert not K.listed(spark, d)
