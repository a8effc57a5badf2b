"""The index in segments equals a full rebuild after every change."""

from pyspark.sql import functions as F

from corpuscle.operators import index as I
from corpuscle.operators import segments as S

SCHEMA = "document_id string, chunk_id string, section_title string, normalized_text string, term string"


def equal(spark, path, chunks):
    tokens = I.tokenized(I.indexed_text(chunks.fillna("", ["normalized_text"])))
    posts = I.postings(tokens)
    cols = ["chunk_id", "term", "tf", "len"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.live(spark, path, "postings").select(cols)) == rows(posts.select(cols))
    assert rows(S.vocabulary(spark, path).select("term", "df")) == rows(I.document_frequency(posts).select("term", "df"))
    got, want = S.stats(spark, path).first(), I.corpus_stats(tokens).first()
    assert (got.n, round(got.avg_len or 0, 9)) == (want.n, round(want.avg_len or 0, 9))


def test_only_changed_segments_are_written(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(f"d{i % 20}", f"c{i}", "Head" if i % 3 else None, f"word{i % 7} common word{i % 5} text", "x") for i in range(120)] + [(None, "n1", None, None, "x")]
    first = spark.createDataFrame(rows, SCHEMA)
    assert len(S.refresh(first, path, segments=16)) == 16 and S.refresh(first, path) == []
    equal(spark, path, first)
    changed = first.where("document_id IS NULL OR document_id <> 'd3'").withColumn(
        "normalized_text", F.when(F.col("chunk_id") == "c5", F.lit("quite new words")).otherwise(F.col("normalized_text"))).unionByName(
        spark.createDataFrame([("fresh", "f1", "New", "common arrival", "x")], SCHEMA))
    of = {r.document_id: r.s for r in spark.createDataFrame([("d3",), ("d5",), ("fresh",)], "document_id string").select("document_id", F.pmod(F.xxhash64("document_id"), F.lit(16)).alias("s")).collect()}
    assert S.refresh(changed, path) == sorted(set(of.values()))
    equal(spark, path, changed)
    assert S.vacuum(spark, path) > 0 and S.vacuum(spark, path) == 0
    equal(spark, path, changed)
    plan = S.live(spark, path, "postings")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "generation" in plan.split("PartitionFilters")[1]
    S.refresh(first.limit(0), path)
    equal(spark, path, first.limit(0))


def test_saved_lengths_need_no_exchange(spark, tmp_path):
    rows = [("d", f"c{i}", "Head" if i % 3 else None, f"word{i % 7} commonWord text", "x") for i in range(50)] + [("d", "c1", None, "other", "x"), ("d", "e", None, "", "x"), ("d", "n", None, None, "x")]
    chunks = spark.createDataFrame(rows, SCHEMA)
    texts = I.indexed_text(chunks)
    assert "Exchange" not in I.token_counts(texts)._jdf.queryExecution().executedPlan().toString()
    I.save_index(chunks, str(tmp_path / "saved"))
    got, tokens = I.load_index(spark, str(tmp_path / "saved")), I.tokenized(texts)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(got["lengths"], "chunk_id", "len") == rows(tokens.select("chunk_id", F.size("tokens").alias("len")), "chunk_id", "len")
    cols = ["chunk_id", "term", "tf", "len"]
    assert rows(got["postings"], *cols) == rows(I.postings(tokens), *cols)
