"""Inputs of the whole retrieval: allowed documents, raw questions, encoder failures, many questions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import index as I
from corpuscle.operators import scoring as S

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@here
def test_only_allowed_documents_are_returned(spark):
    from corpuscle.plans import corpus as K
    from corpuscle.plans import q_retrieval as Q
    from corpuscle.plans import retrieve as P

    plans = K.plans(spark, SF).limit(6)
    mine = K.documents(spark, SF).where("doc_id % 3 = 1").select("document_id")
    few = plans.select("query_id", F.lit(0).alias("variant"), "text")
    rows = P.retrieve(plans, few, Q.index(spark, SF), allowed=mine)
    assert rows.count() > 0 and rows.join(mine, "document_id", "left_anti").count() == 0
    assert P.retrieve(plans, few, Q.index(spark, SF), allowed=mine.limit(0)).count() == 0


def test_a_failing_text_does_not_blank_its_batch(spark):
    def encoder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return np.ones((len(texts), 4))

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, text string").coalesce(1)
    got = {r.id: (list(r.embedding), r.encode_failed) for r in I.encode_texts(rows, encoder, 4).collect()}
    assert got == {1: ([0.5] * 4, False), 2: ([0.0] * 4, True), 3: ([0.5] * 4, False)}


def test_vector_search_in_parts_and_blocks_is_exact(spark, tmp_path):
    rng = random.Random(4)
    vec = {i: [rng.uniform(-1, 1) for _ in range(6)] for i in range(90)}
    v = I.unit_vectors(spark.createDataFrame(list(vec.items()), "chunk_id int, embedding array<double>"))
    unit = {r.chunk_id: r.embedding for r in v.collect()}
    v.write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    q = v.select(F.concat(F.lit("q"), F.col("chunk_id").cast("string")).alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.chunk_id for r in S.vector_top_k(q, v, 4, max_queries=1, part_bytes=256).collect()}
    for i in unit:
        order = sorted(unit, key=lambda j: (-round(sum(a * b for a, b in zip(unit[i], unit[j])), 6), j))[:4]
        assert [got[(f"q{i}", n)] for n in (1, 2, 3, 4)] == order
