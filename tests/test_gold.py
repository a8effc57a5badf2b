"""Gold documents of passages of any length against the SQL of the rule."""

import random

import duckdb
from pyspark.sql import functions as F

from corpuscle.operators import substrings as S
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O


def test_gold_holds_short_passages(spark, tmp_path):
    bodies = ["the left pump was set to low pressure by hand", "a pump", "Pumping water", "pump\twas  set", "", " ", None, "one two three four five six seven eight",
              "the left pump was set to low pressure by hand"]
    asked = ["pump", "ump wa", "the left pump was set to low pressure", "left pump was", "t pump was set t", "ump", "", " ", "\t", "pump\twas", "pump was  ", "nothing here", "pump", None,
             "two three four five six seven", "o three four five six seven eig", "e two th"]
    docs = spark.createDataFrame([(i, x, "en", "src1") for i, x in enumerate(bodies)] + [(1, "a pump", "en", "src1")], "doc_id long, text string, lang string, source string")
    docs.withColumn("n_chars", F.length("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(O.sql("SELECT query_id, document_id FROM golds")).fetchall()
    got = [tuple(r) for r in K.gold(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and ("q-1", "doc-0") in got and len({q for q, _ in got}) == 14


def test_passages_equal_a_plain_search(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("aab b c\n") for _ in range(rng.randrange(0, n)))
    bodies, asked = [text(60) for _ in range(120)], sorted({text(14) for _ in range(150)})
    docs = spark.createDataFrame([(i if i % 9 else None, b) for i, b in enumerate(bodies)], "id long, body string")
    got = [tuple(r) for r in S.passages_held(spark.createDataFrame([(x,) for x in asked], "text string"), docs, "id", "body").collect()]
    key = lambda r: (r[0], r[1] is None, r[1])
    assert sorted(got, key=lambda r: str(key(r))) == sorted([(a, i if i % 9 else None) for i, b in enumerate(bodies) for a in asked if a in b], key=lambda r: str(key(r)))
    none = docs.limit(0)
    assert S.passages_held(spark.createDataFrame([("a b c",)], "text string"), none, "id", "body").count() == 0
    assert S.passages_held(none.select(F.col("body").alias("text")), docs, "id", "body").count() == 0
