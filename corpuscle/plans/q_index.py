"""Queries: index tables, channel scores and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import vocab as V
from corpuscle.operators import blockmax as B
from corpuscle.operators import cells as CE
from corpuscle.operators import index as I
from corpuscle.operators import scoring as S
from corpuscle.plans import corpus as K
from corpuscle.plans import oracle as O
from corpuscle.plans.registry import query

INTENT_SQL = "SELECT query_id, " + O.case("(substr(query_id, 3)::BIGINT % 5)::VARCHAR", dict(enumerate(K.INTENTS))) + " AS intent FROM qs"


def terms(spark, d):
    return S.query_terms(K.questions(spark, d).withColumn("variant", F.lit(0)))


def bm25_scores(spark, d):
    return S.bm25(terms(spark, d), K.postings(spark, d), K.stats(spark, d), source=K.questions(spark, d), df=K.vocabulary(spark, d))


def cosine_scores(spark, d):
    return S.cosine(terms(spark, d), K.weights(spark, d), K.vocabulary(spark, d), K.stats(spark, d), source=K.questions(spark, d))


def channel_top(spark, d, name):
    """The best chunks of a channel, from the posting blocks."""
    t, st, v = terms(spark, d), K.stats(spark, d), K.vocabulary(spark, d)
    asked = S.bm25_weights(t, v, st) if name == "bm25" else S.cosine_weights(t, v, st)
    return B.top_k(asked, K.blocks(spark, d), K.numbers(spark, d), name, S.CHANNEL_POOL, source=K.questions(spark, d))


class Channels:
    """Channel cuts by name, each written when it is first asked for."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def __getitem__(self, name):
        return K.once(self.spark, self.d, f"channel_{name}", lambda: channel_top(self.spark, self.d, name))


def channels(spark, d):
    return Channels(spark, d)


def intents(spark, d):
    n = F.substring("query_id", 3, 20).cast("bigint")
    return K.questions(spark, d).select("query_id", F.element_at(F.array(*[F.lit(i) for i in K.INTENTS]), (n % 5 + 1).cast("int")).alias("intent"))


@query("IDX-01 IDX-04", O.sql("SELECT chunk_id, len, term, tf FROM posts"))
def postings(spark, d):
    return I.postings(I.tokenized(I.indexed_text(K.chunks(spark, d)))).select("chunk_id", "len", "term", "tf")


@query("IDX-04", O.sql("SELECT n, round(avg_len, 6) AS avg_len FROM cstats"))
def corpus_stats(spark, d):
    return K.stats(spark, d).select("n", F.round("avg_len", 6).alias("avg_len"))


@query("IDX-02", O.sql("SELECT term, df FROM vocab"))
def vocabulary(spark, d):
    return I.vocabulary(I.document_frequency(K.postings(spark, d)))


@query("IDX-03", O.sql("SELECT chunk_id, term, round(w, 6) AS w FROM weights"))
def tfidf_weights(spark, d):
    w = I.tfidf_weights(K.postings(spark, d), K.vocabulary(spark, d), K.stats(spark, d))
    return w.select("chunk_id", "term", F.round("w", 6).alias("w"))


@query("IDX-05", O.sql("SELECT DISTINCT lower(ident) AS ident, chunk_id FROM (SELECT chunk_id, unnest(list_concat(list_concat(requirement_ids, api_names), ecu_parameters)) AS ident FROM chunks)"))
def exact_id_index(spark, d):
    return I.exact_ids(K.chunks(spark, d))


@query("IDX-06", """
SELECT vec_id, round(x[1] / n, 6) AS first, round(list_sum(list_transform(x, lambda v: v / n * v / n)), 6) AS norm
FROM (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings))""")
def unit_vectors(spark, d):
    u = I.unit_vectors(K.vectors(spark, d))
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return u.select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(sq, 6).alias("norm"))


@query("RET-01 RET-04 RET-05", O.sql("SELECT query_id, chunk_id, score, rank FROM bm25_ch"))
def bm25_top(spark, d):
    return channel_top(spark, d, "bm25").select("query_id", "chunk_id", "score", "rank")


@query("RET-02 RET-05", O.sql("SELECT query_id, chunk_id, score, rank FROM cos_ch"))
def cosine_top(spark, d):
    return channel_top(spark, d, "dense").select("query_id", "chunk_id", "score", "rank")


_VEC = "list_transform(embedding, lambda v: v::DOUBLE)"


VECTOR_SQL = f"""
SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) AS score
  FROM (SELECT vec_id, {_VEC} AS e FROM embeddings WHERE label = 0) q, (SELECT vec_id, {_VEC} AS e FROM embeddings) v)) WHERE rank <= 10"""


@query("RET-03 RET-05", VECTOR_SQL)
def vector_top(spark, d):
    u = I.unit_vectors(K.vectors(spark, d))
    q = u.where("label = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.vector_top_k(q, u.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)


@query("RET-03 RET-05", VECTOR_SQL)
def vector_cells_top(spark, d):
    """The same search over cells that a question visits by their bounds."""
    u = I.unit_vectors(K.vectors(spark, d)).withColumnRenamed("vec_id", "chunk_id")
    cells = K.once_made(spark, d, "cells", lambda: CE.build(u, "chunk_id"))
    q = u.where("label = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return CE.top_k(q, cells, 10)


@query("RET-06", O.sql("""
SELECT query_id, chunk_id, round((score - lo) / CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE hi - lo END, 6) AS score FROM (
  SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm25_ch)"""))
def min_max_scores(spark, d):
    return S.min_max(channels(spark, d)["bm25"]).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("RET-07", O.sql("""
SELECT query_id, chunk_id, round((s - lo) / CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE hi - lo END, 6) AS score FROM (
  SELECT *, min(s) OVER (PARTITION BY query_id) AS lo, max(s) OVER (PARTITION BY query_id) AS hi FROM (
    SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM (
      SELECT query_id, chunk_id, rank FROM bm25_ch UNION ALL SELECT query_id, chunk_id, rank FROM cos_ch) GROUP BY query_id, chunk_id))"""))
def reciprocal_rank_fusion(spark, d):
    ch = channels(spark, d)
    return S.rrf([ch["bm25"], ch["dense"]]).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _norm(view: str) -> str:
    return f"""SELECT query_id, chunk_id, (score - min(score) OVER q) / CASE WHEN max(score) OVER q = min(score) OVER q THEN 1.0::DOUBLE
      ELSE max(score) OVER q - min(score) OVER q END AS s FROM {view} WINDOW q AS (PARTITION BY query_id)"""


def _weight(table: dict, i: int) -> str:
    return "(" + O.case("intent", {k: str(v[i]) for k, v in table.items()}) + ")::DOUBLE"


FUSED_VIEWS = {
    "intents": INTENT_SQL,
    "nb": _norm("bm25_ch"),
    "nd": _norm("cos_ch"),
    "fused": f"""
SELECT query_id, chunk_id, {_weight(V.FUSION_WEIGHTS, 0)} * coalesce(b.s, 0) + {_weight(V.FUSION_WEIGHTS, 1)} * coalesce(e.s, 0) AS score
FROM nb b FULL JOIN nd e USING (query_id, chunk_id) JOIN intents USING (query_id)""",
}


def fused(spark, d):
    ch = channels(spark, d)
    return S.weighted_fusion({"bm25": ch["bm25"], "dense": ch["dense"]}, intents(spark, d))


@query("RET-08", O.sql("SELECT query_id, chunk_id, round(score, 6) AS score FROM fused", **FUSED_VIEWS))
def weighted_fusion(spark, d):
    return fused(spark, d).withColumn("score", F.round("score", 6))


@query("RET-09", O.sql(f"""
SELECT query_id, chunk_id, round({_weight(V.MODALITY_WEIGHTS, 0)} * coalesce(max(b), 0) + {_weight(V.MODALITY_WEIGHTS, 1)} * coalesce(max(e), 0)
   + {_weight(V.MODALITY_WEIGHTS, 2)} * coalesce(max(g), 0) + {_weight(V.MODALITY_WEIGHTS, 3)} * coalesce(max(m), 0), 6) AS score
FROM (SELECT query_id, chunk_id, s AS b, NULL::DOUBLE AS e, NULL::DOUBLE AS g, NULL::DOUBLE AS m FROM nb
  UNION ALL SELECT query_id, chunk_id, NULL, s, NULL, NULL FROM nd
  UNION ALL SELECT query_id, chunk_id, NULL, NULL, s, NULL FROM ng
  UNION ALL SELECT query_id, chunk_id, NULL, NULL, NULL, s FROM nm) JOIN intents USING (query_id)
GROUP BY query_id, chunk_id, intent""", **FUSED_VIEWS,
    graphc="SELECT query_id, chunk_id, score FROM bm25_ch WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE len(requirement_ids) > 0)",
    modc="SELECT query_id, chunk_id, score FROM cos_ch WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_kind = 'context')",
    ng=_norm("graphc"), nm=_norm("modc")))
def modality_fusion(spark, d):
    ch, c = channels(spark, d), K.chunks(spark, d)
    four = {
        "lexical": ch["bm25"], "dense": ch["dense"],
        "graph": ch["bm25"].join(c.where(F.size("requirement_ids") > 0).select("chunk_id"), "chunk_id", "left_semi"),
        "modality": ch["dense"].join(c.where("chunk_kind = 'context'").select("chunk_id"), "chunk_id", "left_semi"),
    }
    return S.weighted_fusion(four, intents(spark, d), V.MODALITY_WEIGHTS).withColumn("score", F.round("score", 6))
