"""Channel scores and fusion, for a batch of questions at once.

Scores are compared at six decimals: a sum's order then cannot change a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpuscle.functions import text as T
from corpuscle.functions import vocab as V
from corpuscle.operators import index as I

CHANNEL_POOL = 100
RRF_K = 60


def query_terms(variants: DataFrame) -> DataFrame:
    """(query_id, variant, term, tf, max_tf) of a table (query_id, variant, text)."""
    toks = variants.select("query_id", "variant", F.explode(T.technical_tokens(F.col("text"))).alias("term"))
    counted = toks.groupBy("query_id", "variant", "term").agg(F.count("*").alias("tf"))
    return counted.withColumn("max_tf", F.max("tf").over(W.partitionBy("query_id", "variant")))


def six(c: Column) -> Column:
    return F.round(c, 6)


def bm25_weights(terms: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, variant, term, weight): the rarity of each term of a question."""
    n = stats.select("n").scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return terms.select("query_id", "variant", "term").join(df, "term").select("query_id", "variant", "term", idf.alias("weight"))


def bm25_impact(stats: DataFrame, k1: float = 1.5, b: float = 0.75) -> Column:
    """What a posting (tf, len) adds to a score for a term of weight one."""
    tf = F.col("tf")
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / stats.select("avg_len").scalar()))


def bm25(terms: DataFrame, posts: DataFrame, stats: DataFrame, source: DataFrame | None = None,
         k1: float = 1.5, b: float = 0.75, df: DataFrame | None = None) -> DataFrame:
    """(query_id, variant, chunk_id, score) over the distinct terms of each question.

    ``df`` (term, df) is the stored document frequency of all terms; without it the frequencies of the
    questions' terms are counted, which reads the postings once more.  While the question table is small it is
    broadcast, and the sum per chunk needs no exchange; beyond that both sides meet by term.
    """
    if df is None:
        df = I.document_frequency(posts, I.broadcast_if_small(terms.select("term").distinct(), source))
    weighted = I.broadcast_if_small(bm25_weights(terms, df, stats), source)
    part = F.col("weight") * bm25_impact(stats, k1, b)
    return (
        posts.join(weighted, "term")
        .groupBy("chunk_id", "query_id", "variant")
        .agg(six(F.sum(part)).alias("score"))
    )


def cosine_weights(terms: DataFrame, vocab: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, variant, term, weight): the unit TF-IDF row of each question."""
    n = stats.select("n").scalar()
    key = W.partitionBy("query_id", "variant")
    return (
        terms.join(vocab, "term")
        .withColumn("raw", (0.5 + 0.5 * F.col("tf") / F.col("max_tf")) * (F.log((n + 1) / (F.col("df") + 1)) + 1))
        .withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(key)))
        .select("query_id", "variant", "term", (F.col("raw") / F.col("norm")).alias("weight"))
    )


def cosine(terms: DataFrame, weights: DataFrame, vocab: DataFrame, stats: DataFrame,
           source: DataFrame | None = None) -> DataFrame:
    """(query_id, variant, chunk_id, score): sparse dot product of unit TF-IDF rows."""
    return (
        weights.join(I.broadcast_if_small(cosine_weights(terms, vocab, stats), source), "term")
        .groupBy("chunk_id", "query_id", "variant")
        .agg(six(F.sum(F.col("weight") * F.col("w"))).alias("score"))
    )


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "chunk_id",
                 col: str = "embedding", max_queries: int = 4096, part_bytes: int = 64 << 20) -> DataFrame:
    """Exact top-k of unit vectors by dot product: (query_key, key, score, rank).

    Vectors are dealt to parts by their size, questions to blocks, and a part meets each block by key in
    one task: a matrix product that keeps the best k rows of each question.  Nothing is collected or
    counted in the driver, the vectors are read once, and no pair list is built.
    """
    # Sizes are those of the files read; a source without files counts as one block.
    v_bytes, q_bytes = (b if b < 1 << 56 else 1 for b in (I.source_bytes(vectors), I.source_bytes(queries)))
    parts = max(-(-v_bytes // part_bytes), vectors.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, -(-q_bytes // (max_queries * 1024)))
    q_type, v_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, query_key), (vectors, key)))
    left = vectors.select(key, col, F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    right = queries.select(
        query_key, F.col(col).alias("_q"), F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("_part"))

    def best(v, q):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        def matrix(column):
            flat = column.combine_chunks()
            return flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)

        names, ids = v.column(key).combine_chunks(), q.column(query_key).combine_chunks()
        if not len(names) or not len(ids):
            return pa.table({query_key: ids[:0], key: names[:0], "score": pa.array([], pa.float64())})
        by_name = pa.compute.sort_indices(names)
        m, names = matrix(v.column(col))[by_name.to_numpy()], names.take(by_name)
        rows, cols, scores = [], [], []
        asked = matrix(q.column("_q"))
        for a in range(0, len(asked), 256):  # bounds the score matrix
            s = np.round(asked[a : a + 256] @ m.T, 6)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(a, a + len(s)), top.shape[1]))
            cols.append(top.ravel())
            scores.append(np.take_along_axis(s, top, 1).ravel())
        return pa.table({query_key: ids.take(pa.array(np.concatenate(rows))), key: names.take(pa.array(np.concatenate(cols))), "score": pa.array(np.concatenate(scores))})

    found = left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(best, f"{query_key} {q_type}, {key} {v_type}, score double")
    return top_k(found, k, query_key, key)


def top_k(scores: DataFrame, k: int, query_key: str = "query_id", key: str = "chunk_id", score: str = "score") -> DataFrame:
    """Best k rows per question, ties by id; Spark limits each task before the exchange."""
    w = W.partitionBy(query_key).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def comb_max(scores: DataFrame) -> DataFrame:
    """Best score of a chunk over the variants of a question."""
    return scores.groupBy("chunk_id", "query_id").agg(F.max("score").alias("score"))


def channel(scores: DataFrame, pool: int = CHANNEL_POOL) -> DataFrame:
    return top_k(comb_max(scores), pool)


def min_max(scores: DataFrame, score: str = "score") -> DataFrame:
    """Scores of each question scaled to [0, 1]; a flat list becomes zeros."""
    w = W.partitionBy("query_id")
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        score, (F.col(score) - F.col("_lo")) / F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    ).drop("_lo", "_hi")


def rrf(ranked: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of channels carrying ``rank``, scaled to [0, 1]."""
    parts = [r.select("query_id", "chunk_id", (1.0 / (k + F.col("rank"))).alias("p")) for r in ranked]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return min_max(every.groupBy("query_id", "chunk_id").agg(F.sum("p").alias("score")))


def weighted_fusion(channels: dict[str, DataFrame], intents: DataFrame, weights: dict | None = None) -> DataFrame:
    """Min-max scaled channels, weighted by the question's intent; a missing side counts zero.

    ``intents`` is (query_id, intent).  ``weights`` maps an intent to one weight per channel, in the
    order of ``channels``.
    """
    weights = weights or V.FUSION_WEIGHTS
    names = list(channels)
    parts = None
    for name in names:
        p = min_max(channels[name]).select("query_id", "chunk_id", F.lit(name).alias("channel"), "score")
        parts = p if parts is None else parts.unionByName(p)

    def weight(name: str) -> Column:
        i = names.index(name)
        table = T.string_map({intent: float(w[i]) for intent, w in weights.items()})
        return F.coalesce(F.try_element_at(table, F.col("intent")), F.lit(float(weights["unknown"][i])))

    per = [F.max(F.when(F.col("channel") == n, F.col("score"))) for n in names]
    wide = parts.groupBy("query_id", "chunk_id").agg(*[F.coalesce(c, F.lit(0.0)).alias(f"_s{i}") for i, c in enumerate(per)])
    total = None
    for i, n in enumerate(names):
        term = weight(n) * F.col(f"_s{i}")
        total = term if total is None else total + term
    return wide.join(intents, "query_id").select("query_id", "chunk_id", total.alias("score"))
